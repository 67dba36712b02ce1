"""The streaming ledger for rows that come out of order; travels by value as ``folds`` does."""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

from tillbook.functions import folds


class Reordering(StatefulProcessor):
    """``transformWithStateInPandas``: rows of a (product, variant) wait until the stream's time is ``delay`` ms past theirs.

    States: ``waiting`` (rows, packed by up to ``PACK``: a state entry each costs far more than its fold), ``stock`` (quantity, alert flag, last folded seq, time of the timer). One timer a key
    stands at the earliest time that a row falls due. When it fires, the rows up to the largest ``seq`` that is due are folded in
    order. A row whose ``seq`` isn't past the last folded one is told with ``late = 1`` and has no effect.
    """

    #: A row: (seq, op, n, opening, min_level, created_by, created_at, ms).
    ROW, PACK = "rows binary", 4096
    OUT = ("seq", "product_id", "variant_id", "op", "n", "q_before", "q_after", "q_change", "accepted", "created_by", "created_at",
           "min_level", "event", "late")

    def __init__(self, delay: int):
        self.delay = delay

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.ROW)
        self.stock = handle.getValueState("stock", "q long, active int, last long, due long")

    def handleInputRows(self, key, rows, timerValues):
        q, active, last, due = self._stock()
        come, late = [], []
        for pdf in rows:
            for r in zip(*(pdf[c].tolist() for c in ("seq", "op", "n", "opening", "min_level", "created_by", "created_at", "ms")), strict=True):
                row = tuple(None if v is None or v != v else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v if isinstance(v, str) else int(v)
                            for v in r)
                if row[0] <= last:
                    at = row[3] if q is None else q
                    late.append((row, at, at, 0, None, 1))
                else:
                    come.append(row)
        if come:
            self.waiting.appendList(self._packed(come))
            first = min(r[-1] for r in come) + self.delay
            if due is None or first < due:
                self._timer(due, first)
                self.stock.update((q, active, last, first))
        if late:
            yield self._told(key, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        q, active, last, _due = self._stock()
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(r for pack in self.waiting.get() for r in pickle.loads(bytes(pack[0])))
        upto = max((r[0] for r in rows if r[-1] + self.delay <= now), default=last)
        out = []
        for r in rows:
            seq, op, n, opening, low = r[:5]
            if seq > upto:
                continue
            before = opening if q is None else q
            if seq <= last:  # the same seq twice
                out.append((r, before, before, 0, None, 1))
                continue
            after, accepted = folds.apply_op(before, op, n)
            signal, event = folds._signal(op, accepted, after, low), None
            if signal == 1 and not active:
                event, active = "raise", 1
            elif signal == 0 and active:
                event, active = "resolve", 0
            out.append((r, before, after, accepted, event, 0))
            q, last = after, seq
        left = [r for r in rows if r[0] > upto]
        due = None
        if left:
            self.waiting.put(self._packed(left))
            due = max(min(r[-1] for r in left) + self.delay, now + 1)
            self._timer(None, due)
        else:
            self.waiting.clear()
        self.stock.update((q, active, last, due))
        if out:
            yield self._told(key, out)

    def close(self) -> None:
        pass

    def _packed(self, rows):
        return [(pickle.dumps(rows[i:i + self.PACK], protocol=4),) for i in range(0, len(rows), self.PACK)]

    def _stock(self):
        return self.stock.get() or (None, 0, -(1 << 62), None)

    def _timer(self, old, new) -> None:
        if old is not None:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(new)

    def _told(self, key, rows):
        product, variant = key
        # one block of objects: a column of nullable type each costs more than the fold of a key's rows
        return pd.DataFrame([(r[0], product, None if variant == -1 else variant, r[1], r[2], before, after, after - before, accepted, r[5], r[6],
                              r[4], event, late) for r, before, after, accepted, event, late in rows], columns=list(self.OUT), dtype=object)
