"""Pure-Python sequential folds run inside Spark tasks (``mapInPandas`` / state functions).

This module has no Spark imports and is registered with cloudpickle to travel *by
value*, so executors need no installed copy of the package.
"""

from __future__ import annotations

import numpy as np
import pandas as pd


def apply_op(q: int, op: str, n: int) -> tuple[int, int]:
    """One ledger step: (new quantity, accepted flag). ``q`` is None only before an adjustment."""
    if op == "adjustment":
        return n, 1
    if op == "in" or op == "return":
        return q + n, 1
    if op == "out":
        return (q - n if q > n else 0), 1
    if op == "sale":
        if q < n:
            return q, 0
        return q - n, 1
    raise ValueError(f"unknown op {op!r}")


PROBE, RESET = 1, 2  # roles of the two copies of an adjustment row


def fold_sorted_batches(batches):
    """Fold rows sorted by (product_id, _vk, seg, seq); the state crosses batch boundaries, so a task holds
    one Arrow batch and one quantity, however many rows a segment has.

    Segment 0 starts at the row's ``opening``. Where a key is cut into segments, each adjustment row comes twice: a *probe*
    copy closing the previous segment (its ``before`` is the quantity there, its
    ``after`` the set value) and a *reset* copy opening its own segment (sets the state,
    emits nothing) — so no segment needs another segment's result.
    """
    cur = None
    q = 0
    for pdf in batches:
        if pdf.empty:
            continue
        pid = pdf["product_id"].tolist()
        vk = pdf["_vk"].tolist()
        seg = pdf["seg"].tolist()
        op = pdf["op"].tolist()
        n = pdf["n"].tolist()
        role = pdf["_role"].tolist()
        opening = pdf["opening"].tolist()
        chunk = pdf["chunk"].tolist() if "chunk" in pdf else None  # given: opening is the quantity before the chunk
        m = len(pid)
        before = [0] * m
        after = [0] * m
        acc = [1] * m
        keep = [True] * m
        for i in range(m):
            key = (pid[i], vk[i], seg[i], chunk and chunk[i])
            if key != cur:
                cur = key
                q = int(opening[i]) if seg[i] == 0 or chunk else None
            if role[i] == RESET:
                q, keep[i] = int(n[i]), False
                continue
            before[i] = q
            if role[i] == PROBE:
                after[i] = int(n[i])
                continue
            q, acc[i] = apply_op(q, op[i], int(n[i]))
            after[i] = q
        out = pdf[["seq", "product_id", "variant_id", "_vk", "seg", "op", "n"]].copy()
        out["q_before"] = np.asarray(before, dtype=np.int64)
        out["q_after"] = np.asarray(after, dtype=np.int64)
        out["accepted"] = np.asarray(acc, dtype=np.int32)
        out["created_by"] = pdf["created_by"]
        out["created_at"] = pdf["created_at"]
        out["opening"] = pdf["opening"].astype(np.int64)
        yield out[np.asarray(keep)]


FAR = 1 << 60


def fold_chunks(batches):
    """What each chunk of ops does to the quantity before it; rows sorted by (product_id, _vk, seg, chunk, seq).

    Folded from ``start``. Yields a row per chunk: from any quantity in lo..hi all sales and floors turn out as they did from
    ``start``, and the quantity after is ``value`` (fixed = 1), or the quantity before plus ``value`` (fixed = 0).
    """
    cur, out = None, []

    def row():
        return (*cur, lo, hi, int(fixed), q if fixed else d)

    for pdf in batches:
        for *key, op, n, role, start in zip(*(pdf[c].tolist() for c in ("product_id", "_vk", "seg", "chunk", "op", "n", "_role", "start"))):
            if key != cur:
                if cur is not None:
                    out.append(row())
                cur, q, d, lo, hi, fixed = key, int(start), 0, 0, FAR, False
            n = int(n)
            if role == RESET:
                q, fixed = n, True
            elif role == PROBE:
                continue
            elif fixed:
                q, _ = apply_op(q, op, n)
            else:
                # the quantity is the one before the chunk plus d
                if op == "sale":
                    if q >= n:
                        lo = max(lo, n - d)
                    else:
                        hi = min(hi, n - d - 1)
                elif op == "out":
                    if q > n:
                        lo = max(lo, n - d + 1)
                    else:
                        hi, fixed = min(hi, n - d), True
                after, _ = apply_op(q, op, n)
                d += after - q
                q = after
        yield pd.DataFrame(out, columns=["product_id", "_vk", "seg", "chunk", "lo", "hi", "fixed", "value"]).astype("int64")
        out = []
    if cur is not None:
        yield pd.DataFrame([row()], columns=["product_id", "_vk", "seg", "chunk", "lo", "hi", "fixed", "value"]).astype("int64")


def chain_chunks(batches):
    """The quantity before each chunk, from the chunks before it; rows sorted by (product_id, _vk, seg, chunk).

    ``redo`` = 1 where it leaves the chunk's lo..hi: then what follows in the segment is a guess, until that chunk is folded again.
    """
    cur, q = None, 0
    for pdf in batches:
        starts, redo = [], []
        for *key, start, lo, hi, fixed, value in zip(*(pdf[c].tolist() for c in ("product_id", "_vk", "seg", "start", "lo", "hi", "fixed", "value"))):
            if key != cur:
                cur, q = key, start
            starts.append(q)
            redo.append(int(not lo <= q <= hi))
            q = value if fixed else max(0, q + value)
        out = pdf[["product_id", "_vk", "seg", "chunk"]].copy()
        out["start"], out["redo"] = np.asarray(starts, np.int64), np.asarray(redo, np.int64)
        yield out


def _signal(op: str, accepted: int, after: int, min_level) -> int | None:
    """Alert signal of one ledger row: 1 at/below minimum, 0 above (ops that may resolve), None = no effect."""
    if min_level is None or min_level != min_level:  # missing product
        return None
    low = after <= min_level
    if op in ("in", "out", "adjustment"):
        return 1 if low else 0
    if op == "sale" and accepted == 1 and low:
        return 1
    return None


def ledger_state_step(key, pdfs, state):
    """``applyInPandasWithState`` body: fold one key's rows of a micro-batch, in seq order.

    State: (quantity, alert_active, last_seq). Rows with ``seq <= last_seq`` arrive too
    late to be folded in order and are emitted with ``late = 1`` and no effect.
    """
    import warnings
    warnings.filterwarnings("ignore", category=FutureWarning, module="pyspark")
    if state.exists:
        q, active, last_seq = state.get
        q, active, last_seq = int(q), int(active), int(last_seq)
    else:
        q, active, last_seq = None, 0, -(1 << 62)
    pdf = pd.concat(list(pdfs), ignore_index=True).sort_values("seq", kind="stable")
    cols = {c: [] for c in ("seq", "product_id", "variant_id", "op", "n", "q_before", "q_after", "q_change",
                            "accepted", "created_by", "created_at", "min_level", "event", "late")}
    for r in pdf.itertuples(index=False):
        seq = int(r.seq)
        late = seq <= last_seq
        if q is None:
            q = int(r.opening)
        before = q
        if late:
            after, acc, event = q, 0, None
        else:
            after, acc = apply_op(q, r.op, int(r.n))
            sig = _signal(r.op, acc, after, None if pd.isna(r.min_level) else int(r.min_level))
            event = None
            if sig == 1 and not active:
                event, active = "raise", 1
            elif sig == 0 and active:
                event, active = "resolve", 0
            q, last_seq = after, seq
        for c, v in (("seq", seq), ("product_id", r.product_id), ("variant_id", r.variant_id), ("op", r.op),
                     ("n", r.n), ("q_before", before), ("q_after", after), ("q_change", after - before),
                     ("accepted", acc), ("created_by", r.created_by), ("created_at", r.created_at),
                     ("min_level", r.min_level), ("event", event), ("late", int(late))):
            cols[c].append(v)
    state.update((q if q is not None else 0, active, last_seq))
    out = pd.DataFrame(cols)
    for c in ("variant_id", "created_by"):
        out[c] = pd.array(out[c], dtype="Int64")
    for c in ("n", "q_before", "q_after", "q_change", "accepted", "late", "min_level"):
        out[c] = pd.array(out[c], dtype="Int32")
    yield out


ALWAYS, CHANGED, KEEP = 1, 2, 3


def settle_requests(batches):
    """Requests of a group one by one; rows sorted by (grp, req_id).

    Columns: grp, req_id, id, alive (0: refused by a check that does not depend on the others), late (1: refused by a check
    that comes after the keys'), and arrays with one place for each kind of key: claim (the key asked for), old (the key
    the row of this id holds in the table), test (0: no check), held (how many rows of the table hold the claimed key). A key is
    refused if a row of another id holds it at that time; an accepted request gives up its old keys for the new. Yields
    (req_id, clash): the place of the first key refused, -1 if none. Holds the keys of the group that have changed hands.
    """
    more, keys, at = {}, {}, None
    for pdf in batches:
        ids, clashes = [], []
        for grp, req, who, alive, late, claim, old, test, held in zip(*(
                pdf[c].tolist() for c in ("grp", "req_id", "id", "alive", "late", "claim", "old", "test", "held"))):
            if grp != at:
                at = grp
                more.clear()
                keys.clear()
            own = keys.get(who) or list(old)
            bad = -1
            if alive:
                claim = [own[i] if test[i] == KEEP else c for i, c in enumerate(claim)]
                bad = next((i for i, c in enumerate(claim) if c is not None and (test[i] == ALWAYS or test[i] == CHANGED and own[i] != c)
                            and held[i] + more.get((i, c), 0) - (own[i] == c) > 0), -1)
                if bad < 0 and not late:
                    for i, c in enumerate(claim):
                        if own[i] != c:
                            for key, n in ((own[i], -1), (c, 1)):
                                if key is not None:
                                    more[i, key] = more.get((i, key), 0) + n
                    keys[who] = claim
            ids.append(req)
            clashes.append(bad)
        yield pd.DataFrame({"req_id": np.asarray(ids, np.int64), "clash": np.asarray(clashes, np.int32)})


def settle_carts(batches):
    """Carts of a group one by one, all or nothing; rows sorted by (grp, cart_id), one for each key of a cart.

    Columns: grp, cart_id, k, need, open (the key's stock at the start), sold (1: the cart is known to be accepted and only
    takes its stock). Yields (cart_id, status) of the others. Holds what is left of the group's keys, and one cart.
    """
    left, at, held = {}, None, []
    out = ([], [])

    def frame():
        return pd.DataFrame({"cart_id": np.asarray(out[0], np.int64), "status": np.asarray(out[1], object)})

    def close():
        if not held:
            return
        sold = held[0][3]
        fits = sold or all(left.setdefault(k, o) >= n for k, n, o, _ in held)
        if fits:
            for k, n, o, _ in held:
                left[k] = left.get(k, o) - n
        if not sold:
            out[0].append(at[1])
            out[1].append("accepted" if fits else "rejected")
        held.clear()

    for pdf in batches:
        for grp, cart, *row in zip(*(pdf[c].tolist() for c in ("grp", "cart_id", "k", "need", "open", "sold"))):
            if at != (grp, cart):
                close()
                if at is None or at[0] != grp:
                    left.clear()
                at = (grp, cart)
            held.append(row)
        yield frame()
        out[0].clear()
        out[1].clear()
    close()
    yield frame()
