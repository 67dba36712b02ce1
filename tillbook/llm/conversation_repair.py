"""Repair of conversations: the cheapest edits after which the roles alternate, by bidirectional Dijkstra.

A conversation is its rows by turn (NULL first), then role, then text. A row's first fault counts: ``blank`` (no
character but blanks), ``duplicate`` (role and text of an earlier row), ``truncated`` (last such character is not one of
``.!?``). Edits: Keep (0), Rerole to user or assistant (2), Delete (3; the only one for blank and duplicate rows), Insert
an empty user or assistant row anywhere (2); a truncated row that is not deleted costs 1 more. The first characters of the
repaired rows' roles must read ``(s?(ua)+)?``. Among the cheapest the ASCII-least string of edit initials is the audit.

The lattice has a node for each number of rows used up and each of four states of that pattern; from a node each edit
initial leads to one other node. Two heaps grow from its ends, until the sum of their least costs is above the best
crossing: then each cheapest path has a crossing between what either side has settled, and the least audit is read
off from the start, along nodes that lie on such a path.

Long conversations are cut into blocks of ``BLOCK_ROWS`` rows or ``BLOCK_BYTES`` of text. A conversation within one task's
range of the order and one block is solved there. For the others, every block gives its costs between the states at its two
ends; a fold from the last block gives what remains to pay after each one, each block is solved for each
state it may begin with, and a fold from the first block picks. The folds hold four numbers however long the
conversation is, and rows of one conversation are spread over tasks by their order. Equal rows of a turn are counted
before the shuffle. Only the digest of a conversation (``report``) reads its repaired rows in order in one task, one block at
a time.

NULL role or text: one blank. NULL conv_id: a conversation of its own. NULL turns come first and do not count in the gaps.
A conversation without rows is not among the pieces; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tillbook.llm.common import cut

BLOCK_ROWS = 2048
BLOCK_BYTES = 2 << 20
BLANK = " \t\n\x0b\f\r"
FAR = 1 << 60
#: States of the pattern: 0 nothing yet, 1 after a system row, 2 after a user row, 3 after an assistant row.
STATES = range(4)
#: The role that an inserted or changed row has, and the state after it.
NEED = ("user", "user", "assistant", "user")
NEXT = (2, 2, 3, 2)
#: What is left to insert at the end, and its cost.
TAIL = ("", "II", "I", "")
TAIL_COST = tuple(2 * len(x) for x in TAIL)

#: One row of the lattice: (initial of the role, extra cost if it stays, 0), or (None, 0, m): m rows that must go.
Item = tuple[str | None, int, int]


def kept_state(state: int, initial: str) -> int | None:
    """The state after a row that keeps its role; None if it may not stand there."""
    if initial == "s":
        return 1 if state == 0 else None
    return NEXT[state] if initial == NEED[state][0] else None


def ahead(items: list[Item], node: tuple[int, int]) -> list[tuple[str, int, tuple[int, int]]]:
    """Edits from a node, as (initial, cost, node after), by initial."""
    i, s = node
    if i == len(items):
        return []
    initial, extra, gone = items[i]
    if initial is None:
        return [("D", 3 * gone, (i + 1, s)), ("I", 2, (i, NEXT[s]))]
    stay = kept_state(s, initial)
    keep = [] if stay is None else [("K", extra, (i + 1, stay))]
    return [("D", 3, (i + 1, s)), ("I", 2, (i, NEXT[s])), *keep, ("R", 2 + extra, (i + 1, NEXT[s]))]


def behind(items: list[Item], node: tuple[int, int]) -> list[tuple[int, tuple[int, int]]]:
    """Edits to a node, as (cost, node before)."""
    i, s = node
    out = [(2, (i, p)) for p in STATES if NEXT[p] == s] if i < len(items) else []
    if i:
        initial, extra, gone = items[i - 1]
        if initial is None:
            return [*out, (3 * gone, (i - 1, s))]
        out.append((3, (i - 1, s)))
        out += [(extra, (i - 1, p)) for p in STATES if kept_state(p, initial) == s]
        out += [(2 + extra, (i - 1, p)) for p in STATES if NEXT[p] == s]
    return out


def solve(items: list[Item], start: int, exits: tuple[int, ...]) -> tuple[str, int, int] | None:
    """The least audit among the cheapest from state ``start`` to the end, its cost without the exit's, and the last state.

    ``exits`` are the costs that follow in each state at the end; None if none can be reached.
    """
    n = len(items)
    from_start, to_end = {(0, start): 0}, {(n, s): c for s, c in enumerate(exits) if c < FAR}
    heap_f, heap_r = [(0, (0, start))], []
    for node, c in to_end.items():
        heappush(heap_r, (c, node))
    settled_f, settled_r = {}, {}
    best, crossings = FAR, []

    def meet(node, total):
        nonlocal best
        if total <= best:
            if total < best:
                best, crossings[:] = total, []
            crossings.append(node)

    while True:
        while heap_f and heap_f[0][1] in settled_f:
            heappop(heap_f)
        while heap_r and heap_r[0][1] in settled_r:
            heappop(heap_r)
        # a side that is used up has settled all it can reach
        if not heap_f or not heap_r or heap_f[0][0] + heap_r[0][0] > best:
            break
        if heap_f[0][0] <= heap_r[0][0]:
            c, node = heappop(heap_f)
            settled_f[node] = c
            if node[0] == n and exits[node[1]] < FAR:
                meet(node, c + exits[node[1]])
            for _, w, to in ahead(items, node):
                if to in settled_r:
                    meet(node, c + w + settled_r[to])
                if c + w < from_start.get(to, FAR):
                    from_start[to] = c + w
                    heappush(heap_f, (c + w, to))
        else:
            c, node = heappop(heap_r)
            settled_r[node] = c
            for w, of in behind(items, node):
                if of in settled_f:
                    meet(of, settled_f[of] + w + c)
                if c + w < to_end.get(of, FAR):
                    to_end[of] = c + w
                    heappush(heap_r, (c + w, of))
    if best == FAR:
        return None
    useful, new = set(crossings), list(set(crossings))
    while new:
        node = new.pop()
        for w, of in behind(items, node):
            if of not in useful and settled_f.get(of, FAR) + w == settled_f[node]:
                useful.add(of)
                new.append(of)
    audit, node, c = [], (0, start), 0
    while node[0] < n:
        for letter, w, to in ahead(items, node):
            if c + w + settled_r.get(to, FAR) == best or to in useful and settled_f[to] == c + w:
                audit.append("D" * items[node[0]][2] if letter == "D" and items[node[0]][0] is None else letter)
                node, c = to, c + w
                break
    return "".join(audit), c, node[1]


def between(items: list[Item]) -> list[int]:
    """Least costs from each state before the items to each state after them, row by row."""
    out = []
    for start in STATES:
        at = [FAR] * 4
        at[start] = 0
        for initial, extra, gone in items:
            for s in (0, 1, 3, 2):  # inserts
                at[NEXT[s]] = min(at[NEXT[s]], at[s] + 2)
            if initial is None:
                at = [min(FAR, c + 3 * gone) for c in at]
                continue
            to = [min(FAR, c + 3) for c in at]
            for s in STATES:
                stay = kept_state(s, initial)
                if stay is not None:
                    to[stay] = min(to[stay], at[s] + extra)
                to[NEXT[s]] = min(to[NEXT[s]], at[s] + 2 + extra)
            at = [min(c, FAR) for c in to]
        out += at
    return out


def after(audit: str, state: int, items: list[Item], roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts that an audit leaves."""
    out_roles, out_texts, i, gone = [], [], 0, 0
    for letter in audit:
        if letter == "I":
            out_roles.append(NEED[state])
            out_texts.append("")
            state = NEXT[state]
            continue
        initial, _, m = items[i]
        if initial is None:
            gone += 1
            if gone < m:
                continue
            gone = 0
        elif letter != "D":
            out_roles.append(roles[i] if letter == "K" else NEED[state])
            out_texts.append(texts[i])
            state = kept_state(state, initial) if letter == "K" else NEXT[state]
        i += 1
    return out_roles, out_texts


STATS = "n_blank long, n_duplicate long, n_truncated long, n_illegal long, n_turns long, first_role string, last_role string, first_turn long, last_turn long"
ROWS = "rows array<struct<role:string,text:string,fault:string,n:long>>"


def counted_rows(rows: DataFrame, conv: Column, turn: Column, role: Column, text: Column, copies: Column) -> DataFrame:
    """Different rows with their number ``n`` and whether they are the first with their role and text (``fresh``)."""
    blank = F.lit(" ")
    rows = rows.select(conv.alias("conv_id"), turn.cast("long").alias("turn"), F.coalesce(role, blank).alias("role"),
                       F.coalesce(text, blank).alias("text"), copies.alias("copies"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("n"))
    name = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit(""))
    rows = cut(rows.withColumn("sig", F.sha2(F.concat_ws(":", name, F.char_length("role").cast("string"), "role", "text").cast("binary"), 256))
               .withColumn("place", F.struct(F.col("turn").isNotNull().alias("some"), "turn")), "turns")
    again = rows.groupBy("sig").agg(F.min("place").alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    fresh = F.col("first").isNull() | F.col("first").eqNullSafe(F.col("place"))
    return rows.join(again, "sig", "left").select("conv_id", "turn", "role", "text", "n", fresh.alias("fresh"))


def fault(text: Column, fresh: Column) -> Column:
    bare = F.rtrim(text, F.lit(BLANK))
    return (F.when(bare == "", "blank").when(~fresh, "duplicate")
            .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated"))


def initial_of(role: str) -> str:
    return role[:1] or " "


def lattice(rows: list[dict]) -> tuple[list[Item], list[str], list[str]]:
    """Items of counted rows, with role and text of each."""
    items, roles, texts = [], [], []
    for r in rows:
        gone = r["n"]
        if r["fault"] in (None, "truncated"):
            items.append((initial_of(r["role"]), int(r["fault"] is not None), 0))
            roles.append(r["role"])
            texts.append(r["text"])
            gone -= 1
        if gone:
            items.append((None, 0, gone))
            roles.append("")
            texts.append("")
    return items, roles, texts


class Block:
    """Rows of one conversation that follow on one another, and what is counted of them."""

    def __init__(self, conv_id):
        self.conv_id, self.rows, self.bytes = conv_id, [], 0
        self.n = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.first_role = self.last_role = self.first_turn = self.last_turn = None

    def add(self, r: dict) -> None:
        one = initial_of(r["role"])
        self.n["illegal"] += r["n"] - 1 + (self.last_role is not None and self.last_role + one not in ("su", "ua", "au"))
        self.first_role, self.last_role = self.first_role or one, one
        if r["turn"] is not None:
            self.n["turns"] += r["turn"] != self.last_turn
            self.first_turn = r["turn"] if self.first_turn is None else self.first_turn
            self.last_turn = r["turn"]
        stays = r["fault"] in (None, "truncated")
        if stays:
            self.n["truncated"] += r["fault"] is not None
            self.n["duplicate"] += r["n"] - 1
        else:
            self.n[r["fault"]] += r["n"]
        self.rows.append({"role": r["role"], "text": r["text"] if stays else "", "fault": r["fault"], "n": r["n"]})
        self.bytes += len(r["text"]) if stays else 0

    def full(self) -> bool:
        return len(self.rows) >= BLOCK_ROWS or self.bytes >= BLOCK_BYTES

    def record(self, seq: int, whole: bool) -> dict:
        return {"conv_id": self.conv_id, "seq": seq, "whole": whole, "rows": self.rows,
                "costs": None if whole else between(lattice(self.rows)[0]), **{f"n_{k}": v for k, v in self.n.items()},
                "first_role": self.first_role, "last_role": self.last_role, "first_turn": self.first_turn, "last_turn": self.last_turn}


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows, a few at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            yield from batch.slice(i, 64).to_pylist()


def packed(records: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in records:
        held.append(r)
        size += 200 + sum(len(x["text"] or "") + 40 for x in r.get("rows") or ()) + sum(map(len, r.get("texts") or ()))
        if size > BLOCK_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def over(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` from an iterator of rows to one of rows, partition by partition."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(lambda batches: packed(fn(listed(batches)), arrow), schema)


def to_blocks(rows: Iterator[dict]) -> Iterator[dict]:
    """Blocks of sorted rows. ``whole``: no rows of the conversation can lie elsewhere."""
    seq, block, nth, alone = TaskContext.get().partitionId() << 33, None, 0, True
    for r in rows:
        if block is None or r["conv_id"] != block.conv_id or block.full():
            ends = block is None or r["conv_id"] != block.conv_id
            if block is not None:
                # the first and the last conversation of a partition may lie in its neighbours too
                yield block.record(seq, whole=ends and alone and nth > 1)
                seq += 1
            nth, alone = nth + ends, ends
            block = Block(r["conv_id"])
        block.add(r)
    if block is not None:
        yield block.record(seq, whole=False)


def remaining(blocks: Iterator[dict]) -> Iterator[dict]:
    """Costs that follow each block, from the last one back."""
    conv, exits = object(), None
    for r in blocks:
        if r["conv_id"] != conv:
            conv, exits = r["conv_id"], list(TAIL_COST)
        yield {"id": r["conv_id"], "at": r["seq"], "exits": exits}
        exits = [min(min(r["costs"][4 * s + t] + exits[t] for t in STATES), FAR) for s in STATES]


def entries(blocks: Iterator[dict]) -> Iterator[dict]:
    """The state in which each block begins, from the first one on."""
    conv, state = object(), 0
    for r in blocks:
        if r["conv_id"] != conv:
            conv, state = r["conv_id"], 0
        yield {"id": r["conv_id"], "at": r["seq"], "entry": state}
        state = r["ways"][state]["last"]


def ways(blocks: Iterator[dict]) -> Iterator[dict]:
    """Each block with its best way from each state."""
    for r in blocks:
        items = lattice(r["rows"])[0]
        found = [solve(items, s, tuple(r["exits"])) for s in STATES]
        yield {**r, "ways": [{"audit": x[0], "cost": x[1], "last": x[2]} if x else {"audit": "", "cost": FAR, "last": 0} for x in found]}


def pieces(blocks: Iterator[dict]) -> Iterator[dict]:
    """Blocks repaired, once it is known how they begin."""
    for r in blocks:
        items, roles, texts = lattice(r["rows"])
        if r["whole"]:
            state, (audit, cost, last) = 0, solve(items, 0, TAIL_COST)
        else:
            state = r["entry"]
            audit, cost, last = (r["ways"][state][k] for k in ("audit", "cost", "last"))
        roles, texts = after(audit, state, items, roles, texts)
        yield {**r, "audit": audit, "cost": cost, "last": last, "roles": roles, "texts": texts}


def repair(rows: DataFrame, conv: Column | None = None, turn: Column | None = None, role: Column | None = None,
           text: Column | None = None, copies: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Repaired conversations: those in one piece, and the pieces of the others.

    A piece has conv_id, seq (its place among them), audit, cost, last, roles, texts and counts; ``last`` is the pattern's state after
    it. After the last piece what ``TAIL`` says is inserted. ``copies`` is the number of times a row stands in its place.
    """
    col = [F.col(n) if c is None else c for n, c in (("conv_id", conv), ("turn", turn), ("role", role), ("text", text))]
    rows = counted_rows(rows, *col, F.lit(1) if copies is None else copies)
    rows = rows.withColumn("fault", fault(F.col("text"), F.col("fresh"))).drop("fresh")
    kind = rows.schema["conv_id"].dataType.simpleString()
    key = f"conv_id {kind}, seq long, whole boolean"
    in_order = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    blocks = cut(over(in_order, to_blocks, f"{key}, {ROWS}, costs array<long>, {STATS}"), "blocks")
    result = f"{key}, audit string, cost long, last int, roles array<string>, texts array<string>, {STATS}"
    whole, parts = blocks.where("whole"), blocks.where("not whole")

    def on(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b, F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("seq") == F.col("at"))).drop("id", "at")

    backward = parts.select("conv_id", "seq", "costs").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("seq"))
    way = "ways array<struct<audit:string,cost:long,last:int>>"
    solved = cut(over(on(parts, over(backward, remaining, f"id {kind}, at long, exits array<long>")), ways,
                      f"{key}, {ROWS}, {STATS}, {way}"), "ways")
    forward = solved.select("conv_id", "seq", F.transform("ways", lambda w: F.struct(w["last"].alias("last"))).alias("ways"))
    begun = over(forward.repartition("conv_id").sortWithinPartitions("conv_id", "seq"), entries, f"id {kind}, at long, entry int")
    return over(whole, pieces, result), over(on(solved, begun), pieces, result)


def summed(pieces: Iterator[dict]) -> Iterator[dict]:
    """One row per conversation from its pieces in order; the digest takes them one at a time."""
    now = None
    for r in pieces:
        if now is None or r["conv_id"] != now["conv_id"]:
            if now is not None:
                yield finished(now)
            now = {"conv_id": r["conv_id"], "sha": hashlib.sha256(), "any": False, "audit": [], "cost": 0, "last_role": None, "last_turn": None,
                   "first_turn": None, **dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)}
        now["illegal"] += now["last_role"] is not None and now["last_role"] + r["first_role"] not in ("su", "ua", "au")
        now["turns"] -= r["first_turn"] is not None and r["first_turn"] == now["last_turn"]
        for k in ("blank", "duplicate", "truncated", "illegal", "turns"):
            now[k] += r[f"n_{k}"]
        now["first_turn"] = r["first_turn"] if now["first_turn"] is None else now["first_turn"]
        now["last_turn"] = now["last_turn"] if r["last_turn"] is None else r["last_turn"]
        now["last_role"], now["last"] = r["last_role"], r["last"]
        now["audit"].append(r["audit"])
        now["cost"] += r["cost"]
        tell(now, zip(r["roles"], r["texts"], strict=True))
    if now is not None:
        yield finished(now)


def tell(now: dict, rows) -> None:
    for role, text in rows:
        now["sha"].update(f"{chr(10) if now['any'] else ''}{role}:{text}".encode())
        now["any"] = True


def finished(now: dict) -> dict:
    state = now["last"]
    for _ in TAIL[state]:
        tell(now, [(NEED[state], "")])
        state = NEXT[state]
    gaps = 0 if now["first_turn"] is None else now["last_turn"] - now["first_turn"] + 1 - now["turns"]
    return {"conv_id": now["conv_id"], "gaps": gaps, **{k: now[k] for k in ("blank", "duplicate", "truncated", "illegal")},
            "cost": now["cost"] + TAIL_COST[now["last"]], "audit": "".join(now["audit"]) + TAIL[now["last"]],
            "repaired_sha256": now["sha"].hexdigest()}


def report(whole: DataFrame, parts: DataFrame) -> DataFrame:
    """One row per conversation: gaps, faults, illegal pairs, cost, audit and the digest of its repaired rows."""
    kind = whole.schema["conv_id"].dataType.simpleString()
    schema = (f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
              "repaired_sha256 string")
    parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return over(whole, summed, schema).unionAll(over(parts, summed, schema))
