"""Cheapest repair of a conversation's turn structure, by the auction algorithm for shortest paths.

The rows of a conversation and the states of the wanted form `(system? (user assistant)+)?` span a lattice:
node (i, q) stands before row i with what has been given out so far ending in q. Its arcs keep, rerole or
delete row i, or insert a turn, at integer costs. A path from the start grows along the cheapest arc when
its last node's price allows it, and shrinks and raises that price when not. Prices stay dual feasible
(price(u) <= cost + price(v)), so once a path arrives, the arcs of every cheapest path are tight, and a
walk that takes the least letter among tight arcs that still lead to the end is the least of them.

Long conversations go through the lattice in blocks of `BLOCK_ROWS` rows from the end: a block ends in
nodes whose prices are already exact, which makes the work linear in the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Costs of deleting a row, giving it another role, inserting a turn, and leaving a truncated text.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
BLOCK_ROWS = 16
#: What has been given out so far: nothing, system, user, assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn that is not the system's.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEPT = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Audits that a worker remembers, by the codes of the rows.
REMEMBERED = 1 << 16

BLANK, DUPLICATE, CUT, FINE, DROPPED = "blank", "duplicate", "truncated", "fine", "dropped"


def arcs(codes: str, i: int, q: int) -> list[tuple[str, int, int, int]]:
    """(letter, cost, next row, next state) by letter. Codes: `-` must go, else the initial, a capital if truncated."""
    out = []
    if i < len(codes):
        code = codes[i]
        out.append(("D", DELETE, i + 1, q))
        if code != "-":
            extra = TRUNCATED if code.isupper() else 0
            to = KEPT.get(code.lower())
            if to == NEXT[q] or (to == SYSTEM and q == NOTHING):
                out.append(("K", extra, i + 1, to))
            out.append(("R", REROLE + extra, i + 1, NEXT[q]))
    out.append(("I", INSERT, i, NEXT[q]))
    return sorted(out)


def auction(first: int, last: int, origin: int, codes: str, price: dict[tuple[int, int], int]) -> None:
    """Raise `price` until the path from (first, origin) reaches a node of row `last`, whose prices are exact."""
    path = [(first, origin)]
    while path[-1][0] != last:
        i, q = node = path[-1]
        least, best = min((cost + price[j, r], (j, r)) for _, cost, j, r in arcs(codes, i, q))
        if price[node] < least:
            price[node] = least
            if len(path) > 1:
                path.pop()
        else:
            path.append(best)


def repair(codes: str) -> tuple[int, str]:
    """Least cost, and of all cheapest repairs the least string of edit letters (K, R, D of each row, I between)."""
    n = len(codes)
    # after the last row only a missing assistant, or user and assistant, can be wanted
    price = {(n, NOTHING): 0, (n, SYSTEM): 2 * INSERT, (n, USER): INSERT, (n, ASSISTANT): 0}
    cuts = [*range(n, 0, -BLOCK_ROWS), 0] if n else [0]
    for last, first in zip(cuts, cuts[1:]):
        least = min(price[last, q] for q in range(4))  # feasible, since no cost is negative
        price.update({(i, q): least for i in range(first, last) for q in range(4)})
        for q in range(4):
            auction(first, last, q, codes, price)
    # nodes from which tight arcs lead to the end; two inserts at most stand between rows
    open_ends = {(n, NOTHING), (n, ASSISTANT)}
    for i in range(n, -1, -1):
        for _ in range(3):
            for q in range(4):
                if any(price[i, q] == cost + price[j, r] and (j, r) in open_ends for _, cost, j, r in arcs(codes, i, q)):
                    open_ends.add((i, q))
    letters, i, q = [], 0, NOTHING
    while i < n or q not in (NOTHING, ASSISTANT):
        letter, i, q = next((x, j, r) for x, cost, j, r in arcs(codes, i, q) if price[i, q] == cost + price[j, r] and (j, r) in open_ends)
        letters.append(letter)
    return price[0, NOTHING], "".join(letters)


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copy): rows with made-up faults by the CRC of `conv_id:turn`; nulls read as one space.

    `copy` is 0 or 1 and null for a dropped row, which stays as a mark that its conversation exists.
    """
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat_ws(":", of(conv_id), of(turn)).cast("binary")) % 20
    changed = F.when(k == 1, "").when(k == 2, F.regexp_replace(of(text), r"[.!?]", "")).otherwise(of(text))
    copies = F.when(k == 0, F.array(F.lit(None).cast("int"))).when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.when(k == 4, "user").otherwise(of(role)).alias("role"),
        changed.alias("text"),
        F.explode(copies).alias("copy"),
    )


def faults(rows: DataFrame) -> DataFrame:
    """Adds `fault`: the first that holds of blank, duplicate (role and text seen earlier), truncated; else fine.

    Rows of one conversation are ordered by turn, nulls first, then role and text.
    """
    said = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    seen = Window.partitionBy("conv_id", "role", F.sha2("text", 256)).orderBy(F.col("copy").isNull(), F.col("turn").asc_nulls_first(), "copy")
    fault = (
        F.when(F.col("copy").isNull(), DROPPED)
        .when(said == "", BLANK)
        .when(F.row_number().over(seen) > 1, DUPLICATE)
        .when(~said.rlike(r"[.!?]"), CUT)
        .otherwise(FINE)
    )
    return rows.withColumn("fault", fault)


class Story:
    """One conversation, row by row: first all codes, then all texts."""

    def __init__(self) -> None:
        self.codes: list[str] = []
        self.counts = dict.fromkeys((BLANK, DUPLICATE, CUT, DROPPED, FINE), 0)
        self.turns, self.low, self.high, self.illegal, self.before = 0, None, None, 0, None
        self.plan: Iterator[str] | None = None
        self.hash, self.any, self.state = hashlib.sha256(), False, NOTHING

    def code(self, turn: int | None, role: str, fault: str) -> None:
        self.counts[fault] += 1
        if fault == DROPPED:
            return
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        first = role[:1]
        self.illegal += self.before is not None and self.before + first not in ("su", "ua", "au")
        self.before = first
        letter = first if first in KEPT else "x"
        self.codes.append("-" if fault in (BLANK, DUPLICATE) else letter.upper() if fault == CUT else letter)

    def solve(self, known: dict[str, tuple[int, str]]) -> None:
        codes = "".join(self.codes)
        found = known.get(codes) or repair(codes)
        if len(known) < REMEMBERED and len(codes) <= 64:
            known[codes] = found
        self.cost, self.audit = found
        self.plan = iter(self.audit)

    def give(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.any = True

    def inserted(self, letter: str | None) -> str | None:
        while letter == "I":
            self.state = NEXT[self.state]
            self.give(ROLE[self.state], "")
            letter = next(self.plan, None)
        return letter

    def text(self, role: str, text: str) -> None:
        letter = self.inserted(next(self.plan))
        if letter == "K":
            self.state = KEPT[role[0]]
            self.give(role, text)
        elif letter == "R":
            self.state = NEXT[self.state]
            self.give(ROLE[self.state], text)

    def row(self) -> tuple:
        self.inserted(next(self.plan, None))
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        c = self.counts
        return gaps, c[BLANK], c[DUPLICATE], c[CUT], self.illegal, self.cost, self.audit, self.hash.hexdigest()


_COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _batch(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    schema = pa.schema([("conv_id", kind), *((c, pa.int64()) for c in _COLUMNS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)


def _stories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For `mapInArrow` over rows sorted by conversation, phase and place: a row per conversation."""
    known: dict[str, tuple[int, str]] = {}
    conv, story, kind, done = None, None, None, []

    def close() -> None:
        if story.plan is None:
            story.solve(known)
        done.append((conv, *story.row()))

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "phase", "turn", "role", "fault", "text"))):
            if story is None or row[0] != conv:
                if story:
                    close()
                conv, story = row[0], Story()
            _, phase, turn, role, fault, text = row
            if not phase:
                story.code(turn, role, fault)
                continue
            if story.plan is None:
                story.solve(known)
            story.text(role, text)
        if done:
            yield _batch(done, kind)
            done.clear()
    if story:
        close()
        yield _batch(done, kind)


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row per conversation.

    `rows` (conv_id, turn, role, text, copy) as `damaged` gives them; null ids are one conversation. Rows
    shuffle once, by conversation. Sorted, each conversation passes a worker twice: first one letter per
    row, from which the lattice is solved, then its texts, which are hashed as they go by, so no text is
    held and a conversation of any length takes a few numbers per row. Its repaired text has one hash, so it
    cannot be cut between tasks. A conversation of which all rows were dropped gives zeros.
    """
    found = faults(rows.repartition("conv_id"))
    phases = F.explode(F.when(F.col("copy").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("phase")
    order = ("conv_id", "phase", F.col("turn").asc_nulls_first(), "role", "sorted", "copy")
    both = found.select("conv_id", phases, "turn", "role", "fault", "text", "copy").withColumn("sorted", F.sha2("text", 256))
    slim = both.withColumn("text", F.when(F.col("phase") == 1, F.col("text")))
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in _COLUMNS) + ", audit string, repaired_sha256 string"
    ready = slim.sortWithinPartitions(*order).select("conv_id", "phase", "turn", "role", "fault", "text")
    return ready.mapInArrow(_stories, schema)
