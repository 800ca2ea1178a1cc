"""Repeated windows of bytes by a depth-limited radix sort of suffixes, most significant part first.

Suffixes need order only through `size` bytes, since two suffixes that agree so far start the same
repeated window. Every pass groups suffixes on more of their content, lets groups of one leave, and
settles groups whose members are all alike:

1. Each window has one anchor, its `KEY`-byte substring of least hash. Suffixes that start at windows of
   one anchor share it, so the first pass groups anchors instead of suffixes.
2. Windows of an anchor are cut into runs of `RUN` starts at fixed distances from it. What all windows of
   a run share (the core) is the next key; a run with the bytes around its core is a kind.
3. Runs whose core has several kinds are cut into runs of `FINE` starts and these, at last, into
   single windows, each keyed by its whole content.

Groups of equal single windows, and runs of equal kind, are exactly the repeated windows. Rows carry
hashes and positions; texts move once, and later only those with a repeated anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskloom.llm.blocks import _STEP, Block, _powers, blocks, mixed, prefix_sums
from maskloom.llm.shared import written

KEY = 128
RUN = 64
FINE = 8
#: Bits of the distances from an anchor to its last and first window, and the longest windows they allow.
_FAR = 16
MOST = KEY + (1 << _FAR) - 1
_BITS = 20
_PLACE = np.uint64((1 << _BITS) - 1)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    n = len(x) - w + 1
    full = -(-len(x) // w) * w
    x = np.concatenate([x, np.full(full - len(x), np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    up = np.minimum.accumulate(x, axis=1).ravel()
    down = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[w - 1 : w - 1 + n])


def anchors_of(block: Block, size: int, key: int = KEY) -> tuple[np.ndarray, ...]:
    """For all anchors of a block: document, place in it, hash, and distances to its last and first window."""
    n = len(block.data)
    valid = np.zeros(n + 1, np.int64)
    long = block.ends - block.starts >= size
    np.add.at(valid, block.starts[long], 1)
    np.add.at(valid, block.ends[long] - size + 1, -1)
    valid = np.cumsum(valid[:n]) > 0
    starts, places, hashes = [], [], []
    w = size - key + 1
    step = _STEP - size
    down = _powers()[1]
    for low in range(0, max(0, n - size + 1), step):
        high = min(low + step, n - size + 1)
        ok = np.flatnonzero(valid[low:high])
        if not len(ok):
            continue
        sums = prefix_sums(block.data[low : high + size - 1])
        with np.errstate(over="ignore"):
            g = mixed((sums[key:] - sums[:-key]) * down[: len(sums) - key])
        place = np.arange(len(g), dtype=np.uint64)
        at = (sliding_min((g & ~_PLACE) | place, w)[ok] & _PLACE).astype(np.int64)
        starts.append(ok + low)
        places.append(at + low)
        hashes.append(g[at])
    if not starts:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    p, at, h = np.concatenate(starts), np.concatenate(places), np.concatenate(hashes)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(p)) - 1
    at, h = at[first], h[first]
    doc = np.searchsorted(block.ends, at, side="right")
    return doc, at - block.starts[doc], h.view(np.int64), at - p[last], at - p[first]


def text_keys(text: Column) -> list[Column]:
    """Equal texts share their windows, so rows meet by text: hash and bytes."""
    return [F.xxhash64(text).alias("th"), F.octet_length(text).alias("tn")]


def _column(values, kind=None) -> pa.Array:
    return pa.array(values, kind)


def anchors(texts: DataFrame, size: int) -> DataFrame:
    """(key, th, tn, at): all anchors of rows (th, tn, text); `at` packs place and both distances."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                doc, place, h, near, far = anchors_of(block, size)
                row = pa.array(doc + block.first)
                yield pa.RecordBatch.from_arrays(
                    [_column(h), batch.column("th").take(row), batch.column("tn").take(row), _column(place << 2 * _FAR | far << _FAR | near)],
                    ["key", "th", "tn", "at"],
                )

    return texts.mapInArrow(find, "key long, th long, tn int, at long")


def _runs(text: bytes, at: np.ndarray, size: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(start of core, least and largest distance of a window from it, core, core with its surroundings)."""
    core = size - RUN + 1
    for a in np.sort(at).tolist():
        place, far, near = a >> 2 * _FAR, a >> _FAR & ((1 << _FAR) - 1), a & ((1 << _FAR) - 1)
        for i in range(near // RUN, far // RUN + 1):
            start = place - RUN * i
            low, high = max(near - RUN * i, 0), min(far - RUN * i, RUN - 1)
            yield start, low, high, text[start : start + core], text[start - high : start - low + size]


def members(texts: DataFrame, size: int) -> DataFrame:
    """(core, r1, r2, th, tn, start, low, high, n): runs of windows of texts (th, tn, text, copies, ats)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["core", "r1", "r2", "th", "tn", "start", "low", "high", "n"]
        for batch in batches:
            th, tn, n, ats = (batch.column(c) for c in ("th", "tn", "copies", "ats"))
            for block in blocks(batch.column("text")):
                rows, out = [], []
                for i in range(len(block)):
                    r = block.first + i
                    for start, low, high, core, whole in _runs(block.text(i), ats[r].values.to_numpy(), size):
                        x = xxhash.xxh3_128_intdigest(whole)
                        out.append((xxhash.xxh3_64_intdigest(core), x >> 64, x & 0xFFFFFFFFFFFFFFFF, start, low, high))
                        rows.append(r)
                if not rows:
                    continue
                c = list(zip(*out))
                hashes = [_column(np.array(v, np.uint64).view(np.int64)) for v in c[:3]]
                row = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [*hashes, th.take(row), tn.take(row), *(_column(v, pa.int32()) for v in c[3:]), n.take(row)], names
                )

    return texts.mapInArrow(find, "core long, r1 long, r2 long, th long, tn int, start int, low int, high int, n long")


def with_sides(texts: DataFrame, size: int) -> DataFrame:
    """(core, r1, r2, low, high, n, left, right): the bytes around the cores of runs listed with their text."""
    core = size - RUN + 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs")
            for block in blocks(batch.column("text")):
                out = []
                for i in range(len(block)):
                    text = block.text(i)
                    for r in runs[block.first + i].as_py():
                        s, low, high = r["start"], r["low"], r["high"]
                        r["left"], r["right"] = text[s - high : s], text[s + core : s - low + size]
                        out.append(r)
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    fields = [("core", pa.int64()), ("r1", pa.int64()), ("r2", pa.int64()), ("low", pa.int32()), ("high", pa.int32())]
    schema = pa.schema([*fields, ("n", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])
    return texts.mapInArrow(find, "core long, r1 long, r2 long, low int, high int, n long, left binary, right binary")


def _kinds(rows: DataFrame, core: str, one: str, two: str) -> DataFrame:
    """Rows whose core occurs twice or more, with `_alike`: all of its rows are of one kind."""
    groups = (
        rows.groupBy(core)
        .agg(F.sum("n").alias("_n"), *(f(c).alias(f"_{f.__name__}_{c}") for f in (F.min, F.max) for c in (one, two)))
        .filter("_n >= 2")
        .select(core, ((F.col(f"_min_{one}") == F.col(f"_max_{one}")) & (F.col(f"_min_{two}") == F.col(f"_max_{two}"))).alias("_alike"))
    )
    return rows.join(written(groups), core)


def _single_windows(kinds: DataFrame) -> DataFrame:
    """(core, r1, r2, low, high, from, to): distances of repeated windows of runs with several kinds."""
    run = ["core", "r1", "r2", "low", "high"]
    part = F.explode(F.sequence((F.col("low") / FINE).cast("int"), (F.col("high") / FINE).cast("int")))
    fine = kinds.withColumn("t", part).withColumn("near", F.col("t") * FINE).withColumn("far", F.col("t") * FINE + FINE - 1)
    fine = fine.withColumn("from", F.greatest("near", "low")).withColumn("to", F.least("far", "high"))
    # what all windows of the part cover beside the core, and what any of them covers
    shared = [F.expr("substring(left, length(left) - near + 1, near)"), F.expr(f"substring(right, 1, {RUN - 1} - far)")]
    sides = [F.expr("substring(left, length(left) - to + 1, to)"), F.expr(f"substring(right, 1, {RUN - 1} - from)")]
    fine = fine.select(
        *run, "n", "left", "right", "from", "to",
        F.xxhash64("core", "t", *shared).alias("core2"),
        F.xxhash64("core", "t", *sides).alias("k1"),
        F.xxhash64(F.lit(7), "core", "t", *sides).alias("k2"),
    )
    fine = _kinds(fine, "core2", "k1", "k2")
    alike = fine.filter("_alike").select(*run, "from", "to")
    single = fine.filter("NOT _alike").withColumn("d", F.explode(F.sequence("from", "to")))
    sides = [F.expr("substring(left, length(left) - d + 1, d)"), F.expr(f"substring(right, 1, {RUN - 1} - d)")]
    single = single.select(
        *run, "n", "d", F.xxhash64("core", "d", *sides).alias("k1"), F.xxhash64(F.lit(7), "core", "d", *sides).alias("k2")
    )
    twice = written(single.groupBy("k1", "k2").agg(F.sum("n").alias("_n")).filter("_n >= 2").select("k1", "k2"))
    found = single.join(twice, ["k1", "k2"], "left_semi").select(*run, F.col("d").alias("from"), F.col("d").alias("to"))
    return alike.unionByName(found)


def repeated_windows(docs: DataFrame, size: int = 400, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Texts (th, tn, text, copies, ats) with a repeated anchor, and (th, tn, spans): their repeated windows.

    A span holds the first and the last start of neighbouring windows that also start anywhere else in the
    collection. Null text is empty; texts below `size` bytes have no window. `size` goes from `KEY + RUN` to `MOST`.
    """
    if not KEY + RUN <= size <= MOST:
        raise ValueError(f"windows have {KEY + RUN} to {MOST} bytes")
    base = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).filter(F.octet_length("text") >= size)
    base = base.select(*text_keys(F.col("text")), "text")
    every = written(anchors(base, size))
    twice = written(every.groupBy("key").agg(F.count("*").alias("_n")).filter("_n >= 2").select("key"))
    ats = every.join(twice, "key", "left_semi").groupBy("th", "tn").agg(F.collect_set("at").alias("ats"))
    texts = base.groupBy("th", "tn").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    texts = written(texts.join(ats, ["th", "tn"]))

    runs = written(_kinds(members(texts, size), "core", "r1", "r2"))
    run = ["core", "r1", "r2", "low", "high"]
    mixed_runs = runs.filter("NOT _alike")
    kinds = mixed_runs.groupBy(*run).agg(F.sum("n").alias("n"), F.min(F.struct("th", "tn", "start")).alias("_at"))
    listed = kinds.groupBy("_at.th", "_at.tn").agg(
        F.collect_list(F.struct("core", "r1", "r2", F.col("_at.start").alias("start"), "low", "high", "n")).alias("runs")
    )
    sides = written(with_sides(texts.join(listed, ["th", "tn"]).select("text", "runs"), size))
    windows = written(_single_windows(sides).groupBy(*run).agg(F.collect_set(F.struct("from", "to")).alias("_d")))
    whole = runs.filter("_alike").select("th", "tn", "start", F.array(F.struct(F.col("low").alias("from"), F.col("high").alias("to"))).alias("_d"))
    parts = mixed_runs.join(windows, run).select("th", "tn", "start", "_d")
    span = F.transform("_d", lambda d: F.struct((F.col("start") - d["to"]).alias("first"), (F.col("start") - d["from"]).alias("last")))
    spans = (
        whole.unionByName(parts)
        .select("th", "tn", span.alias("s"))
        .groupBy("th", "tn")
        .agg(F.flatten(F.collect_list("s")).alias("spans"))
    )
    return texts, spans


def without_repeats(docs: DataFrame, size: int = 400, text: str = "text") -> DataFrame:
    """All rows and columns of `docs` (one named `_r` is replaced) and struct `_r` (n_bytes, n_removed, n_spans, kept_sha256).

    Every byte under a repeated window of `size` bytes goes, judged on the input. Null text is empty; equal
    texts of at least `size` bytes are removed whole from every row; ids may be null or repeat.
    """
    texts, spans = repeated_windows(docs, size, text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, n_spans, sha = [], [], []
            for block in blocks(batch.column("text")):
                for i in range(len(block)):
                    data = block.text(i)
                    s = batch.column("spans")[block.first + i].values
                    edge = np.zeros(len(data) + 1, np.int64)
                    np.add.at(edge, s.field("first").to_numpy(), 1)
                    np.add.at(edge, s.field("last").to_numpy() + size, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed.append(int(gone.sum()))
                    n_spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    sha.append(hashlib.sha256(np.frombuffer(data, np.uint8)[~gone]).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("th"), batch.column("tn"), _column(removed, pa.int64()), _column(n_spans, pa.int64()), _column(sha, pa.string())],
                ["th", "tn", "n_removed", "n_spans", "sha"],
            )

    cuts = texts.select("th", "tn", "text").join(spans, ["th", "tn"]).mapInArrow(
        cut, "th long, tn int, n_removed long, n_spans long, sha string"
    )
    own = F.coalesce(F.col(text), F.lit(""))
    th, tn = text_keys(own)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), th, tn, F.sha2(own, 256).alias("own_sha"))
    found = F.struct(
        F.col("tn").cast("long").alias("n_bytes"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("sha", "own_sha").alias("kept_sha256"),
    )
    return rows.join(cuts, ["th", "tn"], "left").select(*(f"_row.`{c}`" for c in docs.columns if c != "_r"), found.alias("_r"))
