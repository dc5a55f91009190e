"""Suffix-array dedup of bytes that repeat over ``width`` bytes or more.

A distributed difference-cover suffix sort of every suffix of a corpus would
shuffle each byte's suffix several times. Only the order of the first ``width``
bytes matters here, so the suffixes are dealt by value first: each window of
``width`` bytes belongs to the smallest-hashed ``KEY`` bytes within it (its
minimizer, the leftmost of equals), and equal windows have equal minimizers.
Windows in a row with one minimizer make a segment.

1. Minimizers that occur once are left out; all others' segments are gathered
   by minimizer and content. Of equal segments, all but the first are covered.
2. Where a minimizer has segments of different content, suffixes of the
   distinct ones are sorted by the difference-cover method (``suffix_array``:
   sort sampled triples, recurse on their names, merge the other suffixes) and
   neighbours are compared over ``width`` bytes: each run of equal windows
   covers all but its first.

A minimizer is one partition key, so the suffix sorts of different keys run
apart and never meet. Of keys with too many distinct segments for one sort each
window becomes a segment of its own, settled by hash as equal segments are; or,
at a price, their suffixes are ranked across tasks (``cover``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, slices, text_buffer, written
from .cover import running, suffix_array, suffix_ranks
from .shingles import _BASE, _INVERSE, mix, powers

WIDTH, KEY = 100, 32
#: Bits of the filter of repeated minimizers. One that is full only lets more rows through.
BITS = 23
#: Minimizers with more than 1 / HOT of all gathered segments are dealt to PARTS parts first.
HOT, PARTS = 2000, 64
#: Bytes of one suffix sort, and distinct segments of a minimizer that one sort takes.
SORT, MOST = 1 << 20, 20_000
#: Numbers of a table that is broadcast at most: span ends, or two for a document's key.
BROADCAST = 1_000_000
#: Rows of one id with different texts follow each other at this distance; no string of Spark's is longer.
TWIN = 1 << 31


def _hash_sums(raw: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(raw)), out=sums[1:])
    return sums


def segments(raw: np.ndarray, at: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...] | None:
    """(row, first window, last window, minimizer's hash, content's hash, content's start in raw) of each segment."""
    key_size = min(KEY, width)
    n, span = len(raw), width - key_size + 1
    if n < width:
        return None
    sums, inverse = _hash_sums(raw), powers(_INVERSE, n)
    hashes = mix((sums[key_size:] - sums[:-key_size]) * inverse[: n - key_size + 1])
    least, size = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64), 1
    while size * 2 <= span:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    if size < span:
        least = np.minimum(least[: size - span], least[span - size :])
    at_min = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(at_min)]
    start = np.flatnonzero(np.arange(len(at_min)) + width <= at[1:][row])
    if not len(start):
        return None
    chosen = at_min[start]
    fresh = np.append(True, (chosen[1:] != chosen[:-1]) | (start[1:] != start[:-1] + 1))
    first = np.flatnonzero(fresh)
    a, b, m = start[first], start[np.append(first[1:], len(start)) - 1], chosen[first]
    content = mix((sums[b + width] - sums[a]) * inverse[a] + np.uint64(0x9E3779B97F4A7C15) * ((b - a) * 256 + (m - a) + 1).astype(np.uint64))
    return row[a], a - at[row[a]], b - at[row[a]], hashes[m], content, a


def _minimizers(docs: DataFrame, width: int, wanted: np.ndarray | None) -> DataFrame:
    """Minimizer hashes only (``wanted`` None), else the segments whose minimizer passes the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, at = text_buffer(batch.column(2))
            if (got := segments(raw, at, width)) is None:
                continue
            row, a, b, h, c, _ = got
            if shared is None:
                h, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])
                continue
            slot = (h & np.uint64((1 << BITS) - 1)).astype(np.int64)  # low bits: a minimizer's high ones are small by choice
            keep = np.flatnonzero(shared.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            doc, base = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for low in range(0, len(keep), 100_000):
                k = keep[low : low + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[k].view(np.int64), c[k].view(np.int64), doc[row[k]], base[row[k]] + a[k], (b[k] - a[k]).astype(np.int32))], names=["h", "c", "doc", "a", "more"])

    return docs.mapInArrow(run, "h long, n long" if shared is None else "h long, c long, doc long, a long, more int")


def _filter(repeated: DataFrame) -> np.ndarray:
    """A bitmap of the repeated minimizers, 2 ** BITS bits, built on the executors in blocks."""
    slots = repeated.select(F.col("h").bitwiseAND((1 << BITS) - 1).alias("slot"))
    parts = slots.select(F.shiftright("slot", 12).alias("block"), F.expr("slot & 4095").alias("rest")).groupBy("block").agg(F.collect_set("rest").alias("rests"))  # 4096 numbers a block at most

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rests in batch.column(1):
                bits = np.zeros(4096, np.uint8)
                bits[np.asarray(rests.values, np.int64)] = 1
                out.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["block", "bits"])

    found = np.zeros(1 << (BITS - 3), np.uint8)
    for r in parts.mapInArrow(pack, "block long, bits binary").collect():
        found[r["block"] * 512 : r["block"] * 512 + 512] = np.frombuffer(r["bits"], np.uint8)
    return found


def later_windows(texts: list[bytes], doc: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of segments' contents, with document and place: (segment, first window, last window) of runs of covered windows."""
    flat = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    offset = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
    valid = offset + width <= sizes[owner]
    order = suffix_array(flat.astype(np.int64) + 1)
    order = order[valid[order]]
    view = np.lib.stride_tricks.sliding_window_view(flat, width)
    same = np.zeros(len(order), bool)
    for low in range(1, len(order), 50_000):
        k = np.arange(low, min(low + 50_000, len(order)))
        same[k] = (view[order[k]] == view[order[k - 1]]).all(axis=1)
    run = np.cumsum(~same)
    d, s = doc[owner[order]], start[owner[order]] + offset[order]
    by = np.lexsort((s, d, run))
    later = np.append(False, run[by][1:] == run[by][:-1])
    # The same place met twice is one occurrence.
    again = np.append(False, (run[by][1:] == run[by][:-1]) & (d[by][1:] == d[by][:-1]) & (s[by][1:] == s[by][:-1]))
    head = np.maximum.accumulate(np.where(~later, np.arange(len(by)), 0))
    later &= ~(again & (d[by] == d[by][head]) & (s[by] == s[by][head]))
    hit = np.sort(order[by[later]])
    if not len(hit):
        none = np.empty(0, np.int64)
        return none, none, none
    fresh = np.flatnonzero(np.append(True, (np.diff(hit) != 1) | (owner[hit[1:]] != owner[hit[:-1]])))
    last = np.append(fresh[1:], len(hit)) - 1
    return owner[hit[fresh]], offset[hit[fresh]], offset[hit[last]]


def _sorted_spans(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Spans covered within the groups (h) of a task's rows, which come ordered by h; several groups share a suffix sort."""

    def done(rows: list[tuple]) -> pa.RecordBatch:
        doc, a = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        k, low, high = later_windows([r[3] for r in rows], doc, a, width)
        return pa.RecordBatch.from_arrays([pa.array(doc[k]), pa.array(a[k] + low), pa.array(a[k] + high + width)], names=["doc", "low", "high"])

    held, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if size > SORT and row[0] != held[-1][0]:
                yield done(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield done(held)


def _ranked(rows: DataFrame, keys: list[str], hot) -> DataFrame:
    """``rows`` with ``later``: an equal-keyed row with a smaller (doc, a) exists. Rows with ``hot`` go by parts first."""
    part = F.when(hot, F.pmod(F.xxhash64("doc"), F.lit(PARTS))).otherwise(0)
    dealt = rows.withColumn("part", part)
    inner = Window.partitionBy(*keys, "part").orderBy("doc", "a")
    return dealt.withColumn("later", F.rank().over(inner) > 1)


def _by_windows(contents: DataFrame, width: int) -> DataFrame:
    """Spans covered within segments (doc, a, content) that are too many for one sort: each window as a segment of its own, settled as equal segments are, by 128 bits."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spreads = (np.arange(256, dtype=np.uint64), mix(np.arange(256, dtype=np.uint64)))
        for batch in batches:
            for doc, a, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw, n, keys = np.frombuffer(content, np.uint8), len(content) - width + 1, []
                for spread in spreads:
                    sums = np.zeros(len(raw) + 1, np.uint64)
                    np.cumsum((spread[raw] + np.uint64(1)) * powers(_BASE, len(raw)), out=sums[1:])
                    keys.append(mix((sums[width:] - sums[:-width]) * powers(_INVERSE, n)).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1]), pa.array(np.full(n, doc)), pa.array(a + np.arange(n))], names=["c", "e", "doc", "a"])

    dealt = written(_ranked(contents.select("doc", "a", "content").mapInArrow(windows, "c long, e long, doc long, a long"), ["c", "e"], F.lit(True)))
    heads = dealt.where("not later")
    behind = heads.join(heads.groupBy("c", "e").agg(F.min(F.struct("doc", "a")).alias("x")), ["c", "e"]).where("(doc, a) > (x.doc, x.a)").select("doc", "a")
    return dealt.where("later").select("doc", "a").unionByName(behind).select("doc", F.col("a").alias("low"), (F.col("a") + width).alias("high"))


def _by_ranks(contents: DataFrame, width: int) -> DataFrame:
    """The same by the difference cover: all segments (doc, a, content) as one string, ranked across tasks.

    Neighbours in rank are compared over ``width`` bytes; each run of equal
    windows covers all but its first. A segment that is met twice is one.
    """
    distinct = contents.groupBy("doc", "a").agg(F.max_by("content", F.octet_length("content")).alias("content"))
    placed = written(running(distinct, ["doc", "a"], at=F.octet_length("content")))
    n = placed.agg(F.sum(F.octet_length("content"))).first()[0]

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = np.frombuffer(content, np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(at + np.arange(len(raw))), pa.array(raw.astype(np.int64) + 1)], names=["i", "c"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, doc, a, content in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                k = np.arange(len(content) - width + 1)
                yield pa.RecordBatch.from_arrays([pa.array(at + k), pa.array(np.full(len(k), doc)), pa.array(a + k), pa.array([content[x : x + width] for x in k.tolist()], pa.binary())], names=["i", "doc", "a", "w"])

    ranks = suffix_ranks(placed.select("at", "content").mapInArrow(symbols, "i long, c long"), n)
    ordered = placed.select("at", "doc", "a", "content").mapInArrow(windows, "i long, doc long, a long, w binary").join(ranks, "i").withColumn("range", F.shiftright("r", 16))
    ordered = written(ordered.select("range", "r", "doc", "a", "w"))
    ends = ordered.groupBy("range").agg(F.max_by("w", "r").alias("last"))
    left = ends.select("range", F.lag("last").over(Window.orderBy("range")).alias("left"))  # a row for each 65536 suffixes
    before = F.lag("w").over(Window.partitionBy("range").orderBy("r"))
    fresh = ordered.withColumn("before", before).join(left, "range").select("r", "doc", "a", (~F.coalesce("before", "left").eqNullSafe(F.col("w"))).alias("fresh"))
    runs = written(running(fresh, ["r"], run=F.col("fresh").cast("int")).withColumn("run", F.col("run") + F.col("fresh").cast("int")))
    firsts = runs.groupBy("run").agg(F.min(F.struct("doc", "a")).alias("x"), F.max(F.struct("doc", "a")).alias("y")).where("x != y").select("run", "x")
    return runs.join(firsts, "run").where("(doc, a) > (x.doc, x.a)").select("doc", F.col("a").alias("low"), (F.col("a") + width).alias("high"))


def repeated_spans(docs: DataFrame, width: int = WIDTH, across: bool = False) -> DataFrame:
    """``doc, spans``: merged [low, high) byte pairs, flat, of ``docs (doc_id, base, text)``; only documents that have any."""
    counts = written(_minimizers(docs, width, None).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"))
    wanted = _filter(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > max(1000, total / HOT)).select("h", F.lit(True).alias("hot"))  # HOT rows at most
    rows = _minimizers(docs, width, wanted).join(F.broadcast(hot), "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    ranked = written(_ranked(rows, ["h", "c"], F.col("hot")).select("h", "c", "doc", "a", "more", "hot", "later"))
    heads = ranked.where("not later")
    firsts = heads.groupBy("h", "c").agg(F.min(F.struct("doc", "a", "more")).alias("x"), F.max("hot").alias("hot"))
    # Heads of the parts of a hot key, but the first of all.
    behind = heads.where("hot").alias("p").join(firsts.where("hot").alias("q"), ["h", "c"]).where("(doc, a) > (x.doc, x.a)").select("doc", "a", "more")
    spans = ranked.where("later").select("doc", "a", "more").unionByName(behind).select("doc", F.col("a").alias("low"), (F.col("a") + F.col("more") + width).alias("high"))

    classes = firsts.groupBy("h").agg(F.count("*").alias("k")).where("k > 1")
    mixed = written(firsts.join(classes, "h").select("h", "k", "x.doc", "x.a", "x.more"))
    asked = mixed.groupBy("doc").agg(F.collect_list(F.struct("h", "k", "a", "more")).alias("asked"))  # a document's own segments
    texts = docs.select("doc_id", "base", "text")

    def cutout(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for doc, base, text, asked in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode()
                for x in asked:
                    if 0 <= x["a"] - base < TWIN:
                        out.append((x["h"], doc, x["a"], raw[x["a"] - base : x["a"] - base + x["more"] + width], x["k"]))
            for low in range(0, len(out), 20_000):
                cols = list(zip(*out[low : low + 20_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.int64())], names=["h", "doc", "a", "content", "k"])

    contents = texts.join(asked, F.col("doc_id") == F.col("doc")).select("doc_id", "base", "text", "asked").mapInArrow(cutout, "h long, doc long, a long, content binary, k long")
    crowded = mixed.where(F.col("k") > MOST).limit(1).count() > 0
    if crowded:
        contents = written(contents)
    sorts = contents.where(F.col("k") <= MOST).select("h", "doc", "a", "content")
    near = sorts.repartition("h").sortWithinPartitions("h").mapInArrow(lambda b: _sorted_spans(b, width), "doc long, low long, high long")
    spans = spans.unionByName(near)
    if crowded:

        spans = spans.unionByName((_by_ranks if across else _by_windows)(contents.where(F.col("k") > MOST).select("doc", "a", "content"), width))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for flat in batch.column(1):
                pairs = np.asarray(flat.values.flatten()[0].to_numpy()), np.asarray(flat.values.flatten()[1].to_numpy())
                order = np.argsort(pairs[0], kind="stable")
                low, high = pairs[0][order], np.maximum.accumulate(pairs[1][order])
                fresh = np.flatnonzero(np.append(True, low[1:] > high[:-1]))
                out.append(np.stack([low[fresh], high[np.append(fresh[1:], len(low)) - 1]], axis=1).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["doc", "spans"])

    return spans.groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("all")).mapInArrow(merge, "doc long, spans array<long>")


def _placed(twins: DataFrame) -> DataFrame:
    """``key, h1, base``: the texts of each key by their hash, TWIN apart. A key may have any share of the rows: its hashes are ranked by ranges."""
    dealt = twins.withColumn("range", F.shiftright("h1", 52))
    sizes = dealt.groupBy("key", "range").agg(F.count("*").alias("n"))
    before = sizes.select("key", "range", (F.sum("n").over(Window.partitionBy("key").orderBy("range")) - F.col("n")).alias("before"))  # 4096 rows a key at most
    inner = F.row_number().over(Window.partitionBy("key", "range").orderBy("h1")) - 1
    return dealt.withColumn("nth", inner).join(before, ["key", "range"]).select("key", "h1", ((F.col("before") + F.col("nth")) * TWIN).cast("long").alias("base"))


def drop_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, across: bool = False) -> DataFrame:
    """Whole texts, as UTF-8 bytes, less every byte that a repeated string of ``width`` bytes covers.

    A string counts as repeated where it also starts earlier, in a document of
    smaller id or earlier in the same; strings are judged on the input, never
    cross documents, and their overlaps all count. Returns ``doc_id, n_bytes,
    n_removed, n_spans, kept_sha256``, and ``kept`` (binary, as a cut may fall
    within a character) with ``keep``; a row for each input row. Null and empty
    texts have 0 bytes. Rows equal in id and text are one document; rows of one
    id with different texts follow each other by the hash of the text; a null
    id comes before all others. Other columns are ignored; an empty table gives
    an empty result. ``across`` sorts crowded segments across tasks instead of
    settling their windows by hash: no hash decides there, for some 400 bytes
    of shuffles a byte.
    """
    lowest = F.lit(-(2**63)).cast("long")
    texts = id_text(docs, id_col, text_col).withColumns({"key": F.coalesce("doc_id", lowest), "h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(3), "text"), "n": F.octet_length("text")})
    slim = written(texts.select("key", "h1", "h2", "n"))
    twins = slim.groupBy("key").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x != y").select("key")
    base = F.lit(0).cast("long")
    if not twins.isEmpty():
        order = written(_placed(slim.join(twins, "key").select("key", "h1").distinct()))
        texts, slim = (x.join(order, ["key", "h1"], "left").withColumn("base", F.coalesce("base", base)) for x in (texts, slim))
    else:
        texts, slim = texts.withColumn("base", base), slim.withColumn("base", base)
    same = slim.where(F.col("n") >= width).groupBy("h1", "h2", "n").agg(F.min(F.struct("key", "base")).alias("x"), F.max(F.struct("key", "base")).alias("y")).where("x != y").select("h1", "h2", "n", "x")
    copies = written(slim.join(same, ["h1", "h2", "n"]).where("(key, base) > (x.key, x.base)").select("key", "base", F.col("n").cast("long").alias("n")).distinct())
    few = lambda df, n: F.broadcast(df) if n <= BROADCAST // 2 else df
    judged = texts.join(few(copies.select("key", "base"), copies.count()), ["key", "base"], "left_anti").where(F.col("n") >= width)
    found = written(repeated_spans(judged.select(F.col("key").alias("doc_id"), "base", "text"), width, across))
    whole = copies.select(F.col("key").alias("doc"), F.array(F.col("base"), F.col("base") + F.col("n")).alias("spans"))
    spans = found.unionByName(whole)
    ends, rows = spans.agg(F.sum(F.size("spans")), F.count("*")).first()
    per_doc = spans.groupBy("doc").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    joined = texts.join(F.broadcast(per_doc) if (ends or 0) <= BROADCAST else per_doc, F.col("key") == F.col("doc"), "left").select("doc_id", "base", "text", "spans")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, at, text, spans in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw, own = text.encode(), []
                for low, high in zip((spans or ())[::2], (spans or ())[1::2], strict=True):
                    if at <= low < at + TWIN:
                        own.append((low - at, high - at))
                own.sort()
                parts, done = [], 0
                for low, high in own:
                    parts.append(raw[done:low])
                    done = high
                kept = b"".join([*parts, raw[done:]])
                out.append((doc, len(raw), len(raw) - len(kept), len(own), hashlib.sha256(kept).hexdigest(), kept if keep else None))
            if out:
                cols = list(zip(*out, strict=True))
                arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string())]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(cols[5], pa.binary())] if keep else arrays, names=[*names, "kept"] if keep else names)

    return joined.mapInArrow(strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep)
