"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its distinct five-word shingles. All shingles have one
order: by class of frequency (counted over all documents), then by hash. Two
sets with a Jaccard likeness of at least ``percent`` share one of the first
``n - ceil(percent n / 100) + 1`` shingles of each; where a document's prefix
lengthened by ``l - 1`` more, they share at least the smaller ``l``. Each
document lengthens its prefix by the number of frequent shingles in it, the
estimated cost of its candidates, and so asks for as many more shared ones.

From shared prefix shingles to links, without all pairs of a group:

1. Equal sets are one class; one document stands for it.
2. The centre of a shingle's list is its smallest document. Lists of one centre
   are one group: a row for each document in it, with the number of prefix
   shingles that led there, whatever their number. Two documents that share a
   prefix shingle meet in the group of its centre.
3. Each document is verified against the centre it shares most with; these
   links make the first components.
4. In each group, members are compared by signatures across components, a block
   at a time. In two rounds the likeliest pair of each document is verified, and
   components grow; then all pairs that are still across components and can
   reach the threshold.

Step 3 and the rounds of 4 only save work: two documents of one component need
no link of their own to be in it, and the end of 4 looks at all other pairs, so
no link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, frugal, id_text, pooled, set_aside, slices, written
from .graph import components
from .shingles import WORDS, mix, shingle_sets

#: Shingles that at least so many documents hold are frequent. Doubled until the frequent ones are 2 ** MOST_BITS at most.
LEAST, MOST_BITS = 16, 21
#: Counters of a reducer's share of the counting, and shingles of a task that are packed at once.
RANGE, PACK = 22, 1 << 21
#: Places of the table of frequency classes that is broadcast: 2 ** TABLE at most.
TABLE = 24
#: Rows that are broadcast at most (two numbers each); larger sides are shuffled.
BROADCAST = 500_000
#: Bits of the signatures that travel with groups; pairs that pass are compared by their full ones.
BRIEF = 1024
#: Rows of a group that one task holds at once; a longer group is dealt to pairs of blocks.
BLOCK = 4096
#: Text bytes, and pairs of a group, that are worked on by vectors at once.
SLICE, PAIRS = 1 << 18, 50_000


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST else df


def pack(slots: np.ndarray, width: int) -> bytes:
    """Ascending numbers as differences of ``width`` bytes; the largest value says that the difference goes on."""
    kind, top = np.dtype(f"u{width}"), (1 << 8 * width) - 1
    steps = np.diff(slots, prepend=0)
    more = steps // top
    out = np.full(int(more.sum()) + len(steps), top, kind)
    out[np.cumsum(more + 1) - 1] = (steps % top).astype(kind)
    return out.tobytes()


def unpack(packed: bytes, width: int) -> np.ndarray:
    steps = np.frombuffer(packed, f"u{width}")
    return np.cumsum(steps, dtype=np.int64)[steps != (1 << 8 * width) - 1]


def packs(held: list[np.ndarray], bits: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Range, packed slots, slots met more than once and how often beyond once, of a pack's shingles; empties ``held``.

    A pack is sorted in place and told apart range by range, so that it takes
    twice its own size at most.
    """
    slots = np.concatenate(held)
    held.clear()
    slots >>= np.uint64(64 - bits)
    slots.sort()
    slots = slots.view(np.int64)
    edges = np.searchsorted(slots, np.arange((1 << bits - RANGE) + 1, dtype=np.int64) << RANGE)
    for r in np.flatnonzero(np.diff(edges)).tolist():
        part, c = np.unique(slots[edges[r] : edges[r + 1]] - (r << RANGE), return_counts=True)
        yield r, pack(part, _width(bits)), part[c > 1].astype(np.int32).tobytes(), (c[c > 1] - 1).astype(np.int32).tobytes()


def _slot_bits(texts: DataFrame) -> int:
    """Bits of a shingle's slot: about two slots for each shingle of the corpus, one task's share at least."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(RANGE, min(46, math.ceil(math.log2(max(1, size) / 3.5))))


def _width(bits: int) -> int:
    """Bytes of a packed difference, by the usual gap of a full pack."""
    return 1 if bits <= 29 else 2 if bits <= 37 else 4


def _sets(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """A row for each document (its set's size, 128-bit hash and signatures), and rows of packed slots by range of the counting."""

    def packed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for some in batched(packs(held, bits), 64):
            ranges, *parts = zip(*some, strict=True)
            none = [pa.nulls(len(ranges), k) for k in (pa.int64(),) * 5 + (pa.binary(),) * 2]
            yield pa.RecordBatch.from_arrays([*none, pa.array(ranges, pa.int64()), *(pa.array(x, pa.binary()) for x in parts)], names=names)

    names = ["doc_id", "text_hash", "n", "k1", "k2", "sign", "brief", "range", "once", "often", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, have = [], 0
        for batch in slices(batches, most=SLICE):
            sets = shingle_sets(batch.column(2), size)
            n = np.array([len(s) for s in sets], np.int64)
            every = np.concatenate(sets)
            at = np.concatenate([[0], np.cumsum(n)])
            keys = []
            for salt in (0x1234567, 0x89ABCDEF01):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(every ^ np.uint64(salt)))])
                keys.append(mix(sums[at[1:]] - sums[at[:-1]] + n.astype(np.uint64)).view(np.int64))
            signs = [signature(x) for x in sets]
            briefs = [_fold(x).tobytes() for x in signs]
            empty = [pa.nulls(len(n), k) for k in (pa.int64(),) + (pa.binary(),) * 3]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(keys[0]), pa.array(keys[1]), pa.array(signs, pa.binary()), pa.array(briefs, pa.binary()), *empty], names=names)
            held.append(every)
            have += len(every)
            if have >= PACK:
                yield from packed(held)
                have = 0
        if have:
            yield from packed(held)

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(frugal(run), "doc_id long, text_hash long, n long, k1 long, k2 long, sign binary, brief binary, range long, once binary, often binary, times binary")


def _frequent(found: DataFrame, bits: int) -> DataFrame:
    """``slot, level``: the slots that LEAST documents or more fall on; the level counts doublings."""
    width = _width(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(r: int, counts: np.ndarray) -> pa.RecordBatch:
            slots = np.flatnonzero(counts >= LEAST)
            return pa.RecordBatch.from_arrays([pa.array(slots + (r << RANGE)), pa.array(np.log2(counts[slots] / LEAST).astype(np.int32))], names=["slot", "level"])

        last, counts = None, np.zeros(1 << RANGE, np.int64)
        for batch in batches:
            for r, *parts in zip(batch.column(0).to_pylist(), *(batch.column(k) for k in (1, 2, 3)), strict=True):
                if r != last:
                    if last is not None:
                        yield done(last, counts)
                    last = r
                    counts[:] = 0
                once, often, times = (x.as_py() for x in parts)
                counts[unpack(once, width)] += 1  # each slot once in a pack
                counts[np.frombuffer(often, np.int32)] += np.frombuffer(times, np.int32)
        if last is not None:
            yield done(last, counts)

    packs = found.where("range is not null").select("range", "once", "often", "times")
    return packs.repartition("range").sortWithinPartitions("range").mapInArrow(frugal(run), "slot long, level int")


def _levels(found: DataFrame, bits: int) -> np.ndarray:
    """Frequency class of each place of a table: 0 for the ordinary, 1 and up by doublings. A table's place is the slot's first bits."""
    frequent = cut(_frequent(found, bits))
    sizes = dict(frequent.groupBy("level").count().collect())  # a row for each doubling
    lowest = 0
    while sum(c for level, c in sizes.items() if level >= lowest) > 1 << MOST_BITS:
        lowest += 1
    rows = frequent.where(F.col("level") >= lowest).toArrow()  # 2 ** MOST_BITS rows at most
    wide = min(TABLE, bits)
    levels = np.zeros(1 << wide, np.uint8)
    if rows.num_rows:
        np.maximum.at(levels, rows.column(0).to_numpy() >> (bits - wide), (rows.column(1).to_numpy() - lowest + 1).astype(np.uint8))
    return levels


def signature(s: np.ndarray) -> bytes:
    """Parities of how many shingles fall on each of about twice as many bits as there are shingles, BRIEF at least.

    Two signatures differ in at most as many bits as the sets differ in
    shingles; halving one (by exclusive or) keeps that.
    """
    bits = max(BRIEF, 1 << (2 * len(s)).bit_length())
    at = (s & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def may_reach(x: bytes, y: bytes, n: int, m: int, percent: int) -> bool:
    """Whether sets of ``n`` and ``m`` shingles with these signatures can reach the threshold."""
    a, b, wide, narrow = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * len(x), 8 * len(y)
    while wide != narrow:
        if wide < narrow:
            a, b, wide, narrow = b, a, narrow, wide
        wide //= 2
        a = (a >> wide) ^ (a & (1 << wide) - 1)
    common = (n + m - (a ^ b).bit_count()) // 2  # at most
    return 100 * common >= percent * (n + m - common)


def _fold(sign: bytes) -> np.ndarray:
    """A signature as BRIEF bits, in numbers of 64 bits, halved as often as it takes."""
    words = np.frombuffer(sign, np.uint64)
    while len(words) > BRIEF // 64:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def prefix_length(n: int, percent: int, more: int = 0) -> int:
    """Shingles of an ``n``-set's prefix that asks for ``1 + more`` shared ones; ``more`` below ``overlap(n, percent)``."""
    return n - overlap(n, percent) + 1 + more


def overlap(n: int, percent: int) -> int:
    """Shingles that an ``n``-set shares with any that it links to, at least."""
    return -(-percent * n // 100)


def _index(docs: DataFrame, shared: Broadcast, wide: int, percent: int, size: int) -> DataFrame:
    """A row for each prefix shingle: token, doc, n (set size), l (shared ones asked for), level (``shared`` has it by the hash's first ``wide`` bits)."""
    shift = np.uint64(64 - wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of = shared.value
        for batch in slices(batches, most=SLICE):
            sets = shingle_sets(batch.column(1), size)
            parts = []
            for s in sets:
                level = level_of[(s >> shift).astype(np.int64)]
                order = np.argsort(level, kind="stable")
                first = prefix_length(len(s), percent) if len(s) else 0
                more = min(int((level[order[:first]] > 0).sum()), max(0, overlap(len(s), percent) - 1))
                order = order[: first + more]
                parts.append((s[order], level[order], 1 + more))
            sizes = np.array([len(p[0]) for p in parts], np.int64)
            if not sizes.sum():
                continue
            docs_of = np.repeat(np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64), sizes)
            columns = [np.concatenate([p[0] for p in parts]).view(np.int64), docs_of, np.repeat([len(s) for s in sets], sizes).astype(np.int32), np.repeat([p[2] for p in parts], sizes).astype(np.int32), np.concatenate([p[1] for p in parts]).astype(np.int32)]
            for low in range(0, len(docs_of), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[low : low + 100_000]) for c in columns], names=["token", "doc", "n", "l", "level"])

    return docs.mapInArrow(frugal(run), "token long, doc long, n int, l int, level int")


def _groups(index: DataFrame) -> DataFrame:
    """``centre, doc, n, l, k, mask``: the lists, joined by centre, that hold more than one document.

    ``k`` counts the shingles that led the document there; ``mask`` has a bit
    for each by its hash. A frequent shingle's list is dealt to parts with a
    centre each first, and these have theirs.
    """
    parts = F.expr("shiftleft(4, least(level, 18))")
    salted = index.withColumn("part", F.when(F.col("level") == 0, 0).otherwise(F.pmod(F.xxhash64("doc"), parts)))
    lists = Window.partitionBy("token", "part")
    met = salted.select("token", "doc", "n", "l", "level", F.min("doc").over(lists).alias("centre"), F.max("doc").over(lists).alias("other"))
    live = written(met.where("centre != other or level > 0").select("token", "doc", "n", "l", F.col("level").alias("frequent").cast("boolean"), "centre"))
    tops = cut(pooled(live.where("frequent").groupBy("token").agg(F.min("centre").alias("top"), F.max("doc").alias("other")).where("top != other").select("token", "top")))
    dealt = live.where("frequent").join(_small(tops, tops.count()), "token").withColumn("centre", F.col("top")).drop("top")
    every = live.where("not frequent").unionByName(dealt)
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(token), 64) as int))")
    return written(every.groupBy("centre", "doc").agg(F.first("n").alias("n"), F.first("l").alias("l"), F.count("*").alias("k"), F.bit_or(bit).alias("mask")))


def possible(signs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their signatures let reach the threshold: no linked pair is lost."""
    x, y = (signs.select(F.col("doc_id").alias(k), F.col("sign").alias(f"sign_{k}"), F.col("n").alias(f"n_{k}")) for k in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(k) for k in range(2, 6)]
            yield batch.select([0, 1]).filter(pa.array([may_reach(*(x.as_py() for x in c), percent) for c in zip(*cols, strict=True)], pa.bool_()))

    return pairs.join(x, "a").join(y, "b").select("a", "b", "sign_a", "sign_b", "n_a", "n_b").mapInArrow(frugal(run), "a long, b long").distinct()


def verified(docs: DataFrame, signs: DataFrame, pairs: DataFrame, percent: int, size: int = WORDS) -> DataFrame:
    """The pairs (a, b) whose whole texts reach the threshold, by exact set sizes.

    Signatures sort out most of the others first. The texts of ``a`` travel to
    their ``b``; a ``b`` with many pairs is a skewed key of a plain join, which
    Spark splits.
    """
    pairs = cut(pooled(possible(signs, pairs.select("a", "b"), percent)))
    n = pairs.count()
    left = docs.join(_small(pairs, n), docs["doc_id"] == pairs["a"]).select("a", "b", F.col("text").alias("text_a"))
    ends = pairs.select("b").distinct()
    right = docs.join(_small(ends, n), docs["doc_id"] == ends["b"]).select("b", F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, np.ndarray | None] = (None, None)
        for batch in slices(batches, "text_a", SLICE):
            ok = np.zeros(batch.num_rows, bool)
            sets = shingle_sets(batch.column(2), size)
            for i, (s, text) in enumerate(zip(sets, batch.column(3), strict=True)):
                text = text.as_py()
                if text != last[0]:
                    last = (text, shingle_sets(pa.array([text]), size)[0])
                common = len(np.intersect1d(s, last[1], assume_unique=True))
                ok[i] = 100 * common >= percent * (len(s) + len(last[1]) - common) and common > 0
            yield batch.select([0, 1]).filter(pa.array(ok))

    return cut(pooled(left.join(right.hint("merge"), "b").select("a", "b", "text_a", "text_b").mapInArrow(frugal(run), "a long, b long").distinct()))


def group_pairs(doc: np.ndarray, component: np.ndarray, block: np.ndarray, n: np.ndarray, k: np.ndarray, mask: np.ndarray, brief: np.ndarray, percent: int, between: bool, best: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, shared shingles at most) of a group's pairs across components that may reach the threshold.

    The members of the largest component meet the others only. ``between``
    leaves pairs within a block to others. With ``best``, each row outside the
    largest component gives only its pair of highest bound.
    """
    names, size = np.unique(component, return_counts=True)
    minor = component != names[size.argmax()]
    outside = np.flatnonzero(minor)
    rows, others = [], []
    step = max(1, PAIRS // len(doc))
    for low in range(0, len(outside), step):
        x = outside[low : low + step, None]
        ok = (component != component[x]) & ((mask & mask[x]) != 0) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
        if not best:
            ok &= ~minor | (doc < doc[x])
        if between:
            ok &= block != block[x]
        i, y = np.nonzero(ok)
        i = x[i, 0]
        total = n[i] + n[y]
        common = (total - np.bitwise_count(brief[i] ^ brief[y]).sum(axis=1, dtype=np.int64)) // 2
        good = np.flatnonzero(100 * common >= percent * (total - common))
        if best and len(good):
            good = good[np.lexsort((doc[y[good]], -common[good] / (total - common)[good], i[good]))]
            good = good[np.append(True, i[good][1:] != i[good][:-1])]
        rows.append(i[good])
        others.append(y[good])
    i, y = (np.concatenate(c) if c else np.empty(0, np.int64) for c in (rows, others))
    return i, y, np.minimum(k[i], k[y])


def _across(groups: DataFrame, signs: DataFrame, labels: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs (a, b) across components whose brief signatures let them reach the threshold and that may share enough prefix shingles.

    Two documents share at most as many prefix shingles as the smaller ``k`` of
    theirs, summed over the groups in which they meet.
    """
    marked = groups.join(labels.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    share = marked.groupBy("centre").agg(F.count("*").alias("m"), F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("centre", "m")
    mixed = marked.join(share, "centre").join(signs.select(F.col("doc_id").alias("doc"), "brief"), "doc")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = mixed.withColumn("block", F.pmod(F.xxhash64("doc"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("centre", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "doc", "component", "block", "n", "l", "k", "mask", "brief")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            if len(cols[0]) > 1:
                doc, n, l, k = cols[3], cols[6], cols[7], cols[8]
                i, j, c = group_pairs(doc, cols[4], cols[5], n, k, cols[9], cols[10], percent, bool(cols[1][0] != cols[2][0]), best)
                for low in range(0, len(i), 100_000):
                    x, y = i[low : low + 100_000], j[low : low + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(doc[x], doc[y])), pa.array(np.minimum(doc[x], doc[y])), pa.array(np.minimum(l[x], l[y])), pa.array(c[low : low + 100_000])], names=["a", "b", "l", "c"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(10)]
            _, at, data = batch.column(10).buffers()
            first = np.frombuffer(at, np.int32)[batch.column(10).offset]
            cols.append(np.frombuffer(data, np.uint64, batch.num_rows * (BRIEF // 64), int(first)).reshape(batch.num_rows, -1))
            edges = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                key = tuple(int(c[low]) for c in cols[:3])
                if held and key != last:
                    yield from flush()
                last = key
                held.append([c[low:high].copy() for c in cols])
        if held:
            yield from flush()

    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, as the work is more than the bytes tell
    pairs = dealt.repartition(tasks, "centre", "low", "high").sortWithinPartitions("centre", "low", "high").mapInArrow(frugal(run), "a long, b long, l long, c long")
    if best:
        return pairs.select("a", "b").distinct()
    return pairs.groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("l").alias("l")).where("c >= l").select("a", "b")


def _hooked(parents: DataFrame, rounds: int = 2) -> DataFrame:
    """``node, component`` of a table that hooks each node to a smaller one: its ancestor, 2 ** rounds steps up at most."""
    for _ in range(rounds):
        up = parents.select(F.col("node").alias("component"), F.col("component").alias("up"))
        parents = parents.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
    return cut(pooled(parents))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after ``links``. Nodes of one component are linked somehow, but not all that are need share one: it only saves work."""
    of = lambda k: labels.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("x"), F.coalesce("cb", "b").alias("y")).where("x != y")
    hooks = _hooked(ends.groupBy(F.greatest("x", "y").alias("node")).agg(F.min(F.least("x", "y")).alias("component")))
    above = hooks.select(F.col("node").alias("component"), F.col("component").alias("up"))
    return cut(pooled(labels.join(above, "component", "left").select("node", F.coalesce("up", "component").alias("component")).unionByName(hooks.join(labels.select("node"), "node", "left_anti"))))


def likeness_components(docs: DataFrame, percent: int = 75, size: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sizes of the shingle sets and components of the links.

    Returns ``doc_id, n_shingles, component_id, class_id``, a row for each
    input row. ``component_id`` is the smallest ``doc_id`` reachable by links,
    itself included; ``class_id`` is the smallest with the very same set. Two
    documents link where ``100 * common >= percent * union``, ``percent`` from
    1 to 100. Documents without words, null and empty texts, have 0 shingles
    and link with nothing; a text of fewer words than a shingle is its only
    one. Rows of one id are linked with each other; a null id has null
    component and class and links with nothing. Other columns are ignored; an
    empty table gives an empty result.
    """
    if not 1 <= percent <= 100:
        raise ValueError(f"percent must lie between 1 and 100, not {percent}")
    texts = id_text(docs, id_col, text_col)
    bits = _slot_bits(texts)
    found = written(_sets(texts, size, bits))
    levels = _levels(found, bits)
    rows = found.where("n is not null").select("doc_id", "text_hash", "n", "k1", "k2")
    known = rows.where("doc_id is not null and n > 0")
    signs = found.where("doc_id is not null and n > 0").select("doc_id", "sign", "brief", "n")
    classes = known.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"))
    members = known.join(classes, ["k1", "k2"])
    copies = cut(pooled(members.where("doc_id != rep.doc_id or text_hash != rep.text_hash").select("doc_id", "text_hash", F.col("rep.doc_id").alias("class_id")).distinct()))
    none = cut(pooled(rows.where("doc_id is null or n = 0").select("doc_id", "text_hash").where("doc_id is not null").distinct()))
    keyed = texts.where("doc_id is not null").withColumn("text_hash", F.xxhash64("text"))
    for gone in (copies, none):
        keyed = keyed.join(_small(gone.select("doc_id", "text_hash"), gone.count()), ["doc_id", "text_hash"], "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    groups = _groups(_index(keyed.select("doc_id", "text"), shared, (len(levels) - 1).bit_length(), percent, size))
    shared.destroy()  # the groups are written

    # The centre that each document shares most with, where that is about half the prefix that the threshold asks for.
    met = groups.where("doc != centre").where(F.col("k") * 1750 >= (percent * 2 - 100) * F.col("n")).groupBy("doc").agg(F.max(F.struct("k", "centre")).alias("x"))
    links = verified(texts, signs, met.select(F.col("doc").alias("a"), F.col("x.centre").alias("b")), percent, size)
    labels = _hooked(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")))
    for best in (True, True, False):
        more = verified(texts, signs, _across(groups, signs, labels, percent, best), percent, size)
        links = links.unionByName(more)
        labels = _merged(labels, more) if best else labels
    same_id = members.select(F.col("doc_id").alias("a"), F.col("rep.doc_id").alias("b")).where("a != b")
    labels = components(links.unionByName(same_id))
    tagged = rows.join(classes, ["k1", "k2"], "left").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    lone = F.col("doc_id").isNull() | (F.col("n") == 0)
    return tagged.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.when(lone, F.col("doc_id")).otherwise(F.col("rep.doc_id")).alias("class_id"))


def one_of_each(docs: DataFrame, percent: int = 75, size: int = WORDS) -> DataFrame:
    """``docs`` (with ``doc_id, text``), less all documents but the one of smallest id of each component.

    Of rows that share an id, the one with the smallest hash of its text stays;
    rows without an id stay. All columns are kept as they are.
    """
    columns = docs.columns
    docs, names = set_aside(docs, "doc_id", "text")
    found = cut(likeness_components(docs, percent, size).select("doc_id", "component_id"))
    gone = cut(pooled(found.where("doc_id != component_id").select("doc_id").distinct()))
    left = docs.join(_small(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)
    twins = cut(pooled(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")))
    n = twins.count()
    if not n:
        return left.withColumnsRenamed(names).select(*columns)
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    first = left.join(_small(twins, n), "doc_id", "left_semi").withColumn("__at", F.row_number().over(order)).where("__at = 1").select(*docs.columns)
    return left.join(_small(twins, n), "doc_id", "left_anti").select(*docs.columns).unionByName(first).withColumnsRenamed(names).select(*columns)
