"""Benchmark decontamination by the CGK embedding, bit-sampling LSH and exact edit distance.

Texts are words: runs of letters and digits, lower case, hashed. A window that
starts at a word is walked with a random bit for each step and word: the step
writes down the word and moves on if its bit is 1 (CGK), so that few edits of
the window leave few differing steps. A repetition has bits of its own and a
few sampled steps; windows and benchmark items that agree in all of them are
candidates. Items are searched by classes of like length, each with windows of
the words of its shortest item and steps sampled over all of them; longer items
of the class are walked as far. Repetitions are added until edited
copies of a class's items reach the target recall; a class that doesn't reach
it is searched without loss, by the rarest word pairs of its items. Candidates are decided by the exact edit distance in words: up
to ``1 - similarity`` of the item's words.

Windows are walked only where enough word pairs of any item lie close together;
an occurrence within the distance always has that many (each edit destroys two
pairs at most), so this loses nothing where the item keeps a pair (for a
similarity of 0.7 and more, any). So an occurrence also has one of any choice
of twice the allowed edits and one more of the item's pairs: the exact search
looks only where the rarest of them are.
"""

from __future__ import annotations

import math
import random
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, id_text, slices, text_buffer
from .shingles import mix, runs, words

#: Items of fewer words must occur as they are.
SHORT = 5
#: Items of one pass, and bytes of their texts, on average; a larger benchmark takes several passes over the documents.
BLOCK, BYTES = 50_000, 16 << 20
STEPS_A_WORD, SAMPLED, MOST_REPETITIONS = 2, 2, 64
#: Longest item of a length class by its shortest; simulated copies of a class and kind at least.
SPREAD, COPIES = 1.25, 300
_OTHER = np.ones(256, bool)
_OTHER[48:58] = _OTHER[65:91] = _OTHER[97:123] = False
_OTHER[128:] = False
_FILTER = 20  # bits of the word-pair filter


def lowered(raw: np.ndarray) -> np.ndarray:
    """Bytes with the capitals of ASCII and Latin-1 made small."""
    out = raw.copy()
    out[(raw >= 65) & (raw <= 90)] += 32
    if len(raw) > 1:
        out[1:][(raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)] += 32
    return out


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (bytes in the text), rows and hashes of the words of a column, and the first word of each row."""
    raw, at = text_buffer(column)
    start, end, row, hashes = words(lowered(raw), at, _OTHER)
    return start - at[row], end - at[row], row, hashes, np.searchsorted(row, np.arange(len(column) + 1))


def allowed(n: int, similarity: float) -> int:
    """Edits allowed for an item of ``n`` words."""
    return 0 if n < SHORT else math.floor(n * (1 - similarity) + 1e-9)


def ends_within(item: list[int], text: list[int], most: int) -> list[tuple[int, int]]:
    """(end, distance) of the stretches of ``text`` within ``most`` edits of ``item``, by bit-parallel columns."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    n, full = len(item), (1 << len(item)) - 1
    plus, minus, d, out = full, 0, n, []
    for j, w in enumerate(text):
        eq = masks.get(w, 0)
        x = eq | minus
        down = (((eq & plus) + plus) ^ plus) | eq
        up, low = minus | ~(down | plus) & full, plus & down
        if up >> (n - 1) & 1:
            d += 1
        elif low >> (n - 1) & 1:
            d -= 1
        up, low = up << 1 & full, low << 1 & full
        plus, minus = low | ~(x | up) & full, up & x
        if d <= most:
            out.append((j + 1, d))
    return out


def best_match(item: list[int], text: list[int], most: int) -> tuple[int, int, int] | None:
    """(start, end, distance) of the closest stretch, the first and then shortest of equals; None beyond ``most``."""
    ends = ends_within(item, text, most)
    if not ends:
        return None
    d = min(x[1] for x in ends)
    end = next(e for e, x in ends if x == d)
    back = ends_within(item[::-1], text[:end][::-1], d)
    sizes = [e for e, x in back if x == d]
    return end - min(sizes), end, d


def occurrences(item: list[int], text: list[int], most: int) -> list[tuple[int, int, int]]:
    """(start, end, distance) of the stretches within ``most`` edits that don't overlap, closest first, then first, then shortest."""
    n, out, todo = len(item), [], [(0, len(text))]
    while todo:
        low, high = todo.pop()
        taken: list[tuple[int, int]] = []
        for d, end in sorted((d, low + e) for e, d in ends_within(item, text[low:high], most)):
            at = bisect_left(taken, (end, 0))
            before = taken[at - 1][1] if at else low
            if end - n + d < before:
                continue  # overlaps what is closer
            back = ends_within(item[::-1], text[max(low, end - n - d) : end][::-1], d)
            start = end - min(e for e, x in back if x == d)
            if start >= before:
                taken.insert(at, (start, end))
                out.append((start, end, d))
        if taken:
            edges = [low, *(x for pair in taken for x in pair), high]
            todo += [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= n - most]
    return sorted(out)


@dataclass
class Lengths:
    """Items of like length."""

    members: list[int]
    pairs: np.ndarray  # filter of the items' word pairs
    dense: list[tuple[int, int]]  # by length of item: words of its longest occurrence, word pairs that any has
    repetitions: list[tuple] = field(default_factory=list)  # seed, sampled steps, keys after each, full key -> items
    window: int = 0  # words that a walk sees: those of the class's shortest item
    rare: tuple[np.ndarray, np.ndarray] | None = None  # word pairs, ascending, and their items, where the search is exact


@dataclass
class Tables:
    """What the executors need of a block of items."""

    ids: list[int]
    items: list[list[int]]
    most: list[int]
    pairs: np.ndarray  # filter of the word pairs of all classes
    short: dict[int, dict[int, list[int]]]  # by length, run hash -> items
    own: dict[int, set[int]] = field(default_factory=dict)  # item -> its word pairs
    classes: list[Lengths] = field(default_factory=list)


def _walk(hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int, sampled: list[int]) -> Iterator[tuple[np.ndarray, int]]:
    """The word written at each sampled step (0 beyond the window); the caller may narrow ``starts`` in between by ``send``."""
    here = starts.copy()
    for step in range(sampled[-1] + 1):
        inside = here < stops
        symbol = np.where(inside, hashes[np.minimum(here, len(hashes) - 1)], np.uint64(0))
        if step in sampled:
            keep = yield symbol, step
            here, stops, symbol, inside = here[keep], stops[keep], symbol[keep], inside[keep]
        here += (mix(symbol ^ np.uint64(seed + step * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64(1)).astype(np.int64) & inside


def candidates(hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray, repetitions: list[tuple]) -> set[tuple[int, int]]:
    """(start, item) pairs that agree with an item in all sampled steps of a repetition."""
    found: set[tuple[int, int]] = set()
    for seed, sampled, heads, known in repetitions:
        left, key = np.arange(len(starts)), np.zeros(len(starts), np.uint64)
        walk = _walk(hashes, starts, stops, seed, sampled)
        got = next(walk, None)
        while got is not None:
            key = mix(key ^ got[0])
            keep = np.isin(key, heads[got[1]])
            left, key = left[keep], key[keep]
            if not len(left):
                break
            try:
                got = walk.send(keep)
            except StopIteration:
                break
        for i, k in zip(left.tolist(), key.tolist(), strict=True):
            found.update((int(starts[i]), item) for item in known.get(k, ()))
    return found


def _repetition(items: list[np.ndarray], seed: int, sampled: list[int]):
    """Item keys of a repetition: those after each sampled step, and the full ones by item."""
    flat = np.concatenate(items)
    sizes = np.array([len(x) for x in items])
    stops = np.cumsum(sizes)
    starts = stops - sizes
    heads, key = {}, np.zeros(len(items), np.uint64)
    walk = _walk(flat, starts, stops, seed, sampled)
    got = next(walk)
    while True:
        key = mix(key ^ got[0])
        heads[got[1]] = np.unique(key)
        try:
            got = walk.send(np.arange(len(items)))
        except StopIteration:
            break
    known: dict[int, list[int]] = {}
    for i, k in enumerate(key.tolist()):
        known.setdefault(k, []).append(i)
    return seed, sampled, heads, known


def _slots(hashes: np.ndarray) -> np.ndarray:
    """Place of each word pair in a filter."""
    return (runs(hashes, 2) >> np.uint64(64 - _FILTER)).astype(np.int64)


def _edited(item: list[int], most: int, kind: int, r: random.Random) -> list[int]:
    """A copy with ``most`` edits: 0 all over it, 1 its first words replaced, 2 words in a row replaced."""
    out = list(item)
    if kind:
        at = 0 if kind == 1 else r.randrange(len(out) - most + 1)
        out[at : at + most] = [r.getrandbits(64) for _ in range(most)]
        return out
    for _ in range(most):
        kind, at = r.randrange(3), r.randrange(len(out))
        out[at : at + (kind != 0)] = [r.getrandbits(64)] if kind < 2 else []
    return out


def _dense(near: np.ndarray, dense: list[tuple[int, int]]) -> np.ndarray:
    """The places of ``near`` that lie in a group of enough word pairs."""
    edge = np.zeros(len(near) + 1, np.int64)
    for reach, least in dense:
        k = least - 1
        close = np.flatnonzero(near[k:] - near[: len(near) - k] < reach) if len(near) > k else near[:0]
        np.add.at(edge, close, 1)
        np.add.at(edge, close + k + 1, -1)
    return near[np.cumsum(edge[:-1]) > 0]


def _starts(near: np.ndarray, dense: list[tuple[int, int]], n: int) -> np.ndarray:
    """Starts of the windows that may hold enough of the word pairs at ``near``, in ``n`` words."""
    edge = np.zeros(n + 1, np.int64)
    for reach, least in dense:
        k = least - 1
        close = np.flatnonzero(near[k:] - near[: len(near) - k] < reach) if len(near) > k else near[:0]
        np.add.at(edge, np.maximum(near[close + k] - reach, 0), 1)  # a window of any of these starts holds the pairs
        np.add.at(edge, near[close] + 1, -1)
    return np.flatnonzero(np.cumsum(edge[:-1]))


def _lengths(members: list[int], texts: list[np.ndarray], most: list[int], recall: float, r: random.Random) -> Lengths:
    """A length class (``members`` by length) with its repetitions; the copies lie in longer text, as occurrences do."""
    pairs = np.zeros(1 << _FILTER, bool)
    for i in members:
        pairs[_slots(texts[i])] = True
    out = Lengths(members, pairs, sorted({(len(texts[i]) + most[i], max(1, len(texts[i]) - 1 - 2 * most[i])) for i in members}))
    rounds = -(-COPIES // len(members))
    shortest, longest = len(texts[members[0]]), len(texts[members[-1]])
    out.window = shortest
    around = lambda n: [r.getrandbits(64) for _ in range(n)]
    copies = [(i, np.array(around(longest) + _edited(texts[i].tolist(), most[i], kind, r) + around(STEPS_A_WORD * longest), np.uint64)) for kind in range(3) for i in members for _ in range(rounds)]
    each = len(copies) // 3
    missed = list(range(len(copies)))
    while missed and len(out.repetitions) < MOST_REPETITIONS and max(np.bincount(np.array(missed) // each)) > (1 - recall) * each:
        sampled = sorted(r.sample(range(STEPS_A_WORD * shortest), SAMPLED))
        one = _repetition([texts[i][:shortest] for i in members], r.getrandbits(63), sampled)
        out.repetitions.append((*one[:3], {k: [members[j] for j in v] for k, v in one[3].items()}))
        stops = np.cumsum([len(copies[c][1]) for c in missed])
        flat = np.concatenate([copies[c][1] for c in missed])
        near = np.flatnonzero(pairs[_slots(flat)])
        starts = _starts(near, out.dense, len(flat))
        true = np.append(0, stops[:-1]) + longest
        place = np.minimum(np.searchsorted(stops, starts, side="right"), len(missed) - 1)
        here = np.abs(starts - true[place]) <= np.array([most[copies[c][0]] for c in missed])[place]  # the others don't lead to the whole copy
        starts, place = starts[here], place[here]
        at = dict(zip(starts.tolist(), place.tolist(), strict=True))
        hit = {(at[start], i) for start, i in candidates(flat, starts, np.minimum(starts + shortest, stops[place]), out.repetitions[-1:])}
        missed = [c for k, c in enumerate(missed) if (k, copies[c][0]) not in hit]
    if missed and max(np.bincount(np.array(missed) // each)) > (1 - recall) * each:
        out.repetitions, out.rare = [], _rarest(members, texts, most)
    return out


def _rarest(members: list[int], texts: list[np.ndarray], most: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The rarest word pairs of each item, one more than its allowed edits can destroy, and the items, by pair."""
    pairs = [runs(texts[i], 2) for i in members]
    known, counts = np.unique(np.concatenate(pairs), return_counts=True)
    chosen = [np.unique(p[np.argsort(counts[np.searchsorted(known, p)], kind="stable")[: 2 * most[i] + 1]]) for i, p in zip(members, pairs, strict=True)]
    flat, items = np.concatenate(chosen), np.repeat(members, [len(x) for x in chosen])
    order = np.argsort(flat, kind="stable")
    return flat[order], items[order]


def prepare(rows: list[tuple[int, str]], similarity: float = 0.75, recall: float = 0.97, seed: int = 11) -> Tables:
    """Tables of a block of (id, text) items.

    Repetitions are added to each length class until ``recall`` of each kind of
    simulated copies of its items within longer text, each with as many word
    edits as are allowed, all over it, at its head or in a row, share a key with
    their item at a start that the search looks at. A class that doesn't get
    there in MOST_REPETITIONS is searched exactly.
    """
    if not 0.7 <= similarity <= 1:
        raise ValueError(f"similarity must lie between 0.7 and 1, not {similarity}: below, an occurrence need not keep a word pair")
    column = pa.array([t or "" for _, t in rows], pa.string())
    _, _, _, hashes, first = word_hashes(column)
    texts = [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    short: dict[int, dict[int, list[int]]] = {}
    for i, w in enumerate(texts):
        if 0 < len(w) < SHORT:
            short.setdefault(len(w), {}).setdefault(int(runs(w, len(w))[0]), []).append(i)
    long = sorted((i for i, w in enumerate(texts) if len(w) >= SHORT), key=lambda i: len(texts[i]))
    most = [allowed(len(w), similarity) for w in texts]
    out = Tables([r[0] for r in rows], [w.tolist() for w in texts], most, np.zeros(1 << _FILTER, bool), short)
    out.own = {i: set(runs(texts[i], 2).tolist()) for i in long}
    r = random.Random(seed)
    while long:
        members = [i for i in long if len(texts[i]) <= SPREAD * len(texts[long[0]])]
        long = long[len(members) :]
        out.classes.append(_lengths(members, texts, most, recall, r))
        out.pairs |= out.classes[-1].pairs
    return out


def _leaks(hashes: np.ndarray, first: np.ndarray, tables: Tables) -> list[tuple[int, int, int, int, int]]:
    """(row, item, first word, end word, distance) of all occurrences in a batch of rows."""
    out: list[tuple[int, int, int, int, int]] = []
    for n, known in tables.short.items():
        h = runs(hashes, n)
        for at in np.flatnonzero(np.isin(h, np.array(list(known), np.uint64))).tolist():
            row = int(np.searchsorted(first, at, side="right")) - 1
            if at + n <= first[row + 1]:
                out += [(row, i, at - int(first[row]), at - int(first[row]) + n, 0) for i in known[int(h[at])]]
    if not tables.classes or len(hashes) < 2:
        return out
    pairs, slots = runs(hashes, 2), _slots(hashes)
    near = np.flatnonzero(tables.pairs[slots])
    row_of = np.searchsorted(first, near, side="right") - 1
    inside = near + 1 < first[row_of + 1]
    near = near[inside]
    for lengths in tables.classes:
        out += _class_leaks(hashes, first, pairs, near[lengths.pairs[slots[near]]], lengths, tables)
    return out


def _class_leaks(hashes: np.ndarray, first: np.ndarray, pairs: np.ndarray, near: np.ndarray, lengths: Lengths, tables: Tables) -> list[tuple[int, int, int, int, int]]:
    """Occurrences of a class's items; ``near`` are the places of its word pairs."""
    if lengths.rare is not None:
        known, items = lengths.rare
        at = _dense(near, lengths.dense)
        low, high = np.searchsorted(known, pairs[at]), np.searchsorted(known, pairs[at], side="right")
        n = high - low
        which = items[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        places = np.repeat(at, n)
        reach = [len(tables.items[i]) + tables.most[i] for i in which.tolist()]
        spans = ((i, p - x + 2, p + x) for i, p, x in zip(which.tolist(), places.tolist(), reach, strict=True))
        return _settled(hashes, first, pairs, places, spans, tables)
    starts = _starts(near, lengths.dense, len(hashes))
    if not len(starts):
        return []
    rows = np.searchsorted(first, starts, side="right") - 1
    found = sorted(candidates(hashes, starts, np.minimum(starts + lengths.window, first[rows + 1]), lengths.repetitions))
    spans = ((i, start - tables.most[i], start + len(tables.items[i]) + 2 * tables.most[i]) for start, i in found)
    return _settled(hashes, first, pairs, np.array([x[0] for x in found], np.int64), spans, tables)


def _settled(hashes: np.ndarray, first: np.ndarray, pairs: np.ndarray, places: np.ndarray, spans: Iterable[tuple[int, int, int]], tables: Tables) -> list[tuple[int, int, int, int, int]]:
    """Occurrences by the exact distance in or beside the (item, begin, end) spans that hold enough of the item's word pairs; ``places`` ascend and tell each span's row."""
    joined: dict[tuple[int, int], list[list[int]]] = {}
    for row, (i, begin, end) in zip((np.searchsorted(first, places, side="right") - 1).tolist(), spans, strict=True):
        begin, end = max(int(first[row]), begin), min(int(first[row + 1]), end)
        held = joined.setdefault((row, i), [])
        if held and begin <= held[-1][1]:
            held[-1][1] = max(end, held[-1][1])
        else:
            held.append([begin, end])
    out = []
    for (row, i), held in joined.items():
        item, most, own = tables.items[i], tables.most[i], tables.own[i]
        low, high, wide = int(first[row]), int(first[row + 1]), len(item) + most
        kept: list[list[int]] = []
        for begin, end in held:
            if sum(map(own.__contains__, pairs[begin : end - 1].tolist())) < len(item) - 1 - 2 * most:
                continue  # too few of its word pairs for any match
            begin, end = max(low, begin - wide), min(high, end + wide)  # room for a closer match that reaches beyond
            if kept and begin <= kept[-1][1]:
                kept[-1][1] = end
            else:
                kept.append([begin, end])
        out += [(row, i, begin - low + a, begin - low + b, d) for begin, end in kept for a, b, d in occurrences(item, hashes[begin:end].tolist(), most)]
    return out


def find(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.75, recall: float = 0.97, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Occurrences of benchmark items in whole texts.

    Returns ``doc_id, item_id, start, end`` (code points of the text)``,
    distance, n_words`` (of the item); a row for each occurrence, the best of
    overlapping ones of one item. Items without words, null or empty, occur
    nowhere; items of fewer than SHORT words must occur word by word. Null and
    empty texts hold nothing. Repeated documents each give their rows; equal
    items too. Other columns are ignored. The benchmark is read in blocks of
    about BLOCK items or BYTES, each a broadcast of bounded size; documents aren't
    shuffled. ``similarity`` lies between 0.7 and 1.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    n, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-n // BLOCK), -(-(size or 0) // BYTES))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    names = ["doc_id", "item_id", "start", "end", "distance", "n_words"]
    schema = "doc_id long, item_id long, start long, end long, distance int, n_words int"
    out = None
    for block in range(blocks):
        rows = sorted(((r["item_id"], r["text"]) for r in dealt.where(F.col("block") == block).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        shared = spark.sparkContext.broadcast(prepare(rows, similarity, recall))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tables = shared.value
            for batch in slices(batches):
                start, end, _, hashes, first = word_hashes(batch.column(1))
                hits = _leaks(hashes, first, tables)
                if not hits:
                    continue
                rows = []
                for row, i, a, b, d in sorted(hits):
                    raw = batch.column(1)[row].as_py().encode()
                    x, y = int(start[first[row] + a]), int(end[first[row] + b - 1])
                    before = len(raw[:x].decode())
                    rows.append((batch.column(0)[row].as_py(), tables.ids[i], before, before + len(raw[x:y].decode()), d, len(tables.items[i])))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        part = id_text(docs, id_col, text_col).mapInArrow(frugal(run, "shingles"), schema)
        out = part if out is None else out.unionByName(part)
    return out
