import os
import random
import re
import resource
import tracemalloc

import numpy as np
import pyarrow as pa
from conftest import HARD

from orelode.functions.lineage import BATCH
from orelode.llm import joins, pieces, quality
from orelode.llm.common import cut, forget, frugal, written
from orelode.llm.graph import components
from orelode.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=5):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")))
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(rows, percent=75):
    """(id, size, smallest id reachable) of each row."""
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets if i is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, s) in enumerate(sets):
        for j, t in sets[:n]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return sorted((-1 if i is None else i, len(s), -1 if i is None else top(i)) for i, s in sets)


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        k = r.randrange(len(words))
        words[k : k + r.choice((0, 1))] = [f"w{r.randrange(10**6)}"]
    return " ".join(words)


def corpus(seed=1):
    r = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(300)]
    fresh = lambda n: [r.choice(vocabulary) for _ in range(n)]
    rows, passage = [], fresh(40)
    for group in range(6):  # near copies at every distance, some chained
        origin = fresh(r.randint(40, 160))
        rows += [edited(r, origin, r.randint(0, 9)) for _ in range(r.randint(2, 14))]
    rows += [" ".join(fresh(r.randint(0, 30)) + passage + fresh(r.randint(0, 30))) for _ in range(60)]  # a passage that many share
    rows += [" ".join(fresh(r.randint(1, 8))) for _ in range(40)] + ["same short text"] * 5 + [rows[0]] * 8
    r.shuffle(rows)
    return [(100 + k, t) for k, t in enumerate(rows)]


def form(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in df.collect())


def test_components_against_brute_force(table):
    rows = corpus() + [h for h in HARD if h[0] != 9] + [(11, "x"), (12, "X")]
    assert form(joins.likeness_components(table(rows))) == brute(rows)


def test_everything_frequent(table, monkeypatch):
    """All tokens count as frequent: every prefix is lengthened, every list dealt to parts; nothing is broadcast."""
    monkeypatch.setattr(joins, "_levels", lambda found, bits: np.full(1 << joins.RANGE, 2, np.uint8))
    monkeypatch.setattr(joins, "BROADCAST", 0)
    rows = corpus(2)
    assert form(joins.likeness_components(table(rows))) == brute(rows)


def test_empty_and_rows_of_one_id(table):
    assert joins.likeness_components(table([])).count() == 0
    rows = [(9, "x"), (9, "a completely different text under the same id"), (12, "x")]
    assert form(joins.likeness_components(table(rows))) == [(9, 1, 9), (9, 4, 9), (12, 1, 9)]
    assert [r.doc_id for r in joins.one_of_each(table(rows)).collect()] == [9]


def test_components_of_a_long_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(1000 + k, 1000) for k in range(1, 300)] + [(5, 5)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in range(41)) and all(found[1000 + k] == 1000 for k in range(300)) and len(found) == 341


def test_signatures_lose_no_pair():
    r = random.Random(3)
    for _ in range(600):
        common, x, y = r.randint(0, 120), r.randint(0, 60), r.randint(0, 60)
        every = np.array([r.getrandbits(64) for _ in range(common + x + y)], np.uint64)
        a, b = np.sort(every[: common + x]), np.sort(np.concatenate([every[:common], every[common + x :]]))
        if len(a) and len(b) and 100 * common >= 75 * (common + x + y):
            assert joins.may_reach(joins.signature(a), joins.signature(b), len(a), len(b), 75)


def test_shingle_hashes_are_the_shingles():
    r = random.Random(6)
    texts = ["".join(r.choice(["a", "B", "cé", " ", "\n", "\x0b", " ", "\xa0", "x y"]) for _ in range(r.randint(0, 25))) for _ in range(800)] + [None, ""]
    known = {}
    for t, s in zip(texts, shingle_sets(pa.array(texts)), strict=True):
        assert known.setdefault(tuple(s.tolist()), shingles(t)) == shingles(t) and len(s) == len(shingles(t))
    assert len({frozenset(v) for v in known.values()}) == len(known)


def test_a_pack_takes_twice_its_size():
    r = np.random.default_rng(4)
    held = [r.integers(0, 1 << 64, 1 << 16, dtype=np.uint64) for _ in range(16)]
    held[3][:] = held[2]
    bits = 26
    slots, counts = np.unique(np.concatenate(held) >> np.uint64(64 - bits), return_counts=True)
    want, size = dict(zip(slots.tolist(), counts.tolist(), strict=True)), sum(x.nbytes for x in held)
    tracemalloc.start()
    found, most = {}, 0
    for at, once, often, times in joins.packs(held, bits):
        most = max(most, tracemalloc.get_traced_memory()[1])
        part = {(at << joins.RANGE) + s: 1 for s in joins.unpack(once, joins._width(bits)).tolist()}
        for s, c in zip(np.frombuffer(often, np.int32).tolist(), np.frombuffer(times, np.int32).tolist(), strict=True):
            part[(at << joins.RANGE) + s] += c
        found |= part
        tracemalloc.reset_peak()
        if len(found) == len(part):
            first = most
    tracemalloc.stop()
    assert found == want and not held and first < 1.5 * size


def test_batches_of_texts_are_bounded_in_bytes(spark):
    """Ten thousand rows of any length made one batch before, up to 64 MB."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    for kept in (cut, written):
        texts = spark.range(0, 3000, 1, 1).selectExpr("repeat('x', 4000) as text")
        n = [r.n for r in kept(texts.mapInArrow(sizes, "n long")).collect()]
        assert sum(n) >= 12_000_000 and max(n) < 2 * BATCH and spark.conf.get(key) == before


def test_what_other_operators_left_in_a_worker_goes():
    quality._buckets["word"]
    pieces._ready[(0, "")] = (None, {})
    forget()
    assert not quality._buckets and not pieces._ready


def _own() -> int:
    """MB of this process that it shares with no file."""
    with open("/proc/self/statm") as f:
        resident, shared = map(int, f.read().split()[1:3])
    return (resident - shared) * resource.getpagesize() >> 20


def test_what_goes_is_given_back_to_the_system():
    """Freed memory below something that stays was kept by the process before."""
    pieces._ready[(0, "")] = (None, {i: bytes(2000) for i in range(50_000)})
    above, full = [bytes(2000) for _ in range(1000)], _own()
    forget()
    assert full - _own() > 80 and len(above) == 1000


def test_a_frugal_task_keeps_its_own_and_gives_back_the_rest():
    above, used = [], []

    def run(batches):
        held = [bytes(2000) for _ in range(50_000)]
        above.extend(bytes(2000) for _ in range(1000))
        used.append(_own())
        yield from batches
        del held

    quality._buckets["word"]
    pieces._ready[(0, "")] = (None, {})
    assert list(frugal(run, "quality")(iter("ab"))) == ["a", "b"]
    assert used[0] - _own() > 80 and "word" in quality._buckets and not pieces._ready


def test_small_tables_are_cut_into_few_files(spark):
    """Each took a file, and two processes, for every shuffle partition before."""
    few = max(2, spark.sparkContext.defaultParallelism)
    settings = {"spark.sql.shuffle.partitions": str(3 * few), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    links = spark.range(1, 200).selectExpr("id as a", "id - 1 as b")
    cut(spark.range(1))  # the folder is there
    top = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    had = set(os.listdir(top))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert {tuple(r) for r in components(links).collect()} == {(i, 0) for i in range(200)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = [sum(f.startswith("part-") for f in os.listdir(f"{top}/{x}")) for x in set(os.listdir(top)) - had]
    assert files and max(files) <= few
