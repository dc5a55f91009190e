import hashlib
import random

import numpy as np
import pytest
from conftest import HARD

from orelode.llm import cover, suffix


def brute(rows, width):
    docs = sorted({(-(2**63) if i is None else i, t or "") for i, t in rows}, key=lambda d: d[0])
    seen, want = set(), {}
    for i, t in docs:
        raw = t.encode()
        covered = bytearray(len(raw))
        for k in range(len(raw) - width + 1):
            if raw[k : k + width] in seen:
                covered[k : k + width] = b"\1" * width
            seen.add(raw[k : k + width])
        kept = bytes(c for c, x in zip(raw, covered) if not x)
        want[i, t] = (len(raw), sum(covered), sum(x and not (k and covered[k - 1]) for k, x in enumerate(covered)), hashlib.sha256(kept).hexdigest())
    return sorted((-(2**63) if i is None else i, *want[-(2**63) if i is None else i, t or ""]) for i, t in rows)


def corpus(seed):
    r = random.Random(seed)
    words = ["the ", "é", "ab", "abc ", "x\n", "of ", "漢"]
    fresh = lambda n: "".join(r.choice(words) + str(r.randrange(10**4)) for _ in range(n))
    shared = [fresh(60) for _ in range(3)]
    rows = []
    for _ in range(60):
        t = fresh(r.randint(0, 30))
        for s in r.sample(shared, r.randint(0, 2)):
            a = r.randrange(len(s) // 2)
            t += s[a : a + r.randint(60, 400)] + fresh(r.randint(0, 5))
        rows.append(t)
    rows += ["ab" * 300, "ab" * 200 + "c" + "ab" * 90, rows[0], rows[0] + rows[1], "q" * 99, "q" * 100, "q" * 101]
    return list(enumerate(rows))


def form(df):
    return sorted((-(2**63) if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize("most, across", [(20_000, False), (2, False), (2, True)])
def test_against_brute_force(table, monkeypatch, most, across):
    """With 2, every mixed minimizer is dealt by whole windows, or ranked across tasks."""
    monkeypatch.setattr(suffix, "MOST", most)
    monkeypatch.setattr(cover, "LOCAL", 1 << 12)
    rows = corpus(1) + [(1000 + i if i else i, t) for i, t in HARD if i != 9]
    assert form(suffix.drop_repeats(table(rows), 100, across=across)) == brute(rows, 100)


def test_hot_minimizers_and_rows_of_one_id(table, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 10**9)
    monkeypatch.setattr(suffix, "PARTS", 3)
    text = "".join(f"{k} shared words; " for k in range(30))
    rows = [(k, f"{k} head {text} tail {k}" * 2) for k in range(12)]
    assert form(suffix.drop_repeats(table(rows), 100)) == brute(rows, 100)
    twins = suffix.drop_repeats(table([(1, text), (1, text + "!"), (2, text)]), 100, keep=True).collect()
    assert sum(r.n_removed for r in twins) == 2 * len(text) and suffix.drop_repeats(table([])).count() == 0


def test_many_rows_without_an_id(table, spark):
    text = "".join(f"{k} shared words; " for k in range(30))
    got = suffix.drop_repeats(table([(None, f"{k} {text}") for k in range(200)]), 100).collect()
    assert sorted(r.n_removed > 0 for r in got) == [False] + [True] * 199
    r = random.Random(4)
    rows = [(k % 3, r.getrandbits(64) - 2**63) for k in range(900)]
    placed = suffix._placed(spark.createDataFrame(rows, "key long, h1 long")).collect()
    for key in range(3):
        assert [r.base for r in sorted((r for r in placed if r.key == key), key=lambda r: r.h1)] == [k * suffix.TWIN for k in range(300)]


def test_suffix_arrays():
    r = np.random.default_rng(1)
    for _ in range(800):
        s = r.integers(1, r.integers(2, 5), r.integers(0, 40))
        assert cover.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    s = r.integers(1, 1 << 40, 50)
    assert cover.suffix_array(s).tolist() == sorted(range(50), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize("n, letters", [(100, 2), (101, 9), (102, 1)])
def test_ranks_across_tasks(spark, monkeypatch, n, letters):
    monkeypatch.setattr(cover, "LOCAL", 40)
    r = random.Random(n)
    s = [r.randint(1, letters) for _ in range(n)]
    got = {x.i: x.r for x in cover.suffix_ranks(spark.createDataFrame(list(enumerate(s)), "i long, c long").repartition(5), n).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(range(n), key=lambda i: s[i:])


def test_symbols_ahead_over_blocks(spark):
    s = spark.createDataFrame([(i, i * i + 1) for i in range(23)], "i long, c long")
    got = sorted(tuple(r) for r in cover._ahead(s, 2, 4).select("i", "c0", "c1", "c2").collect())
    assert got == [(i, *((j * j + 1 if j < 23 else 0) for j in (i, i + 1, i + 2))) for i in range(23)]
