import hashlib
import random
import time
from collections import Counter

from conftest import HARD
from pyspark.sql import functions as F

from orelode.llm import lines, merkle


def strip(rows, size=3):
    docs = sorted({(i if i is not None else -(2**63), t or "") for i, t in rows})
    first, want = {}, {}
    for i, t in docs:
        part = t.split("\n")
        for k in range(len(part) - size + 1):
            first.setdefault(tuple(part[k : k + size]), (i, t, k))
    for i, t in docs:
        part, gone = t.split("\n"), set()
        for k in range(len(part) - size + 1):
            if first[tuple(part[k : k + size])] != (i, t, k):
                gone |= set(range(k, k + size))
        want[i, t] = (len(part), len(gone), sum(k - 1 not in gone for k in gone), "\n".join(x for k, x in enumerate(part) if k not in gone))
    return sorted((i if i is not None else -(2**63), *want[i if i is not None else -(2**63), t or ""]) for i, t in rows)


def test_line_windows_against_brute_force(table):
    r = random.Random(4)
    rows = [(k, "\n".join(r.choice("abc") for _ in range(r.randint(0, 9)))) for k in range(60)] + [h for h in HARD if h[0] != 9] + [(70, "a\n" * 3000)]
    got = lines.drop_repeated(table(rows)).collect()
    assert sorted((x.doc_id if x.doc_id is not None else -(2**63), x.n_lines, x.n_removed, x.n_spans, x.text) for x in got) == strip(rows)
    assert lines.drop_repeated(table([])).count() == 0


def test_line_windows_run_no_python(table):
    plan = lines.drop_repeated(table(HARD[:5]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_next_documents_over_many_buckets(table, monkeypatch):
    monkeypatch.setattr(merkle, "BUCKET", 3)
    r = random.Random(5)
    ids = r.sample(range(-50, 10_000), 40) + [10**15]
    rows = [(i, f"text {i}. " + "word " * r.randint(0, 30)) for i in ids]
    got = {x.doc_id: x for x in merkle.with_next(table(rows)).collect()}
    order, texts = sorted(ids, reverse=True), dict(rows)
    for k, i in enumerate(order):
        assert (got[i].text, got[i].next_text) == (texts[i], texts[order[(k + 1) % len(order)]])


def test_trees(table):
    hard = merkle.with_next(table(HARD))
    rows = hard.select("doc_id", "text", merkle.fingerprint(F.col("tree")).alias("f"), merkle.likeness(F.col("tree"), F.col("tree")).alias("same"), "tree.root").collect()
    assert len(rows) == len(HARD) and all(r.same == 1 for r in rows)
    by = {}
    for r in rows:
        assert by.setdefault(r.text, r.f) == r.f
    assert len(set(by.values())) == len(by)
    assert merkle.with_next(table([])).count() == 0
    assert merkle.with_next(table([(1, "alone")])).first().next_text == "alone"


def node(t):
    return hashlib.sha256(t.encode()).hexdigest()


def grown(text):
    """A tree by hand: (root, sections as (node, first paragraph, paragraphs), paragraphs)."""
    nodes = [node(p) for p in text.split("\n")]
    parts, first = [], 0
    for k, x in enumerate(nodes):
        if x[-1] in "0123" or k == len(nodes) - 1:
            parts.append((node(",".join(nodes[first : k + 1])), first, nodes[first : k + 1]))
            first = k + 1
    return node(",".join(p[0] for p in parts)), parts, nodes


def numbered(nodes):
    return [(x, nodes[:k].count(x)) for k, x in enumerate(nodes)]


def differences(x, y):
    """(new, gone, moved) of two texts, with sections that both have as one."""
    parts = [grown(t)[1] for t in (x, y)]
    keys = [numbered([p[0] for p in side]) for side in parts]
    mixed = []
    for side, mine, other in ((parts[0], *keys), (parts[1], *keys[::-1])):
        rows = []
        for part, key in zip(side, mine, strict=True):
            rows += [(part[0], part[1])] if key in other else [(n, part[1] + i) for i, n in enumerate(part[2])]
        mixed.append(rows)
    flat = [numbered([n for n, _ in rows]) for rows in mixed]
    new, gone = ([at for (_, at), key in zip(mixed[k], flat[k], strict=True) if key not in flat[1 - k]] for k in (0, 1))
    both = [(flat[1].index(key), at) for (_, at), key in zip(mixed[0], flat[0], strict=True) if key in flat[1]]
    return new, gone, [at for (before, _), (there, at) in zip(both, both[1:], strict=False) if there < before]


def compared(spark, pairs):
    rows = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(pairs)], "k long, x string, y string")
    trees = rows.withColumns({"tx": merkle.tree(F.col("x")), "ty": merkle.tree(F.col("y")), "edits": F.lit("replaced")})
    return [r.edits for r in merkle.edits(trees, "tx", "ty").orderBy("k").collect()]


def test_trees_and_likeness_against_brute_force(spark):
    r = random.Random(8)
    texts = ["\n".join(" ".join(r.choice("abcdefgh") * 3 for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 12))) for _ in range(60)] + ["", "\n", "\n\n"]
    df = spark.createDataFrame([(k, t, texts[k - 1]) for k, t in enumerate(texts)], "k long, x string, y string").withColumns({"tx": merkle.tree(F.col("x")), "ty": merkle.tree(F.col("y"))})
    for row in df.withColumns({"near": merkle.likeness(F.col("tx"), F.col("ty")), "print": merkle.fingerprint(F.col("tx"))}).collect():
        root, parts, nodes = grown(row.x)
        assert (row.tx.root, list(row.tx.sections), list(row.tx.paragraphs)) == (root, [p[0] for p in parts], nodes)
        a, b = set(row.tx.leaves), set(row.ty.leaves)
        assert len(a) == len(row.tx.leaves) and row.near == (1 if row.tx.root == row.ty.root else 2 * len(a & b) / (len(a) + len(b)) if a or b else 0)
        assert row.print == ":".join((root, ",".join(p[0][:16] for p in parts), ",".join(n[:16] for n in nodes), ",".join(row.tx.leaves)))


def test_edits_against_brute_force(spark):
    r = random.Random(6)
    pairs = [("one\ntwo\nthree", "one\nthree"), ("b\na\nc", "a\nb\nc"), ("", ""), ("", "a"), ("a\nnew\nb\nnew\na\na", "a\nb\nc\na\nd")]
    for _ in range(300):
        x = [r.choice(("p", "q", "r", "s", "t", "u", "v", f"own {r.randrange(99)}")) for _ in range(r.randint(1, 25))]
        y = list(x)
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(y) + 1)
            y[k : k + r.choice((0, 1, 2))] = r.choice(([], ["fresh"], y[:2], y[-1:]))
        pairs.append(("\n".join(x), "\n".join(y)))
    for (x, y), got in zip(pairs, compared(spark, pairs), strict=True):
        new, gone, moved = differences(x, y)
        assert (list(got.new), list(got.gone), list(got.moved)) == (new, gone, moved)
        a, b = x.split("\n"), y.split("\n")
        assert (x == y) == (not new and not gone and not moved)
        assert sorted(a[i] for i in new) == sorted((Counter(a) - Counter(b)).elements()) and sorted(b[i] for i in gone) == sorted((Counter(b) - Counter(a)).elements())


def test_edits_of_long_texts(spark):
    lines_ = [f"line {i % 700} of {i // 3}" for i in range(100_000)]
    other = lines_[:50_000] + ["put in"] + lines_[50_000:70_000] + lines_[70_001:]
    began = time.time()
    got = compared(spark, [("\n".join(other), "\n".join(lines_)), ("\n".join(lines_), "\n".join(x[::-1] for x in lines_))])
    assert (list(got[0].new), list(got[0].gone), list(got[0].moved)) == ([50_000], [70_000], []) and len(got[1].new) > 90_000
    assert time.time() - began < 60


def test_edits_are_located(spark):
    text = "\n".join(f"paragraph {i} has some words of its own, and more. And {i * 7} again." for i in range(30))
    changed = text.replace("paragraph 12 has", "paragraph 12 had")
    got = compared(spark, [(changed, text), (text, text), (None, text)])
    assert [list(x.new) for x in got[:2]] == [[12], []] and [list(x.gone) for x in got[:2]] == [[12], []] and len(got[2].gone) == 30


def test_edited_texts_of_the_query(spark):
    from orelode.llm.queries import op1_fingerprints

    sf = "/root/testdata/sf0.001"
    docs = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in op1_fingerprints(spark, sf).collect()}
    for k, (i, t) in enumerate(docs):
        n = len(t) // 3
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256((t[: len(t) - n] + docs[(k + 1) % len(docs)][1][:n]).encode()).hexdigest()
    long = [r for r in got.values() if r.n_chars > 300]
    assert sum(r.near_edited > 0.5 for r in long) > 0.9 * len(long) and sum(r.near_next < 0.1 for r in long) > 0.9 * len(long)
