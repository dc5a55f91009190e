import random

import pyarrow as pa
import pytest
from conftest import HARD

from orelode.llm import leaks


def distances(item, text):
    """Edit distance of the item to the best stretch that ends at each place."""
    col, out = list(range(len(item) + 1)), []
    for w in text:
        new = [0]
        for i in range(1, len(item) + 1):
            new.append(min(new[i - 1] + 1, col[i] + 1, col[i - 1] + (item[i - 1] != w)))
        col = new
        out.append(col[-1])
    return out


def test_edit_distance():
    r = random.Random(5)
    for _ in range(1500):
        item, text = [r.randrange(4) for _ in range(r.randint(1, 9))], [r.randrange(4) for _ in range(r.randint(0, 20))]
        d = distances(item, text)
        assert leaks.ends_within(item, text, 3) == [(j + 1, x) for j, x in enumerate(d) if x <= 3]
        if (m := leaks.best_match(item, text, 3)) is not None:
            assert m[2] == min(d) and distances(item, text[m[0] : m[1]])[-1] == m[2]


def case(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("the", "an", "re", "on", "ti")) for _ in range(r.randint(1, 3)))
    items = [(k, " ".join(word() for _ in range(r.randint(12, 40)))) for k in range(25)] + [(100, "short item"), (101, ""), (102, None), (103, "..."), (None, "an item without any identifier but with words")]
    docs = []
    for k in range(120):
        w = [word() for _ in range(r.randint(0, 120))]
        if k % 3 == 0:
            part = items[r.randrange(25)][1].upper().split()
            for _ in range(r.randint(0, len(part) // 5)):
                x = r.randrange(len(part))
                part[x : x + r.choice((0, 1))] = [f"zq{r.randrange(99)}"] if r.random() < 0.7 else []
            at = r.randint(0, len(w))
            w[at:at] = part
        docs.append((1000 + k, ", ".join(w)))
    return items, docs


def brute(items, docs, similarity=0.75):
    found = set()
    _, _, _, hashes, first = leaks.word_hashes(pa.array([t or "" for _, t in items]))
    rows = [(i, hashes[a:b].tolist()) for (i, _), a, b in zip(items, first[:-1], first[1:], strict=True)]
    _, _, _, hashes, first = leaks.word_hashes(pa.array([t or "" for _, t in docs]))
    for (d, _), a, b in zip(docs, first[:-1], first[1:], strict=True):
        text = hashes[a:b].tolist()
        for i, item in rows:
            if item and text and min(distances(item, text)) <= leaks.allowed(len(item), similarity):
                found.add((d, i))
    return found


def test_against_brute_force(table, spark):
    items, docs = case()
    docs += [(7, "A short ITEM."), (8, "short, items"), (9, None), (10, "an item; without any IDENTIFIER but with words!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = leaks.find(table(docs), bench).collect()
    want = brute(items, docs)
    assert {(r.doc_id, r.item_id) for r in got} <= want and len({(r.doc_id, r.item_id) for r in got}) >= 0.97 * len(want)
    texts = dict(docs)
    assert all(0 <= r.start < r.end <= len(texts[r.doc_id]) and r.distance <= leaks.allowed(r.n_words, 0.75) for r in got)
    assert {r.doc_id for r in got} >= {7, 10} and not {8, 9} & {r.doc_id for r in got}


def test_blocks_and_hard_rows(table, spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK", 7)
    items, _ = case()
    bench = spark.createDataFrame([*items, (200, "a b c d e f g h i j")], "item_id long, text string")
    got = leaks.find(table(HARD), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(6, 200), (7, 200), (7, 200)]
    assert leaks.find(table([]), bench).count() == 0 and leaks.find(table(HARD), bench.where("false")).count() == 0


def test_stages_in_a_row(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = pipeline.read_table(spark, sf, "documents")
    start, columns, sizes = {r.doc_id: r.text for r in docs.collect()}, docs.columns, []
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.written(stage(spark, docs, sf))
        assert docs.columns == columns
        sizes.append((name, docs.count()))
    assert sizes == sorted(sizes, key=lambda x: -x[1]) and 0.6 * len(start) < sizes[-1][1] < len(start)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert leaks.find(docs, bench).count() == 0
    out = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(out) == sizes[-1][1] and all(r.n_pieces == len(r.ids) for r in out)


def planted(sizes, kinds, seed=3, copies=120):
    """Items of these lengths, and documents that each hold a copy with all the edits allowed, in longer text."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    some = lambda n: [r.choice(vocab) for _ in range(n)]
    items, docs, held = [(i, some(n)) for i, n in enumerate(sizes)], [], set()
    for d in range(copies):
        i, w = items[r.randrange(len(items))]
        w, most = list(w), leaks.allowed(len(w), 0.75)
        kind = kinds[d % len(kinds)]
        if kind == "all over":
            for _ in range(most):
                change, at = r.randrange(3), r.randrange(len(w))
                w[at : at + (change != 0)] = some(change < 2)
        else:
            at = 0 if kind == "head" else r.randrange(len(w) - most + 1)
            w[at : at + most] = some(most)
        docs.append((d, " ".join(some(150) + w + some(150))))
        held.add((d, i))
    return [(i, " ".join(w)) for i, w in items], docs, held


def recall(table, spark, *case):
    items, docs, held = planted(*case)
    got = {(r.doc_id, r.item_id) for r in leaks.find(table(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    return len(got & held) / len(held)


def test_head_and_block_edits_beside_a_short_item(table, spark):
    r = random.Random(0)
    sizes = [r.randint(15, 59) for _ in range(60)] + [8]
    assert recall(table, spark, sizes, ["head", "block"]) >= 0.97


def test_items_of_one_length_in_longer_text(table, spark):
    assert recall(table, spark, [40] * 30, ["all over"], 3, 400) >= 0.95


def test_a_class_beyond_the_repetitions_is_searched_exactly(table, spark, monkeypatch):
    monkeypatch.setattr(leaks, "MOST_REPETITIONS", 4)
    assert recall(table, spark, [40] * 30 + [120] * 5, ["head", "block", "all over"]) == 1


def test_items_of_mixed_lengths_in_longer_text(table, spark):
    r = random.Random(9)
    assert recall(table, spark, [r.randint(10, 75) for _ in range(50)], ["all over", "head", "block"], 5, 400) >= 0.97
    assert recall(table, spark, [60] * 20, ["all over"], 6, 400) >= 0.97


def test_similarity_is_validated(table, spark):
    bench = spark.createDataFrame([(1, "some words of an item")], "item_id long, text string")
    for wrong in (0.5, 1.2):
        with pytest.raises(ValueError, match="similarity"):
            leaks.find(table([(1, "x")]), bench, similarity=wrong)


def test_closest_occurrences():
    r = random.Random(8)
    for _ in range(400):
        item, text = [r.randrange(5) for _ in range(r.randint(5, 9))], [r.randrange(5) for _ in range(r.randint(0, 60))]
        most = leaks.allowed(len(item), 0.75)
        got = leaks.occurrences(item, text, most)
        assert all(x[1] <= y[0] for x, y in zip(got[:-1], got[1:], strict=True))
        assert all(distances(item, text[a:b])[-1] == d <= most for a, b, d in got)
        edges = [0, *(x for a, b, _ in got for x in (a, b)), len(text)]
        assert all(not leaks.ends_within(item, text[a:b], most) for a, b in zip(edges[::2], edges[1::2], strict=True))
        if (m := leaks.best_match(item, text, most)) is not None:
            assert m in got


def test_the_closest_stretch_is_told(table, spark):
    r = random.Random(2)
    some = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    items = [some(r.randint(15, 20)) for _ in range(30)]
    docs = [(d, " ".join(some(40) + items[d % 30] + some(40))) for d in range(3000)]
    got = leaks.find(table(docs), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")).collect()
    assert len(got) > 0.97 * len(docs) and all(x.item_id == x.doc_id % 30 and x.distance == 0 for x in got)
