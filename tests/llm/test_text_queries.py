"""Every registered text query, called through the registry on the smallest tables, against a plain version of what it says."""

import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from conftest import HARD
from pyspark.sql import functions as F
from test_joins import brute as like
from test_leaks_pipeline import brute as leaked
from test_models import PATTERNS, base
from test_native import strip
from test_suffix import brute as repeats

import __spark_entry__ as entry
from orelode.llm import leaks, pieces, quality, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True))


def rows(spark, name):
    found = entry.queries()[name](spark, SF).collect()
    return found, {r.doc_id: r for r in found}


def test_token_counts(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found, by = rows(spark, "op3_token_counts")
    assert len(found) == len(docs)
    for i, t in docs:
        n = len(library.encode(t or ""))
        assert (by[i].n_bytes, by[i].n_tokens, by[i].over_limit) == (len((t or "").encode()), n, n > 4096)


def test_round_trips(spark, docs):
    model = pieces._worker(pieces.read_model(public_tokenizers.path("piece_bpe_32k.model")), pieces._Encoded)
    found, by = rows(spark, "op6_sentencepiece")
    assert len(found) == len(docs)
    for i, t in docs:
        ids = pieces.encode_text(t or "", model[1], model[0].chunks)
        assert by[i].n_pieces == len(ids) and by[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_leaks(spark, docs):
    t = pq.read_table(f"{SF}/benchmark.parquet", columns=["item_id", "text"])
    short = [(i, " ".join((x or "").split()[:1500])) for i, x in docs]
    want = leaked(list(zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True))[:12], short[:60])
    found, _ = rows(spark, "op2_decontamination")
    got = {(r.doc_id, r.item_id) for r in found}
    assert len(want & got) >= 0.97 * len(want)
    texts, items = dict(docs), dict(zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True))
    for r in found:
        hashes = [leaks.word_hashes(pa.array([x]))[3].tolist() for x in (items[r.item_id], texts[r.doc_id][r.start : r.end])]
        assert r.distance <= leaks.allowed(r.n_words, 0.75) and (len(hashes[1]), r.distance) in leaks.ends_within(hashes[0], hashes[1], r.distance)


def test_grades(spark, docs):
    labels = {r["doc_id"]: r for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    grade = lambda r: 0 if r["quality"] == 0 else 1 if r["toxic"] == 1 else 2
    sample = sorted(((grade(labels[i]), quality.sparse(t or "")) for i, t in docs if i in labels), key=lambda x: (x[0], x[1][0].tobytes(), x[1][1].tobytes()))
    model = quality.fit([(*x, g) for g, x in sample])
    found, by = rows(spark, "op4_quality")
    assert len(found) == len(docs)
    for i, t in docs:
        x = quality.features(t or "")
        tails = [1 / (1 + math.exp(b - float(x @ model.weights))) for b in model.thresholds]
        assert by[i].expected_grade == pytest.approx(sum(tails), abs=1e-9) and by[i].p_good == pytest.approx(tails[0], abs=1e-9) and by[i].selected == int(tails[0] >= 0.5)


def test_line_windows(spark, docs):
    found, by = rows(spark, "op5_line_dedup")
    want = {i: (n, gone, spans, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, spans, kept in strip(docs)}
    assert {r.doc_id: (r.n_lines, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == want


def test_toxicity(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5) != 0)
    lexicon = toxicity.learn(toxicity.labelled_sample(spark.read.parquet(f"{SF}/documents.parquet"), labels))
    found, by = rows(spark, "op7_toxicity")
    assert len(found) == len(docs) and lexicon.entries
    for i, t in docs:
        folded, n = toxicity.fold(t or "")
        places = lambda p: [k for k in range(len(folded)) if folded.startswith(p, k)]
        guards = [(k, k + len(p)) for p in lexicon.exceptions for k in places(p)]
        total = sum(w for e, w in lexicon.entries.items() for k in places(e) if not any(a <= k and k + len(e) <= b for a, b in guards))
        z = lexicon.slope * min(total / n if n else 0.0, 1.0) + lexicon.base
        assert by[i].score == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, z)))), abs=1e-9)
        assert by[i].predicted == int(by[i].score >= 0.5) and by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_components(spark, docs):
    found, _ = rows(spark, "op8_ngram_jaccard")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == like(docs)


def test_suffixes(spark, docs):
    found, _ = rows(spark, "op9_suffix_dedup")
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == repeats(docs, 100)


def test_personal_data(spark, docs):
    found, by = rows(spark, "op10_pii")
    assert len(found) == len(docs) and set(PATTERNS) == {"email", "ip", "card", "phone"}
    for i, t in docs:
        spans = base(t or "")
        r = by[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in spans) for kind in PATTERNS]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))


def test_pipeline_against_brute_force(spark, docs):
    """The stages whose result a plain version can give, each on what the stage before kept."""
    import corpus_pipeline as pipeline

    table = pipeline.read_table(spark, SF, "documents")
    state = dict(docs)
    for name, stage in pipeline.STAGES:
        table = pipeline.written(stage(spark, table, SF))
        if name == "sentencepiece":
            break
        kept = {r.doc_id: r.text for r in table.collect()}
        if name == "quality":
            _, by = rows(spark, "op4_quality")
            assert kept == {i: t for i, t in state.items() if by[i].p_good >= 0.5}
        elif name == "line_dedup":
            assert kept == {i: t for i, _, gone, _, t in strip(list(state.items())) if t or not gone}
        elif name == "near_duplicates":
            assert set(kept) == {i for i, _, top in like(list(state.items())) if i == top}
        else:
            t = pq.read_table(f"{SF}/benchmark.parquet").column("text").to_pylist()
            items = [leaks.word_hashes(pa.array([x]))[3].tolist() for x in t]
            words = {i: leaks.word_hashes(pa.array([x or ""]))[3].tolist() for i, x in state.items()}
            held = {i for i, w in words.items() if any(x and leaks.ends_within(x, w, leaks.allowed(len(x), 0.75)) for x in items)}
            assert not set(kept) & held or len(set(kept) & held) <= 0.03 * len(held)
            assert set(state) - held <= set(kept)
        state = kept
    assert {r.doc_id: r.n_pieces for r in table.collect()}.keys() == state.keys()


def test_stages_on_hard_rows(table, spark, monkeypatch):
    """Nulls, empty and very long texts, repeated rows, rows without an id, clashing columns, an empty table."""
    import corpus_pipeline as pipeline

    names = ("tails", "expected_grade", "n_lines", "n_removed", "n_spans", "__id", "__hash", "__lines", "__at", "component_id", "a", "b", "c0", "__column_0")
    for base_rows in (HARD, []):
        docs = table(base_rows).withColumns({n: F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in names})
        columns = docs.columns
        for _, stage in pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            found = out.collect()
            assert all(r[n] == f"{n} {'none' if r.doc_id is None else r.doc_id}" for r in found for n in names)
            assert len(found) <= len(base_rows)
        last = pipeline.STAGES[-1][1](spark, docs, SF)
        assert last.count() == len(base_rows) and last.columns == ["doc_id", "ids", "n_pieces"]
    kept = sorted(-1 if r.doc_id is None else r.doc_id for r in pipeline.drop_near_duplicates(spark, table(HARD), SF).collect())
    assert kept == [-1, 1, 2, 3, 4, 5, 6, 8, 9, 10]
    assert np.all([r.text is not None for r in pipeline.drop_repeated_lines(spark, table(HARD), SF).collect()])
