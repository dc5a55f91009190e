"""The registered queries: thin wrappers that put an operator on its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import joins, leaks, lines, merkle, pieces, pii, quality, suffix, toxicity
from .common import read_table

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text against an edited one (its last third from the next document) and against the next document."""
    near = merkle.with_next(read_table(spark, sf_dir, "documents"))
    size = F.length("text")
    edited = F.concat(F.col("text").substr(F.lit(1), size - F.floor(size / 3).cast("int")), F.col("next_text").substr(F.lit(1), F.floor(size / 3).cast("int")))
    rows = near.withColumn("edited", edited).withColumn("edited_tree", merkle.tree(F.col("edited")))
    return merkle.edits(rows, "edited_tree", "tree").select(
        "doc_id",
        size.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        merkle.fingerprint(F.col("tree")).alias("fingerprint"),
        merkle.fingerprint(F.col("edited_tree")).alias("edited_fingerprint"),
        merkle.likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"),
        merkle.likeness(F.col("tree"), F.col("next_tree")).alias("near_next"),
        F.size("edits.new").cast("long").alias("n_edited_paragraphs"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), similarity=0.75, recall=0.97)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_counts(read_table(spark, sf_dir, "documents"), pieces.read_model(MODEL))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of every document by a model fitted on a bounded sample of the rated ones."""
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit(quality.rated_sample(docs, quality.grades(read_table(spark, sf_dir, "labels")), most=4000))
    scored = quality.score(docs, model)
    tail = F.get("tails", F.lit(0))
    return scored.select("doc_id", "expected_grade", tail.alias("p_good"), F.when(tail >= 0.5, 1).otherwise(0).alias("selected"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_repeated(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text, decodes the ids, and digests both."""
    return pieces.round_trip(read_table(spark, sf_dir, "documents"), pieces.read_model(MODEL))


def held_out(doc_id: str = "doc_id"):
    """The rows whose labels are never learned from; a null id is no such row, and has no label."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    sample = toxicity.labelled_sample(docs, read_table(spark, sf_dir, "labels").where(~held_out()), most=4000)
    scored = toxicity.score(docs, toxicity.learn(sample))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.likeness_components(read_table(spark, sf_dir, "documents"), percent=75, size=5).drop("class_id")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.drop_repeats(read_table(spark, sf_dir, "documents"), width=100)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans; all spans."""
    found = pii.find(read_table(spark, sf_dir, "documents"), pii.train())
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_decontamination": op2_decontamination,
    "op3_token_counts": op3_token_counts,
    "op4_quality": op4_quality,
    "op5_line_dedup": op5_line_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_toxicity": op7_toxicity,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_pii": op10_pii,
}
