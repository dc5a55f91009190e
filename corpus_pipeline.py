"""From raw documents to token ids, in stages that each hand a table on.

Each stage calls one operator of ``orelode.llm`` on all that its predecessor
kept, and its decisions take effect; all but the last return the columns of
``documents``. Each states what it does with nulls, empty texts, repeated rows,
empty tables and further columns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orelode.llm import joins, leaks, lines, pieces, quality
from orelode.llm.common import read_table, set_aside, ship, written

#: Rated documents the quality model is fitted on, at most.
RATED = 4000
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _apart(docs: DataFrame, result: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``result`` of ``docs`` with their own columns: what an operator adds or replaces can't clash with them."""
    aside, names = set_aside(docs, "doc_id", "text")
    return result(aside).select(*aside.columns).withColumnsRenamed(names)


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose chance of a grade above the lowest is at least 1/2.

    Null and empty texts are judged as texts without words. Repeated rows are
    judged alike, so all stay or go; rows without an id are judged as others
    are, by their text. An empty table, or one without two grades among its
    rated documents, keeps all rows. All columns stay as they are.
    """
    ship(spark)
    model = quality.fit(quality.rated_sample(docs, quality.grades(read_table(spark, sf_dir, "labels")), most=RATED))
    return _apart(docs, lambda rows: quality.score(rows, model, keep=True).where(F.get("tails", F.lit(0)) >= 0.5))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated three-line windows out of the texts; a document that loses its whole text goes.

    A null text comes back empty, an empty one stays. Rows equal in id and text
    are one document and get the same text, so none takes lines from the other.
    A null id comes before all others. ``n_chars`` follows the text; all other
    columns stay as they are. An empty table stays empty.
    """
    left = _apart(docs, lambda rows: lines.drop_repeated(rows).where("n_removed = 0 or text != ''"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else left


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one of smallest id.

    Null and empty texts, and rows without an id, link with nothing and stay.
    Of rows that share an id, repeated or not, one stays. All columns stay as
    they are. An empty table stays empty.
    """
    ship(spark)
    return joins.one_of_each(docs, percent=75, size=5)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    All rows of an id go where one of them holds an item. Null and empty texts
    hold none. A row without an id is judged by itself. All columns stay as
    they are. An empty table, or an empty benchmark, leaves all rows.
    """
    ship(spark)
    benchmark = read_table(spark, sf_dir, "benchmark")
    found = written(leaks.find(docs, benchmark, similarity=0.75, recall=0.97).select("doc_id").distinct())
    gone = found.where("doc_id is not null")
    left = _apart(docs, lambda rows: rows.join(F.broadcast(gone) if gone.count() <= joins.BROADCAST else gone, "doc_id", "left_anti"))
    if found.where("doc_id is null").isEmpty():
        return left
    # The rare rows without an id are told apart by their texts.
    lone = docs.where("doc_id is null").withColumn("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))))
    held = leaks.find(lone, benchmark, similarity=0.75, recall=0.97).select("doc_id").distinct()
    clean = _apart(lone, lambda rows: rows.join(held, "doc_id", "left_anti")).withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType))
    return left.where("doc_id is not null").unionByName(clean)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of what is left: ``doc_id, ids, n_pieces``.

    A row for each input row; null and empty texts have no ids. Other columns
    are left out. An empty table gives an empty result.
    """
    ship(spark)
    return pieces.encode(docs, pieces.read_model(MODEL)).withColumn("n_pieces", F.size("ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", select_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("sentencepiece", tokenize),
]

#: SQL can express neither the classifier nor the edit search nor the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result but the last is written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
