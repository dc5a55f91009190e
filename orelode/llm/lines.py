"""Line dedup: repeated windows of three lines, found over the whole corpus.

DataFrame operations only. Lines are hashed twice with 64 bits each; a window
is the pair of hashes of three lines in a row. The first occurrence of a window,
by document id and position, stays; the lines that any later occurrence covers
go. Occurrences are judged on the input, not on what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, set_aside

#: Windows that hold more than this share of all repeated occurrences are joined by broadcast, 1 / HOT at most.
HOT = 1e-3


def _windows(text: Column, size: int) -> Column:
    """array<struct<a, b>> of the windows' hashes, in order of position; for ``size`` lines or more.

    Shifted copies of the line hashes are zipped, so no function of an element
    looks at a whole array: the work is linear in the lines.
    """
    lines = F.split(text, "\n", -1)
    hashes = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    shifted = F.arrays_zip(*[F.slice(hashes, k + 1, F.size(lines) - (size - 1)).alias(f"h{k}") for k in range(size)])
    part = lambda z, side: [z.getField(f"h{k}").getField(side) for k in range(size)]
    return F.transform(shifted, lambda z: F.struct(F.xxhash64(*part(z, "a")).alias("a"), F.xxhash64(F.lit(7), *part(z, "b")).alias("b")))


def drop_repeated(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``text`` less its repeated windows, and ``n_lines, n_removed, n_spans``.

    Lines end at ``\\n`` only. A text of fewer than ``size`` lines has no
    window and stays as it is; null text counts as empty and comes back empty.
    Rows equal in id and text are one document and get the same result; among
    other rows of one id the hash of the text decides which comes first. A null
    id comes before all others. Columns of the input named like the three new
    ones are replaced, all others stay as they are. An empty table gives an
    empty result.

    A window hash with a large share of all occurrences is joined by broadcast
    (there are 1 / HOT of them at most), the others by a shuffle, so that no
    task gets a hot key's rows. The first occurrence comes from a map-side
    combined minimum.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed", "n_spans")]
    docs, names = set_aside(docs.select(*columns), id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = [F.col(id_col).cast("long").alias("__id"), F.xxhash64(text).alias("__hash")]
    many = docs.where(F.size(F.split(text, "\n", -1)) >= size)
    found = many.select(*key, F.posexplode(_windows(text, size)).alias("__at", "__w")).select("__id", "__hash", "__at", F.col("__w.a").alias("__a"), F.col("__w.b").alias("__b"))
    place = F.struct("__id", "__hash", "__at")
    firsts = cut(found.groupBy("__a", "__b").agg(F.count("*").alias("__n"), F.min(place).alias("__first"), F.max(place).alias("__last")).where(F.col("__first") != F.col("__last")))
    total = firsts.agg(F.sum("__n")).first()[0] or 0
    hot = firsts.where(F.col("__n") > total * HOT).select("__a", "__b", "__first")
    cold = firsts.where(F.col("__n") <= total * HOT).select("__a", "__b", "__first")
    later = found.join(F.broadcast(hot), ["__a", "__b"]).unionByName(found.join(cold, ["__a", "__b"])).where(~place.eqNullSafe(F.col("__first")))
    covered = later.groupBy("__id", "__hash").agg(F.collect_set("__at").alias("__starts"))
    # The lines are split below the join, so that above it they are a plain column.
    left = docs.withColumns({"__id": F.col(id_col).cast("long"), "__hash": F.xxhash64(text), "__lines": F.split(text, "\n", -1)}).drop(text_col).alias("l")
    right = covered.select(F.col("__id").alias("__rid"), F.col("__hash").alias("__rhash"), "__starts")
    joined = left.join(right, F.col("__id").eqNullSafe(F.col("__rid")) & (F.col("__hash") == F.col("__rhash")), "left")
    marked = joined.withColumn("__gone", F.when(F.col("__starts").isNull(), F.array().cast("array<int>")).otherwise(F.array_distinct(F.flatten(F.transform("__starts", lambda s: F.sequence(s, s + (size - 1)))))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    out = marked.withColumns(
        {
            "n_lines": F.size("__lines").cast("long"),
            "n_removed": F.size("__gone").cast("long"),
            "n_spans": F.size(F.array_except("__gone", F.transform("__gone", lambda x: x + 1))).cast("long"),
            text_col: F.array_join(F.when(F.size("__gone") == 0, F.col("__lines")).otherwise(F.transform(kept, lambda i: F.get("__lines", i))), "\n"),
        }
    )
    return out.select(*docs.columns, "n_lines", "n_removed", "n_spans").withColumnsRenamed(names)
