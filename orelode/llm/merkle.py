"""Document fingerprints: a Merkle tree over paragraphs and sections.

DataFrame operations only. A paragraph is a line; its node is the SHA-256 of
its text. A section is a run of paragraphs that ends after each one whose node
ends in 0 to 3, so an inserted paragraph disturbs its own section alone; its
node is the SHA-256 of its paragraphs' nodes. The root is the SHA-256 of the
sections' nodes. Under the paragraphs lie leaves of up to ``WORDS`` words each,
by a 32-bit hash, which measure likeness.

Equal roots mean equal texts; where roots differ, only sections and then
paragraphs that differ need to be looked at. A fingerprint grows with its text:
16 digits for each paragraph and section, 8 for each leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text

#: Words of a leaf. Leaves start anew after . ! ? and at line starts.
WORDS = 5
_LEAF = rf"(?:[^\s.!?]{{1,64}}+[ \t]*+){{1,{WORDS}}}+[.!?\s]*+|[.!?\s]++"
#: Documents of a bucket of neighbouring ids, and buckets at most.
BUCKET, BUCKETS, CUTS = 256, 65536, 512


def tree(text: Column) -> Column:
    """struct<root string, sections array<string>, paragraphs array<string>, leaves array<string>> of a text (null: empty)."""
    text = F.coalesce(text, F.lit(""))
    nodes = F.transform(F.split(text, "\n", -1), lambda p: F.sha2(p, 256))
    sections = F.transform(F.split(F.array_join(nodes, ","), "(?<=[0-3]),", -1), lambda s: F.sha2(s, 256))
    leaves = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_LEAF), F.lit(0)), lambda x: F.right(F.lpad(F.hex(F.xxhash64(x)), F.lit(16), F.lit("0")), F.lit(8))))
    return F.struct(F.sha2(F.array_join(sections, ","), 256).alias("root"), sections.alias("sections"), nodes.alias("paragraphs"), leaves.alias("leaves"))


def fingerprint(node: Column) -> Column:
    """A tree as a string: root, sections and paragraphs by their first 16 digits, leaves; parted by colons."""
    short = lambda c: F.array_join(F.transform(c, lambda x: F.left(x, F.lit(16))), ",")
    return F.concat_ws(":", node["root"], short(node["sections"]), short(node["paragraphs"]), F.array_join(node["leaves"], ","))


def likeness(a: Column, b: Column) -> Column:
    """Share of common leaves of two trees: 2 |A and B| / (|A| + |B|); 1 for equal roots."""
    sizes = F.size(a["leaves"]) + F.size(b["leaves"])
    return F.when(a["root"] == b["root"], F.lit(1.0)).when(sizes == 0, F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(a["leaves"], b["leaves"])) / sizes)


def _numbered(rows: DataFrame, **nodes: Column) -> DataFrame:
    """Each array of nodes (column ``name``) as ``name``: array<struct<node, nth, at>>, ordered; ``nth`` counts equal nodes by position.

    Nothing in an array's function looks at a whole array, and each step is a
    column of its own, so the work is a sort's.
    """
    rows = rows.withColumns({f"__{k}": F.array_sort(F.transform(x, lambda v, i: F.struct(v.alias("node"), i.alias("at")))) for k, x in nodes.items()})
    before = lambda k: F.concat(F.array(F.lit(None).cast("struct<node:string,at:int>")), F.col(f"__{k}"))
    fresh = lambda z, i: F.when(z["s"].isNotNull() & (z["p"].isNull() | (z["p"]["node"] != z["s"]["node"])), i)
    rows = rows.withColumns({f"__{k}_first": F.filter(F.transform(F.arrays_zip(F.col(f"__{k}").alias("s"), before(k).alias("p")), fresh), lambda i: i.isNotNull()) for k in nodes})
    last = lambda k: F.concat(F.slice(F.col(f"__{k}_first"), 2, F.greatest(F.size(f"__{k}"), F.lit(1))), F.array(F.size(f"__{k}")))
    rows = rows.withColumns({f"__{k}_nth": F.flatten(F.transform(F.filter(F.arrays_zip(F.col(f"__{k}_first").alias("a"), last(k).alias("b")), lambda z: z["a"].isNotNull()), lambda z: F.sequence(F.lit(0), z["b"] - z["a"] - 1))) for k in nodes})
    rows = rows.withColumns({k: F.transform(F.arrays_zip(F.col(f"__{k}").alias("s"), F.col(f"__{k}_nth").alias("n")), lambda z: F.struct(z["s"]["node"].alias("node"), z["n"].alias("nth"), z["s"]["at"].alias("at"))) for k in nodes})
    return rows.drop(*[f"__{k}{x}" for k in nodes for x in ("", "_first", "_nth")])


def _matched(rows: DataFrame, x: Column, y: Column, left: str, right: str) -> DataFrame:
    """Adds ``left`` and ``right``: array<struct<at, other>> for each node of ``x`` and ``y`` by position.

    The n-th of equal nodes of one side matches the n-th of the other; ``other``
    is its position, null for none.
    """
    rows = _numbered(rows, __x=x, __y=y)
    side = lambda c, n: F.transform(F.col(c), lambda v: F.struct(v["node"].alias("node"), v["nth"].alias("nth"), F.lit(n).alias("side"), v["at"].alias("at")))
    rows = rows.withColumn("__t", F.array_sort(F.concat(side("__x", 0), side("__y", 1))))
    none = F.array(F.lit(None).cast("struct<node:string,nth:int,side:int,at:int>"))
    zipped = F.arrays_zip(F.col("__t").alias("t"), F.concat(none, F.col("__t")).alias("p"), F.concat(F.slice("__t", 2, F.greatest(F.size("__t"), F.lit(1))), none).alias("q"))
    same = lambda u, v: (u["node"] == v["node"]) & (u["nth"] == v["nth"])
    met = lambda z: F.struct(z["t"]["side"].alias("side"), z["t"]["at"].alias("at"), F.when(same(z["t"], z["p"]), z["p"]["at"]).when(same(z["t"], z["q"]), z["q"]["at"]).alias("other"))
    rows = rows.withColumn("__met", F.transform(zipped, met))
    own = lambda n: F.array_sort(F.transform(F.filter("__met", lambda m: m["side"] == n), lambda m: F.struct(m["at"].alias("at"), m["other"].alias("other"))))
    return rows.withColumns({left: own(0), right: own(1)}).drop("__x", "__y", "__t", "__met")


def edits(rows: DataFrame, a: str, b: str, name: str = "edits") -> DataFrame:
    """Adds where tree ``a`` differs from tree ``b``: ``name`` struct<new, gone, moved>, all empty for equal roots only.

    ``new`` has the positions (from 0) of the paragraphs of ``a`` that ``b``
    lacks, ``gone`` those of ``b`` that ``a`` lacks; a paragraph that one has
    more often counts at its last places outside of sections that both have. ``moved`` has the positions in ``a``
    of paragraphs that both have, but where ``b`` has them before the one they
    follow in ``a`` (for a whole section its first). A null tree has no edits.

    The trees are compared from the top: sections that both have stand for
    themselves, and only the paragraphs of the others are looked at. Linear in
    the nodes but for sorts.
    """
    out = rows.columns
    none = F.array().cast("array<string>")
    differ = ~F.col(a)["root"].eqNullSafe(F.col(b)["root"])
    part = lambda c, f: F.when(differ, F.coalesce(F.col(c)[f], none)).otherwise(none)
    rows = rows.withColumns({f"__{k}{f}": part(c, f) for k, c in (("a", a), ("b", b)) for f in ("sections", "paragraphs")})
    rows = _matched(rows, F.col("__asections"), F.col("__bsections"), "__ashared", "__bshared")
    for k in "ab":
        nodes = F.col(f"__{k}paragraphs")
        # A section ends after each paragraph whose node says so, and with the text.
        ends = F.filter(F.transform(F.slice(nodes, 1, F.greatest(F.size(nodes) - 1, F.lit(0))), lambda x, i: F.when(F.right(x, F.lit(1)).isin(*"0123"), i + 1)), lambda i: i.isNotNull())
        rows = rows.withColumn(f"__{k}ends", F.when(F.size(nodes) > 0, F.concat(ends, F.array(F.size(nodes)))).otherwise(F.array().cast("array<int>")))
        rows = rows.withColumn(f"__{k}starts", F.concat(F.array(F.lit(0)), F.slice(f"__{k}ends", 1, F.greatest(F.size(f"__{k}ends") - 1, F.lit(0)))))
        zipped = F.arrays_zip(F.col(f"__{k}sections").alias("node"), F.col(f"__{k}shared").alias("m"), F.col(f"__{k}starts").alias("x"), F.col(f"__{k}ends").alias("y"))
        rows = rows.withColumn(f"__{k}zip", F.filter(zipped, lambda z: z["node"].isNotNull()))
        below = lambda z, k=k: F.transform(F.slice(F.col(f"__{k}paragraphs"), z["x"] + 1, z["y"] - z["x"]), lambda p, i: F.struct(p.alias("node"), (z["x"] + i).alias("at")))
        rows = rows.withColumn(f"__{k}mixed", F.flatten(F.transform(f"__{k}zip", lambda z: F.when(z["m"]["other"].isNotNull(), F.array(F.struct(z["node"].alias("node"), z["x"].alias("at")))).otherwise(below(z)))))
    rows = _matched(rows, F.col("__amixed")["node"], F.col("__bmixed")["node"], "__a", "__b")
    lone = lambda k: F.transform(F.filter(F.arrays_zip(F.col(f"__{k}mixed").alias("n"), F.col(f"__{k}").alias("m")), lambda z: z["m"]["other"].isNull()), lambda z: z["n"]["at"])
    rows = rows.withColumn("__both", F.filter(F.arrays_zip(F.col("__amixed").alias("n"), F.col("__a").alias("m")), lambda z: z["m"]["other"].isNotNull()))
    rows = rows.withColumn("__order", F.transform("__both", lambda z: z["m"]["other"]))
    back = lambda z: F.when(z["n"].isNotNull() & (z["n"]["m"]["other"] < z["p"]), z["n"]["n"]["at"])
    moved = F.filter(F.transform(F.arrays_zip(F.col("__both").alias("n"), F.concat(F.array(F.lit(None).cast("int")), F.col("__order")).alias("p")), back), lambda i: i.isNotNull())
    return rows.withColumn(name, F.struct(lone("a").alias("new"), lone("b").alias("gone"), moved.alias("moved"))).select(*[F.col(c) for c in out if c != name], name)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, tree`` of whole texts, a row for each input row; no shuffle."""
    return id_text(docs, id_col, text_col).withColumn("tree", tree(F.col("text")))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, tree, next_text, next_tree``: each document beside the next by descending id; the last has the first.

    Rows of one id go by the hash of their text; a null id counts as lowest. A
    single row is its own next. No task sees all rows: ids are dealt to buckets
    by quantiles (and evenly within each), rows are ordered in their bucket,
    and each bucket also gets the first row of the bucket below. Texts are
    shuffled once, and alone: trees are grown from them afterwards.
    """
    low = F.lit(-(2**63)).cast("long")
    rows = id_text(docs, id_col, text_col).withColumn("__id", F.coalesce("doc_id", low))
    n, cuts = rows.agg(F.count("*"), F.percentile_approx("__id", [i / CUTS for i in range(CUTS + 1)], 10000)).first()
    if not n:
        return fingerprints(docs, id_col, text_col).withColumns({"next_text": F.col("text"), "next_tree": F.col("tree")})
    cuts, wanted = sorted(set(cuts)), max(1, min(BUCKETS, n // BUCKET))
    cuts, parts = cuts[:: -(-len(cuts) // wanted)], -(-wanted // len(cuts))
    edges = F.array(*[F.lit(c).cast("long") for c in cuts])
    k = F.greatest(F.lit(1), F.size(F.filter(edges, lambda c: c <= F.col("__id"))))
    left, right = F.get(edges, k - 1).cast("double"), F.coalesce(F.get(edges, k), F.lit(2**63 - 1)).cast("double")
    inner = F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.floor((F.col("__id").cast("double") - left) / F.greatest(right - left, F.lit(1.0)) * parts)))
    bucket = (k * parts + inner).cast("long")
    dealt = rows.withColumn("__bucket", bucket)
    tops = dealt.groupBy("__bucket").agg(F.max("__id").alias("__id"))
    around = Window.orderBy(F.col("__bucket").desc())  # a row for each bucket, BUCKETS + CUTS at most
    ring = tops.select("__id", F.coalesce(F.lag("__bucket").over(around), F.min("__bucket").over(Window.partitionBy())).alias("__bucket"))
    guests = rows.join(F.broadcast(ring), "__id").withColumn("__guest", F.lit(1))
    both = dealt.withColumn("__guest", F.lit(0)).unionByName(guests)
    order = Window.partitionBy("__bucket").orderBy("__guest", F.col("__id").desc(), F.xxhash64("text"))
    beside = both.withColumn("next_text", F.lead("text").over(order)).where("__guest = 0")
    return beside.select("doc_id", "text", tree(F.col("text")).alias("tree"), "next_text", tree(F.col("next_text")).alias("next_tree"))
