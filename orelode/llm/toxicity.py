"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton.

A text is folded first: lower case, accents outside Latin-1 off (within it they
make letters of their own in many languages), look-alike letters of other
scripts and digits that stand for letters put back, so that disguised terms
meet their entries. Entries are whole words or beginnings of words. The sum of
the weights of all matches is divided by the text's length in words; matches
inside an exception phrase don't count. A logistic curve turns the result into
a score from 0 to 1. Entries, weights, exceptions and the curve are learned
from labelled texts; lists of the caller's own may be added.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, strings, written

# Letters of other scripts that look like Latin ones, and what they look like.
LOOKS = "абвгдезікмнорстухѕјһԁԛԝαβεζηικνορτυχγƒɡɩʏℓ"
LIKE = "abbrgeeikmhopctyxsjhdqwabeznikvoptuxyfgiyi"
# Digits and signs written for letters; l and i are one letter after folding, as 1 stands for either.
SIGNS = "0123456789@$l"
LETTERS = "oizeasbtbgasi"
#: Lengths of the beginnings of words that may become entries.
STEMS = range(4, 9)


class _Fold(dict):
    """Code point -> folded letter or a blank, worked out when first met."""

    def __missing__(self, point: int) -> str:
        char = chr(point).lower()[:1]
        base = char if point < 256 else unicodedata.normalize("NFKD", char)[:1].lower() or " "
        if base in LOOKS:
            base = LIKE[LOOKS.index(base)]
        if base in SIGNS:
            base = LETTERS[SIGNS.index(base)]
        self[point] = base = base if base.isalpha() else "" if unicodedata.combining(char) or unicodedata.category(char) == "Cf" else " "
        return base


_fold = _Fold()
_signs = re.compile(r"(?<![^\W\d_])[@$]|[@$](?![^\W\d_])")


def fold(text: str) -> tuple[str, int]:
    """The folded words between single blanks, and their number."""
    if "$" in text or "@" in text:
        text = _signs.sub(" ", text)
    words = text.translate(_fold).split()
    return f" {' '.join(words)} ", len(words)


@dataclass(frozen=True)
class Lexicon:
    """Folded entries with weights (" stem" or " word "), exception phrases, and the curve."""

    entries: dict[str, float]
    exceptions: tuple[str, ...]
    slope: float
    base: float


def automaton(lexicon: Lexicon):
    """Entries and exceptions in one automaton; None for an empty lexicon."""
    if not lexicon.entries:
        return None
    machine = ahocorasick.Automaton()
    for phrase in lexicon.exceptions:
        machine.add_word(phrase, (len(phrase), None))
    for entry, weight in lexicon.entries.items():
        machine.add_word(entry, (len(entry), weight))
    machine.make_automaton()
    return machine


def density(text: str, machine) -> float:
    """Summed weight of the matches outside exception phrases, for each word of the text."""
    return _density(*fold(text), machine)


def _density(folded: str, n: int, machine) -> float:
    if machine is None or not n:
        return 0.0
    total, guards, held = 0.0, [], []
    for last, (size, weight) in machine.iter(folded):
        if weight is None:
            guards.append((last - size + 1, last))
        else:
            held.append((last - size + 1, last, weight))
    if guards:
        guards.sort()
        starts, reach = [g[0] for g in guards], np.maximum.accumulate([g[1] for g in guards]).tolist()
        held = [h for h in held if not (at := bisect_right(starts, h[0])) or reach[at - 1] < h[1]]
    for _, _, weight in held:
        total += weight
    return total / n


def chance(value: float, lexicon: Lexicon) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, lexicon.slope * min(value, 1.0) + lexicon.base))))


def _candidates(folded: str) -> set[str]:
    """The whole words of a folded text and their beginnings, as entries."""
    words = set(folded.split())
    found = {f" {w} " for w in words if len(w) > 2}
    for n in STEMS:
        found |= {f" {w[:n]}" for w in words if len(w) >= n}
    return found


def _phrases(folded: str, machine) -> set[str]:
    """Each match of a folded text with the word before and with the word behind."""
    found = set()
    for last, (size, _) in machine.iter(folded):
        start = last - size + 1
        end = folded.index(" ", start + 1)
        found.add(folded[start : folded.index(" ", end + 1) + 1] if end + 1 < len(folded) else "")
        found.add(folded[folded.rindex(" ", 0, start) : end + 1] if start else "")
    return found - {""}


def _odds(toxic: int, clean: int, n1: int, n0: int) -> float:
    return math.log((toxic + 0.5) / (n1 + 1)) - math.log((clean + 0.5) / (n0 + 1))


def _entries(counts: list[tuple[str, int, int]], n1: int, n0: int, floor: float) -> dict[str, float]:
    """Entries from (candidate, toxic texts, clean texts); the better of two that extend each other."""
    odds = {e: (_odds(c, k, n1, n0), c) for e, c, k in counts}
    entries: dict[str, float] = {}
    taken: set[str] = set()  # beginnings of chosen entries
    for e in sorted((e for e in odds if odds[e][0] >= floor), key=lambda e: (-odds[e][0] * odds[e][1], e)):
        heads = {e[:k] for k in range(3, len(e))}
        if e not in taken and not heads & entries.keys():
            entries[e] = odds[e][0]
            taken |= heads
    return entries


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and base of the logistic curve from densities to labels, each label with half the weight; 0 without both."""
    n1, n0 = int(y.sum()), int((1 - y).sum())
    if not n1 or not n0:
        return 0.0, 0.0
    weight = np.where(y > 0, 0.5 / n1, 0.5 / n0)
    scale = max(float(x[y > 0].mean()), 1e-6)
    a = b = 0.0
    for _ in range(60):  # Newton steps on the scaled density, lightly shrunk
        p = 1 / (1 + np.exp(-np.clip(a * x / scale + b, -40, 40)))
        g = np.array([(weight * (p - y) * x / scale).sum() + 1e-3 * a, (weight * (p - y)).sum()])
        h = weight * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(np.array([[(h * (x / scale) ** 2).sum() + 1e-3, (h * x / scale).sum()], [(h * x / scale).sum(), h.sum() + 1e-6]]), g)
        a, b = a - max(-2.0, min(2.0, step[0])), b - max(-2.0, min(2.0, step[1]))
    return a / scale, b


def learn(sample: DataFrame, least: int = 3, floor: float = 2.5, own: dict[str, float] | None = None, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from ``sample (text, toxic)``, as ``labelled_sample`` gives it.

    Every whole word and word beginning is a candidate; one that ``least``
    toxic texts hold, and whose log odds between the labels is ``floor`` or
    more, becomes an entry with these odds as weight. A candidate gives way to
    one it extends or that extends it, if that one has the higher odds times
    toxic texts. A pair of words around an entry that ``least`` clean and no
    toxic texts hold becomes an exception. Without both labels the score is
    1/2 for every text that no entry of the caller's matches.

    Texts stay on the executors, which fold and count; the driver sees the
    candidates that reach ``floor``, the exceptions and a number for each text.
    """
    spark = sample.sparkSession

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fold(t) for t in strings(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64()), batch.column(1)], names=["text", "n", "toxic"])

    def held(of) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pick = of()
            for batch in batches:
                for text, toxic in zip(strings(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                    found = sorted(pick(text))
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([toxic] * len(found), pa.int32())], names=["entry", "toxic"])

        return run

    def counted(of) -> DataFrame:
        found = texts.select("text", "toxic").mapInArrow(held(of), "entry string, toxic int")
        return found.groupBy("entry").agg(F.count_if(F.col("toxic") == 1).alias("c"), F.count_if(F.col("toxic") == 0).alias("k"))

    texts = written(sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(folded, "text string, n long, toxic int"))
    n1, n0 = texts.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    entries: dict[str, float] = {}
    if n1 and n0:
        odds = F.log((F.col("c") + 0.5) / (n1 + 1)) - F.log((F.col("k") + 0.5) / (n0 + 1))
        entries = _entries([tuple(r) for r in counted(lambda: _candidates).where((F.col("c") >= least) & (odds >= floor - 1e-9)).collect()], n1, n0, floor)
    entries |= {f" {fold(k)[0].strip()} ": w for k, w in (own or {}).items()}
    phrases = {fold(x)[0] for x in exceptions} - {" ", "  "}
    if not entries:
        return Lexicon({}, tuple(sorted(phrases)), 0.0, 0.0)
    bare = spark.sparkContext.broadcast(Lexicon(entries, (), 0, 0))

    def around() -> Callable:
        machine = automaton(bare.value)
        return lambda text: _phrases(text, machine)

    phrases |= {r["entry"] for r in counted(around).where((F.col("k") >= least) & (F.col("c") == 0)).collect()}
    draft = Lexicon(entries, tuple(sorted(phrases)), 0.0, 0.0)
    shared = spark.sparkContext.broadcast(draft)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(shared.value)
        for batch in batches:
            found = [min(_density(t, n, machine), 1.0) for t, n in zip(strings(batch.column(0)), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column(2)], names=["x", "toxic"])

    got = sorted(tuple(r) for r in texts.mapInArrow(dense, "x double, toxic int").collect())
    slope, base = _curve(np.array([x for x, _ in got]), np.array([float(y) for _, y in got]))
    return Lexicon(entries, draft.exceptions, slope, base)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text, toxic`` of at most ``most`` labelled whole texts, up to half of each label.

    ``labels`` has ``doc_id, toxic``; nulls are left out. The ids with the
    smallest hashes are taken, whatever the partitioning; of several texts of
    one id, the one with the smallest hash.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").distinct()
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic")


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, density, score`` of whole texts, a row for each input row.

    Null and empty texts, and texts without letters, have density 0. Other
    columns are ignored; an empty table gives an empty result. There is no
    shuffle; the lexicon is broadcast, and the size of its sample bounds it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(shared.value)
        for batch in batches:
            found = [density(t, machine) for t in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array([chance(x, shared.value) for x in found], pa.float64())], names=["doc_id", "density", "score"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, density double, score double")
