"""Personal data: exact base patterns, and a semi-Markov CRF that adds what they miss.

The base kinds follow fixed patterns and always stay. The model looks at what
is left: around digits and at-signs outside base spans it scores candidate
segments of up to ``SPAN`` tokens by features of the whole segment (digit
groups, separators, checksum, cue words before it, ...), and a dynamic program
over the tokens picks the boundaries and types of highest total score, where a
token outside any segment scores 0. Its weights maximise the conditional
likelihood of sentences made here from templates; no labelled data is read.

What bounds it: an entity has ``SPAN`` tokens at most (words, digit groups,
signs and blanks each count), stands on one line, and lies within ``AROUND``
characters of a digit group, an at-sign or a word written for one.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, strings

# The kinds in their order of output, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behind changes no match: a run of digits that fails from its start fails from within.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
#: Tokens a segment has at most.
SPAN = 17
#: Characters on either side of a trigger that the model looks at.
AROUND = 60


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in linear time: from each at-sign the local part is the run before it."""
    found, low = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > low and _LOCAL.match(text, start - 1):
            start -= 1
        if start < m.start():
            found.append((start, m.end()))
            low = m.end()
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points by kind, then start."""
    spans = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return spans
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m[0].split("."))):
            spans.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            spans.append(("card", m.start(), m.end()))
    if "+" in text:
        spans += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return spans


_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[ \t]+|\n|[^\w\s]|.", re.S)
_TRIGGER = re.compile(r"(?<![^\W_])[0-9]+(?![^\W_])|@|[\[(]\s?at\s?[\])]|\sdot\s", re.I)
# Words that announce a kind, and words written for signs.
CUES = {"email": {"mail", "email", "e", "contact", "write"}, "ip": {"ip", "host", "server", "address"}, "card": {"card", "visa", "mastercard", "amex", "pan"}, "phone": {"tel", "phone", "call", "mobile", "fax", "cell"}}
_AT, _DOT = {"at"}, {"dot"}


def _features(tokens: list[str], i: int, j: int) -> list[str] | None:
    """Features of the whole segment tokens[i:j]; None where it can be no entity at all."""
    first, last = tokens[i], tokens[j - 1]
    if not (first[0].isalnum() or first in "+(") or not last[0].isalnum():
        return None
    groups = [t for t in tokens[i:j] if t[0].isdigit()]
    digits = sum(map(len, groups))
    words = [t.lower() for t in tokens[i:j] if t[0].isalpha()]
    at = "@" in tokens[i:j] or bool(_AT & set(words))
    if not at and (digits < 4 or digits > 19 or set(words) - _DOT):
        return None
    if "\n" in tokens[i:j]:
        return None
    joints = {t for t in tokens[i:j] if not t[0].isalnum() or t.lower() in _DOT}
    signs = "".join(sorted({t.strip()[:1] or " " for t in joints}))
    out = ["bias", f"signs={signs}"]
    if at:
        dots = tokens[i:j].count(".") + words.count("dot")
        inner = [t for t in tokens[i:j] if t[0].isalpha() and t.lower() not in _AT | _DOT]
        out += [f"case={any(t[0].isupper() for t in inner[1:])}", f"broken={any(a == '.' and not b.strip() for a, b in zip(tokens[i:j], tokens[i + 1 : j], strict=False))}/{any(a == '.' and not b.strip() for a, b in zip(tokens[i + 1 : j], tokens[i:j], strict=False))}"]
        out += [f"at={min(2, tokens[i:j].count('@') + words.count('at'))}", f"dots={min(3, dots)}", f"spoken={bool(_AT & set(words))}/{bool(_DOT & set(words))}", f"end={last.isalpha() and 2 <= len(last) <= 4}", f"pieces={min(8, len(words) + len(groups))}", f"head={first[0].isalpha() and first.lower() not in _AT}"]
    else:
        sizes = [len(g) for g in groups]
        spread = "-".join(map(str, sizes)) if len(sizes) < 6 else "many"
        lead = "+" if first == "+" else "(" if first == "(" else groups[0][:2] if groups[0][:1] == "0" and len(groups) > 1 else "1" if groups[0] == "1" else "n"
        out += [f"digits={digits}", f"groups={spread}", f"plus={first == '+'}", f"paren={'(' in joints}{')' in joints}"]
        out += [f"lead={'0' if lead[0] == '0' and lead != '00' else lead}/{min(6, len(groups))}", f"long={8 <= digits <= 15}/{min(5, len(groups))}", f"sizes={min(sizes)}/{max(sizes)}"]
        if 13 <= digits <= 19:
            out += [f"luhn={luhn(''.join(groups))}", f"parted={len(groups) > 1}/{luhn(''.join(groups))}"]
        if len(groups) == 4:
            out.append(f"octets={all(len(g) <= 3 and int(g) <= 255 for g in groups)}/{signs}")
        out.append(f"one={len(set(joints)) <= 1}")
    before = [t.lower() for t in tokens[max(0, i - 4) : i] if t[0].isalpha()]
    out += [f"cue={kind}" for kind, cues in CUES.items() if cues & set(before[-2:])]
    for side, k in (("l", i - 1), ("r", j)):
        if 0 <= k < len(tokens):
            t = tokens[k]
            beyond = tokens[k - 1 if side == "l" else k + 1] if 0 < k < len(tokens) - 1 else " "
            out.append(f"{side}={'9' if t[0].isdigit() else 'a' if t[0].isalpha() else t.strip()[:1] or ' '}{'9' if beyond[0].isdigit() else ''}")
    return out


def _candidates(tokens: list[str]) -> list[tuple[int, int, list[str]]]:
    return [(i, j, f) for i in range(len(tokens)) if tokens[i][0].isalnum() or tokens[i] in "+(" for j in range(i + 1, min(i + SPAN, len(tokens)) + 1) if (f := _features(tokens, i, j)) is not None]


class Weights(dict):
    """feature -> a weight for each kind."""

    def score(self, features: list[str]) -> np.ndarray:
        total = np.zeros(len(KINDS))
        for f in features:
            if (w := self.get(f)) is not None:
                total += w
        return total


def _made_up(r: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A sentence with entities the base patterns miss, and with numbers that are none."""
    word = lambda: "".join(r.choice(("the", "an", "re", "on", "ti", "lo", "mi", "ra", "es", "ber", "que", "sch")) for _ in range(r.randint(1, 3)))
    run = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card(n: int = 16) -> str:
        body = run(n - 1)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def title() -> str:
        return word().title()

    def split(n: int, sizes: tuple[int, ...] = (2, 3, 4)) -> list[str]:
        """Digits in groups, none of one digit but the first."""
        out = []
        while n:
            k = min(n, r.choice(sizes))
            out.append(run(k if n - k != 1 else n))
            n -= len(out[-1])
        return out

    def plain() -> str:
        return r.choice((word, word, word, word, lambda: run(r.randint(1, 4)), lambda: run(r.randint(5, 12)), lambda: f"{run(2)}.{run(2)}", lambda: f"{run(4)}-{run(2)}-{run(2)}", lambda: f"{run(2)}/{run(2)}/{run(4)}", lambda: f"{run(2)}:{run(2)}:{run(2)}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 20)}", lambda: f"{r.randint(1, 9)},{run(3)},{run(3)}", lambda: next(x for x in iter(lambda: run(16), None) if not luhn(x)), lambda: f"at {word()}", lambda: f"{run(3)} {run(3)}", lambda: f"{run(4)}.{run(4)}.{run(4)}.{run(3)}", lambda: f"{run(1)}.{run(1)}.{run(1)}.{run(1)}.{run(1)}", lambda: f"({run(4)})", lambda: f"{word()}. {title()} at {word()}", lambda: f"{title()} at {word()}. {title()}", lambda: f"{word()} at {word()} dot", lambda: f"{word()} @ {run(r.randint(1, 3))}", lambda: f"{run(4)} - {run(4)}", lambda: f"{r.randint(1, 20)} . {r.randint(1, 20)}", lambda: f"{r.choice(('19', '20'))}{run(2)}, {r.choice(('19', '20'))}{run(2)}, {r.choice(('19', '20'))}{run(2)}", lambda: f"{run(2)} {run(2)} {run(2)}", lambda: f"{r.randint(1, 999)} x {r.randint(1, 999)}", lambda: f"{r.randint(1, 9)} {r.randint(1, 9)} {r.randint(1, 9)} {r.randint(1, 9)}", lambda: f"no. {run(r.randint(5, 9))}", lambda: " - ".join(run(4) for _ in range(3)), lambda: f"{r.randint(300, 999)} . {run(2)} . {run(2)} . {run(2)}", lambda: f"{run(3)}-{r.choice('123456789')}-{run(2)}-{run(6)}-{run(1)}"))()

    def entity() -> tuple[str, str]:
        kind = r.choice(KINDS)
        if kind == "email":
            at, dot = r.choice(((" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "."), ("(at)", "."), (" @ ", "."), (" @ ", " . "), (" (at) ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("@", " . ")))
            host = word() + r.choice(("", "", dot + word()))
            return kind, f"{word()}{r.choice(('', '.' + word(), run(2), '_' + word(), '-' + word(), dot + word()))}{at}{host}{dot}{r.choice(('com', 'org', 'net', 'de', 'fr', 'edu', 'io'))}"
        if kind == "ip":
            return kind, r.choice((" . ", "[.]", " dot ", "(.)")).join(str(r.choice((r.randint(0, 255), r.randint(0, 9)))) for _ in range(4))
        if kind == "card":
            c = card()
            return kind, r.choice((".", "/", " - ", "_", ".", " / ")).join((c[:4], c[4:8], c[8:12], c[12:]))
        gap = r.choice((" ", " ", "-", ".", " - ", "/"))
        return kind, r.choice((lambda: f"({run(3)}) {run(3)}-{run(4)}", lambda: f"{run(3)}-{run(3)}-{run(4)}", lambda: f"{run(3)}.{run(3)}.{run(4)}", lambda: f"1-{run(3)}-{run(3)}-{run(4)}", lambda: f"00{run(2)}{gap}{gap.join(split(r.randint(8, 10), (2, 3, 4, 7)))}", lambda: f"({run(3)}) {run(3)} {run(4)}", lambda: f"0{run(r.randint(1, 4))}{gap}{gap.join(split(r.randint(6, 8), (2, 3, 4, 7)))}", lambda: f"(0{run(r.randint(1, 4))}) {' '.join(split(r.randint(6, 8), (2, 3, 4, 7)))}"))()

    text, spans = "", []
    for _ in range(r.randint(5, 9)):
        if r.random() < 0.22:
            kind, piece = entity()
            if r.random() < 0.3:
                text += r.choice(sorted(CUES[kind])) + r.choice((" ", ": "))
            spans.append((kind, len(text), len(text) + len(piece)))
        else:
            piece = plain()
        text += piece + r.choice((" ", " ", " ", ", ", ". ", "\n"))
    return text, spans


def train(sentences: int = 420, rounds: int = 5, rate: float = 0.25, shrink: float = 1e-3, seed: int = 7) -> Weights:
    """Weights by stochastic ascent on the conditional log-likelihood.

    The expected features come from a forward and a backward pass over all
    segmentations. The sentences and their order come from ``seed`` alone.
    """
    r, data = random.Random(seed), []
    for _ in range(sentences):
        text, spans = _made_up(r)
        parts = list(_TOKEN.finditer(text))
        tokens, starts, ends = [p[0] for p in parts], {p.start(): k for k, p in enumerate(parts)}, {p.end(): k + 1 for k, p in enumerate(parts)}
        gold = {(starts[a], ends[b]): KINDS.index(k) for k, a, b in spans if a in starts and b in ends}
        data.append((len(tokens), _candidates(tokens), gold))
    index: dict[str, int] = {}
    sets = [([np.array([index.setdefault(f, len(index)) for f in fs]) for _, _, fs in c]) for _, c, _ in data]
    w, seen = np.zeros((len(index), len(KINDS))), np.full((len(index), len(KINDS)), 1e-3)
    for _ in range(rounds):
        for k in r.sample(range(len(data)), len(data)):
            n, cands, gold = data[k]
            scores = np.array([w[f].sum(axis=0) for f in sets[k]]) if cands else np.zeros((0, len(KINDS)))
            mass = np.logaddexp.reduce(scores, axis=1) if cands else []
            ahead, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
            ahead[0] = back[n] = 0.0
            ending: dict[int, list[int]] = {}
            starting: dict[int, list[int]] = {}
            for c, (i, j, _) in enumerate(cands):
                ending.setdefault(j, []).append(c)
                starting.setdefault(i, []).append(c)
            for j in range(1, n + 1):
                ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[cands[c][0]] + mass[c] for c in ending.get(j, ()))])
            for i in range(n - 1, -1, -1):
                back[i] = np.logaddexp.reduce([back[i + 1], *(back[cands[c][1]] + mass[c] for c in starting.get(i, ()))])
            for c, (i, j, _) in enumerate(cands):
                g = -np.exp(np.clip(ahead[i] + scores[c] + back[j] - ahead[n], -50, 0))
                if (kind := gold.get((i, j))) is not None:
                    g[kind] += 1
                if np.abs(g).max() > 1e-4:
                    f = sets[k][c]
                    step = g - shrink * w[f]
                    seen[f] += step * step
                    w[f] += rate * step / np.sqrt(seen[f])
    return Weights({f: w[i] for f, i in index.items()})


def segment(tokens: list[str], weights: Weights) -> list[tuple[str, int, int]]:
    """The best segmentation: (kind, first token, end token)."""
    n = len(tokens)
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    ending: dict[int, list] = {}
    for i, j, f in _candidates(tokens):
        s = weights.score(f)
        k = int(s.argmax())
        if s[k] > 0:
            ending.setdefault(j, []).append((i, float(s[k]), k))
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, s, k in ending.get(j, ()):
            if best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, (i, k)
    found, j = [], n
    while j:
        if back[j] is None:
            j -= 1
        else:
            i, k = back[j]
            found.append((KINDS[k], i, j))
            j = i
    return found[::-1]


def added_spans(text: str, base: list[tuple[str, int, int]], weights: Weights, around: int = AROUND) -> list[tuple[str, int, int]]:
    """What the model finds outside the base spans, within ``around`` characters of a trigger.

    Neighbouring windows are one window, cut at base spans and line ends, so
    the work is linear in the text.
    """
    held = sorted((a, b) for _, a, b in base)
    windows: list[list[int]] = []
    at = 0
    for m in _TRIGGER.finditer(text):
        while at < len(held) and held[at][1] <= m.start():
            at += 1
        if at < len(held) and held[at][0] < m.end():
            continue
        low, high = max(0, m.start() - around), min(len(text), m.end() + around)
        if at and held[at - 1][1] > low:
            low = held[at - 1][1]
        if at < len(held):
            high = min(high, held[at][0])
        if windows and low <= windows[-1][1]:
            windows[-1][1] = max(high, windows[-1][1])
        else:
            windows.append([low, high])
    found = []
    for low, high in windows:
        for line in re.finditer(r"[^\n]+", text[low:high]):
            parts = list(_TOKEN.finditer(line[0]))
            shift = low + line.start()
            found += [(kind, shift + parts[i].start(), shift + parts[j - 1].end()) for kind, i, j in segment([p[0] for p in parts], weights)]
    edges = [a for a, _ in held]
    return [(k, a, b) for k, a, b in found if not ((x := bisect_left(edges, b)) and any(e > a for _, e in held[max(0, x - 4) : x]))]


def find(docs: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in whole texts.

    Returns ``doc_id, spans array<struct<kind, start, end, base>>``, a row for
    each input row: code points, end exclusive, by kind as in ``KINDS``, then
    start; ``base`` marks those of the fixed patterns. Null and empty texts
    have no spans; other columns are ignored. There is no shuffle; the weights
    are broadcast, the templates bound their number.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kind_of = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in strings(batch.column(1)):
                base = base_spans(text)
                spans = [(KINDS.index(k), a, b, True) for k, a, b in base]
                if _TRIGGER.search(text):
                    spans += [(KINDS.index(k), a, b, False) for k, a, b in added_spans(text, base, shared.value)]
                rows.append([{"kind": KINDS[k], "start": a, "end": b, "base": y} for k, a, b, y in sorted(spans)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(kind_of))], names=["doc_id", "spans"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<kind string, start long, end long, base boolean>>")
