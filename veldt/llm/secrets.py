"""Secret scans: fixed patterns, and a randomness test battery with false-discovery control.

Base spans come from three patterns. The battery looks at every other token of ``LEAST_LENGTH`` characters
or more that some encoding may have produced (hex, base32, base64 and so on); below that length its tests
tell too little. Three statistics of a token are taken in its inferred encoding: chi-squared against a
uniform alphabet, the share of changes of character kind between neighbours, and the serial correlation of
neighbours. The null hypothesis is "an ordinary token of this encoding and length": words, numbers and dates
put together as such tokens are (``ordinary``). It is fitted for each encoding and length on generated
tokens: the weights of the three statistics, and mean and spread of their weighted sum, so a p-value means
the same for all of them. The sum gives a one-sided p-value (towards randomness). Tokens are ranked within
classes of encoding and length, and the Benjamini-Hochberg rule, over all tokens of the corpus, sets each
class's threshold. A token that the same tests refuse as random (too even, too regular) is no secret either.

p-values are rounded up to hundredths of a power of ten, so the counts that the driver sees are a
table of fixed size, whatever the corpus. Texts are scanned whole; null counts as empty; rows are
independent, so ties, repeated rows and extra columns need no rule; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import operator
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, parts, texts_of

#: The kinds of spans, in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "random")

_KEYWORD = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = re.compile(rf"""(?:{_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: A cheap necessary condition of the pattern above.
_ASSIGN_HINT = re.compile(r"""[dDtTnNyY]["']?\x20*[:=]""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

LEAST_LENGTH = 20
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Encodings, narrowest first: name, what a token of it looks like, its alphabet in the order of its values.
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = [
    ("hex", re.compile(r"(?=.*[a-f])(?=.*[0-9])[0-9a-f]+"), _DIGITS + "abcdef"),
    ("HEX", re.compile(r"(?=.*[A-F])(?=.*[0-9])[0-9A-F]+"), _DIGITS + "ABCDEF"),
    ("base32", re.compile(r"(?=.*[A-Z])(?=.*[2-7])[A-Z2-7]+"), _UPPER + "234567"),
    ("base36", re.compile(r"(?=.*[a-z])(?=.*[0-9])[a-z0-9]+"), _DIGITS + _LOWER),
    ("BASE36", re.compile(r"(?=.*[A-Z])(?=.*[0-9])[A-Z0-9]+"), _DIGITS + _UPPER),
    ("base62", re.compile(r"(?=.+[A-Z])(?=.*[a-z])[A-Za-z0-9]+"), _DIGITS + _LOWER + _UPPER),
    ("base64", re.compile(r"(?=.+[A-Z])(?=.*[a-z])(?=.*[0-9])[A-Za-z0-9+/]+"), _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", re.compile(r"(?=.+[A-Z])(?=.*[a-z])(?=.*[0-9])[A-Za-z0-9_-]+"), _UPPER + _LOWER + _DIGITS + "-_"),
]
_PLACES = [{c: i for i, c in enumerate(alphabet)} for _, _, alphabet in ENCODINGS]
#: The kind of a character: digit, small letter, capital, sign.
_KIND = {c: k for k, signs in enumerate((_DIGITS, _LOWER, _UPPER, "+/-_")) for c in signs}
#: Upper ends of the length classes.
CLASSES = (28, 40, 64)
#: Lengths for which the null is fitted, on so many generated tokens each; it is linear in between.
FITTED, EACH = (20, 25, 32, 44, 72, 160), 600
#: A token less random than this by any test, on either side, is none.
LEAST_RANDOM = 1e-4
STEPS = 100
MOST_STEPS = 40 * STEPS


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, in order."""
    out = [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if _ASSIGN_HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end() - m.start(1) >= 6]
    return sorted(out)


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _normal_of_chi(x: float, df: float) -> float:
    """The cube-root approximation of a chi-squared value as a normal one."""
    return ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))


def encoding_of(body: str) -> int | None:
    """The narrowest encoding that a token looks like."""
    return next((i for i, (_, looks, _) in enumerate(ENCODINGS) if looks.fullmatch(body)), None)


#: What ordinary tokens are made of.
_WORDS = (
    "account address admin alert archive article backup banner basic blog book build button cache calendar center change chapter client cloud "
    "column comment common config connect contact content control country create current data default delete design detail device display "
    "document domain download editor email engine event example export feature filter folder format frame front global group header health "
    "history home image import index input item label language library list local login main manager market master media member menu message "
    "method mobile model module music network news notice number object office online option order page panel payment people phone photo"
).split()
_HEX_WORDS = "dead beef cafe face babe feed bead fade decade facade added deed ace bad dad fee abc abcdef ff ee aa".split()


def ordinary(encoding: int, length: int, r: random.Random) -> str:
    """An ordinary token of an encoding: words, numbers, dates and counters, joined as is usual for it."""
    name = ENCODINGS[encoding][0]

    def number() -> str:
        kind = r.random()
        if kind < 0.35:
            return f"{r.randint(1990, 2030)}{r.randint(1, 12):02d}{r.randint(1, 28):02d}"[: r.choice([4, 6, 8])]
        if kind < 0.6:
            return str(r.randint(0, 99)).zfill(r.choice([2, 3, 4, 8]))
        return str(r.randint(0, 10 ** r.randint(1, 5)))

    while True:
        out = ""
        while len(out) < length:
            if name in ("hex", "HEX"):
                piece = r.choice(_HEX_WORDS) if r.random() < 0.4 else number() if r.random() < 0.8 else r.choice("0123456789abcdef") * r.randint(2, 8)
            else:
                piece = r.choice(_WORDS) if r.random() < 0.75 else number()
            if name in ("base62", "base64", "base64url"):
                piece = piece.capitalize() if r.random() < 0.6 else piece
            if name in ("base64", "base64url") and out and r.random() < 0.6:
                piece = r.choice("+/" if name == "base64" else "-_") + piece
            out += piece
        out = out[:length]
        if name in ("HEX", "base32", "BASE36"):
            out = out.upper()
        if name == "base32":
            out = out.translate(str.maketrans("0189", "2345"))
        if encoding_of(out) == encoding:
            return out


def statistics(body: str, encoding: int) -> tuple[float, float, float]:
    """Chi-squared over its degrees of freedom, the share of changes of kind, the serial correlation."""
    place = _PLACES[encoding]
    size, n = len(place), len(body)
    values = [place[c] for c in body]
    chi = sum((k - n / size) ** 2 - (n / size) ** 2 for k in Counter(values).values()) * size / n + n
    kinds = [_KIND[c] for c in body]
    changes = sum(map(operator.ne, kinds, kinds[1:]))
    mean = sum(values) / n
    spread = sum((v - mean) ** 2 for v in values)
    serial = sum((a - mean) * (b - mean) for a, b in zip(values, values[1:], strict=False)) / spread if spread else 1.0
    return chi / (size - 1), changes / (n - 1), serial


#: Upper tails at which the null is held against the normal distribution, and its values there.
TAILS = ((0.02, 2.054), (0.01, 2.326), (0.005, 2.576))
#: For each encoding and fitted length: the weights of the three statistics and the mean of their weighted sum, whose spread is 1 at most.
Null = dict[int, list[tuple[float, ...]]]


@functools.cache
def fitted_null() -> Null:
    """The null, fitted on generated tokens from a fixed seed; some seconds, once on the driver.

    The weights are those that set random tokens of the encoding furthest apart from ordinary ones, by the means
    of both and the covariance of the ordinary ones.
    """
    r, out = random.Random(7), {}
    for encoding, (_, _, alphabet) in enumerate(ENCODINGS):
        rows = []
        for length in FITTED:
            told = np.array([statistics(ordinary(encoding, length, r), encoding) for _ in range(EACH)])
            even = np.array([statistics("".join(r.choices(alphabet, k=length)), encoding) for _ in range(EACH)])
            spread = np.cov(told.T) + 1e-9 * np.eye(3)
            weights = np.linalg.solve(spread, even.mean(axis=0) - told.mean(axis=0))
            weights /= math.sqrt(weights @ spread @ weights)
            sums = (told - told.mean(axis=0)) @ weights
            # Where the upper tail is longer than the normal one, the tail is what counts.
            weights /= max(1.0, *(float(np.quantile(sums, 1 - tail)) / z for tail, z in TAILS))
            rows.append((*weights.tolist(), float(weights @ told.mean(axis=0))))
        out[encoding] = rows
    return out


def null_at(null: Null, encoding: int, length: int) -> tuple[float, ...]:
    """What is fitted for an encoding at any length; beyond the longest fitted one, as there."""
    rows = null[encoding]
    k = bisect.bisect_right(FITTED, length)
    if k == 0 or k == len(FITTED):
        return rows[min(k, len(FITTED) - 1)]
    share = (length - FITTED[k - 1]) / (FITTED[k] - FITTED[k - 1])
    return tuple(a + share * (b - a) for a, b in zip(rows[k - 1], rows[k], strict=True))


def test_token(token: str, null: Null) -> tuple[int, float] | None:
    """The encoding of a token and the log10 of its combined p-value; None if it is no candidate."""
    body = token.rstrip("=")
    n = len(body)
    if n < LEAST_LENGTH or _UUID.fullmatch(body) or (encoding := encoding_of(body)) is None:
        return None
    alphabet = ENCODINGS[encoding][2]
    size = len(alphabet)
    chi, changes, serial = stats = statistics(body, encoding)
    shares = [sum(a.isdigit() for a in alphabet), sum(a in _LOWER for a in alphabet), sum(a in _UPPER for a in alphabet)]
    shares.append(size - sum(shares))
    same = sum((s / size) ** 2 for s in shares)
    # How far each statistic lies from what random characters give.
    far = [
        _normal_of_chi(chi * (size - 1), size - 1),
        (changes - (1 - same)) * math.sqrt((n - 1) / (same * (1 - same))),
        (serial + 1 / n) * math.sqrt(n),
    ]
    if any(2 * _upper_tail(abs(z)) < LEAST_RANDOM for z in far):
        return None
    *weights, mean = null_at(null, encoding, n)
    p = _upper_tail(sum(w * x for w, x in zip(weights, stats, strict=True)) - mean)
    return encoding, math.log10(p) if p > 0 else -MOST_STEPS / STEPS


def class_of(encoding: int, length: int) -> int:
    """The number of the class of an encoding and a length."""
    return encoding * (len(CLASSES) + 1) + sum(length > most for most in CLASSES)


def candidates(text: str, base: list[tuple[int, int, int]], null: Null) -> list[tuple[int, int, int, int]]:
    """(start, end, class, step) of the tested tokens that no base span touches.

    The step is the p-value in hundredths of a power of ten, rounded towards 1.
    """
    out, taken, k = [], sorted((s, e) for s, _, e in base), 0
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if any(s < end and e > start for s, e in taken[k : k + 4]):
            continue
        if told := test_token(m.group(), null):
            out.append((start, end, class_of(told[0], end - start), min(MOST_STEPS, max(0, int(-told[1] * STEPS)))))
    return out


def thresholds(counts: dict[tuple[int, int], int], rate: float) -> dict[int, int]:
    """For each class of encoding and length the least step that the Benjamini-Hochberg rule takes."""
    out = {}
    for kind in range(len(ENCODINGS) * (len(CLASSES) + 1)):
        own = sorted(((step, n) for (c, step), n in counts.items() if c == kind), reverse=True)
        total, held, least = sum(n for _, n in own), 0, MOST_STEPS + 1
        for step, n in own:
            held += n
            if 10 ** (-step / STEPS) <= rate * held / total:
                least = step
        out[kind] = least
    return out


_FOUND = "base array<struct<start:int,kind:int,end:int>>, tested array<struct<start:int,kind:int,end:int,token_class:int,step:int>>"


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans and tested tokens of each text: doc_id, base_sha256, base, tested. One narrow pass."""
    id_type = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    null = fitted_null()
    tested = pa.struct([*span, pa.field("token_class", pa.int32()), pa.field("step", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            shas, bases, tests = [], [], []
            for text in texts_of(part, "text"):
                base = base_spans(text)
                shas.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest())
                bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
                tests.append([{"start": s, "kind": 3, "end": e, "token_class": c, "step": p} for s, e, c, p in candidates(text, base, null)])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(shas, pa.string()), pa.array(bases, pa.list_(span)), pa.array(tests, pa.list_(tested))],
                ["doc_id", "base_sha256", "base", "tested"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, base_sha256 string, {_FOUND}")


def learn_thresholds(found: DataFrame, rate: float) -> dict[int, int]:
    """Thresholds over all tested tokens of the corpus; the driver gets counts by class and step."""
    each = found.select(F.explode("tested").alias("x")).groupBy("x.token_class", "x.step").count()
    return thresholds({(r.token_class, r.step): r["count"] for r in each.collect()}, rate)


def scan(docs: DataFrame, *, rate: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All spans of each text: doc_id, base_sha256, spans (array of start, kind, end, in order)."""
    found = cut(find(docs, id_col=id_col, text_col=text_col))
    least = learn_thresholds(found, rate)
    limit = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])
    added = F.transform(
        F.filter("tested", lambda x: x["step"] >= limit[x["token_class"]]),
        lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")),
    )
    return found.select("doc_id", "base_sha256", F.sort_array(F.concat("base", added)).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, and all spans as text."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def count(kind: int):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    said = F.transform("spans", lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"]))
    return scanned.select("doc_id", *[count(k) for k in range(3)], "base_sha256", F.array_join(said, ",").alias("spans"), count(3))


def redact(docs: DataFrame, *, rate: float = 0.01, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with every found span replaced by ``mark``; all columns and rows stay.

    Texts are scanned twice, once for the thresholds and once to redact, rather than shuffled.
    Spans that overlap are replaced together. A null text stays null.
    """
    tested = find(docs, id_col=id_col, text_col=text_col).select("tested")
    least = learn_thresholds(tested, rate)
    at, null = docs.columns.index(text_col), fitted_null()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, text_col):
            texts = [t if t is None else hide(t, least, mark, null) for t in column(part, text_col)]
            yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def hide(text: str, least: dict[int, int], mark: str, null: Null) -> str:
    base = base_spans(text)
    spans = [(s, e) for s, _, e in base] + [(s, e) for s, e, c, p in candidates(text, base, null) if p >= least[c]]
    out, at = [], 0
    end = -1
    for s, e in sorted(spans):
        if s >= end:
            out += [text[at:s], mark]
        end = max(end, e)
        at = end
    return "".join([*out, text[at:]])
