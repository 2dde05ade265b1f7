"""Toxicity: gradient-boosted trees over dense features of the text, with isotonic calibration.

The lexicon is learned: words, and beginnings of words, that toxic training rows hold far more often
than others (a binomial bound keeps chance ones out; all that pass are kept). The features are densities
of lexicon words, their nearness to second-person words, capitals, punctuation and obfuscation rates.
Trees are fitted on histograms of at most ``most_rows`` labelled rows, a documented bound: the rows least
by a hash of their id. Two folds cross-fit the lexicon and the scores that the isotonic curve is fitted on,
so no row is judged by a lexicon or by trees that saw its label.

Features are made for some hundred texts at a time on arrays of code points: words are numbered once by
their hashes, looked up once, and summed by text. Nothing is kept from one batch to the next.

Only the text makes a score. Null counts as the empty text, which is scored like any other (all
densities 0). Scoring is one narrow pass over whole texts; rows are independent, so ties, repeated
rows and other columns need no rule. Labels that are null or belong to no row are passed over; rows
labelled more than once count as toxic if any label says so. Without labels of both kinds the score
of every row is the share of toxic labels, 0 if there are none.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Spans, cut, drop_cut, parts, span_hashes, texts_of

#: Second-person words of some languages.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur ya tu te toi ton ta tes vous votre vos du dich dir dein deine deinen deiner ihr euch euer "
    "ti tú usted ustedes vosotros vuestro vuestra su sus".split()
)
PREFIXES = (4, 5, 6, 7, 8)
NEAR = 5
FEATURES = (
    "log_words", "lexicon", "lexicon_weight", "top_weight", "hits", "different_hits", "prefix", "prefix_top", "leet", "near_second", "second",
    "capitals", "shouted", "exclaim", "question", "punctuation", "symbols", "digits", "mixed", "masked", "stretched", "word_length",
)
#: Kinds of characters: letter, digit, underscore (the three make words), capital, small letter, signs that mask letters,
#: signs that stand for letters, signs between spelled-out letters.
LETTER, DIGIT, UNDER, UPPER, LOWER, MASK, LEET, BETWEEN = (1 << i for i in range(8))
IN_WORD = LETTER | DIGIT | UNDER
_LEET = dict(zip("0134578@$!", "oieastbasi", strict=True))
#: Kinds of ASCII characters that are counted: A-Z, a-z, 0-9, punctuation, symbols, ! and ?.
_COUNTED = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".,;:!?'\"()-", "#*$%&|<>@^~+=", "!", "?")


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: kinds, the small letter, the letter that a sign stands for; by ASCII code: what is counted."""
    kinds, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, rule in ((LETTER, r"[^\W\d_]+"), (DIGIT, r"\d+"), (UNDER, "_+"), (MASK, r"[*@$#!]"), (LEET, r"[@$!*]"), (BETWEEN, r"[.\-_ ]")):
        for m in re.finditer(rule, every):
            kinds[np.frombuffer(m.group().encode("utf-32-le"), np.uint32)] |= kind
    for c in every:
        small = c.lower()
        if small != c and len(small) == 1:
            lower[ord(c)] = ord(small)
        if c.isupper():
            kinds[ord(c)] |= UPPER
        elif c.islower():
            kinds[ord(c)] |= LOWER
    plain = lower.copy()
    for sign, letter in _LEET.items():
        plain[ord(sign)] = ord(letter)
    counted = np.zeros(128, np.uint8)
    for i, signs in enumerate(_COUNTED):
        counted[[ord(c) for c in signs]] |= 1 << i
    return kinds, lower, plain, counted


def _word_hashes(words: list[str]) -> np.ndarray:
    """Hashes of whole words, as ``Spans`` has them."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    return span_hashes(points, np.append(0, ends)[:-1], ends)


@dataclass
class Table:
    """Weights by hash, the hashes sorted."""

    hashes: np.ndarray
    weights: np.ndarray

    @staticmethod
    def of(hashes: np.ndarray, weights: np.ndarray) -> Table:
        order = np.argsort(hashes)
        return Table(hashes[order], weights[order])

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """The weight of each hash, 0 where there is none."""
        if not len(self.hashes):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.weights[at], 0.0)


@dataclass
class Lexicon:
    words: Table
    prefixes: Table

    @staticmethod
    def of(words: dict[str, float], prefixes: dict[str, float]) -> Lexicon:
        made = [Table.of(_word_hashes(list(x)), np.array(list(x.values()), np.float64)) for x in (words, prefixes)]
        return Lexicon(*made)


def _edges(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true values start and end."""
    around = np.zeros(len(mask) + 2, bool)
    around[1:-1] = mask
    edge = np.flatnonzero(around[1:] != around[:-1])
    return edge[::2], edge[1::2]


class Texts:
    """Some texts as code points, each ended by a line break; their words, numbered by hash."""

    def __init__(self, texts: list[str]) -> None:
        self.count = len(texts)
        self.points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
        self.kinds = _tables()[0][self.points]
        self.lengths = np.fromiter(map(len, texts), np.int64, self.count)
        self.first = np.cumsum(self.lengths + 1) - (self.lengths + 1)
        self.start, self.end = _edges((self.kinds & IN_WORD) > 0)
        self.doc = self.text_of(self.start)
        self.spans = Spans(_tables()[1][self.points])
        self.words, self.at, self.back = np.unique(self.spans.hashes(self.start, self.end), return_index=True, return_inverse=True)

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, side="right") - 1

    def per_text(self, places: np.ndarray) -> np.ndarray:
        """How many of the places are in each text."""
        return np.bincount(self.text_of(places), minlength=self.count)

    def prefix_hashes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Which different words are longer than ``size``, and the hashes of their beginnings."""
        longer = np.flatnonzero(self.end[self.at] - self.start[self.at] > size)
        begin = self.start[self.at[longer]]
        return longer, self.spans.hashes(begin, begin + size)


_SECOND = _word_hashes(sorted(SECOND_PERSON))


def measure(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    if not texts:
        return np.zeros((0, len(FEATURES)))
    t = Texts(texts)
    kinds, count, doc, back = t.kinds, t.count, t.doc, t.back
    best = np.zeros(len(t.words))
    for size in PREFIXES:
        longer, hashes = t.prefix_hashes(size)
        best[longer] = np.maximum(best[longer], lexicon.prefixes(hashes))
    weight, prefix, second = lexicon.words(t.words)[back], best[back], np.isin(t.words, _SECOND)[back]
    hit, marked = weight > 0, (weight > 0) | (prefix > 0)

    def summed(of: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(doc[of], None if values is None else values[of], count)

    def top(values: np.ndarray) -> np.ndarray:
        out = np.zeros(count)
        np.maximum.at(out, doc[values > 0], values[values > 0])
        return out

    n_words = np.bincount(doc, minlength=count)
    n = np.maximum(n_words, 1)
    different = np.unique(doc[hit] * len(t.words) + back[hit]) // max(len(t.words), 1)
    # Texts stand further apart than NEAR words.
    place = np.arange(len(doc)) + doc * (NEAR + 1)
    at, where = place[second], place[marked]
    near = np.zeros(len(where), bool)
    if len(at):
        right = np.searchsorted(at, where)
        near = (np.abs(at[np.minimum(right, len(at) - 1)] - where) <= NEAR) | (np.abs(at[np.maximum(right - 1, 0)] - where) <= NEAR)
    # Characters.
    signs = _tables()[3][np.minimum(t.points, 127)]
    capital, small, digit, punctuation, symbol, exclaim, question = (
        np.add.reduceat((signs & (1 << i)) > 0, t.first, dtype=np.int64) for i in range(len(_COUNTED))
    )
    size, letters = np.maximum(t.lengths, 1), np.maximum(capital + small, 1)

    def in_words(kind: int) -> np.ndarray:
        held = np.append(0, np.cumsum((kinds & kind) > 0, dtype=np.int64))
        return held[t.end] - held[t.start]

    shouted = (in_words(UPPER) > 0) & (in_words(LOWER) == 0) & (t.end - t.start > 2) & (capital > 0.2 * letters)[doc]
    # Words with digits or signs in them, once for each run of such characters, from the first such word on.
    run_end = _edges((kinds & (IN_WORD | LEET)) > 0)[1]
    odd = np.flatnonzero((in_words(LETTER) > 0) & ((in_words(DIGIT) > 0) | ((kinds[t.end] & LEET) > 0)))
    run = np.searchsorted(run_end, t.start[odd], side="right")
    fits = run_end[run] - t.start[odd] >= 3
    run, once = np.unique(run[fits], return_index=True)
    odd = odd[fits][once]
    leet = np.zeros(0, bool)
    if len(odd):
        leet = lexicon.words(Spans(_tables()[2][t.points]).hashes(t.start[odd], run_end[run])) > 0
    # Letters behind signs, and spelled-out words.
    a, b = _edges((kinds & MASK) > 0)
    masked = t.per_text(a[(a > 0) & ((kinds[np.maximum(a - 1, 0)] & LETTER) > 0) & ((kinds[b] & LETTER) > 0)])
    a, b = _edges((kinds & LETTER) > 0)
    alone = b - a == 1
    linked = alone[:-1] & alone[1:] & (a[1:] - b[:-1] == 1) & ((kinds[b[:-1]] & BETWEEN) > 0)
    x, y = _edges(linked)
    masked = masked + t.per_text(a[x[y - x >= 3]])
    # Letters three times or more.
    same = (t.points[1:] == t.points[:-1]) & ((kinds[1:] & LETTER) > 0)
    stretched = t.per_text(_edges(same[1:] & same[:-1])[0])
    return np.column_stack(
        [
            np.log1p(n_words), summed(hit) / n, summed(hit, weight) / n, top(weight), summed(hit), np.bincount(different, minlength=count),
            summed(prefix > 0) / n, top(prefix), np.bincount(doc[odd[leet]], minlength=count), np.bincount(doc[marked][near], minlength=count) / n,
            summed(second) / n, capital / letters, summed(shouted) / n, exclaim / size, question / size, punctuation / size, symbol / size,
            digit / size, np.bincount(doc[odd], minlength=count) / n, masked / n, stretched / n, np.bincount(doc, t.end - t.start, count) / n,
        ]
    )


def count_terms(rows: DataFrame) -> DataFrame:
    """In how many rows of each fold a term stands, and in how many toxic ones: prefix, term, n0, k0, n1, k1.

    ``rows`` has text, toxic and fold. Terms are words (prefix 0) and beginnings of words (prefix 1), by hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            t = Texts(texts_of(part, "text"))
            toxic, fold = part.column(1).to_numpy(), part.column(2).to_numpy()
            own = np.unique(t.doc * max(len(t.words), 1) + t.back)
            doc, word = own // max(len(t.words), 1), own % max(len(t.words), 1)
            terms = [(0, t.words[word], doc)]
            for size in PREFIXES:
                longer, hashes = t.prefix_hashes(size)
                of_word = np.full(len(t.words), -1)
                begins, back = np.unique(hashes, return_inverse=True)
                of_word[longer] = back
                here = of_word[word] >= 0
                pair = np.unique(doc[here] * max(len(begins), 1) + of_word[word][here])
                terms.append((1, begins[pair % max(len(begins), 1)], pair // max(len(begins), 1)))
            for prefix in (0, 1):
                hashes = np.concatenate([h for p, h, _ in terms if p == prefix])
                doc = np.concatenate([d for p, _, d in terms if p == prefix])
                each, back = np.unique(hashes, return_inverse=True)
                columns = [np.bincount(back, (fold[doc] == f) * w, len(each)).astype(np.int64) for f in (0, 1) for w in (np.ones(len(doc)), toxic[doc])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(each), prefix, np.int32)), pa.array(each.view(np.int64)), *map(pa.array, columns)], ["prefix", "term", "n0", "k0", "n1", "k1"]
                )

    made = rows.select("text", F.col("toxic").cast("int"), F.col("fold").cast("int")).mapInArrow(run, "prefix int, term bigint, n0 bigint, k0 bigint, n1 bigint, k1 bigint")
    return made.groupBy("prefix", "term").agg(*[F.sum(c).alias(c) for c in ("n0", "k0", "n1", "k1")])


def _passes(hits: Column, rows: Column, share: float, least_log_p: float) -> Column:
    """Whether a term's toxic rows are far more than chance: an upper bound of the log of a binomial tail (Chernoff)."""
    a = hits / F.nullif(rows, F.lit(0))  # a term may stand in the other fold only
    tail = -rows * (a * F.log(a / share) + F.when(a < 1, (1 - a) * F.log((1 - a) / (1 - share))).otherwise(0.0))
    return (hits >= 4) & (hits > 2 * share * rows) & (tail < least_log_p)


def learn_lexicons(rows: DataFrame, *, least_log_p: float = -14.0) -> list[Lexicon]:
    """The lexicons of fold 0, of fold 1 and of both, in one pass; ``rows`` has text, toxic and fold.

    The driver gets the terms that pass. Each stands in four toxic rows at least, and there are at most
    ``most_rows`` of ``train``, so their number has a bound whatever the corpus.
    """
    totals = {r.fold: (r.n, int(r.k)) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).collect()}
    sets = [(0,), (1,), (0, 1)]
    shares = []
    for folds in sets:
        n, k = (sum(totals.get(f, (0, 0))[i] for f in folds) for i in (0, 1))
        shares.append(k / n if 0 < k < n else None)
    tests = [
        _passes(sum((F.col(f"k{f}") for f in folds[1:]), F.col(f"k{folds[0]}")), sum((F.col(f"n{f}") for f in folds[1:]), F.col(f"n{folds[0]}")), share, least_log_p)
        if share is not None
        else F.lit(False)
        for folds, share in zip(sets, shares, strict=True)
    ]
    tests = [F.coalesce(t, F.lit(False)).alias(f"p{i}") for i, t in enumerate(tests)]
    found = count_terms(rows).select("*", *tests).where("p0 or p1 or p2").toArrow()
    column = {c: found.column(c).to_numpy() for c in found.column_names}
    out = []
    for i, (folds, share) in enumerate(zip(sets, shares, strict=True)):
        n, k = (sum(column[f"{c}{f}"] for f in folds) for c in "nk")
        tables = []
        for prefix in (0, 1):
            own = column[f"p{i}"].astype(bool) & (column["prefix"] == prefix)
            weight = np.log((k[own] + 0.5) / (n[own] - k[own] + 0.5) * (1 - share) / share) if share is not None else np.zeros(0)
            tables.append(Table.of(column["term"][own].astype(np.int64).view(np.uint64), weight))
        out.append(Lexicon(*tables))
    return out


@dataclass
class Trees:
    """Complete binary trees: for every inner node a feature and a cut, for every leaf a value."""

    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.features.shape[1]
        for f, c, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            while node[0] < inner if len(node) else False:
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += leaf[node - inner]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, *, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss on histograms."""
    share = min(max(y.mean(), 1e-4), 1 - 1e-4)
    start = math.log(share / (1 - share))
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, bins)[1:-1])) for col in x.T]
    binned = np.stack([np.searchsorted(e, col, side="left") for e, col in zip(edges, x.T, strict=True)], axis=1)
    width = bins + 1
    flat = binned + np.arange(x.shape[1]) * width
    inner = 2**depth - 1
    features, cuts, leaves = [], [], []
    margin = np.full(len(y), start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        f, c = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                own = np.flatnonzero(node == k)
                if len(own) < 10:
                    node[own] = 2 * k + 1
                    continue
                size = x.shape[1] * width
                g = np.bincount(flat[own].ravel(), np.repeat(grad[own], x.shape[1]), size).reshape(-1, width).cumsum(axis=1)
                h = np.bincount(flat[own].ravel(), np.repeat(hess[own], x.shape[1]), size).reshape(-1, width).cumsum(axis=1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
                gain[(h < 0.5) | (ht - h < 0.5)] = -1
                for j, e in enumerate(edges):
                    gain[j, len(e) :] = -1
                j, b = np.unravel_index(gain.argmax(), gain.shape)
                right = np.zeros(len(own), np.int64)
                if gain[j, b] > 1e-3:
                    f[k], c[k] = j, edges[j][b]
                    right = (binned[own, j] > b).astype(np.int64)
                node[own] = 2 * k + 1 + right
        place = node - inner
        g, h = np.bincount(place, grad, inner + 1), np.bincount(place, hess, inner + 1)
        leaf = rate * g / (h + ridge)
        margin += leaf[place]
        features.append(f)
        cuts.append(c)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(cuts), np.array(leaves), start)


@dataclass
class Isotonic:
    """A rising curve from margins to probabilities, linear between its points."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.x, self.y)


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; each pool stands at its mean margin."""
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []
    for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        pools.append([1, v, m])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n, s, t = pools.pop()
            pools[-1] = [pools[-1][0] + n, pools[-1][1] + s, pools[-1][2] + t]
    x = np.array([t / n for n, _, t in pools])
    # A pool's share is drawn a little towards the middle, so that no score is exactly 0 or 1.
    p = np.array([(s + 0.05) / (n + 0.1) for n, s, _ in pools])
    return Isotonic(x, np.maximum.accumulate(p))


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    curve: Isotonic | None
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or self.curve is None:
            return np.full(len(x), self.share)
        return np.clip(self.curve(self.trees.score(x)), 0, 1)


def featurise(rows: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """``keep`` and an array of features for each row that has a text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            made = measure(texts_of(part, "text"), lexicon)
            columns = [part.column(part.schema.get_field_index(k)) for k in keep]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * len(FEATURES)), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([*columns, flat], [*keep, "features"])

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keep), "features array<double>"])
    return rows.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, *, most_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``most_rows`` of the labelled rows; ``labels`` has the id and ``toxic`` (0/1)."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    # The chosen rows are at most most_rows pairs of numbers.
    joined = text.join(F.broadcast(chosen), F.col("_id") == F.col("doc_id")).select("text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).alias("fold"))
    rows = cut(joined)
    x, y, margin = [], [], []
    lexicons = learn_lexicons(rows)
    for fold in (0, 1):
        made = featurise(rows.where(F.col("fold") == fold), lexicons[1 - fold], ["toxic"]).collect()
        x.append(np.array([r.features for r in made], np.float64).reshape(-1, len(FEATURES)))
        y.append(np.array([r.toxic for r in made], np.float64))
    share = float(np.concatenate(y).mean()) if sum(map(len, y)) else 0.0
    if any(len(np.unique(v)) < 2 for v in y):
        drop_cut(rows)
        return Model(Lexicon.of({}, {}), None, None, share)
    for fold in (0, 1):
        margin.append(fit_trees(x[1 - fold], y[1 - fold]).score(x[fold]))
    drop_cut(rows)
    trees = fit_trees(np.concatenate(x), np.concatenate(y))
    curve = fit_isotonic(np.concatenate(margin), np.concatenate(y))
    return Model(lexicons[2], trees, curve, share)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row, by its whole text."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            made = measure(texts_of(part, "text"), model.lexicon)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(made))], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, score double")


def reject(docs: DataFrame, model: Model, *, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows that score below ``threshold``, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, text_col):
            yield part.filter(pa.array(model.score(measure(texts_of(part, text_col), model.lexicon)) < threshold))

    return docs.mapInArrow(run, docs.schema)
