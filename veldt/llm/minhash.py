"""Near-duplicate texts: consistent weighted sampling over TF-IDF shingles, banded, then verified.

A shingle (five words) weighs its number in the text times an inverse document frequency,
ln((N + PRIOR) / n) / ln(1 / COMMON), at most 1 and at least ``LEAST_WEIGHT``: N texts, n of them hold it. So what stands in up
to a tenth of the corpus has full weight, and what more and more texts share weighs less and less. COMMON is
that high as a group of near copies, which may hold a third of all rows, must not fall apart over its own
common shingles; PRIOR stands for texts not seen, so that shares of a few texts mean little. n is read from a
count-min sketch of all shingles of all texts (two rows of hashed cells; the lesser cell counts), which bounds
what driver and tasks hold whatever the corpus; it is at most about N times the mean shingles of a text / 2**17 too high.

Improved consistent weighted sampling (Ioffe) gives each text ``SAMPLES`` samples; two texts share
one with a probability of their weighted Jaccard similarity. Bands of samples are buckets. Texts with
equal shingles are one from the start. Then bucket members are compared exactly, in two rounds:

1. every member of a bucket with its lead, the member that meets most others in all its buckets;
2. of the members of a lead's buckets, the pairs across components that can be alike by what sets each of
   them apart from the lead (``differences``, ``candidates``). No such pair is left out: weighted Jaccard
   distances are bounded by sums of differences, and what two texts must share of them is looked up.

Rows of round 2 are members and their differences, so their number grows with that of the members of buckets that
are open after round 1, not with pairs; members that differ from their lead each in its own way meet nowhere.
No bucket is capped. At a similarity of 0.8 a pair misses all bands with a chance of 2e-4, which is the only one.

Result: one row per row: doc_id, class_id (least id of its group) and kept (the group's leader).
Texts are told apart by a hash of id and text, so different texts under one id, null too, are compared
as any others. The leader is the text of the least id (of several texts of it, the least hash); a null
id leads only groups of null ids, whose class_id is null. Null texts and texts without words are
groups of one. Rows that repeat id and text are alike in all. Other columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, mix64, parts, settle, texts_of
from .components import components
from .shingles import Shingles

CELL_BITS = 17
COMMON, PRIOR, LEAST_WEIGHT = 0.1, 1000, 0.05
SAMPLES, ROWS = 64, 4
#: The most samples that can be drawn.
WIDE = 512
#: The differences of so many texts are handed on at a time.
BLOCK = 512
EPSILON = 1e-6

_draw = np.random.default_rng(20)
_TABLE = 4096
#: Draws of the sampling scheme: Gamma(2, 1) steps and heights, uniform shifts.
_STEP = _draw.gamma(2, 1, _TABLE).astype(np.float32)
_HEIGHT = np.log(_draw.gamma(2, 1, _TABLE)).astype(np.float32)
_SHIFT = _draw.random(_TABLE).astype(np.float32)
_FLAT = (_STEP[:, None] * (_SHIFT[None, :64] - 1)).astype(np.float32)
_KEYS = _draw.integers(1, 2**63, WIDE, np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _draw.integers(1, 2**63, WIDE, np.uint64) * np.uint64(2) + np.uint64(1)


def _cells(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each shingle in both rows of cells."""
    mask = np.uint64((1 << CELL_BITS) - 1)
    first, second = hashes >> np.uint64(64 - CELL_BITS), (hashes >> np.uint64(64 - 2 * CELL_BITS)) & mask
    return first.astype(np.int64), second.astype(np.int64) + (1 << CELL_BITS)


def count_cells(docs: DataFrame, size: int) -> DataFrame:
    """cell, n: in how many texts the shingles of each cell stand, summed; at cell -1, how many texts have shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts = np.zeros(2 << CELL_BITS, np.int64), 0
        for part in parts(batches, "text"):
            s = Shingles(texts_of(part, "text"), size)
            texts += int((np.diff(s.bounds) > 0).sum())
            for cells in _cells(s.hashes):
                held += np.bincount(cells, minlength=len(held))
        cells = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(cells, -1).astype(np.int32)), pa.array(np.append(held[cells], texts))], ["cell", "n"]
        )

    return docs.select("text").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


def idf_of(counted: DataFrame, common: float = COMMON, prior: int = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """The weight of each cell, to hundredths, and how common it is, to eighths of a doubling (a byte each)."""
    n, texts = np.zeros(2 << CELL_BITS), 0
    for batch in counted.toArrow().to_batches():
        cell, number = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        texts += int(number[cell < 0].sum())
        n[cell[cell >= 0]] = number[cell >= 0]
    weight = np.log((texts + prior) / np.maximum(n, 1)) / np.log(1 / common) if texts else np.ones(len(n))
    return np.round(100 * np.clip(weight, LEAST_WEIGHT, 1)).astype(np.uint8), np.minimum(8 * np.log2(n + 1), 255).astype(np.uint8)


def weights(s: Shingles, idf: np.ndarray) -> np.ndarray:
    first, second = _cells(s.hashes)
    return s.counts * (np.maximum(idf[first], idf[second]) / 100)


def sample(s: Shingles, idf: np.ndarray, count: int = SAMPLES) -> np.ndarray:
    """The samples of each text that has shingles, 32 bits each: (texts, count)."""
    log_w = np.log(weights(s, idf)).astype(np.float32)
    heavy = np.flatnonzero(log_w)
    firsts = np.unique(s.bounds[:-1][np.diff(s.bounds) > 0])
    out = np.empty((len(firsts), count), np.int32)
    log_w = log_w[heavy]
    for k in range(count):
        h = (s.hashes ^ _KEYS[k]) * _FACTORS[k]
        h ^= h >> np.uint64(29)
        step = (h >> np.uint64(52)).astype(np.intp)
        shift = ((h >> np.uint64(46)) & np.uint64(63)).astype(np.intp)
        high = _HEIGHT[((h >> np.uint64(34)) & np.uint64(_TABLE - 1)).astype(np.intp)]
        # ln a = ln c - r (t - beta) - r, where t = floor(ln w / r + beta), which is 0 for weight 1.
        level = high + _FLAT[step, shift]
        tag = h & np.uint64(0xFFFFFFFF)
        if len(heavy):
            r = _STEP[step[heavy]]
            t = np.floor(log_w / r + _SHIFT[shift[heavy]])
            level[heavy] -= r * t
            tag[heavy] ^= (t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
        # Positive floats are ordered as their bits are; ties are broken by the tag, alike everywhere.
        bits = np.maximum(level + np.float32(96), np.float32(0)).view(np.uint32).astype(np.uint64)
        least = np.minimum.reduceat(bits << np.uint64(32) | tag, firsts)
        out[:, k] = mix64(least).astype(np.uint32).view(np.int32)
    return out


def signatures(docs: DataFrame, idf: np.ndarray, size: int) -> DataFrame:
    """doc_id, uid, k1, k2 (a hash of all shingles; null without words), samples. One narrow pass."""
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "text"):
            count = part.num_rows
            s = Shingles(texts_of(part, "text"), size)
            some = np.diff(s.bounds) > 0
            keys, lists = [], np.zeros((count, SAMPLES), np.int32)
            if some.any():
                lists[some] = sample(s, idf)
            firsts = s.bounds[:-1][some]
            for salt in (1, 2):
                key = np.zeros(count, np.int64)
                if some.any():
                    each = mix64((s.hashes + s.counts.astype(np.uint64)) * _KEYS[salt])
                    key[some] = np.add.reduceat(each, firsts).view(np.int64)
                keys.append(pa.array(key, mask=~some))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * SAMPLES), pa.array(lists.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *keys, flat], ["doc_id", "uid", "k1", "k2", "samples"])

    return docs.select("doc_id", "uid", "text").mapInArrow(run, f"doc_id {id_type}, uid bigint, k1 bigint, k2 bigint, samples array<int>")


def verify(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float, size: int) -> DataFrame:
    """The pairs (u, v) whose weighted Jaccard similarity is at least the threshold, with it."""
    id_type = dict(pairs.dtypes)["u"]
    one = pairs.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("b")), "v")
    both = one.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("a")), "u").select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "b"):
            u, v, a, b = (c.to_pylist() for c in part.columns)
            # Rows of one u come together: its text is read once.
            place: dict = {}
            texts: list[str] = []
            for ids, own in ((u, a), (v, b)):
                for i, text in zip(ids, own, strict=True):
                    if i not in place:
                        place[i] = len(texts)
                        texts.append(text)
            s = Shingles(texts, size)
            w = weights(s, idf)
            total = np.add.reduceat(np.append(w, 0), s.bounds[:-1])
            told = []
            for x, y in zip(u, v, strict=True):
                p, q = place[x], place[y]
                (pa_, pb), (qa, qb) = s.bounds[p : p + 2], s.bounds[q : q + 2]
                at = np.searchsorted(s.hashes[pa_:pb], s.hashes[qa:qb])
                at[at == pb - pa_] = 0
                same = s.hashes[pa_:pb][at] == s.hashes[qa:qb]
                shared = np.minimum(w[pa_:pb][at[same]], w[qa:qb][same]).sum()
                told.append(shared / (total[p] + total[q] - shared))
            told = np.array(told)
            hit = np.flatnonzero(told >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(hit)), part.column(1).take(pa.array(hit)), pa.array(told[hit])], ["u", "v", "similarity"])

    return both.mapInArrow(run, f"u {id_type}, v {id_type}, similarity double")


def differences(stars: DataFrame, texts: DataFrame, idf: np.ndarray, rank: np.ndarray, threshold: float, size: int) -> DataFrame:
    """What sets each text (v) of a star apart from the star's lead (u), as far as a pair of members can need it.

    One row per element (a shingle that one of the two has more often): lead, rep, comp, element (hash, lowest
    bit: more often in the lead), slack (the text's share of the bound less the weight of its differences), rest
    (the weight of this element and those after it), far (not alike the lead) and first (see ``candidates``).
    """
    id_type = dict(stars.dtypes)["u"]
    one = stars.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("b")), "v")
    both = one.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("a")), "u").select("u", "v", "comp", "a", "b")
    share = (1 - threshold) / (1 + threshold)
    names = ["lead", "rep", "comp", "element", "slack", "rest", "far", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, "b"):
            u, v, comp, a, b = (c.to_pylist() for c in part.columns)
            place: dict = {}
            for i, text in zip(u, a, strict=True):
                place.setdefault(i, (len(place), text))
            s = Shingles([t for _, t in place.values()] + b, size)
            w = weights(s, idf)
            cells = _cells(s.hashes)
            n = np.minimum(rank[cells[0]], rank[cells[1]]).astype(np.int16)
            for at in range(0, len(v), BLOCK):
                made = []
                for k in range(at, min(at + BLOCK, len(v))):
                    (pa_, pb), (qa, qb) = (s.bounds[x : x + 2] for x in (place[u[k]][0], len(place) + k))
                    hashes = np.concatenate([s.hashes[pa_:pb], s.hashes[qa:qb]])
                    signed = np.concatenate([-w[pa_:pb], w[qa:qb]])
                    often = np.concatenate([n[pa_:pb], n[qa:qb]])
                    order = np.argsort(hashes, kind="stable")
                    hashes, often = hashes[order], often[order]
                    new = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
                    more = np.add.reduceat(signed[order], new)
                    some = np.abs(more) > 1e-9
                    hashes, often, more = hashes[new][some], often[new][some], more[some]
                    lacks = more < 0
                    element = (hashes & ~np.uint64(1) | lacks.astype(np.uint64)).view(np.int64)
                    # Rare ones first: what few texts have, then what many have but this one.
                    order = np.lexsort((element, np.where(lacks, 512 - often, often)))
                    element, weight = element[order], np.abs(more[order])
                    rest = np.cumsum(weight[::-1])[::-1]
                    lead_share = share * w[pa_:pb].sum()
                    slack = share * w[qa:qb].sum() - weight.sum()
                    far = bool(slack + lead_share < EPSILON)
                    first = rest >= (-slack if far else (lead_share - slack) / 2) - EPSILON
                    keep = np.flatnonzero(rest >= (-slack - lead_share) / 2 - EPSILON if far else first)
                    made.append((k, element[keep], rest[keep], first[keep], slack, far))
                counts = [len(m[1]) for m in made]
                own = pa.array(np.repeat([m[0] for m in made], counts))
                each = lambda x: np.repeat([m[x] for m in made], counts)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [part.column(x).take(own) for x in range(3)]
                    + [pa.array(np.concatenate([m[1] for m in made])), pa.array(each(4).astype(float)), pa.array(np.concatenate([m[2] for m in made]))]
                    + [pa.array(each(5).astype(bool)), pa.array(np.concatenate([m[3] for m in made]))],
                    names,
                )

    kinds = [id_type] * 3 + ["bigint", "double", "double", "boolean", "boolean"]
    return both.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def candidates(told: DataFrame) -> DataFrame:
    """The pairs (u, v) of one star and different components that can reach the threshold, by ``differences``.

    Two texts x and y are at a distance (the sum of |weight in x - weight in y|) of that of each to the lead, less
    twice what their differences share, and reach the threshold if it is at most the sum of their shares. So what
    they share weighs at least -(slack x + slack y) / 2; where that is not above 0, both are alike the lead and one
    component. The first element that they share, in an order alike in all texts, has a ``rest`` of that weight in
    both. Of a pair the one with more slack is looked up by the elements that come ``first``: after them less is
    left than it must share with any text of less slack. The other is far from the lead, and looks up all.
    """
    rows = lambda which, end: told.where(which).select("lead", "element", *[F.col(c).alias(c + end) for c in ("rep", "comp", "slack", "rest")])
    met = rows("far", "_x").join(rows("first", "_y"), ["lead", "element"])
    order = "slack_x < slack_y OR (slack_x = slack_y AND rep_x < rep_y)"
    enough = F.least("rest_x", "rest_y") >= -(F.col("slack_x") + F.col("slack_y")) / 2 - EPSILON
    met = met.where((F.col("comp_x") != F.col("comp_y")) & F.expr(order) & enough)
    return met.select(F.least("rep_x", "rep_y").alias("u"), F.greatest("rep_x", "rep_y").alias("v")).distinct()


def open_stars(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """u, v, comp: the pairs of a lead and a member, of leads whose members are of several components."""
    here = pairs.join(found, F.col("v") == F.col("node"), "left").select("u", "v", F.coalesce("component", "v").alias("comp"))
    several = here.groupBy("u").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least != most")
    return here.join(several.select("u"), "u", "left_semi")


def _uid(id_col: str, text_col: str) -> Column:
    """What tells texts apart: a hash of id and text."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col(text_col))


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: they are found among the components that the links touch, and carried over."""
    own = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    ends = links.join(own("u"), "u", "left").join(own("v"), "v", "left")
    edges = ends.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")).where("u != v").distinct()
    more = settle(components(edges))
    above = more.select(F.col("node").alias("of"), F.col("component").alias("to"))
    carried = found.join(above, F.col("component") == F.col("of"), "left").select("node", F.coalesce("to", "component").alias("component"))
    fresh = above.join(found, F.col("of") == F.col("node"), "left_anti").select(F.col("of").alias("node"), F.col("to").alias("component"))
    out = cut(carried.union(fresh))
    drop_cut(found, more)
    return out


def _groups(docs: DataFrame, threshold: float, size: int, id_col: str, text_col: str, common: float, prior: int) -> DataFrame:
    """doc_id, uid, class_id, kept for each row of ``docs``. Inside, a text goes by its ``uid``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), _uid(id_col, text_col).alias("uid"), F.col(text_col).alias("text"))
    idf, rank = idf_of(count_cells(rows, size), common, prior)
    signed = cut(signatures(rows, idf, size))
    key = ["k1", "k2"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first")
    classes = signed.where("k1 is not null").groupBy(*key).agg(F.min("uid").alias("rep"), first)
    same = [signed[k] == classes[k] for k in key]
    reps = cut(signed.join(classes, [*same, signed["uid"] == classes["rep"]]).select("rep", "samples").dropDuplicates(["rep"]))

    bands = F.array(*[F.xxhash64(F.lit(b), *[F.get("samples", F.lit(ROWS * b + k)) for k in range(ROWS)]) for b in range(SAMPLES // ROWS)])
    posted = reps.select("rep", F.explode(bands).alias("bucket"))
    shared = posted.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    posts = cut(posted.join(shared, "bucket").select("bucket", "rep", "n"))
    involved = posts.groupBy(F.col("rep").alias("node")).agg(F.sum("n").alias("met"))
    named = rows.where("text is not null").select(F.col("uid").alias("doc_id"), "text")
    texts = cut(named.join(involved, F.col("doc_id") == F.col("node"), "left_semi").dropDuplicates(["doc_id"]))

    # The member that meets most others in all its buckets leads: it is about the middle of its group.
    leads = posts.join(involved, F.col("rep") == F.col("node")).groupBy("bucket").agg(F.max(F.struct("met", "rep")).alias("most"))
    led = posts.join(leads.select("bucket", F.col("most.rep").alias("u")), "bucket").where("rep != u")
    pairs = cut(led.select("u", F.col("rep").alias("v")).distinct())
    links = cut(verify(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), texts, idf, threshold, size))
    found = settle(components(links))
    more = cut(candidates(differences(open_stars(pairs, found), texts, idf, rank, threshold, size)))
    if not more.isEmpty():
        new = cut(verify(more, texts, idf, threshold, size))
        if not new.isEmpty():
            found = _joined(found, new)
        drop_cut(new)
    drop_cut(reps, posts, pairs, texts, links, more)
    label = classes.join(found, F.col("rep") == F.col("node"), "left").select(*key, F.coalesce("component", "rep").alias("comp"), "first")
    leads = label.groupBy(F.col("comp").alias("_comp")).agg(F.min("first").alias("_lead"))
    label = label.join(leads, F.col("comp") == F.col("_comp")).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "_lead")
    out = signed.join(label, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
    own = F.when(F.col("_lead").isNull(), F.col("doc_id")).otherwise(F.col("_lead.doc_id"))
    return out.select("doc_id", "uid", own.alias("class_id"), (F.col("uid") == F.coalesce("_lead.uid", "uid")).alias("kept"))


def near_duplicates(
    docs: DataFrame, *, threshold: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text", common: float = COMMON, prior: int = PRIOR
) -> DataFrame:
    """doc_id, class_id, kept for each row of ``docs``."""
    return _groups(docs, threshold, size, id_col, text_col, common, prior).select("doc_id", "class_id", "kept")


def keep_one(docs: DataFrame, *, threshold: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that lead their group, all columns; of rows that repeat id and text one stays."""
    found = _groups(docs, threshold, size, id_col, text_col, COMMON, PRIOR)
    leaders = found.where("kept").select(F.col("uid").alias("__veldt_leader")).distinct()
    joined = docs.withColumn("__veldt_uid", _uid(id_col, text_col)).join(leaders, F.col("__veldt_uid") == F.col("__veldt_leader"))
    # The join has dealt and sorted the rows by uid already.
    first = F.row_number().over(Window.partitionBy("__veldt_uid").orderBy(F.lit(0)))
    return joined.withColumn("__veldt_number", first).where("__veldt_number = 1").select(*docs.columns)
