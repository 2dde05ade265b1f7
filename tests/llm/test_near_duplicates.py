"""Near duplicates, components and the pipeline against plain forms on small fixtures."""

import itertools
import math
import os
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldt.llm import components, embeddings, minhash


def find_components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    r = random.Random(1)
    links = {
        "path": [(i, i + 1) for i in range(60)],
        "star": [(50, i) for i in range(50)] + [(50, i) for i in range(51, 80)],
        "random": [(r.randrange(60), r.randrange(60)) for _ in range(45)],
        "none": [],
    }[kind]
    links = [(a, b) for a, b in links if a != b]
    df = spark.createDataFrame(links + links[:3], "u long, v long")
    got = {x.node: x.component for x in components.components(df).collect()}
    assert got == find_components({n for e in links for n in e}, links)


def vectors(seed=0, n=600, width=16):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, width))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(200):
        near = base[i % 40] + r.normal(size=width) * r.choice([0.05, 0.15, 0.25])
        rows.append((1000 + i, near.tolist()))
    rows += [(2000 + i, (2 * base[3]).tolist()) for i in range(30)] + [(2100 + i, base[5].tolist()) for i in range(30)]
    return rows


def plain_links(rows, threshold):
    links = []
    for (i, a), (j, b) in itertools.combinations([(i, np.array(v)) for i, v in rows], 2):
        if a.shape == b.shape and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
            links.append((i, j))
    return links


def test_embeddings(spark):
    rows = vectors()
    odd = [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [1.0, None] + [0.0] * 14), (3004, [float("nan")] + [1.0] * 15), (3005, [float("inf")] * 16), (3006, [1.0, 2.0]), (3007, [2.0, 4.0])]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows + odd + rows[:2]], "vec_id long, embedding array<double>, near string, rep int").repartition(3)
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    links = plain_links(rows + odd[-2:], 0.95)
    count = {}
    for e in links:
        for n in e:
            count[n] = count.get(n, 0) + 1
    assert len(got) == len(rows) + len(odd)
    assert sum(r.n_links for r in got.values()) >= 0.98 * 2 * len(links)
    assert all(r.n_links <= count.get(i, 0) for i, r in got.items())
    true = find_components(got, links)
    assert sum(got[i].component_id == c for i, c in true.items()) >= 0.98 * len(got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert all(got[i].n_links == 0 and got[i].kept for i in range(3000, 3006)) and got[3007].component_id == 3006
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_long_lists_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    r = np.random.default_rng(3)
    base = r.normal(size=16)
    rows = [(i, (base + 0.05 * r.normal(size=16)).tolist()) for i in range(150)] + [(1000 + i, r.normal(size=16).tolist()) for i in range(50)]
    got = {x.vec_id: x.n_links for x in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert sum(got.values()) >= 0.98 * 2 * len(plain_links(rows, 0.95))


def plain_shingles(text, size=5):
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    out = {}
    for s in [tuple(words[i : i + size]) for i in range(len(words) - size + 1)] or ([tuple(words)] if words else []):
        out[s] = out.get(s, 0) + 1
    return out


def corpus(seed=0, groups=25):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(string.ascii_lowercase) for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for g in range(groups):
        words = [word() for _ in range(r.choice([40, 150, 400]))]
        for c in range(r.choice([1, 2, 6])):
            own = list(words)
            for _ in range(int(len(own) * r.choice([0, 0.01, 0.02, 0.03])) if c else 0):
                own[r.randrange(len(own))] = word()
            texts.append(" ".join(own) + (" " + passage if g % 5 == 0 else ""))
    return texts + texts[:3] + [texts[0].upper() + "!", None, "", " .,", "one two", "One, two!", "one two three", "é漢 ß"] * 2


def test_near_texts(spark):
    """Against all pairs by plain weighted Jaccard; the frequencies here are too small to weigh anything."""
    texts = corpus()
    df = spark.createDataFrame([(i, t, "clash", 3) for i, t in enumerate(texts)], "doc_id long, text string, samples string, k1 int").repartition(3)
    got = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    shingles = [plain_shingles(t) for t in texts]
    links = []
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = shingles[i], shingles[j]
        if a and b:
            shared = sum(min(n, b[s]) for s, n in a.items() if s in b)
            if shared / (sum(a.values()) + sum(b.values()) - shared) >= 0.8:
                links.append((i, j))
    true = find_components(range(len(texts)), links)
    assert {i: r.class_id for i, r in got.items()} == true
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.values())
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({*true.values()})
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    repeats = df.where("doc_id < 2").unionByName(df.where("doc_id < 2")).unionByName(df.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted(str(r.doc_id) for r in minhash.keep_one(repeats).collect()) == sorted({str(true[0]), str(true[1]), "None"})


def plain_weights(shingles, common, prior):
    n = len([x for x in shingles if x])
    held = {}
    for own in shingles:
        for x in own:
            held[x] = held.get(x, 0) + 1
    return {x: round(min(1, max(minhash.LEAST_WEIGHT, math.log((n + prior) / k) / math.log(1 / common))), 2) for x, k in held.items()}


@pytest.mark.parametrize("common, prior", [(0.02, 0), (0.05, 10)])
def test_near_texts_by_real_weights(spark, common, prior):
    """Against all pairs where common shingles weigh less than others: some links go, others come."""
    texts = corpus(3, 30)
    shingles = [plain_shingles(t) for t in texts]
    weight = plain_weights(shingles, common, prior)
    assert len(set(weight.values())) > 3 and min(weight.values()) < 0.7

    def alike(w):
        links = []
        for i, j in itertools.combinations(range(len(texts)), 2):
            a, b = shingles[i], shingles[j]
            if a and b:
                shared = sum(min(n, b[x]) * w(x) for x, n in a.items() if x in b)
                if shared / (sum(n * w(x) for x, n in a.items()) + sum(n * w(x) for x, n in b.items()) - shared) >= 0.8 - 1e-12:
                    links.append((i, j))
        return find_components(range(len(texts)), links)

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df, common=common, prior=prior).collect()}
    assert got == alike(weight.__getitem__)
    if common == 0.02:
        assert got != alike(lambda x: 1)


def test_a_common_passage_links_nothing_and_makes_no_pairs_of_all(spark):
    """Half of the texts share a passage that is most of each: by its weight they are not alike."""
    r = random.Random(4)
    word = lambda: "".join(r.choice(string.ascii_lowercase) for _ in range(5))
    passage = " ".join(word() for _ in range(100))
    texts = [" ".join(word() for _ in range(5)) + " " + passage for _ in range(150)] + [" ".join(word() for _ in range(40)) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    flat = minhash.near_duplicates(df)
    assert flat.where("kept").count() < 160
    assert minhash.near_duplicates(df, prior=0).where("kept").count() == 300


def test_different_texts_under_one_id(spark):
    """Rows are told apart by id and text: no clean text goes because its id, null too, stands elsewhere."""
    r = random.Random(12)
    words = lambda n: ["".join(r.choice(string.ascii_lowercase) for _ in range(5)) for _ in range(n)]
    texts = [words(60) for _ in range(14)]
    text = lambda i: " ".join(texts[i])
    near = " ".join([*texts[0][:-1], "other"])
    rows = [(None, text(i)) for i in range(6)] + [(None, text(0)), (None, near)] + [(5, text(i)) for i in range(6, 10)] + [(5, text(6))]
    rows += [(7, text(10)), (7, text(11)), (6, " ".join([*texts[11][:-1], "other"])), (None, text(10)), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in minhash.keep_one(df).collect()]
    assert len(kept) == len(set(kept))
    assert sum(k in kept for k in [(None, text(0)), (None, near)]) == 1
    assert set(kept) - {(None, text(0)), (None, near)} == {*[(None, text(i)) for i in range(1, 6)], *[(5, text(i)) for i in range(6, 10)], (7, text(10)), rows[15], (None, None)}
    got = minhash.near_duplicates(df).collect()
    assert len(got) == len(rows) and sorted(r.class_id for r in got if r.doc_id == 7) == [6, 7]


def test_buckets_of_many_near_copies(spark, monkeypatch):
    """A group whose members are often not alike pairwise, in blocks of a few."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    r = random.Random(9)
    word = lambda: "".join(r.choice(string.ascii_lowercase) for _ in range(5))
    base = [word() for _ in range(120)]
    texts = []
    for _ in range(60):
        own = list(base)
        for _ in range(r.choice([1, 2, 3, 4])):
            own[r.randrange(120)] = word()
        texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(df).collect()}
    shingles = [set(plain_shingles(t)) for t in texts]
    idf = 1.0
    links = [(i, j) for i, j in itertools.combinations(range(60), 2) if len(shingles[i] & shingles[j]) * idf >= 0.81 * (len(shingles[i] & shingles[j]) * idf + len(shingles[i] ^ shingles[j]))]
    true = find_components(range(60), links)
    assert all(got[i] == got[c] for i, c in true.items())


def test_work_on_near_copies_grows_with_their_number(spark, monkeypatch):
    """Three times as many members of a group around the threshold: no table has nine times the rows, no link is lost."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    plain_cut, rows = minhash.cut, []

    def counted(df):
        out = plain_cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(minhash, "cut", counted)
    most = []
    for n in (100, 300):
        r = random.Random(21)
        word = lambda: "".join(r.choice(string.ascii_lowercase) for _ in range(5))  # noqa: B023, E731
        base, texts = [word() for _ in range(200)], []
        for i in range(n):
            # One in five is a changed copy of another member, far from the middle of the group.
            own = list(texts[r.randrange(len(texts))] if i % 5 == 4 else base)
            for _ in range(1 if i % 5 == 4 else r.choice([1, 2, 3, 6])):
                own[r.randrange(200)] = word()
            texts.append(own)
        texts = [" ".join(t) for t in texts]
        shingles = [plain_shingles(t) for t in texts]
        w = plain_weights(shingles, minhash.COMMON, minhash.PRIOR)
        total = [sum(w[x] for x in own) for own in shingles]
        links = []
        for i, j in itertools.combinations(range(n), 2):
            shared = sum(w[x] for x in shingles[i].keys() & shingles[j].keys())
            if shared / (total[i] + total[j] - shared) >= 0.8 - 1e-12:
                links.append((i, j))
        rows.clear()
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        got = {x.doc_id: x.class_id for x in minhash.near_duplicates(df).collect()}
        assert got == find_components(range(n), links)
        assert 10 < len({*got.values()}) < 0.8 * n
        most.append(max(rows))
    assert most[1] < 5 * most[0]


def test_samples_estimate_weighted_jaccard():
    from veldt.llm.shingles import Shingles

    r = random.Random(2)
    words = ["".join(r.choice(string.ascii_lowercase) for _ in range(5)) for _ in range(4000)]
    a, b = words[:3000], words[300:3300]
    s = Shingles([" ".join(a), " ".join(b + b[:500])])
    idf = np.full(2 << minhash.CELL_BITS, 100, np.uint8)
    got = minhash.sample(s, idf, minhash.WIDE)
    x, y = plain_shingles(" ".join(a)), plain_shingles(" ".join(b + b[:500]))
    shared = sum(min(n, y.get(k, 0)) for k, n in x.items())
    true = shared / (sum(x.values()) + sum(y.values()) - shared)
    assert abs((got[0] == got[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / minhash.WIDE)


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")
def test_pipeline(spark):
    """Each stage does what its operator says, to all that the stage before kept."""
    import corpus_pipeline as p

    from veldt.llm import packing, queries, quality, secrets, toxicity
    from veldt.llm.common import cut

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(p.STAGES)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    model = queries.toxicity_model(spark, docs, SF)
    first = cut(stages["toxicity"](spark, docs, SF))
    assert ids(first) == ids(toxicity.score(docs, model).where("score < 0.3")) and first.columns == docs.columns
    second = cut(stages["quality_rules"](spark, first, SF))
    assert ids(second) == ids(quality.judge(first, contents=True, keep_first=True).where("kept")) and second.columns == docs.columns
    third = cut(stages["minhash_near_dedup"](spark, second, SF))
    assert ids(third) == ids(minhash.near_duplicates(second).where("kept"))
    fourth = cut(stages["secret_scan"](spark, third, SF))
    assert ids(fourth) == ids(third)
    assert secrets.digest(secrets.scan(fourth)).where("n_assign + n_access + n_hex > 0").count() == 0
    before = {r.doc_id: r.text for r in third.collect()}
    changed = {r.doc_id for r in fourth.collect() if r.text != before[r.doc_id]}
    assert changed == ids(secrets.scan(third).where("size(spans) > 0"))
    last = stages["best_fit_packing"](spark, fourth, SF)
    whole = lambda df: sorted(tuple(r) for r in df.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert whole(last) == whole(packing.pack(fourth, queries.vocabulary("byte_bpe_50k.json"))) == whole(p.run(spark, SF))
    assert p.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


AWKWARD = [
    (None, None, "en", "a"), (None, "", "en", "a"), (None, "one two", None, None), (None, "three four", None, None), (1, "word " * 3, "en", "a"),
    (1, "word " * 3, "en", "a"), (1, "another text under the same id", "en", "a"), (2, " \n\n\t", "en", None), (3, "aa bb cc dd\n" * 40, "de", "a"),
    (4, " ".join(f"w{i}" for i in range(20_000)), "en", "b"), (5, " ".join(f"w{i}" for i in range(20_000)), "en", "b"), (6, "password=hunter2222 " + " ".join(f"k{i}" for i in range(30)), "fr", "b"),
]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")
@pytest.mark.parametrize("rows", [AWKWARD, []])
def test_the_pipeline_takes_awkward_rows(spark, rows):
    """Null ids and texts, repeated rows, an empty table, long texts, columns whose names clash."""
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, uid string, class_id int, score double, words string, task int"
    docs = spark.createDataFrame([(*r, 7, "k", "u", 1, 0.5, "w", 3) for r in rows], schema)
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == schema.replace(",", "").split()[::2], name
        kept = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "quality_rules" and rows:
            assert all(t is not None and len(t.split()) >= 20 for _, t in kept) and {4, 5, 6} == {i for i, _ in kept}
        if name == "minhash_near_dedup" and rows:
            assert sorted(i for i, _ in kept) == [4, 6]
    if rows:
        assert {r.doc_id: r.text[:8] for r in docs.collect()}[6] == "[SECRET]" and {r.n_chars == len(r.text) for r in docs.collect()} == {True}
    last = p.STAGES[-1][1](spark, docs, SF)
    assert sorted({r.doc_id for r in last.collect()}) == ([4, 6] if rows else [])
