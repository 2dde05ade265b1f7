"""Operators that read one text at a time, against plain forms and on awkward rows."""

import hashlib
import html.parser
import math
import os
import random
import re
import string
import zlib

import pytest
from pyspark.sql import functions as F

from veldt.llm import bpe, chat, html_text, licenses, packing, quality, secrets, toxicity
from veldt.llm.pieces import Split

tokenizers = pytest.importorskip("public_tokenizers")
RANKS, TOKENIZER = tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, source string, score string, words array<int>, task int, lines string"
AWKWARD = [None, "", " ", "\n\n \t\n", "a", "İ ſ K ß", "\u0085\xa0 x", "😀é漢" * 50, "x" * 3000, "don't 's 're  'LL\r\n'd", "a\0b"]


def frame(spark, texts, **more):
    rows = [(i, t, more.get("source", "s"), "clash", [1], 7, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def encoder():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.merger(RANKS).ranks, special_tokens={})


def random_texts(n, seed=0, alphabet=" \n\t'  aabsdtmrelv'L.12!é漢  \x1c😀½ abcdefghijklmnop"):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.choice([0, 3, 20, 400]))) for _ in range(n)]


def test_split_is_the_pattern():
    import regex

    rule = regex.compile(tokenizers.PATTERN)
    texts = [t or "" for t in AWKWARD] + random_texts(400)
    s = Split(texts)
    for i, t in enumerate(texts):
        assert [s.piece(j).decode() for j in range(s.bounds[i], s.bounds[i + 1])] == rule.findall(t)


def test_bpe_is_what_the_library_does(spark):
    texts = AWKWARD + random_texts(200, 1) + ["abc" * 2000, " the the" * 500, "<|endoftext|>"] * 2
    got = {r.doc_id: r for r in bpe.encode_texts(frame(spark, texts), RANKS).collect()}
    e = encoder()
    for i, t in enumerate(texts):
        ids = e.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == sha(b"".join(x.to_bytes(4, "little") for x in ids))
        assert got[i].decoded_sha256 == sha(t or "")
    assert bpe.encode_texts(frame(spark, []), RANKS).count() == 0


def test_long_pieces_merge_alike():
    m, e = bpe.merger(RANKS), encoder()
    r = random.Random(3)
    pieces = ["".join(r.choice(a) for _ in range(n)).encode() for n in (1, 2, 3, 7, 129, 500, 4000) for a in ("a", "ab", "abcething", "=-", string.ascii_lowercase)]
    ids, size = m.encode(pieces)
    ends = size.cumsum()
    for piece, n, end in zip(pieces, size, ends, strict=True):
        assert ids[end - n : end].tolist() == e._encode_single_piece(piece)


@pytest.mark.parametrize("most", [1, 7, 50, 10_000])
def test_a_small_cache_changes_nothing(most):
    e, cache = encoder(), bpe.PieceCache(bpe.merger(RANKS).encode, most)
    for seed in range(12):
        texts = random_texts(6, seed)
        ids, edges = cache.lookup(Split(texts))
        assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:], strict=False)] == [e.encode_ordinary(t) for t in texts]
        assert most < 100 or len(cache.keys) <= most


def test_pieces_that_only_share_a_hash_are_told_apart():
    e, cache = encoder(), bpe.PieceCache(bpe.merger(RANKS).encode)
    for texts in (["alpha beta"], ["gamma beta", " beta gamma alpha"]):
        split = Split(texts)
        split.hashes[:] = 5
        ids, edges = cache.lookup(split)
        assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:], strict=False)] == [e.encode_ordinary(t) for t in texts]


def check_packing(rows, texts, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // capacity)
        assert all(r.length == capacity for r in own[1:])
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing(spark):
    texts = AWKWARD + random_texts(300, 5) + ["word " * 3000, "word " * 1023, "word " * 1022, "word " * 1024]
    rows = packing.pack(frame(spark, texts), TOKENIZER).collect()
    n = check_packing(rows, texts, 1024)
    assert n <= 1.1 * -(-sum(r.length for r in rows) // 1024)
    check_packing(packing.pack(frame(spark, texts[:60]), TOKENIZER, capacity=16).collect(), texts[:60], 16)
    assert packing.pack(frame(spark, []), TOKENIZER).count() == 0


def test_packing_ids_are_the_library_s(spark):
    """The library as it is loaded: an added token in a text is its one id, and cuts the text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    end = "<|endoftext|>"
    texts = [end, f"a {end} b", f"a  {end}  b{end}{end}", "", "plain  text ", f"don{end}'t <|endof{end}text|>", "<|endoftext|", f"{end}x", " x  "]
    ids, edges = packing.encode_whole(texts, TOKENIZER)
    wanted = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:], strict=False)] == wanted and wanted[0] == [50256]
    rows = packing.pack(frame(spark, texts), TOKENIZER).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in rows} == {
        i: (len(x) + 1, zlib.crc32(b"".join(y.to_bytes(4, "little") for y in [*x, 2]))) for i, x in enumerate(wanted)
    }


@pytest.mark.parametrize("seed", range(30))
def test_plan_places_every_piece(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 30, 100, 1024])
    counts = {s: r.choice([0, 1, 2, 5, 1000]) for s in r.sample(range(1, capacity + 1), min(capacity, 25))}
    plan = packing.plan_bins(counts, capacity)
    held, fill = {}, {}
    for size, first, bins, each, offset in plan.entries:
        held[size] = held.get(size, 0) + bins * each
        for b in range(first, first + bins):
            fill.setdefault(b, []).append((offset, each * size))
    assert held == {s: n for s, n in counts.items() if n}
    assert set(fill) == set(range(plan.bins))
    for parts in fill.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity


def test_large_items_pair():
    """Two above a third share a bin if they fit, the largest with its largest partner."""
    plan = packing.plan_bins({600: 2, 424: 1, 400: 1, 24: 1}, 1024)
    assert plan.bins == 2
    assert packing.plan_bins({512: 5}, 1024).bins == 3 and packing.plan_bins({1024: 3, 342: 3}, 1024).bins == 5
    assert packing.plan_bins({}, 1024).bins == 0


def plain_quality(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows, covered = {}, set()
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in windows.values():
        for i in places if len(places) > 1 else ():
            covered.update(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def quality_texts():
    r = random.Random(4)
    texts = [" ".join(r.choice("a b c d e #x y|").replace("z", "") for _ in range(r.choice([5, 30, 200]))) for _ in range(60)]
    vocabulary = ["".join(r.choice(string.ascii_lowercase) for _ in range(6)) for _ in range(900)]
    texts += ["\n".join(" ".join(r.choice(vocabulary) for _ in range(12)) for _ in range(r.randint(1, 6))) for _ in range(60)]
    return AWKWARD + texts + [texts[-1] + "\n" + texts[-1], "\x1cword \x85 x\x0by\x0cz " * 10]


def test_quality_statistics(spark):
    texts = quality_texts()
    got = {r.doc_id: r for r in quality.judge(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_quality(t), t


#: What the pipeline asks for: copies of one text count once, and a line stays in its first document.
ONCE = {"contents": True, "keep_first": True}


def test_quality_lines_by_a_plain_count(spark):
    """The method as it stands: distinct documents of each host, lines above both limits gone from all of them."""
    r = random.Random(31)
    lines = [new_words(r, r.choice([3, 9, 14])) for _ in range(40)]
    hosts = ["hot", "hot", "hot", "cold", None]
    rows = []
    for i in range(150):
        own = [new_words(r, 12) for _ in range(r.randint(1, 4))] + [lines[min(int(r.expovariate(0.1)), 39)] for _ in range(r.randint(0, 6))]
        r.shuffle(own)
        rows.append((i, "\n".join(own), r.choice(hosts), 1.0))
    rows += rows[:20] + [(None, rows[3][1], "hot", 1.0), (None, rows[4][1], "hot", 1.0), (None, None, "hot", 1.0), (5, rows[6][1], "cold", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score double").repartition(3)
    normal = lambda t: [" ".join(x.lower().split()) for x in (t or "").split("\n") if x.split()]
    documents = {(i, h, t): normal(t) for i, t, h, _ in rows}
    per_host = {h: sum(x == h for _, x, _ in documents) for h in hosts}
    for max_docs, max_share in ((4, 0.001), (4, 0.08), (1000, 0.0)):
        held = {}
        for (_, h, _), own in documents.items():
            for line in set(own):
                held[h, line] = held.get((h, line), 0) + 1
        frequent = {x for x, n in held.items() if n > max_docs and n > max_share * per_host[x[0]]}
        wanted = []
        for i, t, h, _ in rows:
            n, gone = len((t or "").split()), sum(len(x.split()) for x in documents[i, h, t] if (h, x) in frequent)
            failed = plain_quality(t)[-1]
            wanted.append((str(i), n, gone, not failed and n - gone >= 0.3 * n))
        got = quality.judge(df, max_docs=max_docs, max_share=max_share).collect()
        assert sorted((str(x.doc_id), x.n_words, x.n_removed_words, x.kept) for x in got) == sorted(wanted)
        assert max_docs == 1000 or len({w[2] for w in wanted}) > 3
        cleaned = quality.clean(df, max_docs=max_docs, max_share=max_share).collect()
        assert sorted(len((x.text or "").split()) for x in cleaned) == sorted(n - gone for _, n, gone, kept in wanted if kept)


def test_quality_lines(spark):
    """A line above the limit goes from all documents of its host but the first; copies of one text count once."""
    r = random.Random(6)
    words = lambda n: " ".join("".join(r.choice(string.ascii_lowercase) for _ in range(7)) for _ in range(n))
    common, copied = words(60), words(80)
    texts = [common + "\n" + words(10) for _ in range(6)] + [common.upper() + "  \n" + words(100)] + [copied] * 20 + [words(30)]
    rows = quality.judge(frame(spark, texts), max_docs=5, **ONCE).collect()
    kept = {x.doc_id: x.kept for x in rows}
    assert [kept[i] for i in range(6)] == [True] + [False] * 5 and kept[6]
    assert all(kept[i] for i in range(7, 28))
    assert {x.doc_id for x in rows if x.n_removed_words} == {1, 2, 3, 4, 5, 6}
    cleaned = {x.doc_id: x for x in quality.clean(frame(spark, texts), max_docs=5, **ONCE).collect()}
    assert set(cleaned) == {i for i, k in kept.items() if k} and cleaned[6].text == texts[6].split("\n")[1]
    assert cleaned[0].text == texts[0] and cleaned[0].score == "clash"
    other = frame(spark, texts[:4]).union(frame(spark, texts[4:6], source=None).withColumn("doc_id", F.col("doc_id") + 4))
    assert all(x.kept for x in quality.judge(other, max_docs=5, **ONCE).collect())


def new_words(r, n):
    return " ".join("".join(r.choice(string.ascii_lowercase) for _ in range(7)) for _ in range(n))


def test_quality_counts_every_occurrence_of_a_line(spark):
    """A frequent line that stands many times in a document is removed many times, and all its words count."""
    r = random.Random(16)
    common = [new_words(r, 5) for _ in range(5)]
    # Every pair of neighbours differs, so no window of 8 words recurs.
    mixed = "\n".join(x for k in range(8) for i in range(5) for x in (common[i], new_words(r, 1)))
    texts = ["\n".join(common) + "\n" + new_words(r, 90) for _ in range(6)] + [mixed + "\n" + new_words(r, 20)]
    rows = {x.doc_id: x for x in quality.judge(frame(spark, texts), max_docs=5, **ONCE).collect()}
    last = rows[6]
    assert (last.n_words, last.n_removed_words, last.base_failed, last.kept) == (260, 200, False, False)
    assert [rows[i].n_removed_words for i in range(6)] == [0] + [25] * 5 and all(rows[i].kept for i in range(6))
    cleaned = {x.doc_id: len(x.text.split()) for x in quality.clean(frame(spark, texts), max_docs=5, **ONCE).collect()}
    assert cleaned == {i: rows[i].n_words - rows[i].n_removed_words for i in range(6)}


def test_quality_judges_rows_by_themselves(spark):
    """Repeated rows do not add up their removed words, nor do different texts under one id or a null one."""
    r = random.Random(17)
    common = new_words(r, 40)
    texts = [common + "\n" + new_words(r, 60) for _ in range(8)] + [new_words(r, 30)]
    df = frame(spark, texts)
    twice = quality.judge(df.union(df), max_docs=5, **ONCE).collect()
    assert len(twice) == 18 and all(x.kept for x in twice) and {x.n_removed_words for x in twice if 1 <= x.doc_id < 8} == {40}
    shared = df.withColumn("doc_id", F.when(F.col("doc_id") > 1, F.lit(None).cast("long")).otherwise(F.col("doc_id")))
    assert [(x.n_words, x.n_removed_words, x.kept) for x in quality.judge(shared, max_docs=5, **ONCE).orderBy("n_words", "n_removed_words").collect()] == [
        (30, 0, True), (100, 0, True), *[(100, 40, True)] * 7,
    ]
    cleaned = sorted(len(x.text.split()) for x in quality.clean(shared, max_docs=5, **ONCE).collect())
    assert cleaned == [30, *[60] * 7, 100]
    hosts = df.union(frame(spark, texts[3:4], source="other")).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.lit(None).cast("long")).otherwise(F.col("doc_id")))
    assert sorted(len(x.text.split()) for x in quality.clean(hosts.where("source = 'other' or text is not null"), max_docs=5, **ONCE).collect()) == [30, *[60] * 7, 100, 100]


def test_quality_on_nothing_and_repeats(spark):
    assert quality.judge(frame(spark, [])).count() == 0 and quality.clean(frame(spark, [])).count() == 0
    one = frame(spark, ["w " * 5 + " ".join(f"v{i}" for i in range(40))])
    assert [r.kept for r in quality.judge(one.union(one).withColumn("doc_id", F.lit(None).cast("long"))).collect()] == [True, True]


def plain_spans(text):
    out = []
    word = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    rules = [("assign", word + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", r"(AKIA[A-Z0-9]+)"), ("hex", r"([0-9a-f]+)")]
    for k, (kind, rule) in enumerate(rules):
        for m in re.finditer(rule, text):
            if len(m.group(1)) >= (6, 20, 24)[k]:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(out))


def secret_texts():
    r = random.Random(7)
    random_key = lambda n: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(n))
    texts = ['token = "abcdef0123"', "token=token:abcdefg", "PassWord: 'x' secret=abcde api_key=abcdef APIKEY:abcdef", "AKIA" + "A" * 16 + " AKIAAKIA12", "é" * 5 + "a1" * 12]
    texts += ["paſſword=abcdefgh", "toKen=abcdefgh", "secret=" + "a" * 40, "key " + random_key(40) + " end", "deadbeef" * 3 + " token=" + "b" * 8]
    return AWKWARD + texts + [f"thing {random_key(44)} thing" for _ in range(20)] + ["MyVeryLongClassNameFactory2 path/to/some/file/name_of_thing.py"]


def test_secrets(spark):
    texts = secret_texts()
    scanned = {r.doc_id: r for r in secrets.digest(secrets.scan(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        base = plain_spans(t or "")
        r = scanned[i]
        assert r.base_sha256 == sha(base), t
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(base.count(k + ":") for k in ("assign", "access", "hex"))
        assert set(base.split(",")) <= set(r.spans.split(",")) if base else True
    keys = [i for i, t in enumerate(texts) if t and t.startswith("thing ")]
    assert sum(scanned[i].spans == "random:6:50" for i in keys) >= 19
    long = "aa bb\n" * 30_000 + "password=hunter22 " + "k9" * 9 + "\n"
    told = secrets.digest(secrets.scan(frame(spark, [long, long]))).collect()
    assert [r.spans for r in told] == ["assign:180000:180017"] * 2
    assert scanned[len(texts) - 1].spans in ("", "random:0:27")  # a name that looks like base62
    hidden = {r.doc_id: r.text for r in secrets.redact(frame(spark, texts)).collect()}
    assert hidden[0] is None and hidden[1] == "" and hidden[keys[0]] == "thing [SECRET] thing" and hidden[11] == '[SECRET]"'
    assert secrets.scan(frame(spark, [])).count() == 0


def test_false_discovery_thresholds():
    classes = len(secrets.ENCODINGS) * (len(secrets.CLASSES) + 1)
    assert secrets.thresholds({(0, 500): 3, (0, 10): 97}, 0.01)[0] == 500
    assert secrets.thresholds({}, 0.01) == {k: secrets.MOST_STEPS + 1 for k in range(classes)}
    null = secrets.fitted_null()
    assert secrets.test_token("abcdefghijklmnopqrstuvwxyz0123456789", null) is None and secrets.test_token("A1" * 12, null) is None
    r = random.Random(3)
    for rate in (0.001, 0.01, 0.2):
        steps = [r.choice([r.randrange(60), r.randrange(800)]) for _ in range(300)]
        p = sorted(10 ** (-x / secrets.STEPS) for x in steps)
        taken = max([i + 1 for i in range(len(p)) if p[i] <= rate * (i + 1) / len(p)], default=0)
        least = secrets.thresholds({(5, x): steps.count(x) for x in steps}, rate)[5]
        assert sum(x >= least for x in steps) == taken


#: Least share of random tokens that are found where one token in twenty of their class is random, by encoding and length.
RECALL = {
    "hex": (0.88, 0.93, 0.97), "HEX": (0.85, 0.93, 0.97), "base32": (0.68, 0.78, 0.88), "base36": (0.8, 0.92, 0.97), "BASE36": (0.85, 0.92, 0.97),
    "base62": (0.8, 0.92, 0.97), "base64": (0.68, 0.88, 0.93), "base64url": (0.72, 0.85, 0.95),
}


def test_random_tokens_of_every_encoding_are_found_among_ordinary_ones():
    null, r = secrets.fitted_null(), random.Random(11)
    for encoding, (name, _, alphabet) in enumerate(secrets.ENCODINGS):
        for length, wanted in zip((20, 28, 40), RECALL[name], strict=True):
            tokens = []
            while len(tokens) < 40:
                token = "".join(r.choice(alphabet) for _ in range(length))
                tokens += [(token, True)] * (secrets.encoding_of(token) == encoding)
            tokens += [(secrets.ordinary(encoding, length, r), False) for _ in range(760)]
            told = [(secrets.test_token(t, null), is_random) for t, is_random in tokens]
            told = [(min(secrets.MOST_STEPS, max(0, int(-x[1] * secrets.STEPS))) if x else -1, is_random) for x, is_random in told]
            counts = {}
            for step, _ in told:
                if step >= 0:
                    counts[0, step] = counts.get((0, step), 0) + 1
            least = secrets.thresholds(counts, 0.01)[0]
            found = [is_random for step, is_random in told if step >= least]
            assert sum(found) >= (wanted - 0.12) * 40, (name, length, sum(found))
            assert len(found) - sum(found) <= 4, (name, length, len(found), sum(found))


def test_licenses(spark):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 200)
    texts = AWKWARD + [
        "Some words.\nReleased under the MIT License.\nMore.",
        "x\n\n" + mit.replace(" deal", "\n  deal") + "\n\ny",
        "Neither the name of Foo Bar nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission.",
        "Released under the MIT-like License.",
        "my license to drive",
        "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0.",
    ]
    got = {r.doc_id: r for r in licenses.digest(licenses.scan(frame(spark, texts))).collect()}
    n = len(AWKWARD)
    assert all(got[i].n_licenses == 0 for i in range(n))
    assert [got[n + i].licenses for i in range(6)] == ["MIT", "MIT", "BSD-3-Clause", "", "", "Apache-2.0,CC-BY-NC-4.0"]
    assert got[n].spans == "MIT:12:42"
    assert licenses.scan(frame(spark, [])).count() == 0


def plain_alignments(words, template, most):
    """For each start, the fewest changes to the template's words over all ends: (changes, start, end), telling words fixed."""
    apart = lambda w: w in licenses.TELLING or any(c.isdigit() for c in w)
    own, out = [w for p in template.parts for w in p], []
    for start in range(len(words)):
        row = {0: 0}
        for token in [None, *own]:
            then = {}
            for j in range(min(len(words) - start, len(own) + most) + 1):
                options = []
                if token is None:
                    options.append(0 if j == 0 else 10**6)
                else:
                    options.append(row[j] + (10**6 if apart(token) else 1))
                    if j:
                        word = words[start + j - 1]
                        options.append(row[j - 1] + (0 if word == token else 10**6 if apart(word) or apart(token) else 1))
                        options.append(then[j - 1] + (10**6 if apart(word) else 1))
                then[j] = min(options)
            row = then
        end = min(row, key=lambda j: (row[j], j))
        if row[end] <= most:
            out.append((row[end], start, start + end))
    return out


def test_licenses_by_all_templates_on_all_places():
    r = random.Random(21)
    vocabulary = ["".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(3, 9))) for _ in range(80)] + ["v2", "not", "mit"]
    templates = [(f"L{k}", "license " + " ".join(r.choice(vocabulary) for _ in range(r.choice([6, 21, 30, 45])))) for k in range(8)]
    scanner = licenses.Scanner(templates)
    found = 0
    for _ in range(40):
        k = r.randrange(8)
        own = templates[k][1].split()
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            place = r.randrange(1, len(own))
            own[place : place + 1] = r.choice([[], [r.choice(vocabulary)], [own[place], r.choice(vocabulary)]])
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 25))] + own + [r.choice(vocabulary) for _ in range(r.randint(0, 25))]
        wanted = []
        for name, template in zip([n for n, _ in templates], scanner.templates, strict=True):
            some = plain_alignments(words, template, template.own // licenses.WORDS_A_CHANGE)
            if some:
                wanted.append((name, min(some)[0]))
        got = scanner.scan(" ".join(words).replace("license", "license", 1))
        assert [(f["license"], len(f["changes"])) for f in got] == wanted, (words, got)
        found += len(got)
    assert found > 15


def test_licenses_with_differences(spark):
    by_name = {n: t for n, t in licenses.TEMPLATES if len(t) > 100}
    cases = [
        (by_name["MIT"].replace("deal in", "trade in"), "MIT", 1),
        (by_name["MIT"].replace(" The above", "\n\n   The above").replace("rights", "freedoms"), "MIT", 1),
        (by_name["BSD-2-Clause"].replace(" 1.", "\n\n  1.").replace(" 2.", "\n\n  2.").replace("must retain", "shall retain"), "BSD-2-Clause", 1),
        ("# " + by_name["ISC"].replace(", ", ",\n# ").replace("any purpose", "any use"), "ISC", 1),
        (by_name["Apache-2.0"].replace("this file", "this work"), "Apache-2.0", 1),
        (by_name["MIT"].replace("without restriction", "with restriction"), "", 0),
        (by_name["MPL-2.0"].replace("v. 2.0", "v. 1.1"), "", 0),
        ("SPDX-License-Identifier: BSD-3-Clause\n", "BSD-3-Clause", 0),
        ("This tool is licensed under the GPL v3, see there.", "GPL-3.0", 0),
        ("words " * 30_000 + "\nReleased under the GPLv2.\n" + "words " * 30_000, "GPL-2.0", 0),
    ]
    got = {r.doc_id: r for r in licenses.digest(licenses.scan(frame(spark, [t for t, _, _ in cases]))).collect()}
    assert [(got[i].licenses, got[i].n_changes) for i in range(len(cases))] == [(n, k) for _, n, k in cases]
    scanner = licenses.Scanner(licenses.TEMPLATES)
    assert scanner.scan(cases[0][0])[0]["changes"] == ["deal>trade"]
    for name, text in licenses.TEMPLATES:  # each is found by itself: it has a cue and saves enough
        assert [f["license"] for f in scanner.scan(text.replace("*", "Someone"))] == [name.replace("*", "Someone")], text


def test_published_licenses(spark):
    """The published forms have blank lines between their paragraphs; other paragraphs and long texts stand around them."""
    cut_at = {"MIT": ("The above copyright",), "BSD-2-Clause": ("1. Redist", "2. Redist")}
    whole = {}
    for name, marks in cut_at.items():
        text = next(t for n, t in licenses.TEMPLATES if n == name and len(t) > 200)
        for mark in marks:
            text = text.replace(" " + mark, "\n\n" + mark)
        whole[name] = text
        assert text.count("\n\n") == len(marks)
    r = random.Random(8)
    filler = "\n\n".join(" ".join(r.choice(["license", "alpha", "beta", "gamma", "warranty", "delta"]) for _ in range(30)) for _ in range(400))
    texts, wanted = [], []
    for name, text in whole.items():
        for lead, tail in (("", ""), (f"{name} License\n\nCopyright (c) 2020 A\n\n", '\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY.'), (filler + "\n\n", "\n\n" + filler)):
            texts.append(lead + text + tail)
            wanted.append(f"{name}:{len(lead)}:{len(lead + text.rstrip('.'))}")
        commented = "\n".join(" *      " + x for x in text.replace(", ", ",\n").split("\n"))
        texts.append("/*\n" + commented + "\n */")
        wanted.append(f"{name}:{texts[-1].index('P' if name == 'MIT' else 'R')}:{len(texts[-1]) - 5}")
    both = whole["MIT"] + "\n\n" + whole["BSD-2-Clause"]
    texts.append(both)
    wanted.append(f"MIT:0:{len(whole['MIT']) - 1},BSD-2-Clause:{len(whole['MIT']) + 2}:{len(both) - 1}")
    got = {r.doc_id: r.spans for r in licenses.digest(licenses.scan(frame(spark, texts))).collect()}
    assert [got[i] for i in range(len(texts))] == wanted


def test_chats(spark):
    ctl = "a\\b [IN\\ST] [\\INST] </s> \\\\[/INST] <s> [SYS][/ROLE] \\"
    rows = [(1, 0, "user", ctl), (1, 1, "assistant", ctl), (2, 0, "assistant", "x"), (2, 1, None, None), (2, 1, "tool</s>", ""), (3, None, "system", "s"), (3, 0, "user", "q"),
            (3, 1, "assistant", "é😀"), (None, 0, "user", "u"), (4, 0, "user", "same"), (4, 0, "user", "same")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn int, role string, text string, segments string").repartition(3)
    got = {r.conv_id: r for r in chat.digest(chat.format_chats(df)).collect()}
    key = lambda r: tuple((v is not None, v) for v in (r[1], r[2] or "", r[3] or ""))
    for conv in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        loss = "".join(t for role, t in own if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{a}\n{b}\n" for a, b in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    assert {c: (r.valid, r.error_turn) for c, r in got.items()} == {1: (True, None), 2: (False, 0), 3: (True, None), None: (False, 1), 4: (False, 1)}
    joined = chat.format_chats(df).select(F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("a"), "formatted")
    assert joined.where("a <> formatted").count() == 0
    assert chat.format_chats(df.limit(0)).count() == 0


def test_page_blocks():
    page = """<html><head><title>x</title></head><body><!-- c --><script>if (a < b) "</p>"</script><nav class=menu><a href='/'>Home</a></nav>
    <p>one &amp; <b>two<br>three</b>&nbsp;four<p>five<ul><li>a<li>b</ul><table><tr><td>1<td>2</table>six</body>"""
    assert [b.text for b in html_text.leaf_blocks(page)] == ["Home", "one & two three four", "five", "a", "b", "1", "2", "six"]
    assert html_text.leaf_blocks("") == [] and [b.text for b in html_text.leaf_blocks("a < b & c <p unclosed")] == ["a < b & c"]


def test_pages_without_optional_tags(spark):
    """A head that is not closed hides nothing of the body; elements that never end hide nothing; math and object show text."""
    texts = lambda page: [b.text for b in html_text.leaf_blocks(page)]
    article = "<article><h1>Title</h1><p>One sentence, of the article.</p><p>Another one.</p></article>"
    shown = ["Title", "One sentence, of the article.", "Another one."]
    for head in ("<head><title>t</title>", "<head><meta charset=utf-8><style>p {}</style><script>x</script>", "<head><noscript>n</noscript></head>", "<HEAD><title>t</title></HEAD>"):
        for body in ("<body>", ""):
            assert texts(f"<html>{head}{body}{article}") == shown
    assert texts(f"<head><title>t {article}") == [] and texts(f"<header>a</header>{article}") == ["a", *shown]
    assert texts("<p>a <math><mi>x</mi><mo>=</mo><annotation encoding=tex>\\x</annotation></math> b <object data=d>c</object></p>") == ["a x= b c"]
    for open_ in ("<svg>", "<canvas>", "<template>", "<iframe src=x>", "<svg/>", "<title-card>", "<style-guide>"):
        assert texts(f"<p>a</p>{open_}{article}") == ["a", *shown]
    assert texts(f"<p>a</p><svg/>{article}<svg>no</svg>") == ["a", *shown]
    assert texts("<canvas>" * 20_000 + "a") == ["a"]
    page = f"<html><head><title>t</title><body><nav><ul><li><a href='/a'>Menu</a></li></ul></nav>{article}<footer>&copy; x</footer>"
    rows = html_text.extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).collect()
    assert rows[0].text == "\n".join(shown)


def test_features_see_the_whole_block():
    """Phrases count wherever they stand, and no feature has a name but no value."""
    long = html_text.features(html_text.leaf_blocks("<p>" + "word " * 200 + "all rights reserved</p>"))
    assert long[0, html_text.NAMES.index("phrase")] == 1
    assert long.shape[1] == len(html_text.NAMES) and "digits" not in html_text.NAMES


def test_pages(spark):
    chain = html_text.trained()
    wrong = total = 0
    for seed in range(20_000, 20_150):
        x, y = html_text.labelled(seed)
        wrong += int((chain.decode(x) != y).sum())
        total += len(y)
    assert wrong < 0.02 * total
    page = '<html><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy.</div><article><h1>T &lt;1&gt;</h1><p>A  b\n c.</p></article><footer>&copy; x</footer>'
    rows = [(1, "u", page, 0), (2, None, None, 0), (3, "u", "", 0), (None, "u", page, 0), (1, "u", page, 0), (5, "u", "<p>" + "w " * 30_000 + "</p>", 0)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert [r.text for r in got if r.page_id in (1, None)] == ["T <1>\nA b c."] * 3
    assert [r.text for r in got if r.page_id in (2, 3)] == ["", ""] and len(got) == 6


class PlainReader(html.parser.HTMLParser):
    """The blocks inside the article element of a page, without the asides, adverts and forms in it."""

    GONE = frozenset("script style aside nav form header footer title".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.held, self.inside, self.gone = [], [], False, []

    def handle_starttag(self, tag, attrs):
        if tag in html_text.BLOCKS:
            self.cut()
        elif tag == "br":
            self.held.append(" ")
        self.inside |= tag == "article"
        if tag in self.GONE or tag == "div" and (self.gone or dict(attrs).get("class")):
            self.gone.append(tag)

    def handle_endtag(self, tag):
        if tag in html_text.BLOCKS:
            self.cut()
        if self.gone and self.gone[-1] == tag:
            self.gone.pop()
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside and not self.gone:
            self.held.append(data)

    def cut(self):
        if text := " ".join("".join(self.held).split()):
            self.blocks.append(text)
        self.held = []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are absent")
def test_given_pages_are_their_article(spark):
    got = {r.page_id: r for r in html_text.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    wrong = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        reader = PlainReader()
        reader.feed(r.html)
        reader.close()
        reader.cut()
        wrong += got[r.page_id].text != "\n".join(reader.blocks)
    assert len(got) == 250 and wrong == 0


def test_bare_pages(spark):
    """Text without any element around it, however short or long, is the text of its page."""
    long = "Words, and more words. " * 9000
    pages = ["<p>One plain sentence, of an article.</p>", f"<p>{long}</p>", "<h1>A title</h1><p>Some words, here.</p><p>And some more of them, there.</p>", "Just some words, without any element at all."]
    got = html_text.extract(spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {
        0: "One plain sentence, of an article.", 1: long.strip(), 2: "A title\nSome words, here.\nAnd some more of them, there.", 3: pages[3],
    }


def test_decoding_is_the_best_path():
    import itertools

    import numpy as np

    r = np.random.default_rng(1)
    c = html_text.Chain(r.normal(size=3), r.normal(size=(2, 2)), r.normal(size=2))
    for n in range(1, 7):
        x = r.normal(size=(n, 3))
        gain = x @ c.weights
        score = lambda p, g=gain: c.first[p[0]] + sum(g[i] * v for i, v in enumerate(p)) + sum(c.moves[a, b] for a, b in zip(p, p[1:], strict=False))
        assert max(itertools.product((0, 1), repeat=n), key=score) == tuple(c.decode(x).astype(int))


def plain_features(text, words_of, prefixes_of):
    """The features of one text, character by character and word by word."""
    small = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    spans = [m.span() for m in re.finditer(r"\w+", text)]
    words = [small[a:b] for a, b in spans]
    n = max(len(words), 1)
    weight = [words_of.get(w, 0) for w in words]
    prefix = [max([prefixes_of.get(w[:k], 0) for k in toxicity.PREFIXES if len(w) > k], default=0) for w in words]
    second = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    near = sum(any(abs(i - j) <= toxicity.NEAR for j in second) for i in range(len(words)) if weight[i] or prefix[i])
    letters = max(len(re.findall("[A-Za-z]", text)), 1)
    capitals = len(re.findall("[A-Z]", text))
    shouted = sum(b - a > 2 and any(c.isupper() for c in text[a:b]) and not any(c.islower() for c in text[a:b]) for a, b in spans)
    mixed = []
    for m in re.finditer(r"[\w@$!*]+", text):
        for a, b in spans:
            own = text[a:b]
            if m.start() <= a < m.end() and re.search(r"[^\W\d_]", own) and (re.search(r"\d", own) or text[b : b + 1] in list("@$!*")):
                if m.end() - a >= 3:
                    mixed.append(small[a : m.end()].translate(str.maketrans("0134578@$!", "oieastbasi")))
                    break
    masked = len(re.findall(r"(?<=[^\W\d_])[*@$#!]+(?=[^\W\d_])", text))
    masked += len(re.findall(r"(?<![^\W\d_])(?:[^\W\d_][.\-_ ]){3,}[^\W\d_](?![^\W\d_])", text))
    size = max(len(text), 1)
    among = lambda signs: sum(c in signs for c in text) / size
    return [
        math.log1p(len(words)), sum(w > 0 for w in weight) / n, sum(weight) / n, max(weight, default=0), sum(w > 0 for w in weight),
        len({w for w, x in zip(words, weight, strict=True) if x}), sum(p > 0 for p in prefix) / n, max(prefix, default=0), sum(w in words_of for w in mixed),
        near / n, len(second) / n, capitals / letters, shouted / n if capitals > 0.2 * letters else 0, among("!"), among("?"), among(".,;:!?'\"()-"),
        among("#*$%&|<>@^~+="), among("0123456789"), len(mixed) / n, masked / n, len(re.findall(r"([^\W\d_])\1{2,}", text)) / n, sum(map(len, words)) / n,
    ]


def test_toxicity_features_are_the_plain_ones():
    words, prefixes = {"vile": 2.0, "rot": 1.5, "you": 0.5, "sh_t": 3.0}, {"dung": 1.0, "vileho": 2.5}
    lexicon = toxicity.Lexicon.of(words, prefixes)
    texts = [t or "" for t in AWKWARD] + random_texts(150, 7) + random_texts(150, 8, "vileroYOUt  dung!$1@.-_ *#'é½İ²") + [
        "You VILE rotten v1le fellow, sooooo v!le you!!", "r.o.t. r o t s r-o-t-s you", "a*b*c d@e f**k", "VILEHORSE vilehorse dungface ya", "x " * 1500 + "vile",
    ]
    got = toxicity.measure(texts, lexicon)
    for text, row in zip(texts, got, strict=True):
        for name, x, y in zip(toxicity.FEATURES, row, plain_features(text, words, prefixes), strict=True):
            assert x == pytest.approx(y, abs=1e-12), (name, text[:100])
    assert (toxicity.measure(texts[5:6], lexicon) == got[5:6]).all()


def test_the_lexicon_has_every_term_that_passes(spark):
    """Thousands of terms, by a plain count; there is no cap."""
    r = random.Random(5)
    rows = []
    for i in range(400):
        toxic = int(i % 4 == 0)
        rows.append((i, " ".join([f"w{r.randrange(2000)}" for _ in range(30)] + [f"bad{j}x" for j in range(3000)] * toxic + [f"only{i}"]), toxic, i % 8 // 4))
    frame_ = spark.createDataFrame(rows, "doc_id long, text string, toxic int, fold int")
    lexicons = toxicity.learn_lexicons(frame_)
    for folds, lexicon in zip(((0,), (1,), (0, 1)), lexicons, strict=True):
        own = [(set(t.split()), y) for _, t, y, f in rows if f in folds]
        share = sum(y for _, y in own) / len(own)
        wanted = {}
        for kind, terms in (("words", lambda w: {w}), ("prefixes", lambda w: {w[:k] for k in toxicity.PREFIXES if len(w) > k})):
            n, k = {}, {}
            for words, y in own:
                for t in set().union(*map(terms, words)):
                    n[t], k[t] = n.get(t, 0) + 1, k.get(t, 0) + y
            for t in n:
                a = k[t] / n[t]
                if k[t] >= 4 and a > 2 * share:
                    tail = -n[t] * (a * math.log(a / share) + ((1 - a) * math.log((1 - a) / (1 - share)) if a < 1 else 0))
                    if tail < -14:
                        wanted.setdefault(kind, {})[t] = math.log((k[t] + 0.5) / (n[t] - k[t] + 0.5) * (1 - share) / share)
        assert len(lexicon.words.hashes) == len(wanted["words"]) == 3000 and len(lexicon.prefixes.hashes) == len(wanted["prefixes"])
        same = toxicity.Lexicon.of(wanted["words"], wanted["prefixes"])
        assert (same.words.hashes == lexicon.words.hashes).all() and same.words.weights == pytest.approx(lexicon.words.weights)
        assert (same.prefixes.hashes == lexicon.prefixes.hashes).all()


def test_trees_score_as_a_walk_through_each():
    import numpy as np

    r = np.random.default_rng(4)
    x = r.normal(size=(300, 5))
    trees = toxicity.fit_trees(x, (x[:, 2] + r.normal(size=300) > 0).astype(float), rounds=12)
    for row, told in zip(x, trees.score(x), strict=True):
        total = trees.start
        for f, c, leaf in zip(trees.features, trees.cuts, trees.leaves, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > c[node] else 1)
            total += leaf[node - len(f)]
        assert told == pytest.approx(total)


def toxic_rows(n, seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("bdfgklmn") + r.choice("aeiou") for _ in range(3)) for _ in range(300)]
    rows = []
    for i in range(n):
        toxic = int(r.random() < 0.25)
        words = [r.choice(vocabulary) for _ in range(r.randint(20, 120))]
        for _ in range(r.randint(2, 5) if toxic else 0):
            words[r.randrange(len(words))] = r.choice(["vilehorse", "rotbrain", "dungface"])
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity(spark):
    rows = toxic_rows(1500, 1)
    docs = spark.createDataFrame([(i, t, "clash", 1.0) for i, t, _ in rows], "doc_id long, text string, toxic string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:1000]] + [(0, None), (None, 1), (99_999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    right = sum((got[i] >= 0.3) == bool(y) for i, _, y in rows[1000:])
    assert right >= 490 and all(0 <= s <= 1 for s in got.values())
    odd = toxicity.score(frame(spark, AWKWARD), model).collect()
    assert len(odd) == len(AWKWARD) and len({r.score for r in odd if r.doc_id in (0, 1)}) == 1
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.3}
    nothing = toxicity.train(docs, labels.where("toxic = 5"))
    assert {r.score for r in toxicity.score(docs.limit(3), nothing).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0
    bounded = toxicity.train(docs, labels, most_rows=400)
    assert bounded.trees is not None


def test_trees_and_isotonic():
    import numpy as np

    r = np.random.default_rng(2)
    x = r.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((toxicity.fit_trees(x, y).score(x) > 0) == (y > 0)).mean() > 0.97
    curve = toxicity.fit_isotonic(np.array([1.0, 2, 3, 3, 4]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(curve(np.linspace(0, 5, 50))) >= 0).all()
