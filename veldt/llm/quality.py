"""Quality rules: statistics of each text, and cross-document line frequency.

Lines are normalised (lower case, runs of white space as one space) and hashed. For each host and line
the documents are counted that hold it. A line in more than ``max_docs`` documents, and in more than the
share ``max_share`` of the host's, is removed from them all; documents left with too few of their words
are rejected. The share makes the limit grow with the host, so that ordinary sentences don't cross it.

Two switches serve a pipeline that looks for copies later: with ``contents`` documents of one content count
once, and with ``keep_first`` the first document (least id) of the host that has a line keeps it, so what
is copied is not lost in all its copies.

All of it is DataFrame and SQL functions. Counting is two aggregations that combine before each
shuffle; the join back is on (host, line), which adaptive execution may split; texts are never shuffled
for a verdict. What the one pass over the texts finds is written once to the shared folder.

A line that stands k times in a document counts k times in the words removed, as all k go.

Null text counts as empty (no words: ``base_failed``). A null host is a host of its own. Rows are told
apart by a hash of id, host and text: those alike in all three share a verdict, others under one id, null
too, have their own. Other columns are not read; an empty table gives no rows. Ties in the least id
cannot arise within one id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"

#: Words of the windows that occur twice or more: windows are sorted by hash, neighbours compared,
#: and the spans of 8 words from the repeated starts measured as a union.
_REPEATED = """
transform(array(sort_array(transform(wins, (h, i) -> named_struct('h', h, 'i', i)))), s ->
  transform(array(sort_array(transform(
      filter(s, (x, j) -> coalesce(get(s, j - 1).h = x.h, false) or coalesce(get(s, j + 1).h = x.h, false)), x -> x.i))), p ->
    aggregate(transform(p, (x, k) -> least(8, coalesce(get(p, k + 1) - x, 8))), 0L, (a, b) -> a + b))[0])[0]
"""


#: The hash of each window of 8 words, from the hashes of its words (place by place: slices would copy the text).
_WINDOWS = "if(size(hashes) > 8, transform(sequence(0, size(hashes) - 8), i -> xxhash64({})), array())".format(
    ", ".join(f"get(hashes, i + {k})" for k in range(8))
)


#: The different lines, each with the words of all its occurrences: runs of the sorted ones.
_LINES = """
if(size(array_distinct(each)) = size(each), each, transform(array(sort_array(each)), s ->
  transform(array(filter(sequence(0, size(s) - 1), i -> i = 0 or s[i].line != s[i - 1].line)), p ->
    transform(p, (i, k) -> named_struct('line', s[i].line, 'n_words', s[i].n_words * (coalesce(get(p, k + 1), size(s)) - i))))[0])[0])
"""


def _key(id_col: str, text_col: str, host_col: str) -> Column:
    """What tells rows apart: a hash of id, host and text."""
    parts = [F.col(id_col), F.col(host_col).cast("string"), F.col(text_col)]
    return F.xxhash64(*[x for p in parts for x in (p.isNull(), p)])


def _normal(line: Column) -> Column:
    """Lower case, and every run of white space as one space."""
    out = F.lower(line)
    for blank in "\t\x0b\f\r":
        out = F.replace(out, F.lit(blank), F.lit(" "))
    return F.trim(F.regexp_replace(out, " {2,}", " "))


def profile(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row: doc_id, key, host, the statistics of the text, ``content`` and ``lines``.

    Statistics: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed. ``lines`` are
    the different lines with their hashes and the words of all their occurrences, ``content`` the hash of
    all lines, ``key`` that of id, host and text.
    One narrow pass over the texts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(
        F.col(id_col).alias("doc_id"),
        _key(id_col, text_col, host_col).alias("key"),
        F.col(host_col).cast("string").alias("host"),
        F.filter(F.split(text, BLANK + "+", -1), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD)).alias("raw"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    arrays = split.select(
        "doc_id",
        "key",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        "n_symbols",
        (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.transform("raw", _normal).alias("normal"),
    )
    windows = arrays.withColumn("wins", F.expr(_WINDOWS)).withColumn("each", F.transform("normal", _line))
    counted = windows.select(
        "doc_id",
        "key",
        "host",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.expr(f"if(size(array_distinct(wins)) = size(wins), 0L, {_REPEATED})").alias("n_repeat_words"),
        F.xxhash64("normal").alias("content"),
        F.expr(_LINES).alias("lines"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _line(normal: Column) -> Column:
    words = F.length(normal) - F.length(F.replace(normal, F.lit(" "), F.lit(""))) + 1
    return F.struct(F.xxhash64(normal).alias("line"), words.cast("long").alias("n_words"))


def document_lines(profiles: DataFrame) -> DataFrame:
    """Each different line of each row: doc_id, key, host, content, line, n_words."""
    each = profiles.select("doc_id", "key", "host", "content", F.explode("lines").alias("x"))
    return each.select("doc_id", "key", "host", "content", "x.line", "x.n_words")


def frequent_lines(profiles: DataFrame, lines: DataFrame, max_docs: int, max_share: float, contents: bool) -> DataFrame:
    """Lines in more documents of a host than the limit: host, line, n_docs, first_doc."""
    unit = "content" if contents else "key"
    one = lines.groupBy("host", "line", unit).agg(F.min("doc_id").alias("first_doc"))
    per_line = one.groupBy("host", "line").agg(F.count("*").alias("n_docs"), F.min("first_doc").alias("first_doc")).where(F.col("n_docs") > max_docs)
    hosts = profiles.groupBy("host", unit).agg(F.count("*")).groupBy(F.col("host").alias("_host")).agg(F.count("*").alias("_docs"))
    joined = per_line.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).where(F.col("n_docs") > max_share * F.col("_docs"))
    return joined.select("host", "line", "n_docs", "first_doc")


def removed_lines(lines: DataFrame, frequent: DataFrame, keep_first: bool) -> DataFrame:
    """The document lines that go, once for rows that are alike: key, line, n_words."""
    known = frequent.select(F.col("host").alias("_host"), F.col("line").alias("_line"), "first_doc")
    hit = F.col("host").eqNullSafe(F.col("_host")) & (F.col("line") == F.col("_line"))
    joined = lines.join(known, hit)
    if keep_first:
        joined = joined.where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    return joined.select("key", "line", "n_words").distinct()


def judge(
    docs: DataFrame,
    *,
    max_docs: int = 50,
    max_share: float = 0.001,
    least_share: float = 0.3,
    contents: bool = False,
    keep_first: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """The statistics of each document and whether it is kept.

    Adds ``n_removed_words`` (words in removed lines) and ``kept``: not ``base_failed``, and at least
    ``least_share`` of its words left.
    """
    profiles = cut(profile(docs, id_col=id_col, text_col=text_col, host_col=host_col))
    return _verdict(profiles, max_docs, max_share, least_share, contents, keep_first)[0].drop("key")


def _verdict(
    profiles: DataFrame, max_docs: int, max_share: float, least_share: float, contents: bool, keep_first: bool
) -> tuple[DataFrame, DataFrame]:
    lines = document_lines(profiles)
    removed = removed_lines(lines, frequent_lines(profiles, lines, max_docs, max_share, contents), keep_first)
    gone = removed.groupBy("key").agg(F.sum("n_words").alias("n_removed"))
    joined = profiles.join(gone, "key", "left")
    n_removed = F.least(F.coalesce("n_removed", F.lit(0)), "n_words")
    left_enough = F.col("n_words") - n_removed >= least_share * F.col("n_words")
    verdict = joined.select(
        "key",
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & left_enough).alias("kept"),
        n_removed.alias("n_removed_words"),
    )
    return verdict, removed


def clean(
    docs: DataFrame,
    *,
    max_docs: int = 50,
    max_share: float = 0.001,
    least_share: float = 0.3,
    contents: bool = False,
    keep_first: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """The kept documents with all their columns, their removed lines gone from the text."""
    profiles = cut(profile(docs, id_col=id_col, text_col=text_col, host_col=host_col))
    verdict, removed = _verdict(profiles, max_docs, max_share, least_share, contents, keep_first)
    gone = removed.groupBy("key").agg(F.collect_set("line").alias("__veldt_gone"))
    marked = verdict.where("kept").select("key").distinct().join(gone, "key", "left").withColumnRenamed("key", "__veldt_key")
    stay = F.filter(
        F.split(F.col(text_col), "\n", -1), lambda x: ~(x.rlike(WORD) & F.array_contains(F.col("__veldt_gone"), F.xxhash64(_normal(x))))
    )
    text = F.when(F.col("__veldt_gone").isNull(), F.col(text_col)).otherwise(F.array_join(stay, "\n"))
    keyed = docs.withColumn("__veldt_key", _key(id_col, text_col, host_col))
    return keyed.join(marked, "__veldt_key").withColumn(text_col, text).select(*docs.columns)
