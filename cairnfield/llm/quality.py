"""Quality rules as one projection without user functions (operator 4).

`THRESHOLDS` is a table of rules (metric, least, most); `verdicts` compiles it into columns. Every metric is a ratio of
counts that are taken over the whole text in the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: White space that ends a word: space, and from tab to carriage return.
BLANKS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Words that prose in the corpus' languages can't do without (fixed values).
_STOPS = "the of and to in a is that it for was on with as by at from be this or le la les de des et un une en est que dans pour du sur avec pas qui au par der die das und ist nicht ein eine zu mit von den auf im sich el los las y por con para no su al lo como una del se".split()
STOP_WORDS = [c for w in _STOPS for c in dict.fromkeys((w, w.capitalize(), w.upper()))]
#: Ratios of counts: name, count, and the count that it is divided by, at least 1.
RATIOS = [
    ("mean_word_chars", "word_chars", "n_words"),
    ("symbols_per_word", "n_symbols", "n_words"),
    ("marks_per_word", "n_marks", "n_words"),
    ("stop_word_ratio", "n_stop_words", "n_words"),
    ("dup_line_ratio", "n_dup_lines", "n_lines"),
]
#: Bits of a window's hash that are used: all.
HASH_BITS = -1
#: name, metric, least, most: a document with a metric outside is not kept.
THRESHOLDS = [
    ("word_length", "mean_word_chars", 2.0, 18.0),
    ("symbols", "symbols_per_word", None, 0.4),
    ("shouting", "marks_per_word", None, 0.6),
    ("stop_words", "stop_word_ratio", 0.02, None),
    ("repeated_lines", "dup_line_ratio", None, 0.5),
]


def words_of(text: Column) -> Column:
    """The words of a text, as an array without nulls."""
    return F.array_remove(F.split(text, BLANKS, -1), F.lit(""))


def counted(rows: DataFrame) -> DataFrame:
    """A table with `text`, and others that don't begin with two underscores, with `__m`: counts over the whole text; a null text
    has no words.

    For repeated windows of 3 words, each window's hash gives its lowest bits to the window's position, so that sorting makes
    windows of one hash neighbours. If all neighbours of one hash have equal words, equal windows are neighbours; else the
    windows of that text are sorted by their words.
    """
    d = rows.withColumn("__t", F.coalesce(F.col("text"), F.lit("")))
    d = d.withColumn("__w", words_of(F.col("__t"))).withColumn("__n", F.size("__w"))
    d = d.withColumn("__h1", F.transform("__w", lambda w: F.xxhash64(w)))
    d = d.withColumn(
        "__h",
        F.expr(
            "zip_with(zip_with(slice(__h1, 1, greatest(0, __n - 2)), slice(__h1, 2, greatest(0, __n - 2)), (a, b) -> xxhash64(a, b)), "
            "slice(__h1, 3, greatest(0, __n - 2)), (ab, c) -> xxhash64(ab, c))"
        ),
    )
    d = d.withColumn("__mask", F.expr("shiftleft(1L, 1 + CAST(log2(greatest(__n, 1)) AS int)) - 1"))
    d = d.withColumn("__s", F.expr(f"CASE WHEN size(array_distinct(__h)) < __n - 2 THEN sort_array(transform(__h, (h, i) -> (h & {HASH_BITS}L & ~__mask) | i)) END"))
    d = d.withColumn("__p", F.expr("CASE WHEN __s IS NOT NULL THEN filter(sequence(0, size(__s) - 2), i -> ((get(__s, i) ^ get(__s, i + 1)) & ~__mask) = 0) END"))
    one, two = "CAST(get(__s, i) & __mask AS int)", "CAST(get(__s, i + 1) & __mask AS int)"
    equal = " AND ".join(f"get(__w, {one} + {k}) = get(__w, {two} + {k})" for k in range(3))
    found = f"flatten(transform(__p, i -> array({one}, {two})))"
    by_words = "array_sort(transform(sequence(0, __n - 3), i -> struct(concat_ws(' ', slice(__w, i + 1, 3)) AS k, i AS i)))"
    slow = f"transform(array({by_words}), z -> flatten(transform(filter(sequence(0, size(z) - 2), i -> get(z, i).k = get(z, i + 1).k), i -> array(get(z, i).i, get(z, i + 1).i))))[0]"
    d = d.withColumn("__r", F.expr(f"CASE WHEN __p IS NOT NULL THEN sort_array(array_distinct(CASE WHEN forall(__p, i -> {equal}) THEN {found} ELSE {slow} END)) END"))
    d = d.withColumn("__l", F.filter(F.split("__t", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    m = F.struct(
        F.col("__n").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "__w")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.expr("coalesce(aggregate(__r, struct(0L AS n, -3 AS p), (a, x) -> struct(a.n + least(3, x - a.p) AS n, x AS p), a -> a.n), 0L)").alias("n_repeat_words"),
        F.size(F.filter("__w", lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.regexp_count("__t", F.lit("[!?]")).cast("long").alias("n_marks"),
        F.size("__l").cast("long").alias("n_lines"),
    )
    return d.withColumn("__m", m).drop("__t", "__w", "__n", "__h1", "__h", "__mask", "__s", "__p", "__r", "__l")


def metrics() -> dict[str, Column]:
    return {name: F.col(f"__m.{a}") / F.greatest(F.col(f"__m.{b}"), F.lit(1)) for name, a, b in RATIOS}


def base_failed() -> Column:
    n, r = F.col("__m.n_words"), F.col("__m.n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


def failed_rules(thresholds=THRESHOLDS) -> list[Column]:
    """For each rule its name if the document breaks it, else null."""
    have = metrics()
    out = []
    for name, metric, least, most in thresholds:
        bad = [have[metric] < least] * (least is not None) + [have[metric] > most] * (most is not None)
        out.append(F.when(reduce(lambda a, b: a | b, bad), F.lit(name)))
    return out


def judged(rows: DataFrame) -> DataFrame:
    """A table as `counted` takes it, with `__m` (counts) and `__v` (base_failed, failed, kept)."""
    d = counted(rows).withColumn("__f", F.array_compact(F.array(*failed_rules())))
    v = F.struct(base_failed().alias("base_failed"), F.col("__f").alias("failed"), (~base_failed() & (F.size("__f") == 0)).alias("kept"))
    return d.withColumn("__v", v).drop("__f")


def quality(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Key columns, counts, base_failed, kept and the names of broken rules, a row for each row of `docs`.

    A null or empty text has no words, so it fails the base. Rows that repeat are judged alike, an empty table gives an
    empty one, other columns are left out. Nothing is shuffled.
    """
    rows = docs.select(F.struct(*key).alias("key"), F.col(text).alias("text"))
    return judged(rows).select(
        "key.*",
        *(F.col(f"__m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        *(F.col(f"__v.{c}").alias(c) for c in ("base_failed", "kept", "failed")),
    )


def kept_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the rules keep, with the columns of `docs`, whatever their names.

    Null and empty texts fail, repeated rows stay or go together, an empty table gives an empty one. The row number keeps the
    optimizer from moving the filter below the projections, where it would repeat their work.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text).alias("text"))
    return judged(rows).withColumn("__row", F.monotonically_increasing_id()).filter("__v.kept AND __row >= 0").select("row.*")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdicts; the broken rules joined by commas."""
    return quality(documents(spark, sf_dir), ["doc_id"]).withColumn("failed", F.array_join("failed", ","))


def _oracle() -> str:
    """The counts and verdicts in SQL, from the same table of thresholds."""
    ratios = {name: f"{a}::DOUBLE / greatest({b}, 1)" for name, a, b in RATIOS}
    broken = [
        f"CASE WHEN {' OR '.join([f'{ratios[metric]} < {least}'] * (least is not None) + [f'{ratios[metric]} > {most}'] * (most is not None))} THEN '{name}' END" for name, metric, least, most in THRESHOLDS
    ]
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{BLANKS}'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM twice GROUP BY doc_id),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
m AS (SELECT l.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '{SYMBOLS}')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(list_filter(w, lambda x: x IN ({stops}))) AS n_stop_words,
  len(regexp_extract_all(t, '[!?]')) AS n_marks, len(l) AS n_lines FROM l LEFT JOIN repeats r ON r.doc_id = l.doc_id),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',', {', '.join(broken)}) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM v"""


QUERIES = {"op4_quality": op4_quality}
ORACLE_SQL = {"op4_quality": _oracle()}
