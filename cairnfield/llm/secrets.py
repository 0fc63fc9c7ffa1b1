"""Secret scans with a randomness test battery (operator 3), in DataFrame functions alone.

Three patterns give the base spans. The method adds strings that look drawn at random: for each candidate an encoding is
inferred, and three tests ask whether its characters could come from uniform draws over that encoding's alphabet:
chi-squared on character counts, runs above and below the alphabet's middle, and serial correlation. A candidate counts as
a secret if the three tests, weighed by length under false-discovery control, do not reject randomness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: Fixed patterns of the base: kind, pattern, and least characters of a match (of group 2 for `assign`).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
#: As runs of a class are whole, asking for the length in the pattern finds the same as dropping short runs.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
#: Candidates of the method: whole runs of this class of at least 20 characters with a digit anywhere. Letters alone are words,
#: names and paths; that gives up the 3 in 100 random strings of 20 base64 characters that have no digit.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}"
#: A run that fits no alphabet, as it mixes those of base64 and base64url, is cut into such parts.
PART = r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{20,}"
#: Alphabets by encoding, in the order in which they are inferred; the position in the alphabet is the character's value.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Rate of false rejections that the procedure of Benjamini and Hochberg allows among the tests of a text.
RATE = 0.05
KINDS = ("assign", "access", "hex")
MASK = "[SECRET]"


#: Elements that a running value is carried through at a time, so that its cost follows the number of elements.
BLOCK = 256
SPAN = "struct<s: int, e: int, m: string>"


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(items: Column, step, start: str, kind: str, shift) -> Column:
    """Elements of `kind` made of `items` one after another, by blocks: `step(at, x)` gives (at, element) with `at` from 0 in
    each block, and `shift(element, base)` moves a block's elements by where the block begins."""
    empty = F.expr(f"CAST(struct({start} AS at, array() AS out) AS struct<at: int, out: array<{kind}>>)")
    outer = F.expr(f"CAST(struct({start} AS at, array() AS out) AS struct<at: int, out: array<struct<base: int, out: array<{kind}>>>>)")

    def block(xs):
        return F.aggregate(xs, empty, lambda a, x: let(step(a["at"], x), lambda y: F.struct(y["at"].alias("at"), F.concat(a["out"], F.array(y["element"])).alias("out"))))

    blocks = let(items, lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda k: block(F.slice(xs, k * BLOCK + 1, BLOCK))))
    based = F.aggregate(blocks, outer, lambda a, b: F.struct((a["at"] + b["at"]).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("base"), b["out"].alias("out")))).alias("out")), lambda a: a["out"])
    return F.flatten(F.transform(based, lambda b: F.transform(b["out"], lambda x: shift(x, b["base"]))))


def found(text: Column, pattern: str, keep=None) -> Column:
    """Matches of a pattern as structs (s, e, m), in order: the text between matches and the matches give the places."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(hits.alias("m"), F.slice(gaps, 1, F.size(hits)).alias("g"))

    def step(at, x):
        return let(at + F.length(x["g"]), lambda s: F.struct((s + F.length(x["m"])).alias("at"), F.struct(s.alias("s"), (s + F.length(x["m"])).alias("e"), x["m"].alias("m")).alias("element")))

    spans = running(both, step, "0", SPAN, lambda x, base: F.struct((x["s"] + base).alias("s"), (x["e"] + base).alias("e"), x["m"].alias("m")))
    spans = F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(F.expr(f"CAST(array() AS array<{SPAN}>)"))
    return F.filter(spans, keep) if keep else spans


def base_spans(text: Column) -> dict[str, Column]:
    long_enough = lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= ASSIGN_LEAST
    return {"assign": found(text, ASSIGN, long_enough), "access": found(text, ACCESS), "hex": found(text, HEX)}


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by the logistic approximation (off by less than 2e-4)."""
    return 1.0 / (1.0 + F.exp(F.greatest(F.least(1.5976 * z + 0.07056 * z * z * z, F.lit(700.0)), F.lit(-700.0))))


def with_alphabets(spans: Column) -> Column:
    """Spans with the encoding and alphabet that is inferred for each; null if none fits."""

    def one(x):
        encoding, alphabet = F.expr("CAST(NULL AS string)"), F.expr("CAST(NULL AS string)")
        for name in reversed(ALPHABETS):
            fits = F.length(F.translate(x["m"], ALPHABETS[name], "")) == 0
            encoding, alphabet = F.when(fits, name).otherwise(encoding), F.when(fits, ALPHABETS[name]).otherwise(alphabet)
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), encoding.alias("encoding"), alphabet.alias("alphabet"))

    return F.transform(spans, one)


def candidates(text: Column) -> Column:
    """Candidates with their alphabets. Runs that fit none are cut into parts of letters and digits, which fit base64."""
    whole = with_alphabets(found(text, CANDIDATE))
    moved = lambda x: F.transform(found(x["m"], PART), lambda y: F.struct((y["s"] + x["s"]).alias("s"), (y["e"] + x["s"]).alias("e"), y["m"].alias("m")))
    return let(
        whole,
        lambda w: F.when(F.exists(w, lambda x: x["alphabet"].isNull()), F.concat(F.filter(w, lambda x: x["alphabet"].isNotNull()), with_alphabets(F.flatten(F.transform(F.filter(w, lambda x: x["alphabet"].isNull()), moved))))).otherwise(w),
    )


def battery(spans: str) -> str:
    """SQL for an array of candidates with their statistics: (s, e, encoding, n, chi2, df, runs, low, serial).

    Each is one pass over the string's bytes; nothing is kept for each character.
    """
    n, k = "CAST(length(x.m) AS double)", "CAST(length(x.alphabet) AS double)"
    value = "CAST(instr(x.alphabet, CAST(substring(x.b, i, 1) AS string)) - 1 AS double)"
    return f"""transform(transform(transform({spans},
        x -> struct(x.s AS s, x.e AS e, x.m AS m, x.alphabet AS alphabet, x.encoding AS encoding, CAST(x.m AS binary) AS b, {n} AS n, {k} AS k)),
      x -> struct(x AS x, aggregate(sequence(1, CAST(x.n AS int)), struct(-1D AS last, 0D AS runs, 0D AS low, 0D AS serial),
        (t, i) -> transform(array({value}), v -> struct(v AS last,
          t.runs + IF(t.last < 0 OR (v < x.k / 2) != (t.last < x.k / 2), 1D, 0D) AS runs, t.low + IF(v < x.k / 2, 1D, 0D) AS low,
          t.serial + IF(t.last < 0, 0D, (v - (x.k - 1) / 2) * (t.last - (x.k - 1) / 2)) AS serial))[0]) AS t)),
      y -> struct(y.x.s AS s, y.x.e AS e, y.x.encoding AS encoding, y.x.n AS n,
        aggregate(sequence(1, CAST(y.x.k AS int)), 0D, (t, j) -> t + power(y.x.n - length(replace(y.x.m, substring(y.x.alphabet, j, 1), '')) - y.x.n / y.x.k, 2D)) * y.x.k / y.x.n AS chi2,
        y.x.k - 1 AS df, y.t.runs AS runs, y.t.low AS low, y.t.serial / ((y.x.k * y.x.k - 1) / 12) / sqrt(y.x.n - 1) AS serial))"""


def p_values(x: Column) -> Column:
    """Three p-values: of the counts (Wilson and Hilferty's cube root), of the runs, and of the serial correlation, the last two two-sided."""
    third = F.pow(x["chi2"] / x["df"], F.lit(1.0 / 3))
    spread = 2.0 / (9.0 * x["df"])
    counts = _upper_tail((third - (1.0 - spread)) / F.sqrt(spread))
    high = x["n"] - x["low"]
    mean = 2.0 * x["low"] * high / x["n"] + 1.0
    var = (mean - 1.0) * (mean - 2.0) / (x["n"] - 1.0)
    runs = F.when(var > 0, 2.0 * _upper_tail(F.abs(x["runs"] - mean) / F.sqrt(F.greatest(var, F.lit(1e-9))))).otherwise(0.0)
    return F.array(counts, F.least(runs, F.lit(1.0)), F.least(2.0 * _upper_tail(F.abs(x["serial"])), F.lit(1.0)))


def random_spans(found: str) -> Column:
    """Of the candidates in the column of that name, those for which no test rejects randomness, as (s, e, kind).

    All tests of a text make one family. A test's weight is its candidate's share of the characters, so long strings, for
    which a test can tell more, get more of the allowed rate; the step-up procedure goes over p / weight: of `n` tests, the
    largest p / weight that is at most its rank / n * RATE, and all below, are rejected. About RATE of true keys that come alone
    are given up by design.
    """
    tested = F.transform(F.expr(battery(found)), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["encoding"].alias("kind"), x["n"].alias("n"), p_values(x).alias("p")))
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda t, x: t + x["n"]) / F.size(xs)
    weighed = let(tested, lambda xs: let(mean(xs), lambda m: F.transform(xs, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), F.transform(x["p"], lambda p: p * m / x["n"]).alias("q")))))
    cut = lambda xs: let(F.array_sort(F.flatten(F.transform(xs, lambda x: x["q"]))), lambda q: let(F.size(q), lambda n: F.coalesce(F.array_max(F.filter(q, lambda v, i: v <= (i + 1) * RATE / n)), F.lit(-1.0))))
    return let(weighed, lambda xs: let(cut(xs), lambda c: F.transform(F.filter(xs, lambda x: F.array_min(x["q"]) > c), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))))


def scanned(rows: DataFrame) -> DataFrame:
    """A table with `text` and others that don't begin with two underscores, with `__t` (the text, never null), `__base` and
    `__all`: arrays of spans (s, o, e, kind), sorted; places are code points, ends exclusive."""
    d = rows.withColumn("__t", F.coalesce(F.col("text"), F.lit("")))
    for kind, spans in base_spans(F.col("__t")).items():
        d = d.withColumn(f"__{kind}", spans)
    d = d.withColumn("__c", candidates(F.col("__t")))
    d = d.withColumn("__random", F.when(F.size("__c") > 0, random_spans("__c")))
    label = lambda c, kind, o: f"transform({c}, x -> struct(x.s AS s, {o} AS o, x.e AS e, '{kind}' AS kind))"
    base = F.expr("array_sort(concat(" + ", ".join(label(f"__{k}", k, i) for i, k in enumerate(KINDS)) + "))")
    d = d.withColumn("__base", base)
    added = F.expr("transform(__random, x -> struct(x.s AS s, 9 AS o, x.e AS e, concat('random-', x.kind) AS kind))")
    d = d.withColumn("__all", F.when(F.size("__random") > 0, F.array_sort(F.concat("__base", added))).otherwise(F.col("__base")))
    return d.drop("__c", "__random")


def joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')")


def secrets(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Key columns, n_assign, n_access, n_hex, and `base` and `spans` (kind:start:end, comma-joined), a row for each row.

    A null or empty text has no spans and an empty string for them. Repeated rows get the same, an empty table gives an
    empty one, other columns are left out. Nothing is shuffled.
    """
    d = scanned(docs.select(F.struct(*key).alias("key"), F.col(text).alias("text")))
    return d.select("key.*", *(F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS), joined("__base").alias("base"), joined("__all").alias("spans"))


def merged(spans: Column) -> Column:
    """Sorted spans (s, e) with those that overlap or touch made one: the largest end so far tells where a new one begins."""
    step = lambda at, x: let(F.greatest(at, x["e"]), lambda e: F.struct(e.alias("at"), e.alias("element")))

    def whole(xs):
        # Ends are largest over a block at first, then over the blocks before as well.
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda k: F.slice(xs, k * BLOCK + 1, BLOCK))
        empty = F.expr("CAST(struct(-1 AS at, array() AS out) AS struct<at: int, out: array<int>>)")
        inner = lambda ys: F.aggregate(ys, empty, lambda a, x: let(step(a["at"], x), lambda y: F.struct(y["at"].alias("at"), F.concat(a["out"], F.array(y["element"])).alias("out"))))
        outer = F.expr("CAST(struct(-1 AS at, array() AS out) AS struct<at: int, out: array<array<int>>>)")
        ends = F.flatten(
            F.aggregate(
                F.transform(blocks, inner), outer, lambda a, b: F.struct(F.greatest(a["at"], b["at"]).alias("at"), F.concat(a["out"], F.array(F.transform(b["out"], lambda e: F.greatest(e, a["at"])))).alias("out")), lambda a: a["out"]
            )
        )
        return let(ends, lambda es: turned(xs, es))

    def turned(xs, es):
        first = F.filter(F.sequence(F.lit(0), F.size(xs) - 1), lambda i: (i == 0) | (F.get(xs, i)["s"] > F.get(es, i - 1)))
        return let(first, lambda f: F.transform(f, lambda i, k: F.struct(F.get(xs, i)["s"].alias("s"), F.get(es, F.coalesce(F.get(f, k + 1), F.size(xs)) - 1).alias("e"))))

    return let(spans, whole)


def masked(text: Column, cuts: Column) -> Column:
    """The text with each of the spans (s, e), which are in order and apart, replaced; a block of spans at a time, as a place
    in a text is found by counting from its begin."""

    def whole(xs):
        ends = lambda k: F.when(k == 0, 0).otherwise(F.get(xs, k * BLOCK - 1)["e"])
        last = F.floor((F.size(xs) - 1) / BLOCK).cast("int")

        def block(k):
            own = F.slice(xs, k * BLOCK + 1, BLOCK)
            return let(ends(k), lambda base: let(own, lambda ys: let(F.substring(text, base + 1, F.element_at(ys, -1)["e"] - base), lambda t: F.array_join(F.transform(ys, lambda y, i: part(t, ys, y, i, base)), ""))))

        def part(t, ys, y, i, base):
            return let(F.when(i == 0, base).otherwise(F.get(ys, i - 1)["e"]), lambda before: F.concat(F.substring(t, before - base + 1, y["s"] - before), F.lit(MASK)))

        rest = F.substring(text, F.element_at(xs, -1)["e"] + 1, F.lit(2**31 - 1))
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), last), block), ""), rest)

    return let(cuts, whole)


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with every span replaced by `[SECRET]`, overlapping or touching spans by one; `n_chars`, if there, follows the text.

    Null and empty texts stay as they are, repeated rows get the same, an empty table gives an empty one, and other columns,
    whatever their names, are kept. Nothing is shuffled.
    """
    d = scanned(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text).alias("text")))
    d = d.withColumn("__new", F.when(F.size("__all") > 0, masked(F.col("__t"), merged(F.transform("__all", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))))
    )
    out = []
    for c in docs.columns:
        own = F.col("row").getField(c)
        if c == text:
            own = F.coalesce(F.col("__new"), own)
        elif c == "n_chars":
            own = F.when(F.col("__new").isNotNull(), F.length("__new").cast(docs.schema[c].dataType)).otherwise(own)
        out.append(own.alias(c))
    return d.select(*out)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = secrets(documents(spark, sf_dir), ["doc_id"])
    return d.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


QUERIES = {"op3_secrets": op3_secrets}
