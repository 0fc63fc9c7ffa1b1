import random
import re
from collections import Counter

import duckdb
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnfield.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n, r = len(words), len(hit)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, r, n < 50 or 100 * r > 50 * n


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
CASES = [None, "", " \n\t", "a", "a b", "a b c", "a a a a a", "a b c a b c", "x y z x y\nx y z x y\n\n \n", "é😀 # é😀 $ é😀 # é😀 $ ", "w" * 100000, "the cat sat on " * 2000, "   x y"]


def test_counts_equal_brute_force(spark, sf_dir):
    texts = CASES + [d["text"] for d in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    for r in quality.quality(df, ["doc_id"]).collect():
        assert tuple(r[c] for c in COLUMNS) == brute(texts[r.doc_id]), texts[r.doc_id]
        assert r.kept == (not r.base_failed and not r.failed)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n\t#"), max_size=200), min_size=20, max_size=20))
def test_repeats_equal_brute_force(texts):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.quality(df, ["doc_id"]).collect():
        assert tuple(r[c] for c in COLUMNS) == brute(texts[r.doc_id])


def test_good_stays_bad_goes_and_columns(spark):
    good = "The sun was low on the hills and a wind came up from the sea. " * 1 + " ".join(f"word{i} of day{i} the" for i in range(20))
    df = spark.createDataFrame([(1, good, 2), (2, " ".join(f"x{i}%%%" for i in range(80)), 2), (3, None, None)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in quality.kept_documents(df).collect()] == [(1, good, 2)]
    assert quality.kept_documents(df).columns == df.columns
    assert quality.quality(df.filter("doc_id > 7"), ["doc_id"]).count() == 0


def test_colliding_hashes_change_nothing(spark, monkeypatch):
    """With three bits of hash, different windows meet and stand between equal ones."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randrange(3, 300))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(quality, "HASH_BITS", 7 << 40)
    for r in quality.quality(df, ["doc_id"]).collect():
        assert tuple(r[c] for c in COLUMNS) == brute(texts[r.doc_id])


def test_sql_says_the_same(spark, sf_dir):
    texts = CASES + [d["text"] for d in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").toArrow()  # noqa: F841
    want = duckdb.sql(quality.ORACLE_SQL["op4_quality"]).df().set_index("doc_id")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = quality.quality(df, ["doc_id"]).withColumn("failed", F.array_join("failed", ",")).toPandas().set_index("doc_id")
    assert list(want.columns) == list(got.columns) and want.sort_index().equals(got.sort_index().astype(want.dtypes.to_dict()))


def test_clashing_names(spark):
    good = " ".join(f"word{i} of day{i} the" for i in range(20))
    df = spark.createDataFrame([(1, good, "w", "m", "r", "x")], "__t long, text string, __w string, __m string, row string, text2 string")
    assert [tuple(r) for r in quality.kept_documents(df).collect()] == [tuple(df.first())] and quality.kept_documents(df).columns == df.columns
    assert quality.quality(df, ["__t", "row"]).columns[:2] == ["__t", "row"]
