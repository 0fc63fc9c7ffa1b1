import random
import re

import numpy as np
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import functions as F

from cairnfield.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=4):
    """Component of each index: the least index reachable."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    a = np.array(fps, "u8")
    for i in range(len(fps)):
        for j in np.nonzero(np.bitwise_count(a ^ a[i]) <= radius)[0]:
            x, y = sorted((find(i), find(int(j))))
            parent[y] = x
    return [find(i) for i in range(len(fps))]


def test_query_equals_brute_force(spark, sf_dir):
    t = sorted(pq.read_table(f"{sf_dir}/documents.parquet").to_pylist(), key=lambda d: d["doc_id"])
    rows = {r.doc_id: r for r in simhash.op6_simhash(spark, sf_dir).collect()}
    fps = [brute_fingerprint(d["text"]) for d in t]
    for d, fp, c in zip(t, fps, brute_components(fps)):
        assert rows[d["doc_id"]].fingerprint == f"{fp:016x}" and rows[d["doc_id"]].component_id == t[c]["doc_id"]
    assert len(rows) == len(t)


def test_chains_and_dense_groups(spark):
    rng = random.Random(7)
    fps = [rng.getrandbits(64) for _ in range(400)]
    for start in (3, 9):
        x = fps[start]
        for _ in range(60):  # a chain of steps within the radius
            for b in rng.sample(range(64), 4):
                x ^= 1 << b
            fps.append(x)
    centre = rng.getrandbits(64)
    fps += [centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(500)]
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {}
    for r in simhash.grouped(df).collect():
        got.setdefault(r.root, set()).add(r.fp)
    want = {}
    for f, c in zip(fps, brute_components([f & (1 << 64) - 1 for f in fps])):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_edges(spark):
    df = spark.createDataFrame(
        [(5, None, 1), (2, "", 1), (None, " \n", 1), (9, "One two", 1), (9, "one TWO", 2), (9, "one TWO", 2), (None, "null key", 3), (1, "some other long text of words " * 3000, 1)],
        "doc_id long, text string, fp int",
    )
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert len(got) == 8
    assert {c for d, f, c in got if f == "0" * 16} == {2}
    assert [c for d, f, c in got if f == f"{brute_fingerprint('null key'):016x}"] == [None]
    assert simhash.near_duplicates(df.filter("fp > 8")).count() == 0


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Ascending, the worst order; 1600 links in at most 12 rounds, and 12 steps in a round."""
    calls, real = [], simhash.staged
    monkeypatch.setattr(simhash, "staged", lambda df, label: (calls.append(label), real(df, label))[1])
    chain = spark.range(1600).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    rows = simhash.components(chain).collect()
    assert {r.node: r.root for r in rows} == dict.fromkeys(range(1601), 0)
    assert calls.count("edges") - 1 <= 12 and calls.count("roots") <= 24
    pairs = spark.createDataFrame([(5, 9), (9, 7), (2, 3), (8, 1), (1, 4), (4, 9)], "u long, v long")
    assert {r.node: r.root for r in simhash.components(pairs).collect()} == {5: 1, 9: 1, 7: 1, 2: 2, 3: 2, 8: 1, 1: 1, 4: 1}


def test_a_hot_fingerprint_and_a_hot_place(spark, monkeypatch):
    """Many rows of one text, and more fingerprints of one place than a tile holds."""
    monkeypatch.setattr(simhash, "TILE", 8)
    rng = random.Random(2)
    fps = set()
    while len(fps) < 300:  # four bits in each sub-word
        fps.add(sum(sum(1 << b for b in rng.sample(range(8), 4)) << 16 * i for i in range(4)))
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    got = {}
    for r in simhash.grouped(spark.createDataFrame([(f,) for f in fps], "fp long")).collect():
        got.setdefault(r.root, set()).add(r.fp)
    want = {}
    for f, c in zip(fps, brute_components([f & (1 << 64) - 1 for f in fps])):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    df = spark.createDataFrame([(i, "same text" if i % 3 else f"text {i}") for i in range(900)], "doc_id long, text string")
    rows = simhash.near_duplicates(df).collect()
    assert len(rows) == 900 and {r.component_id for r in rows if r.doc_id % 3} == {1}
