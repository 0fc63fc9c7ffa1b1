import random
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq

from cairnfield.llm import sharding


def check(rows, texts, shards):
    """Sizes and digests; counts one apart; slots without gaps. Returns the shards of each text."""
    slots, homes = defaultdict(list), defaultdict(Counter)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        slots[r.shard].append(r.slot)
        homes[texts[r.doc_id] or ""][r.shard] += 1
    n = len(rows)
    for s in range(shards):
        assert sorted(slots.get(s, [])) == list(range(n // shards + (s < n % shards)))
    return homes


def test_query(spark, sf_dir):
    texts = {d["doc_id"]: d["text"] for d in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
    rows = sharding.op10_sharding(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    check(rows, texts, 40)


def test_groups_stay_together_and_large_ones_are_cut(spark):
    rng = random.Random(3)
    texts = ["hot"] * 400 + [f"g{i % 60}" for i in range(300)] + [f"s{i}" for i in range(299)] + [None]
    rng.shuffle(texts)
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, shard string")
    homes = check(sharding.shard_documents(df).collect(), dict(enumerate(texts)), 40)
    together = sum(len(homes[f"g{i}"]) == 1 for i in range(60))
    assert together >= 54 and len(homes["hot"]) < 40


def test_edges(spark):
    df = spark.createDataFrame([(None, None), (None, ""), (1, "a"), (1, "a")], "doc_id long, text string")
    rows = sharding.shard_documents(df).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(0, 0), (1, 0), (2, 0), (3, 0)]
    assert sharding.shard_documents(df.filter("doc_id > 7")).count() == 0
