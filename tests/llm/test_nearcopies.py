import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq

import corpus_pipeline
from cairnfield.llm import bpe, nearcopies, secrets
from cairnfield.llm.common import staged


def brute_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(texts):
    """Least id of each group of texts linked by Jaccard similarity of 0.8 or more."""
    sets = {i: brute_shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        if a == b or 5 * len(a & b) >= 4 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {find(i) for i in sets}


def made_texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    line = " ".join(rng.choices(words, k=12))
    texts = [None, "", " \n", "one two", "One  TWO", "one two three"]
    for _ in range(40):
        base = rng.choices(words, k=rng.choice((8, 30, 60, 300, 2500)))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(5)):
            new = list(base)
            for _ in range(rng.randrange(1, 2 + len(base) // 40)):
                new[rng.randrange(len(new))] = rng.choice(words)
            texts.append(" ".join(new) + (" " + line if rng.random() < 0.3 else ""))
    hot = rng.choices(words, k=80)
    texts += [" ".join([*hot[:k], f"x{i}", *hot[k:]]) for i, k in enumerate(rng.choices(range(80), k=80))]
    texts += [f"{line} {' '.join(rng.choices(words, k=20))}" for _ in range(60)]
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_near_copies_beyond_the_digest_radius_go(spark, sf_dir):
    """The stage alone, over the raw documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {d["doc_id"]: d["text"] for d in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
    kept = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == brute_kept(texts)


def test_made_copies(spark):
    texts = made_texts()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = sorted(r.doc_id for r in nearcopies.one_of_each(df).collect())
    assert rows == sorted(brute_kept(texts)) and len(rows) < len(texts) - 100


def test_a_group_of_many_blocks(spark, monkeypatch):
    """More copies than a block holds: those of a clump that joins at once, and a band whose ends are far apart."""
    monkeypatch.setattr(nearcopies, "MEMBERS", 8)
    monkeypatch.setattr(nearcopies, "TILE", 32)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(4000)]
    base, band = rng.choices(words, k=100), rng.choices(words, k=400)
    texts = [" ".join([*base[:k], f"x{i}", *base[k:]]) for i, k in enumerate(rng.choices(range(100), k=60))]
    texts += [" ".join(band[i * 4 : i * 4 + 100]) for i in range(70)]  # each is linked to the next few alone
    texts += [" ".join(rng.choices(words, k=60)) for _ in range(40)]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in nearcopies.one_of_each(df).collect()) == sorted(brute_kept(dict(enumerate(texts))))


def test_fingerprints_carry_the_radius():
    """Sets at the least similarity, of all kinds of sizes, are within the radius; unrelated ones are not."""
    rng = np.random.default_rng(1)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype="u8")
    lost = 0
    for n in (16, 40, 200, 3000):
        for _ in range(150):
            both, one, two = draw(8 * n // 10), draw(n // 10), draw(2 * n // 10 - n // 10)
            a, b = (nearcopies.fingerprint(np.unique(np.concatenate(x))) for x in ((both, one), (both, two)))
            lost += np.bitwise_count(a ^ b).sum() > nearcopies.RADIUS or np.bitwise_count(a[0] ^ b[0]) > nearcopies.FIRST
            assert np.bitwise_count(a ^ nearcopies.fingerprint(draw(n))).sum() > nearcopies.RADIUS
    assert lost <= 1


def test_clashing_names_stay(spark):
    df = spark.createDataFrame([(1, "a b c", 5, 6, "r"), (2, "a b c", 7, 8, "s")], "doc_id long, text string, k int, __h int, row string")
    got = nearcopies.one_of_each(df)
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [(1, "a b c", 5, 6, "r")]


def test_repeated_rows_and_null_keys(spark):
    df = spark.createDataFrame([(9, "a b c d e f g h"), (9, "a b c d e f g h"), (None, "A b c d e f g h"), (None, "other"), (None, "other")], "doc_id long, text string")
    assert sorted(map(tuple, nearcopies.one_of_each(df).collect()), key=str) == [(9, "a b c d e f g h"), (None, "other")]
    assert nearcopies.one_of_each(df.filter("doc_id > 9")).count() == 0


def test_stages_after_near_dedup(spark, sf_dir):
    frames = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(staged(stage(spark, frames[-1], sf_dir), name))
    after = [{r.doc_id: r for r in f.collect()} for f in frames[1:-1]]
    assert set(after[2]) == brute_kept({i: r.text for i, r in after[1].items()})
    assert set(after[3]) == set(after[2])
    assert not secrets.secrets(frames[4], ["doc_id"]).filter("base <> ''").collect()
    got = Counter()
    for r in frames[5].collect():
        ids = [*bpe.encoder(None, True).ids(after[3][r.doc_id].text).tolist(), 0]
        part = b"".join(i.to_bytes(4, "little") for i in ids[r.start : r.start + r.length])
        assert r.ids_crc32 == zlib.crc32(part)
        got[r.doc_id] += r.length
    assert set(got) == set(after[3])
