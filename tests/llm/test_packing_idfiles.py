import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from cairnfield.llm import bpe, idfiles, packing


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def truth(sf_dir):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_vocab())
    return {d["doc_id"]: lib.encode(d["text"] or "", add_special_tokens=False).ids + [0] for d in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}


def test_patterns_use_the_histogram_up():
    rng = np.random.default_rng(5)
    h = dict(Counter(rng.integers(1, 1025, 5000).tolist()))
    got, waste = Counter(), 0
    for pattern, count in packing.patterns_of(h, 1024):
        assert sum(pattern) <= 1024 and list(pattern) == sorted(pattern, reverse=True)
        waste += (1024 - sum(pattern)) * count
        for x in pattern:
            got[x] += count
    assert got == h and waste < 0.03 * sum(k * v for k, v in h.items())
    assert packing.patterns_of({}, 1024) == []
    assert packing.patterns_of({1024: 3}, 1024) == [((1024,), 3)]


def test_query_packs_every_id_once(spark, sf_dir, truth):
    rows = packing.op1_packing(spark, sf_dir).collect()
    at, seen = {}, Counter()
    for r in rows:
        ids = truth[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[r.start : r.start + r.length])
        seen[r.doc_id] += r.length
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {d: len(x) for d, x in truth.items()}
    for spans in at.values():
        end = 0
        for o, n in sorted(spans):
            assert o == end
            end += n
        assert end <= 1024
    assert sorted(at) == list(range(len(at)))
    total = sum(map(len, truth.values()))
    assert len(at) * 1024 < 1.03 * total + 1024


def test_packing_edges(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "a " * 3000)], "doc_id long, text string")
    rows = packing.packed_documents(df).collect()
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.packed_documents(df.filter("doc_id > 5")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0)], "k long, length long"), ["k"])


def test_files_hold_all_ids_in_order(spark, sf_dir, truth):
    start = 0
    rows = {r.doc_id: r for r in idfiles.op9_token_files(spark, sf_dir).collect()}
    for d in sorted(truth):
        assert (rows[d].start, rows[d].n_tokens, rows[d].ids_crc32) == (start, len(truth[d]), crc(truth[d]))
        start += len(truth[d])
    assert len(rows) == len(truth)


def test_file_access_and_edges(spark, tmp_path):
    df = spark.createDataFrame([(3, "c " * 90000, 1), (1, None, 1), (None, "", 1), (1, None, 1)], "doc_id long, text string, start int")
    uri = f"file://{tmp_path}/x"
    parts = idfiles.write_ids(df, uri)
    got = sorted(idfiles.read_ids(spark, uri, parts, df.schema["doc_id"].dataType).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 1, 3] and [r.n_tokens for r in got[:3]] == [1, 1, 1]
    assert got[3].ids == bpe.encoder(None, True).ids("c " * 90000).tolist() + [0]
    last = idfiles.IdFile(f"{uri}/part-{parts[-1].number:06d}.ids.arrow")
    assert last.reader.schema.field("ids").type.list_size == 1024
    assert idfiles.write_ids(df.filter("doc_id > 9"), f"{uri}2") == []
    assert idfiles.read_ids(spark, uri, [], df.schema["doc_id"].dataType).count() == 0


def test_masks_tell_ids_from_filling(spark, tmp_path):
    df = spark.createDataFrame([(i, "word " * i) for i in range(300)], "doc_id long, text string")
    parts = idfiles.write_ids(df, f"file://{tmp_path}/m")
    for p in parts:
        file = idfiles.IdFile(f"file://{tmp_path}/m/part-{p.number:06d}.ids.arrow")
        sequences = [file.sequence(i) for i in range(-(-p.tokens // 1024))]
        masks = np.concatenate([m for _, m in sequences])
        assert masks.sum() == p.tokens and masks[: p.tokens].all()
        assert np.array_equal(np.concatenate([s for s, _ in sequences])[: p.tokens], file.ids(0, p.tokens))
        assert len(file.ids(p.tokens, p.tokens + 5)) == 0
