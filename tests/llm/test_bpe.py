import hashlib

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnfield.llm import bpe


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocab())


CASES = ["", " ", "a", "it's  we'll\n\n x\t y   z", "　\x1c a\x1c\x1db \x00c", "x<|endoftext|> y<|endoftext|>", "é" * 400, "ab" * 3000, "日本語 текст 😀😀", "a\n b", "a \nb", "a\n  y", " lead and trail \n", "don'T 's!!,, \"q\""]


@pytest.mark.parametrize("own", [True, False])
def test_cases_equal_library(library, own):
    enc = bpe.ByteBPE(bpe.default_vocab(), own, limit=50)
    for t in CASES:
        want = library.encode(t, add_special_tokens=False).ids
        assert enc.ids(t).tolist() == want, repr(t)
        assert bpe.decoder(None).text(want) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'stabé  \x1c\x85,."), st.characters(codec="utf-8")), max_size=60))
def test_any_text_equals_library(text):
    from tokenizers import Tokenizer

    lib = getattr(test_any_text_equals_library, "lib", None) or Tokenizer.from_file(bpe.default_vocab())
    test_any_text_equals_library.lib = lib
    assert bpe.encoder(None, True).ids(text).tolist() == lib.encode(text, add_special_tokens=False).ids


def test_long_word_same_as_short():
    enc = bpe.ByteBPE(bpe.default_vocab())
    import json

    spec = json.load(open(bpe.default_vocab()))["model"]
    ids = [spec["vocab"][c] for c in bpe.byte_letters()]
    pairs = {spec["vocab"][a] << 20 | spec["vocab"][b]: (r, spec["vocab"][a + b]) for r, (a, b) in enumerate(spec["merges"])}
    for w in (b"thethethethere" * 40, b"aaaaaaaaaaaaaaa", b"xyz" * 100):
        assert bpe.merge_long(w, ids, pairs) == bpe.merge_short(w, ids, pairs)
    assert enc.dtype.itemsize == 2


def test_query_equals_library(spark, sf_dir, library):
    rows = {r.doc_id: r for r in bpe.op2_bpe(spark, sf_dir).collect()}
    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    assert len(rows) == len(t)
    for d in t:
        e = library.encode(d["text"] or "", add_special_tokens=False).ids
        r = rows[d["doc_id"]]
        assert r.n_tokens == len(e) and r.ids_sha256 == hashlib.sha256(",".join(map(str, e)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((d["text"] or "").encode()).hexdigest()


def test_nulls_empties_and_other_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (1, None, 5), (2, "", 6), (None, "a b", 7)], "doc_id long, text string, ids long")
    got = bpe.encode(df, ["doc_id"]).collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == [("1", []), ("1", []), ("2", []), ("None", [64, 275])]
    assert bpe.encode(df.filter(F.lit(False)), ["doc_id"]).count() == 0
    assert [r.text for r in bpe.decode(bpe.encode(df.filter("text = 'a b'"), ["doc_id"]), ["doc_id"]).collect()] == ["a b"]
