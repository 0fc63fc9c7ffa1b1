import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

import corpus_pipeline
from cairnfield.llm import bpe, language, secrets, simhash
from cairnfield.llm.common import staged

from .test_nearcopies import brute_kept
from .test_quality import brute as brute_counts


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(staged(stage(spark, frames[-1], sf_dir), name))
    for f in frames[1:-1]:
        assert f.columns == columns
    raw = {d["doc_id"]: d for d in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
    after = [{r.doc_id: r for r in f.collect()} for f in frames[1:-1]]
    # Quality: what fails the base goes.
    assert not any(brute_counts(r.text)[5] for r in after[0].values()) and 0 < len(after[0]) < len(raw)
    # Language: the model of what came in, without the held-out, judges all of it.
    labeller = language.Labeller(language.learn(frames[1]))
    for d, r in after[0].items():
        lang, share, _ = labeller.label([r.text])[0]
        assert (d in after[1]) == (lang != "und" and share >= language.LEAST_SHARE)
    # Near copies: one of each group that similarities of 0.8 of five-word shingles link, the least id.
    assert set(after[2]) == brute_kept({i: r.text for i, r in after[1].items()})
    # Secrets: no base span is left, and documents stay.
    assert sorted(after[3]) == sorted(after[2])
    left = secrets.secrets(frames[4], ["doc_id"]).filter("base <> ''").collect()
    assert not left
    assert all(r.n_chars == len(r.text) for r in after[3].values() if secrets.MASK in r.text)
    # Packing: every id once.
    got = Counter()
    for r in frames[5].collect():
        ids = [*bpe.encoder(None, True).ids(after[3][r.doc_id].text).tolist(), 0]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        got[r.doc_id] += r.length
    assert set(got) == set(after[3])


def test_run_and_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert simhash.RADIUS == 4  # op6's own; the pipeline's stage goes by similarity
