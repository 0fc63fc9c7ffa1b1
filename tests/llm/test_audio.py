import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from cairnfield.llm import audio


def test_query_equals_brute_force(spark, sf_dir):
    texts = {d["doc_id"]: d["text"] for d in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}
    rows = audio.op8_audio(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    features = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        media = audio.stored(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        with wave.open(io.BytesIO(media)) as w:
            assert w.readframes(w.getnframes()) == payload and w.getsampwidth() == 1
        assert features.setdefault(raw, r.feature) == r.feature
        mel, found = audio.analysed(media)
        blob = audio.tensor_bytes(mel, found)
        assert (r.tensor_bytes, r.tensor_sha256) == (len(blob), hashlib.sha256(blob).hexdigest())
        table = pa.ipc.open_stream(blob).read_all()
        assert np.array_equal(np.concatenate([x.to_numpy_ndarray().reshape(-1, audio.BANDS) for x in table["mel"].chunks])[: len(mel)], mel)
        assert r.feature.split(";")[:2] == [str(len(mel)), ",".join(f"{a}-{b}" for a, b in found)]


def test_resampling_equals_zero_stuffing():
    rng = np.random.default_rng(2)
    x = rng.normal(size=500).astype("float32")
    for rate, target in ((16000, 8000), (8000, 12000), (48000, 32000), (44100, 44100)):
        up, down = target // np.gcd(rate, target), rate // np.gcd(rate, target)
        got = audio.resampled(x, rate, target)
        if up == down:
            assert (got == x).all()
            continue
        half = audio.TAPS * max(up, down)
        t = np.arange(-half, half + 1)
        h = np.sinc(t / max(up, down)) * np.blackman(2 * half + 3)[1:-1]
        h *= up / h.sum()
        stuffed = np.zeros(len(x) * up)
        stuffed[::up] = x
        want = np.convolve(stuffed, h)[half : half + len(stuffed)][::down]
        assert len(got) == len(want) and np.allclose(got, want, atol=1e-4)


def test_a_tone_falls_into_its_band_and_segment():
    t = np.arange(16000) / 8000
    x = np.where((t > 0.5) & (t < 1.5), np.sin(2 * np.pi * 1000 * t), 0.001 * np.sin(2 * np.pi * 50 * t))
    mel = audio.log_mel(x.astype("float32"))
    peak = audio.filterbank()[round(1000 / 4000 * 128)].argmax()
    assert mel[100].argmax() == peak
    ((a, b),) = audio.segments(mel.mean(1))
    assert abs(a * audio.HOP / 8000 - 0.5) < 0.05 and abs(b * audio.HOP / 8000 - 1.5) < 0.05


def test_hysteresis():
    level = np.array([0, 0, 0.5, 0.7, 0.4, 0.5, 0.2, 0.5, 0.0, 0.0, 0.9])
    assert audio.segments(level) == [(3, 6), (10, 11)]
    assert audio.segments(np.zeros(0)) == []


def test_tensors_and_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (1, "", 1), (None, "x" * 576, 1), (4, "long text " * 30000, 1)], "doc_id long, text string, media int")
    rows = audio.audio(df).collect()
    assert [len(audio.read_back(bytes(r.media))[0]) for r in rows] == [576, 576, 576, 300096]
    assert rows[0].feature == rows[1].feature
    table = pa.ipc.open_stream(bytes(rows[3].tensors)).read_all()
    assert table.schema.field("mel").type.shape == [audio.TENSOR, audio.BANDS] and table.num_rows == -(-int(rows[3].feature.split(";")[0]) // 100)
    assert b"segments" in table.schema.metadata and table["end_s"][0].as_py() == 1.0
    assert audio.audio(df.filter("media > 1")).count() == 0


def test_null_media_and_clashing_columns(spark):
    wav = audio.stored(b"\xff" * 576)
    df = spark.createDataFrame([(1, None, "x"), (2, bytearray(wav), "y"), (2, bytearray(wav), "y")], "doc_id long, media binary, payload_sha256 string")
    got = sorted(audio.read_samples(df, ["doc_id"]).collect())
    assert got[0].payload_bytes is None and [r.payload_bytes for r in got[1:]] == [576, 576]
