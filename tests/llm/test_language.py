import random
import zlib
from itertools import product

import numpy as np
import pyarrow.parquet as pq

from cairnfield.llm import language


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = {x["doc_id"]: x for x in pq.read_table(f"{d}/documents.parquet").to_pylist()}
    rows = language.op5_language(spark, d).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    right = sum(r.lang_pred == docs[r.doc_id]["lang"] for r in held if r.lang_pred != "und")
    assert right >= 0.95 * sum(docs[r.doc_id]["lang"] is not None for r in held)
    for r in rows:
        assert 0 <= r.score <= 1
        assert not r.spans or (r.spans[0].start, r.spans[-1].end) == (0, len(docs[r.doc_id]["text"]))


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(3)
    scores = rng.normal(size=(30, 3)).astype("float32") * 3
    rows = [rng.integers(0, 30, n) for n in (0, 1, 2, 5, 6, 7)]
    for row, path in zip(rows, language.viterbi(scores, rows, 2.0)):
        value = lambda p: sum(scores[w, s] for w, s in zip(row, p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert len(path) == len(row) and np.isclose(value(path), max(map(value, product(range(3), repeat=len(row)))), atol=1e-4)


def test_scripts_and_mixed_text(spark):
    rng = random.Random(1)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(6))
    text = lambda letters, n=60: " ".join(word(letters) for _ in range(n))
    alphabets = {"aa": "abcdef", "bb": "ghijkl", "cc": "абвгде"}
    df = spark.createDataFrame([(i, text(a), x, 1) for i in range(40) for x, a in alphabets.items()], "doc_id long, text string, lang string, score int")
    model = language.learn(df)
    assert model.languages == ["aa", "bb", "cc"]
    cyrillic = language.SCRIPT_NAMES.index("Cyrillic")
    assert model.candidates[cyrillic].tolist() == [False, False, True]
    one, two, three = text("abcdef", 40), text("ghijkl", 20), text("абвгде", 10)
    cases = [(1, f"{one} {two} {three}"), (2, None), (3, ""), (4, "12 \0 34 !?\0"), (None, three), (None, three), (7, "x" * 50000)]
    got = language.identify(spark.createDataFrame(cases, "doc_id long, text string"), model).collect()
    assert len(got) == len(cases)
    by = {r.doc_id: r for r in got}
    assert [(s.start, s.end, s.lang) for s in by[1].spans] == [(0, len(one) + 1, "aa"), (len(one) + 1, len(one) + len(two) + 2, "bb"), (len(one) + len(two) + 2, len(cases[0][1]), "cc")]
    assert by[1].lang_pred == "aa" and {by[i].lang_pred for i in (2, 3, 4)} == {"und"} and by[None].lang_pred == "cc"
    kept = language.kept_documents(spark.createDataFrame(cases, "doc_id long, text string"), model)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "7", "None", "None"]
    empty = df.filter("doc_id > 99")
    assert language.learn(empty).languages == [] and language.identify(empty, language.learn(empty)).count() == 0
    assert {r.lang_pred for r in language.identify(df, language.learn(empty)).collect()} == {"und"}


def test_seventy_languages_are_all_learned(spark):
    """Each has two letters of its own; none is left out, though there are more than any small number type or list could hold."""
    pairs = [(chr(0x4E00 + 2 * i), chr(0x4E00 + 2 * i + 1)) for i in range(150)]
    text = lambda p, n=12: " ".join((p[0] + p[1]) * 3 for _ in range(n))
    df = spark.createDataFrame([(3 * i + j, text(p), f"l{i:03d}") for i, p in enumerate(pairs) for j in range(3)], "doc_id long, text string, lang string")
    df = df.filter(language.remainder("doc_id") != 2)
    want = {r.lang for r in df.select("lang").distinct().collect()}
    model = language.learn(df)
    assert set(model.languages) == want and len(want) > 140 and model.bins == language.BINS // 2
    got = language.identify(df, model).select("doc_id", "lang_pred").collect()
    right = {r.doc_id: r.lang for r in df.collect()}
    assert all(r.lang_pred == right[r.doc_id] for r in got)
    assert [language.bins_for(n) for n in (1, 128, 129, 256, 257, 10**6)] == [1 << 14, 1 << 14, 1 << 13, 1 << 13, 1 << 12, 1 << 8]


def test_another_script_goes(spark):
    df = spark.createDataFrame([(i, "plain words of one language and more", "aa") for i in range(20)], "doc_id long, text string, lang string")
    model = language.learn(df)
    asked = spark.createDataFrame([(1, "only plain words here"), (2, "\u0431\u0443\u043a\u0432\u044b \u0434\u0440\u0443\u0433\u0438\u0435"), (3, None), (4, "")], "doc_id long, text string")
    assert [r.doc_id for r in language.kept_documents(asked, model).collect()] == [1]
    scores = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(asked, model).collect()}
    assert scores[2] == ("aa", 0.0) and scores[3] == ("und", 0.0)
