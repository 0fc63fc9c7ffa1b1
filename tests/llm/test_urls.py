import duckdb
import numpy as np
import pyarrow as pa

from cairnfield.llm import urls

CASES = [
    None, "", "no scheme", "http://", "http://NET", "http://net/", "http://a.net/x", "http://xnet/x", "https://Example.NET/en/?q=/fr/", "http://b.example.net/en", "http://example.com/de/1#x", "http://m.example.org/fr/x",
    "http://u:p@a.example.net:80/en/", "http://a.net?x=/", "a://b://c.net/", "http://é.org/fr/é", "http://.net/", "http://example.com/DE/", "http://net./x", "http://org/fr/",
    "http://spam-farm.example.org/x", "http://a.spam-farm.example.org/fr/1", "http://notspam-farm.example.org/", "http://free-bets.example.com",
]


def brute(url):
    host, path = urls.parts(url)
    under = lambda h: host == h or host.endswith("." + h)
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if under(h) and path.startswith(p)]
    listed = any(under(h) for h, _ in urls.LISTED)
    return (host, path, max(fits)[1], max(fits)[2], listed) if fits else (host, path, None, "block" if listed else "allow", listed)


def test_cases_and_oracle(spark):
    rows = [(i, u, "k") for i, u in enumerate(CASES)] + [(0, None, "k"), (None, CASES[5], None)]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = [tuple(r) for r in urls.judged(df).collect()]
    assert sorted(got, key=str) == sorted([(i, *brute(u)) for i, u, _ in rows], key=str)
    pages = df.toArrow()  # noqa: F841
    want = duckdb.sql(urls.ORACLE_SQL["op7_urls"]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert urls.judged(df.filter("page_id > 99")).count() == 0


def test_query_equals_oracle(spark, sf_dir):
    got = sorted(tuple(r) for r in urls.op7_urls(spark, sf_dir).collect())
    pages = duckdb.read_parquet(f"{sf_dir}/pages.parquet")  # noqa: F841
    assert got == sorted(duckdb.sql(urls.ORACLE_SQL["op7_urls"]).fetchall())


def test_collisions_are_confirmed(spark, tmp_path, monkeypatch):
    """All keys have one digest, so that the stored strings alone decide."""
    n = 500
    schema = pa.schema([("digest", pa.int64()), ("key", pa.large_binary()), ("verdict", pa.string())])
    rows = [(7, f"rh{i}.example/{i}/".encode(), "block" if i % 2 else "allow") for i in range(n)]
    with pa.ipc.new_file(str(tmp_path / "part-000000.arrow"), schema) as w:
        w.write_batch(pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema))
    monkeypatch.setattr(urls, "digest", lambda key: 7)
    store = urls.Store(f"file://{tmp_path}", (7,), ())
    assert store.find([b"rh7.example/7/", b"nothing/", b"rh498.example/498/"]) == ["block", None, "allow"]
    assert urls.Store("nowhere", (), ()).find([b"x"]) == [None]


def test_files_are_sorted_and_a_table_may_be_the_list(spark, monkeypatch):
    monkeypatch.setattr(urls, "KEYS", 100)
    urls_ = [(f"h{i}.example", f"/p/{i}") for i in range(1000)]
    table = spark.createDataFrame([*urls_, *urls_[:5], ("whole.example", None), (None, "/x")], "host string, path string")
    store = urls.build(urls.entries(spark, [("allow", "h1.example", "/p/"), ("block", "h1.example", "/p/")], table))
    files = [store.file(i) for i in range(len(store.firsts))]
    digests = np.concatenate([f[0] for f in files])
    assert len(files) > 5 and (np.diff(digests) >= 0).all() and len(digests) == 1002
    assert all(urls.digest(k.as_py()) == int(np.uint64(d.astype("u8"))) for f in files for d, k in zip(f[0], f[1]))
    pages = spark.createDataFrame([(1, "http://h7.example/p/7?x"), (2, "http://h7.example/p/8"), (3, "http://a.WHOLE.example"), (4, "http://h1.example/p/1"), (5, "http://b.h7.example/p/7")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict, r.listed) for r in urls.judged(pages, [("allow", "h1.example", "/p/")], table).collect()}
    assert got == {1: (None, "block", True), 2: (None, "allow", False), 3: (None, "block", True), 4: ("h1.example/p/", "allow", True), 5: (None, "allow", False)}
    assert urls.judged(pages, [], []).filter("verdict = 'allow'").count() == 5


def test_long_urls_make_few_candidates(spark):
    url = "http://" + "a." * 100_000 + "net/" + "b" * 100_000
    store = urls.build(urls.entries(spark, urls.RULES, urls.LISTED))
    assert len(store.candidates(*urls.parts(url))) <= len(urls.RULES) + len(urls.LISTED)
    assert urls.judged(spark.createDataFrame([(1, url)], "page_id long, url string")).select("rule").collect()[0].rule == "net/"
