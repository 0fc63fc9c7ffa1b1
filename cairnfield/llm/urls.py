"""URL filters over a sorted array of digests (operator 7).

Rules (host and path prefix, allow or block) and a block list (whole hosts, or single urls) become keys. Spark sorts the keys
by their 64-bit xxhash and writes them in stretches to the shared folder; workers memory-map a stretch when they need it. A
batch of urls becomes candidate keys, one binary search probes them all, and a hit counts only if the stored string is the
candidate. A host's candidates are its suffixes of lengths that rules have, so their number follows the rules, not the url.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import file_system, new_path, slices

#: The rules in force (fixed values): verdict, host, path. A rule holds for its host and all subdomains.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: The block list (host, path), for urls that no rule fits: without a path a host and its subdomains, else that url alone.
LISTED = [(f"{name}.example.{top}", None) for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]
#: The verdict on a url that neither a rule nor the list has.
DEFAULT = "allow"
#: Candidate keys that are probed at a time, and keys in a file.
PROBES, KEYS = 1 << 18, 4 << 20
#: Kinds of keys: of a rule, of a listed host, of a listed url.
RULE, HOST, URL = "r", "h", "u"
SEED = 42
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TABLE = str.maketrans(_UPPER, _LOWER)
_ENTRY = "kind string, host string, path string, verdict string"


def digest(key: bytes) -> int:
    """A key's digest; the same that Spark's xxhash64 gives."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(key, SEED)


@dataclass(frozen=True)
class Store:
    """Where the files are, the first digest of each (ascending), and the lengths of hosts and paths by kind of key."""

    uri: str
    firsts: tuple[int, ...]
    lengths: tuple[tuple[str, int, int], ...]

    def file(self, i: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
        return _opened(f"{self.uri}/part-{i:06d}.arrow")

    def find(self, keys: list[bytes]) -> list[str | None]:
        """For each key its verdict, or None: binary search of the digests, then the full string decides."""
        wanted = np.fromiter(map(digest, keys), "<u8", len(keys)).view("<i8")
        out: list[str | None] = [None] * len(keys)
        part = np.searchsorted(np.array(self.firsts, "i8"), wanted, "right") - 1
        for p in np.unique(part[part >= 0]).tolist():
            digests, strings, verdicts = self.file(p)
            mine = np.nonzero(part == p)[0]
            at = np.searchsorted(digests, wanted[mine])
            hit = at < len(digests)
            hit[hit] = digests[at[hit]] == wanted[mine[hit]]
            for i, k in zip(mine[hit].tolist(), at[hit].tolist()):
                while k < len(digests) and digests[k] == wanted[i]:
                    if strings[k].as_py() == keys[i]:
                        out[i] = verdicts[k].as_py()
                        break
                    k += 1
        return out

    def candidates(self, host: str, path: str) -> list[tuple[str, bytes]]:
        """(kind, key) that can be stored for this host and path; rules' first, longest first, equally long ones with the longer host first."""
        out, end = [], len(host)
        for kind, h, p in self.lengths:
            if kind == URL:
                out.append((kind, f"{URL}{host}{path}".encode()))
            elif (h == end or h < end and host[end - h - 1] == ".") and p <= len(path):
                out.append((kind, f"{kind}{host[end - h :]}{path[:p]}".encode()))
        return out


@lru_cache(maxsize=64)
def _opened(uri: str) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Digests, keys and verdicts of a file, memory-mapped if it is local."""
    from pyarrow import fs

    files, path = file_system(uri)
    source = pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)
    batch = pa.ipc.open_file(source).get_batch(0)
    return batch.column(0).to_numpy(), batch.column(1), batch.column(2)


def entries(spark: SparkSession, rules: DataFrame | Iterable[tuple[str, str, str]], listed: DataFrame | Iterable[tuple[str, str | None]]) -> DataFrame:
    """(kind, host, path, verdict) of rules (verdict, host, path) and a block list (host, path or null), as tables or as tuples.

    Rows with a null host, and rules with a null path or verdict, are left out; a verdict other than allow or block raises.
    """
    rules = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "verdict string, host string, path string")
    listed = listed if isinstance(listed, DataFrame) else spark.createDataFrame(list(listed), "host string, path string")
    host = F.translate("host", _UPPER, _LOWER).alias("host")
    known = F.when(F.col("verdict").isin("allow", "block"), F.col("verdict")).otherwise(F.raise_error(F.concat(F.lit("verdicts must be allow or block, not "), F.col("verdict"))))
    r = rules.filter("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(F.lit(RULE).alias("kind"), host, "path", known.alias("verdict"))
    kind = F.when(F.col("path").isNull(), HOST).otherwise(URL).alias("kind")
    return r.unionByName(listed.filter("host IS NOT NULL").select(kind, host, F.coalesce("path", F.lit("")).alias("path"), F.lit("block").alias("verdict")))


def build(table: DataFrame) -> Store:
    """Writes the store of a table of entries to the shared folder. Of equal keys one is stored, allowing before blocking.

    Keys are sorted in stretches of digests, a file each; only the files' first digests, and the pairs of lengths of hosts and
    paths (of rules and hosts, which urls bound), come to the driver.
    """
    spark = table.sparkSession
    uri = new_path(spark, "urls")
    keys = table.groupBy(F.concat("kind", "host", "path").alias("key")).agg(F.min("verdict").alias("verdict"), F.count(F.lit(1)).alias("n"))
    pair = F.when(F.col("kind") == URL, F.struct(F.lit(0).alias("h"), F.lit(0).alias("p"))).otherwise(F.struct(F.length("host").alias("h"), F.length("path").alias("p")))
    lengths = table.select("kind", pair.alias("l")).groupBy("kind", "l.h", "l.p").agg(F.count(F.lit(1)).alias("n")).collect()
    parts = max(1, sum(r["n"] for r in lengths) // KEYS + 1)
    order = ["digest", "key"]
    sorted_ = keys.select(F.xxhash64("key").alias("digest"), F.col("key").cast("binary").alias("key"), "verdict").repartitionByRange(parts, "digest").sortWithinPartitions(*order)
    schema = pa.schema([("digest", pa.int64()), ("key", pa.large_binary()), ("verdict", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]):
        found = pa.Table.from_batches(list(batches)).cast(schema) if (batches := list(batches)) else None
        if found is not None and found.num_rows:
            files, root = file_system(uri)
            files.create_dir(root, recursive=True)
            number = TaskContext.get().partitionId()
            hidden = f"{root}/.{TaskContext.get().taskAttemptId()}"
            with files.open_output_stream(hidden) as sink, pa.ipc.new_file(sink, schema) as w:
                w.write_batch(found.combine_chunks().to_batches()[0])
            files.move(hidden, f"{root}/part-{number:06d}.arrow")
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([found["digest"][0].as_py()], pa.int64())], ["number", "first"])

    firsts = sorted(tuple(r) for r in sorted_.mapInArrow(run, "number long, first long").collect())
    kinds = [RULE, HOST, URL]
    found = sorted(((r["kind"], r["h"], r["p"]) for r in lengths), key=lambda x: (kinds.index(x[0]), -(x[1] + x[2]), -x[1]))
    return Store(uri, tuple(f for _, f in firsts), tuple(found))


def parts(url: str | None) -> tuple[str, str]:
    """Host and path: between the first `://` and `/`, `?`, `#` or the end; then up to `?`, `#` or the end."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1].split("?", 1)[0].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_TABLE), slash + path


def judged(pages: DataFrame, rules=RULES, listed=LISTED, key: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """key, host, path, rule (host and path of the longest that fits, else null), verdict and listed, a row for each row.

    The verdict is the rule's; without a rule, block if the list has the host or the url, else `default`. `rules` and `listed` are
    tables or tuples, as in `entries`. A null url, or one without `://`, has an empty host and path, which no list has. Repeated
    rows get the same, an empty table gives an empty one, other columns are left out. The urls are not shuffled.
    """
    store = build(entries(pages.sparkSession, rules, listed))
    schema = T.StructType([pages.schema[key], *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")), T.StructField("listed", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches):
            both = [parts(u.as_py()) for u in b.column(1)]
            rule, verdict, on = [None] * len(both), [default] * len(both), [False] * len(both)
            keys, of = [], []
            for i, (host, path) in enumerate(both):
                found = store.candidates(host, path) if host or path else []
                keys += found
                of += [i] * len(found)
                if len(keys) >= PROBES or i + 1 == len(both):
                    for (kind, k), j, hit in zip(keys, of, store.find([k for _, k in keys])):
                        if hit is None:
                            continue
                        if kind == RULE and rule[j] is None:
                            rule[j], verdict[j] = k.decode()[1:], hit
                        elif kind != RULE:
                            on[j] = True
                            if rule[j] is None:
                                verdict[j] = hit
                    keys, of = [], []
            texts = [*([x[k] for x in both] for k in (0, 1)), rule, verdict]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.string()) for x in texts), pa.array(on, pa.bool_())], schema.names)

    return pages.select(key, F.col(url).alias("__url")).mapInArrow(run, schema)


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_RULE = "CASE " + " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
) + " END"
_LISTED = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h, _ in LISTED)
#: Each url against all rules, longest first, and against the list.
ORACLE_SQL = {
    "op7_urls": f"""
WITH a AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM a),
c AS (SELECT *, {_RULE} AS rule, {_LISTED} AS listed FROM b)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in RULES)} WHEN listed THEN 'block' ELSE '{DEFAULT}' END AS verdict, listed FROM c"""
}
QUERIES = {"op7_urls": op7_urls}
