"""Near-duplicates by SimHash (operator 6): fingerprints, a tiled exact comparison, and connected components.

Distinct fingerprints are dealt to tiles by the population counts of their sub-words. Two fingerprints within the radius
differ in those counts by no more than the radius in sum, so tile pairs beyond it are skipped and nothing is lost. What is
left is compared bit by bit with numpy. A comparison returns a forest that connects what it linked, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, forget, joined, slices, staged

#: Words in a shingle, seed of its hash, and differing bits of linked fingerprints.
SHINGLE, SEED, RADIUS = 4, 42, 4
#: Sub-words whose population counts place a fingerprint, and fingerprints in a tile, about.
SUBWORDS, TILE = 4, 2048
#: Pairs that numpy compares at a time.
PAIRS = 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A text's 64 bits: each is set if it is set in over half of the shingles' hashes; no word: 0."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # of bytes: A-Z alone, and white space as the contract has it
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "int64", len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    spans = map(slice, starts[:n].tolist(), ends[len(words) - n :].tolist())
    hashes = np.fromiter(map(xxh64_intdigest, map(line.__getitem__, spans), repeat(SEED)), "<u8", n)
    counts = np.zeros(64, "int64")
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="int64")
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Key columns and `fp`, the fingerprint's bits as a long, a row for each row; a text without words, or null, has 0."""
    schema = T.StructType([*(docs.schema[k] for k in key), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches):
            found = np.array([fingerprint(t.as_py(), shingle) for t in b.column(len(key))], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found)], schema.names)

    return docs.select(*key, F.col(text).alias("__text")).mapInArrow(run, schema)


def steps(radius: int, n: int = SUBWORDS) -> list[tuple[int, ...]]:
    """Differences of counts of tile pairs that are compared: within the radius in sum; of each and its opposite the later."""
    zero = (0,) * n
    return [d for d in product(range(-radius, radius + 1), repeat=n) if sum(map(abs, d)) <= radius and d >= zero]


def linked(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a matrix of links, (node, least node of its component) of the nodes with links; columns come after the rows."""
    rows, columns = mask.shape
    none = rows + columns
    a, b = np.arange(rows), np.arange(rows, none)
    if mask.sum() > 4 * none:
        while True:
            a2 = np.minimum(a, np.where(mask, b, none).min(1))
            b2 = np.minimum(b, np.where(mask, a2[:, None], none).min(0))
            if (a2 == a).all() and (b2 == b).all():
                break
            a, b = a2, b2
    else:
        i, j = np.nonzero(mask)
        while True:
            a2, b2 = a.copy(), b.copy()
            np.minimum.at(a2, i, b[j])
            np.minimum.at(b2, j, a2[i])
            if (a2 == a).all() and (b2 == b).all():
                break
            a, b = a2, b2
    label = np.concatenate([a, b])
    nodes = np.nonzero(label != np.arange(none))[0]
    return nodes, label[nodes]


def compared(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges (as fingerprints) of a forest that connects what is within the radius between two arrays."""
    step = max(1, PAIRS // max(1, len(right)))
    for at in range(0, len(left), step):
        part = left[at : at + step]
        nodes, least = linked(np.bitwise_count(part[:, None] ^ right[None, :]) <= radius)
        if len(nodes):
            both = np.concatenate([part, right])
            u, v = both[nodes], both[least]
            yield u[u != v], v[u != v]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) between the distinct fingerprints in column `fp` of a written table; they connect all that is linked."""
    spark = fps.sparkSession
    width = 64 // SUBWORDS
    counts = [F.bit_count(F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit((1 << width) - 1))).cast("int") for i in range(SUBWORDS)]
    placed = fps.select("fp", F.array(*counts).alias("place"))
    sizes = placed.groupBy("place").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("chunks"))
    tiles = placed.join(sizes, "place").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks"))).groupBy("place", "chunk").agg(F.collect_list("fp").alias("fps"))
    tiles = staged(tiles, "tiles")
    # A row for each place, of which there are fewer than (width + 1) ** SUBWORDS. Both sides go by place and chunk, so that the
    # pairs of tiles of the commonest place are dealt to as many tasks as it has tiles.
    to = F.broadcast(sizes.select("place", F.col("chunks").cast("int").alias("chunks")))
    offsets = F.array(*(F.array(*map(F.lit, d)) for d in steps(radius)))
    near = tiles.select("fps", "chunk", F.col("place").alias("own"), F.explode(offsets).alias("step"))
    near = near.select(F.col("fps").alias("left"), F.col("chunk").alias("from"), F.zip_with("own", "step", lambda p, s: p + s).alias("place"), (F.col("own") == F.zip_with("own", "step", lambda p, s: p + s)).alias("same"))
    near = near.filter((F.array_min("place") >= 0) & (F.array_max("place") <= width)).join(to, "place")
    near = near.withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1L)"))).filter("NOT same OR chunk >= from").select("left", "place", "chunk")

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            lefts, rights = b.column(0), b.column(1)
            groups: dict[bytes, tuple[np.ndarray, list[np.ndarray]]] = {}
            for x, y in zip(lefts, rights):
                right = y.values.to_numpy().view("u8")
                groups.setdefault(right.tobytes(), (right, []))[1].append(x.values.to_numpy().view("u8"))
            for right, found in groups.values():
                for u, v in compared(np.concatenate(found), right, radius):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view("i8")), pa.array(v.view("i8"))], ["u", "v"])

    # Sizes of written tables don't tell how often a tile is repeated, so a broadcast must not be chosen by them.
    pairs = near.hint("merge").join(tiles.select("place", "chunk", F.col("fps").alias("right")).hint("merge"), ["place", "chunk"]).select("left", "right")
    return pairs.mapInArrow(run, "u long, v long").distinct()


def _jumped(table: DataFrame) -> DataFrame:
    """A written (node, root) with `root` followed to its end: each step, a join, doubles what is jumped, so a chain takes its logarithm."""
    while True:
        up = table.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = staged(table.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("root").alias("was")), "roots")
        forget(table)
        done = new.filter("root <> was").isEmpty()
        table = new.drop("was")
        table._staged = new._staged
        if done:
            return table


def components(edges: DataFrame) -> DataFrame | None:
    """(node, root) of every node with an edge, or None without edges: each round joins nodes to their least neighbour, follows
    these to their ends and contracts the edges. Of neighbours one at least is no end, so a round halves the nodes, and both
    rounds and steps of a round follow the logarithm of the number of nodes. Tables of a round are written, and deleted when
    the next ones are."""
    edges = staged(edges, "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("root"))
        to = _jumped(staged(to, "roots"))
        of = lambda c: to.select(F.col("node").alias(c), F.col("root").alias(f"{c}2"))  # noqa: B023, E731
        old, edges = edges, staged(edges.join(of("u"), "u").join(of("v"), "v").select(F.col("u2").alias("u"), F.col("v2").alias("v")).filter("u <> v").distinct(), "edges")
        if roots is None:
            roots = to
        else:
            up = to.select(F.col("node").alias("root"), F.col("root").alias("next"))
            before, roots = roots, staged(roots.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
            forget(before, to)
        forget(old)
    forget(edges)
    return roots


def grouped(table: DataFrame, radius: int = RADIUS) -> DataFrame:
    """A written table with `fp`, with `root`: the same for all rows whose fingerprints are linked by steps within the radius."""
    roots = components(links(staged(table.select("fp").distinct(), "fps"), radius))
    if roots is None:
        return table.withColumn("root", F.col("fp"))
    return table.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """key, fingerprint (hexadecimal) and component_id (the least key reachable), a row for each row.

    A text that is null, empty or of white space has fingerprint 0, which is linked like any other. Repeated rows and equal
    texts share a component. Null keys are never the least; a component of null keys alone has a null id. An empty table
    gives an empty one, other columns are left out.
    """
    table = staged(fingerprints(docs, [key], text), "fingerprints")
    least = staged(table.groupBy("fp").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("weight")), "least")
    rooted = staged(grouped(least, radius), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(rooted.join(ids, "root").select("fp", "weight", "component_id"), "named")
    return joined(table, named, "fp", "weight", table.count()).select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op6_simhash": op6_simhash}
