"""Near copies by SimHash with an exact check: operator 6 for similarities of word shingles, as the pipeline's stage needs it.

A fingerprint of 64 bits can't tell a Jaccard similarity of 0.8, at which about 10 of them differ, from passages in common. So
fingerprints have 512 bits here, of distinct shingles. Tiles of documents of like size are compared exactly by exclusive-or and
bit counts; pairs of tiles whose sizes or population counts differ too much are skipped. What is linked makes groups, and within
a group the shingles themselves decide. Members of one label are never compared again, so a group costs the number of members that
the largest label leaves out, times the group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import joined, slices, staged
from .simhash import PAIRS, SEED, components

#: Words in a shingle, and the least similarity of linked sets as a fraction.
SHINGLE, TOP, BOTTOM = 5, 4, 5
#: Words of 64 bits in a fingerprint. At a similarity of 0.8 a bit differs with a chance of 0.15 (the angle between the sets, over
#: pi), so 78 of 512 differ, with a deviation of 8; RADIUS is six of these more. Unrelated sets differ in 256, with a deviation of 11.
WORDS, RADIUS = 8, 128
#: Radius of the first two words, which spares most comparisons of the others: 20 bits differ, with a deviation of 4. A bit is more
#: likely to differ where shingles are few (0.19 of 4 and 5), so sets of fewer than SMALL are compared without it, and within WIDE.
#: With independent bits a link at the least similarity is lost with a chance of at most 4e-8 (sets of 25), without these of 4e-12.
FIRST, SMALL, WIDE = 48, 16, 160
#: Fingerprints in a tile, about, and documents in a block of the exact check.
TILE, MEMBERS = 8192, 256


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a shorter text is one shingle, no word gives none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "u8")
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "int64", len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    spans = map(slice, starts[:n].tolist(), ends[len(words) - n :].tolist())
    return np.unique(np.fromiter(map(xxh64_intdigest, map(line.__getitem__, spans), repeat(SEED)), "u8", n))


def fingerprint(own: np.ndarray) -> np.ndarray:
    """A set's bits: each is set if it is set in over half of the shingles' hashes, which are mixed anew for each word."""
    counts = np.zeros(64 * WORDS, "int64")
    salts = np.arange(WORDS, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(own), 4096):
        h = own[at : at + 4096, None] + salts
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        bits = np.unpackbits(h.view("u1"), axis=1, bitorder="little")
        counts += bits.sum(0, dtype="uint16")
    return np.packbits(2 * counts > len(own), bitorder="little").view("<u8")


class Forest:
    """Nodes joined so far, each with the least node that it is known to reach."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while not np.array_equal(next_ := self.up[self.up], self.up):
            self.up = next_
        return self.up

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Joins pairs of nodes."""
        while True:
            root = self.roots()
            a, b = root[i], root[j]
            new = a != b
            if not new.any():
                return
            i, j, a, b = i[new], j[new], a[new], b[new]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.up, high, low)


def radius_of(n: np.ndarray, m: np.ndarray) -> int:
    """The radius between sets of these sizes."""
    return WIDE if min(n.min(), m.min()) < SMALL else RADIUS


def join_near(forest: Forest, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], at: int, to: int) -> None:
    """Joins what is within the radius, and of sizes that allow the similarity, between two arrays of sets (sizes, fingerprints),
    whose nodes begin at `at` and `to` in the forest."""
    (n, f), (m, g) = left, right
    radius = radius_of(n, m)
    step = max(1, PAIRS // len(m))
    first = np.ascontiguousarray(g[:, :2].T)
    for begin in range(0, len(n), step):
        differ = np.bitwise_count(f[begin : begin + step, :1] ^ first[0])
        differ += np.bitwise_count(f[begin : begin + step, 1:2] ^ first[1])
        i, j = np.nonzero(differ <= (FIRST if radius < WIDE else 128))
        i += begin
        fit = BOTTOM * np.minimum(n[i], m[j]) >= TOP * np.maximum(n[i], m[j])
        i, j = i[fit], j[fit]
        for part in range(0, len(i), 1 << 17):
            x, y = i[part : part + (1 << 17)], j[part : part + (1 << 17)]
            hit = np.bitwise_count(f[x] ^ g[y]).sum(1, dtype="int64") <= radius
            forest.join(x[hit] + at, y[hit] + to)


def _tile(sets: pa.StructScalar) -> tuple[np.ndarray, ...]:
    """Ids, sizes, fingerprints and population counts of a tile's sets, by population count."""
    rows = sets.values
    ids, n = (rows.field(c).to_numpy() for c in (0, 1))
    bits = np.frombuffer(b"".join(rows.field(2).to_pylist()), "<u8").reshape(-1, WORDS)
    counts = np.bitwise_count(bits).sum(1, dtype="int64")
    order = np.argsort(counts, kind="stable")
    return ids[order], n[order], bits[order], counts[order]


def links(sets: DataFrame) -> DataFrame:
    """Edges (u, v) between the ids of a written table (id, n, fp) of distinct sets that connect all that is linked.

    Sizes of linked sets differ by a quarter at most, so a set is compared within its class of sizes and the next one.
    """
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BOTTOM / TOP)) + 1e-9).cast("int")
    placed = sets.filter(F.col("n") * (BOTTOM - TOP) >= TOP).withColumn("size", size)  # smaller ones are linked to equal ones alone
    # A row for each class of sizes: at most 97 of them, as a text has less than 2^31 words.
    chunks = placed.groupBy("size").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("chunks"))
    placed = placed.join(F.broadcast(chunks), "size").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    tiles = staged(placed.groupBy("size", "chunk").agg(F.collect_list(F.struct("id", "n", "fp")).alias("sets")), "tiles")
    to = chunks.select(F.explode(F.expr("array(size, size - 1)")).alias("from"), F.col("size").alias("to_size"), F.col("chunks").alias("to_chunks")).withColumnRenamed("from", "size")
    pairs = tiles.join(F.broadcast(to), "size").withColumn("to_chunk", F.explode(F.expr("sequence(0, to_chunks - 1)"))).filter("to_size > size OR to_chunk >= chunk")
    pairs = pairs.select(F.col("to_size").alias("size"), F.col("to_chunk").alias("chunk"), F.col("sets").alias("left"))
    # Sizes of written tables don't tell how often a tile is repeated, so a broadcast must not be chosen by them.
    both = pairs.hint("merge").join(tiles.withColumnRenamed("sets", "right").hint("merge"), ["size", "chunk"]).select("left", "right")

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for x, y in zip(b.column(0), b.column(1)):
                (ids, n, f, p), (other, m, g, q) = _tile(x), _tile(y)
                forest, radius = Forest(len(ids) + len(other)), radius_of(n, m)
                for at in range(0, len(ids), 512):  # by population counts, so those beyond the radius are skipped
                    part = slice(at, at + 512)
                    lo, hi = np.searchsorted(q, p[part][0] - radius, "left"), np.searchsorted(q, p[part][-1] + radius, "right")
                    if lo < hi:
                        join_near(forest, (n[part], f[part]), (m[lo:hi], g[lo:hi]), at, len(ids) + int(lo))
                names = np.concatenate([ids, other])
                u, v = names, names[forest.roots()]
                yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], ["u", "v"])

    return both.mapInArrow(run, "u long, v long").distinct()


def _similar(sets: list[np.ndarray]):
    """A function that tells which of some sets (by number) have the similarity to the i-th."""
    sizes = np.array(list(map(len, sets)))
    starts = np.cumsum(sizes) - sizes  # no set is empty here
    names, place = np.unique(np.concatenate(sets), return_inverse=True)
    here = np.zeros(len(names), bool)

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        own = place[starts[i] : starts[i] + sizes[i]]
        here[own] = True
        both = np.add.reduceat(here[place], starts, dtype="int64")[rest]
        here[own] = False
        return BOTTOM * both >= TOP * (sizes[i] + sizes[rest] - both)

    return near


def _sets(table: pa.Table) -> tuple[list[int], list[np.ndarray], dict[int, int]]:
    """Distinct ids in order, their sets, and their labels; an id may come more than once."""
    label = dict(zip(table.column("id").to_pylist(), table.column("label").to_pylist()))
    found = dict(zip(table.column("id").to_pylist(), table.column("set")))
    ids = sorted(found)
    return ids, [np.frombuffer(found[i].as_py(), "<u8") for i in ids], label


def within(table: pa.Table) -> pa.Table:
    """(id, label) of a block's sets: the least id that each reaches by links. What is linked leaves early."""
    ids, sets, _ = _sets(table)
    near, root, rest = _similar(sets), list(range(len(ids))), np.arange(len(ids))
    while len(rest):
        least, front, rest = int(rest[0]), [int(rest[0])], rest[1:]
        while front and len(rest):
            mask = near(front.pop(), rest)
            front += rest[mask].tolist()
            for j in rest[mask].tolist():
                root[j] = least
            rest = rest[~mask]
    return pa.table({"id": pa.array(ids, pa.int64()), "label": pa.array([ids[r] for r in root], pa.int64())})


def between(table: pa.Table) -> pa.Table:
    """Edges (u, v) of labels between the sets of two blocks that have different ones so far; of a single block, within it."""
    ids, sets, label = _sets(table)
    names = np.array([label[i] for i in ids], "int64")
    block = dict(zip(table.column("id").to_pylist(), table.column("block").to_pylist()))
    side = np.array([block[i] for i in ids])
    near, edges, one, place = _similar(sets), set(), side.min() == side.max(), np.arange(len(ids))
    for i in range(len(ids)):
        if one or side[i] == side.min():
            rest = np.nonzero((names != names[i]) & ((place > i) if one else (side != side[i])))[0]
            if len(rest):
                edges.update((int(names[i]), int(names[j])) for j in rest[near(i, rest)].tolist())
    u, v = zip(*sorted(edges)) if edges else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def exact(members: DataFrame) -> DataFrame:
    """(id, label) of a written table (root, id, set): within a root, sets with the similarity, by steps, have one label.

    A root's sets are compared in blocks of about MEMBERS; then one set of each label goes on to the next round, until a root's
    are in one block or get no fewer. Of a label's sets any may have a link to another label's, not only the one that went on: so
    of roots of several blocks and, still, labels, all sets beside those of the largest label are compared with all of the root.
    """
    labels, rows = members.select("root", "id", F.col("id").alias("label")).distinct(), members.count()
    labels, sets = staged(labels, "labels"), members.select("root", "id", "set")
    at, left, first = labels.select("root", "id"), None, True
    while True:
        counts = at.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        blocks = joined(at, counts, "root", "n", rows).withColumn("blocks", F.ceil(F.col("n") / MEMBERS).cast("int"))
        blocks = staged(blocks.filter("n > 1").withColumn("block", F.pmod(F.xxhash64("id", F.lit(0 if left is None else left)), F.col("blocks")).cast("int")), "blocks")
        if blocks.isEmpty():
            break
        found = (sets if first else sets.join(blocks.select("root", "id"), ["root", "id"], "left_semi")).withColumn("label", F.col("id"))
        found = found.join(blocks.select("root", "id", "blocks", "block"), ["root", "id"])
        new = staged(found.groupBy("root", "block").applyInArrow(lambda t: within(t), "id long, label long"), "within")
        labels = staged(_relabelled(labels, new.withColumnRenamed("id", "node").withColumnRenamed("label", "to")), "labels")
        many = blocks.filter("blocks > 1").select("root").distinct()
        at = staged(labels.join(many, "root", "left_semi").select("root", F.col("label").alias("id")).distinct(), "at")
        count = at.count()
        if not count or left is not None and count > 0.9 * left:
            break
        left, first = count, False
    # What is left: roots of several blocks with several labels. Blocks from 0 on are those of all labels but the largest, whose
    # own come after them and don't meet each other.
    sizes = labels.groupBy("root", "label").agg(F.count(F.lit(1)).alias("size"))
    open_ = sizes.groupBy("root").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("labels"), F.max(F.struct("size", "label")).alias("most"))
    open_ = open_.filter((F.col("labels") > 1) & (F.col("n") > MEMBERS))
    open_ = staged(open_.select("root", "n", F.col("most.label").alias("most"), F.ceil((F.col("n") - F.col("most.size")) / MEMBERS).cast("int").alias("beside"), F.ceil(F.col("most.size") / MEMBERS).cast("int").alias("own")), "open")
    if not open_.isEmpty():
        some = joined(labels, open_, "root", "n", rows)
        hashed = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        some = some.withColumn("block", F.when(F.col("label") == F.col("most"), F.col("beside") + hashed("own")).otherwise(hashed("beside")))
        some = some.withColumn("other", F.explode(F.expr("sequence(0, if(label = most, beside, beside + own) - 1)")))
        some = some.select("root", "id", "label", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
        pairs = sets.join(some, ["root", "id"]).groupBy("root", "a", "b").applyInArrow(lambda t: between(t), "u long, v long").distinct()
        more = components(pairs)
        if more is not None:
            labels = staged(_relabelled(labels, more.withColumnRenamed("root", "to")), "labels")
    return labels.select("id", "label")


def _relabelled(labels: DataFrame, new: DataFrame) -> DataFrame:
    """Labels after (node, to) for some of them."""
    return labels.join(new.select(F.col("node").alias("label"), "to"), "label", "left").select("root", "id", F.coalesce("to", "label").alias("label"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one document of each group of near copies: the least by (key, hash of its text), nulls last; of repeated rows one.

    Documents are linked if their shingles' Jaccard similarity is at least TOP / BOTTOM and their fingerprints are near, or if both
    have no word (null and empty texts); links make groups. An empty table gives an empty one; other columns are kept, whatever
    their names.
    """
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(text).alias("text"))
    keyed = row.select("k", "h", "text")
    schema = T.StructType([*(keyed.schema[c] for c in ("k", "h")), T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("fp", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]):
        from xxhash import xxh64_intdigest

        for b in slices(batches):
            sets = [shingles(t.as_py()) for t in b.column(2)]
            ids = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], "u8").view("i8")
            fps = pa.array([fingerprint(s).tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(ids), pa.array(list(map(len, sets)), pa.int64()), fps], schema.names)

    table = staged(keyed.mapInArrow(run, schema), "shingles")
    first = F.min(F.struct(F.col("k").isNull().alias("none"), "k", "h")).alias("first")
    least = staged(table.groupBy("id").agg(first, F.min("n").alias("n"), F.min("fp").alias("fp")), "least")
    roots = components(links(least))
    rooted = least.select("id", "first", F.col("id").alias("root"))
    if roots is not None:
        members = roots.withColumnRenamed("node", "id").join(least.select("id", "first.k", "first.h"), "id")
        same = keyed["k"].eqNullSafe(members["k"]) & (keyed["h"] == members["h"])
        texts = keyed.join(members, same).select("root", "id", "text")

        def coded(batches: Iterator[pa.RecordBatch]):
            for b in slices(batches):
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([shingles(t.as_py()).tobytes() for t in b.column(2)], pa.binary())], ["root", "id", "set"])

        labels = exact(staged(texts.mapInArrow(coded, "root long, id long, set binary"), "members"))
        rooted = least.join(labels, "id", "left").select("id", "first", F.coalesce("label", "id").alias("root"))
    kept = staged(rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.k").alias("kept_k"), F.col("first.h").alias("kept_h")), "kept")
    out = row.join(kept, row["k"].eqNullSafe(kept["kept_k"]) & (row["h"] == kept["kept_h"]), "left_semi")
    if not table.groupBy("k", "h").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates(["k", "h"])
    return out.select("row.*")
