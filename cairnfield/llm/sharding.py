"""Sharding by balanced label propagation (operator 10), in DataFrame functions alone.

Documents with equal texts are neighbours of each other. Groups larger than a shard are first cut into chunks of at most a
shard. Chunks of over half a shard, of which there are at most twice as many as shards, are seeds, and linked documents start on
the places beside them, dealt evenly. In each round every chunk joins its documents' present shards: it proposes the one that
most of its documents are on of those whose quota has room for the others, else any with room for all. Proposals are taken up
to the quotas, those that mend most first, and the documents move. So a pair of neighbours on different shards, a cut edge, may
vanish in a round, and none comes up. Rounds end when nothing moves, or after ROUNDS.

What is still apart then goes, largest first, to shards with room, until no waiting chunk fits any shard. Only those are cut:
their documents lie one after the other over the shards with most room. Documents without links then fill the shards up to
their quotas, so that counts are at most one apart (law `rows`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buckets_for, documents, forget, joined, salted_rank, staged

SHARDS = 40
#: Rounds of propagation at most; what they leave apart is placed by size.
ROUNDS = 8


def prefix(df: DataFrame, by: str, salt: Column, value: str, order: list[str], out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows before within `by`, in the order of (salt, `order`), without a hot task."""
    d = df.withColumn("__salt", salt)
    sums = d.groupBy(by, "__salt").agg(F.sum(value).alias("__sum"))
    before = sums.select(by, "__salt", (F.sum("__sum").over(Window.partitionBy(by).orderBy("__salt")) - F.col("__sum")).alias("__before"))
    here = F.sum(value).over(Window.partitionBy(by, "__salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return d.withColumn("__here", here).join(before, [by, "__salt"]).withColumn(out, F.col("__here") + F.col("__before")).drop("__salt", "__here", "__before")


def _weight(c: Column) -> Column:
    """Orders chunks by size, largest first, in bounded many steps: the bits of the size."""
    return F.lit(64) - F.length(F.bin(c))


def _of(numbers: list[int], at: Column) -> Column:
    """One of some numbers, by place."""
    return F.element_at(F.array(*(F.lit(x).cast("long") for x in numbers)), (at + 1).cast("int"))


def propagate(state: DataFrame, free: list[int], rounds: int = ROUNDS) -> tuple[DataFrame, list[int]]:
    """Label propagation over a written table (unit, start, n, shard): so many documents of a chunk that began on `start` are on
    `shard`. `free` are the places that no row of the table takes yet, by shard. The state at the end, and the cut edges
    before the first round and after each: pairs of neighbours on different shards. They never rise."""
    shards, cuts = len(free), []
    room_for = lambda n: F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: _of(free, s) >= n)
    for turn in range(rounds + 1):
        votes = state.groupBy("unit", "shard").agg(F.sum("n").alias("votes"))
        choice = F.struct((F.col("need") <= _of(free, F.col("shard"))).alias("fits"), "votes", F.xxhash64("unit", "shard").alias("tie"), "shard", "need")
        sizes = votes.groupBy("unit").agg(F.sum("votes").alias("all"), F.sum(F.col("votes") * F.col("votes")).alias("squares"))
        cuts.append(int(sizes.agg(F.coalesce(F.sum((F.col("all") * F.col("all") - F.col("squares")) / 2), F.lit(0))).first()[0]))
        if turn == rounds or not cuts[-1]:
            break
        asked = votes.join(sizes.filter("squares < all * all").select("unit", "all"), "unit").withColumn("need", F.col("all") - F.col("votes"))
        asked = asked.groupBy("unit", "all").agg(F.max(choice).alias("own"))
        elsewhere = F.try_element_at(room_for(F.col("all")), (F.pmod(F.xxhash64("unit", F.lit(turn)), F.greatest(F.size(room_for(F.col("all"))), F.lit(1))) + 1).cast("int"))
        asked = asked.select("unit", F.when(F.col("own.fits"), F.col("own.shard")).otherwise(elsewhere).cast("int").alias("to"), F.when(F.col("own.fits"), F.col("own.need")).otherwise(F.col("all")).alias("need"))
        # The pairs that a move mends follow the documents that move: by the bits of their number, most first.
        salt = _weight(F.col("need")) * 4096 + F.pmod(F.xxhash64("unit"), F.lit(4096))
        taken = prefix(asked.filter("to IS NOT NULL"), "to", salt, "need", ["unit"], "before")
        taken = staged(taken.filter(F.col("before") + F.col("need") <= _of(free, F.col("to"))).select("unit", "to"), "taken")
        if taken.isEmpty():
            break
        moved = staged(state.join(taken, "unit", "left").withColumn("next", F.coalesce("to", "shard")).select("unit", "start", "n", "shard", "next"), "moved")
        forget(state, taken)
        change = {s: [0, 0] for s in range(shards)}
        for side, column in enumerate(("shard", "next")):
            for s, n in moved.filter("shard <> next").groupBy(column).agg(F.sum("n")).collect():
                change[s][side] = n
        free = [f + change[s][0] - change[s][1] for s, f in enumerate(free)]
        state = moved.select("unit", "start", "n", F.col("next").alias("shard"))
        state._staged = moved._staged
    return state, cuts


def shards_of(batches: DataFrame, units: DataFrame, rows: int, shards: int, rounds: int, report: list[int] | None = None) -> DataFrame:
    """(unit, shard, base) of the chunks that found room; `base` counts the documents before it on the shard.

    `units` is a written table (unit, n, label), where `label` is the shard that most documents of the chunk were dealt to;
    `batches` (unit, place, n) has the chunks' documents dealt evenly to so many places.
    """
    spark, schema = units.sparkSession, units.select("unit", "n", F.col("label").alias("shard")).schema
    free = [rows // shards + (s < rows % shards) for s in range(shards)]
    large = []
    for u in sorted(units.filter(F.col("n") * 2 > rows // shards).collect(), key=lambda u: (-u["n"], u["unit"])):
        # Where most of its documents are, or else the shard with least room that is enough.
        s = min(range(shards), key=lambda s: (free[s] < u["n"], s != u["label"], free[s], s))
        if free[s] >= u["n"]:
            free[s] -= u["n"]
            large.append((u["unit"], u["n"], s))
    seeds = staged(spark.createDataFrame(large, schema), "seeds")
    rest = units.join(F.broadcast(seeds.select("unit")), "unit", "left_anti")
    # The others start beside the seeds, each shard with its part of the places that are free.
    docs = staged(batches.join(F.broadcast(seeds.select("unit")), "unit", "left_anti"), "batches")
    total, room = docs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], sum(free)
    firsts = [sum(free[:s]) for s in range(shards)]
    state, taken = docs, [0] * shards
    if total:
        numbered = salted_rank(docs.withColumn("one", F.lit(0)), ["one"], ["unit", "start", "at"], F.pmod(F.xxhash64("unit", "start", "at"), F.lit(max(256, buckets_for(total)))), "place")
        at = F.floor(F.col("place") * F.lit(room) / F.lit(total))
        last = F.size(F.filter(F.array(*(F.struct(F.lit(f).cast("long").alias("f"), F.lit(n).cast("long").alias("n")) for f, n in zip(firsts, free))), lambda x: x["f"] <= at)) - 1
        state = numbered.withColumn("shard", last.cast("int")).groupBy("unit", F.col("shard").alias("start"), "shard").agg(F.count(F.lit(1)).alias("n"))
        state = staged(state.select("unit", "start", "n", "shard"), "state")
        for s, n in state.groupBy("shard").agg(F.sum("n")).collect():
            taken[s] = n
        state, cuts = propagate(state, [f - t for f, t in zip(free, taken)], rounds)
        if report is not None:
            report += cuts
    whole = state.groupBy("unit").agg(F.min("shard").alias("shard"), F.max("shard").alias("other"), F.sum("n").alias("n")).filter("shard = other") if total else None
    placed = staged(seeds.unionByName(whole.select("unit", "n", "shard")) if total else seeds, "placed")
    waiting = rest.select("unit", "n").join(placed.select("unit"), "unit", "left_anti")
    # Of each size, so many go to each shard; there are fewer sizes than twice the root of the rows.
    used = dict(placed.groupBy("shard").agg(F.sum("n")).collect())
    free = [rows // shards + (s < rows % shards) - used.get(s, 0) for s in range(shards)]
    runs = []
    for n, count in sorted(waiting.groupBy("n").count().collect(), reverse=True):
        at = 0
        for s in range(shards):
            if (fit := min(count - at, free[s] // n)) > 0:
                runs.append((n, at, at + fit, s))
                at, free[s] = at + fit, free[s] - fit * n
    if runs:
        ranked = salted_rank(waiting.select("unit", "n"), ["n"], ["unit"], F.pmod(F.xxhash64("unit"), F.lit(256)), "rank")
        to = F.broadcast(spark.createDataFrame(runs, "n long, first long, end long, shard int"))
        fits = ranked.join(to, "n").filter("rank >= first AND rank < end").select("unit", "n", "shard")
        placed = staged(placed.unionByName(fits), "placed")
    salt = F.pmod(F.xxhash64("unit"), F.lit(4096))
    return prefix(placed, "shard", salt, "n", ["unit"], "base")


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS, report: list[int] | None = None) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard: a row for each row. `report`, if given, gets the cut edges before the
    first round and after each.

    Law `rows`: counts at most one apart; grown_shard is null. A null text counts as the empty one, in size (16), digest and
    links. Repeated rows are rows of their own. Slots count from 0 without gaps on each shard. With fewer rows than shards,
    the first shards have one row each; an empty table gives an empty one. Other columns are left out.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = staged(
        docs.select(F.col(key), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("same")),
        "sizes",
    )
    rows = base.count()
    room = max(1, rows // shards)
    salt = F.pmod(F.xxhash64(key, "same"), F.lit(max(256, buckets_for(rows))))
    ranked = salted_rank(base, ["same"], [key], salt, "rank", "total")
    # A chunk: at most a shard's rows of a group. `start`: the shard to which a document is dealt for the seeds' votes.
    ranked = ranked.withColumn("chunk", F.floor(F.col("rank") / room)).withColumn("at", F.col("rank") % room)
    unit = F.xxhash64("same", "chunk")
    ranked = staged(ranked.withColumn("unit", F.when(F.col("total") > 1, F.struct("same", "chunk"))).withColumn("start", F.pmod(F.xxhash64(key, "rank", unit), F.lit(shards)).cast("int")), "ranked")
    linked = ranked.filter("unit IS NOT NULL")
    votes = linked.groupBy("unit", "start").agg(F.count(F.lit(1)).alias("votes"))
    units = staged(votes.groupBy("unit").agg(F.sum("votes").alias("n"), F.min_by("start", F.struct(-F.col("votes"), "start")).alias("label")), "units")
    several = units.filter("n > 1")
    dealt = joined(linked.select("unit", "start", "at"), several.select("unit", F.col("n").alias("weight")), "unit", "weight", rows).select("unit", "start", "at", F.lit(1).cast("long").alias("n"))
    placed = staged(shards_of(dealt, several, rows, shards, rounds, report), "placed")
    # Free places by shard: `shards` numbers, whatever the input.
    used = dict(placed.groupBy("shard").agg(F.sum("n")).collect())
    free = [rows // shards + (s < rows % shards) - used.get(s, 0) for s in range(shards)]
    # Shards with most room come first, so that what must be cut is cut least.
    turn = sorted(range(shards), key=lambda s: -free[s])
    firsts = [sum(free[s] for s in turn[:i]) for i in range(shards)]
    # What is cut lies one after the other. A chunk's rows are up to a shard: large chunks are joined apart.
    cut = several.join(placed.select("unit"), "unit", "left_anti")
    cut = staged(prefix(cut.withColumn("all", F.lit(0)), "all", F.pmod(F.xxhash64("unit"), F.lit(4096)), "n", ["unit"], "place").select("unit", "place"), "cut")
    taken = several.join(cut.select("unit"), "unit", "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    homes = staged(units.select("unit", "n").join(placed.select("unit", "shard", "base"), "unit", "left").join(cut, "unit", "left"), "homes")
    at_home = joined(linked, homes, "unit", "n", rows)
    done = at_home.filter("shard IS NOT NULL").select(key, "size", "text_crc32", "shard", (F.col("base") + F.col("at")).cast("long").alias("slot"))
    whole = at_home.filter("place IS NOT NULL").select(key, "size", "text_crc32", (F.col("place") + F.col("at")).alias("place"))
    rest = at_home.filter("shard IS NULL AND place IS NULL").select(ranked.columns).unionByName(ranked.filter("unit IS NULL"))
    left = staged(rest.select(key, "size", "text_crc32", "same", "rank", F.lit(0).alias("one")), "left")
    numbered = salted_rank(left, ["one"], [key, "same", "rank"], F.pmod(F.xxhash64(key, "same", "rank"), F.lit(max(256, buckets_for(rows)))), "place")
    numbered = numbered.select(key, "size", "text_crc32", (F.col("place") + taken).alias("place")).unionByName(whole)
    # Shards without free places come last, and begin where all places end.
    turned = F.size(F.filter(F.array(*(F.lit(f).cast("long") for f in firsts)), lambda f: f <= F.col("place"))) - 1
    numbered = numbered.withColumn("turn", turned.cast("int"))
    of = lambda xs: _of(xs, F.col("turn"))
    filled = numbered.select(key, "size", "text_crc32", of(turn).cast("int").alias("shard"), (F.col("place") - of(firsts) + of([used.get(s, 0) for s in turn])).cast("long").alias("slot"))
    both = done.unionByName(filled)
    return both.select(key, "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))


QUERIES = {"op10_sharding": op10_sharding}
