"""Operators over time: latest values, buffers, budgets, ticks and rate limits.

A key's rows are cut into buckets of time, so that no task sorts all of a busy key; what a bucket needs of earlier ones is
one carried value, or the bucket before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds, and units of an order, in a bucket.
BUCKET, ORDERS = 86_400.0, 10_000


def latest_before(left: DataFrame, right: DataFrame, by: str, at: str, tie: str, values: list[str], tie_right: str | None = None, bucket: float = BUCKET) -> DataFrame:
    """`left` with the `values` of the last row of `right` at or before its time, by key; null where there is none.

    Both sides go through one window of a bucket in the order (time, right side first, tie): a backward join without a range
    join. What was last in the buckets before is carried over, a row for each bucket.
    """
    none = lambda df, columns: F.lit(None).cast(df.select(F.struct(*columns)).schema[0].dataType)
    place = F.floor(F.col(at).cast("double") / bucket).alias("__bucket")
    l = left.select(by, at, place, F.lit(1).alias("__side"), F.col(tie).alias("__tie"), F.struct(*left.columns).alias("__l"), none(right, values).alias("__r"))
    r = right.select(by, at, place, F.lit(0).alias("__side"), F.col(tie_right or tie).alias("__tie"), none(left, left.columns).alias("__l"), F.struct(*values).alias("__r"))
    both = l.unionByName(r)
    ends = both.groupBy(by, "__bucket").agg(F.max_by("__r", F.when(F.col("__side") == 0, F.struct(at, "__tie"))).alias("__end"))
    carried = ends.withColumn("__before", F.last("__end", True).over(Window.partitionBy(by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("__end")
    w = Window.partitionBy(by, "__bucket").orderBy(at, "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    j = both.withColumn("__last", F.last("__r", True).over(w)).filter("__side = 1")
    same = j[by].eqNullSafe(carried[by]) & (j["__bucket"] == carried["__bucket"])
    j = j.join(carried, same, "left").select("__l", F.coalesce("__last", "__before").alias("__last"))
    return j.select("__l.*", *(F.col(f"__last.{v}").alias(v) for v in values))


def buffered(scans: DataFrame, by: str, stamp: str, seconds: float, aggregates: list) -> DataFrame:
    """Each scan with aggregates over the scans of the last `seconds`, itself included; `stamp` is in seconds.

    Buckets are as long as the buffer, and each gets the scans of the one before as well.
    """
    span = round(seconds * 1_000_000)
    d = scans.withColumn("__t", F.round(F.col(stamp) * 1_000_000).cast("long"))
    d = d.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("__late")).withColumn("__bucket", F.expr(f"__t div {max(span, 1)} - IF(__t % {max(span, 1)} < 0, 1, 0)") + F.col("__late"))
    w = Window.partitionBy(by, "__bucket").orderBy("__t").rangeBetween(-span, 0)
    return d.withColumns({name: a.over(w) for name, a in aggregates}).filter("__late = 0").drop("__t", "__late", "__bucket")


def within_budget(frames: DataFrame, by: str, order: str, size: str, budget: int, bucket: int = ORDERS) -> DataFrame:
    """The newest frames whose sizes together stay within the budget, and always the newest. Buckets of the order that the newer
    ones leave nothing for are dropped before any sort."""
    d = frames.withColumn("__bucket", F.floor(F.col(order) / bucket))
    sums = d.groupBy(by, "__bucket").agg(F.sum(size).alias("__sum"))
    newer = Window.partitionBy(by).orderBy(F.desc("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(by).alias("__by"), F.col("__bucket").alias("__b"), F.sum("__sum").over(newer).alias("__newer")).filter(F.col("__newer").isNull() | (F.col("__newer") <= budget))
    d = d.join(sums, d[by].eqNullSafe(F.col("__by")) & (F.col("__bucket") == F.col("__b")))
    here = Window.partitionBy(by, "__bucket").orderBy(F.desc(order))
    total = F.sum(size).over(here.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("__newer", F.lit(0))
    first = F.col("__newer").isNull() & (F.row_number().over(here) == 1)
    return d.withColumns({"__total": total, "__first": first}).filter((F.col("__total") <= budget) | F.col("__first")).select(*frames.columns)


def rate_limited(events: DataFrame, by: str, stamp: str, tie: str, period: float, start: float | None = None) -> DataFrame:
    """Events that are at least `period` after the last one let through, by key, in the order (stamp, tie).

    With `start`, the period counts from there at first; without, a key's first event passes. A task goes over its sorted events
    once and holds one batch and one time; events with a null stamp are dropped.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, fresh = None, start, True
        for b in batches:
            keep = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if fresh or k != key:
                    key, last, fresh = k, start, False
                keep.append(ok := last is None or t - last >= period)
                if ok:
                    last = t
            yield b.filter(pa.array(keep, pa.bool_()))

    rows = events.select(by, stamp, tie).filter(F.col(stamp).isNotNull()).repartition(by).sortWithinPartitions(by, stamp, tie)
    return rows.mapInArrow(run, f"{by} {kinds[by]}, {stamp} {kinds[stamp]}, {tie} {kinds[tie]}")


def ticks(spans: DataFrame, by: str, period: float) -> DataFrame:
    """Times (by, tick, t) every `period` from `first` to `last` of each row of `spans`, in seconds."""
    n = F.floor((F.col("last") - F.col("first")) / period).cast("int")
    return spans.filter("last >= first").select(by, "first", F.explode(F.sequence(F.lit(0), n)).alias("tick")).select(by, "tick", (F.col("first") + F.col("tick") * period).alias("t"))


def newer_than(frames: DataFrame, since: int, order: str = "seq") -> DataFrame:
    """The newest frame after `since`, or none: what a reader that polls with a cursor gets."""
    return frames.filter(F.col(order) > since).orderBy(F.desc(order)).limit(1)
