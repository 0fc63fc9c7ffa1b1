import random

from cairnfield.llm import sharding

from .test_sharding import check


def test_chunks_that_fit_are_never_cut(spark):
    """A hot third, groups and many pairs: there is room for all of them, as a third of the rows is alone."""
    texts = ["hot"] * 1333 + [f"g{i % 10}" for i in range(300)] + [f"p{i % 500}" for i in range(1000)] + [f"s{i}" for i in range(1367)]
    random.Random(11).shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cuts: list[int] = []
    homes = check(sharding.shard_documents(df, report=cuts).collect(), dict(enumerate(texts)), 40)
    assert cuts[0] > 0 and all(a >= b for a, b in zip(cuts, cuts[1:])) and cuts[-1] < cuts[0] / 10
    assert len(homes["hot"]) <= 14  # 13 full shards and what is over
    assert not [t for t, h in homes.items() if t != "hot" and len(h) > 1]


def test_what_fits_nowhere_is_cut_least(spark):
    """Five groups of 3 on four shards of 5: one finds no room."""
    texts = [f"g{i % 5}" for i in range(15)] + ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    homes = check(sharding.shard_documents(df, shards=4).collect(), dict(enumerate(texts)), 4)
    assert sorted(len(h) for t, h in homes.items() if t[0] == "g") == [1, 1, 1, 1, 2]


def pairs_cut(rows):
    """Pairs of one unit on different shards, from (unit, shard, n)."""
    by = {}
    for u, s, n in rows:
        by.setdefault(u, {}).setdefault(s, 0)
        by[u][s] += n
    return sum((sum(c.values()) ** 2 - sum(x * x for x in c.values())) // 2 for c in by.values())


def test_rounds_mend_cuts_under_quotas(spark):
    """Scattered groups on shards with little room: cuts fall from round to round, further than one vote gets, and quotas hold."""
    rng, shards = random.Random(5), 8
    rows = []
    for u in range(60):
        n = rng.choice((2, 3, 5, 8))
        for s in rng.choices(range(shards), weights=[4, 3, 2, 1, 1, 1, 1, 1], k=n):
            rows.append((f"u{u}", s, 1))
    loads = [sum(n for _, s, n in rows if s == k) for k in range(shards)]
    quota = max(loads) + 3
    state = spark.createDataFrame([(u, s, s, n) for u, s, n in rows], "unit string, start int, shard int, n long").groupBy("unit", "start", "shard").sum("n").withColumnRenamed("sum(n)", "n")
    state = sharding.staged(state, "state")
    free = [quota - x for x in loads]
    after, cuts = sharding.propagate(state, free)
    got = [(r.unit, r.shard, r.n) for r in after.collect()]
    assert cuts[0] == pairs_cut(rows) and cuts[-1] == pairs_cut(got)
    assert all(a >= b for a, b in zip(cuts, cuts[1:])) and len(cuts) > 2 and cuts[-1] < cuts[1] < cuts[0]
    assert all(sum(n for _, s, n in got if s == k) <= quota for k in range(shards))
    assert sum(n for _, _, n in got) == len(rows)


def test_no_room_moves_nobody(spark):
    state = sharding.staged(spark.createDataFrame([("a", 0, 0, 1), ("a", 1, 1, 1)], "unit string, start int, shard int, n long"), "state")
    after, cuts = sharding.propagate(state, [0, 0])
    assert cuts == [1] and sorted(r.shard for r in after.collect()) == [0, 1]
