"""Negatives found head by head: the same as by joins, and what they shuffle."""

import random

from pyspark.sql import functions as F

from spanloom.operators import graph as G
from spanloom.operators import heads as H
from spanloom.operators import pairs as R
from spanloom.plans import load_all
from tests.oracle import SF
from tests.test_disk import _shuffles

QUERIES, _ = load_all()


def _mentions(spark, seed: int, sentences: int, entities: int):
    rnd, m = random.Random(seed), []
    for s in range(sentences):
        at = 0
        for rn in range(rnd.choice([1, 2, 3, 5, 12])):
            n = rnd.choice([0, 1, 5, 30, None])
            m.append((s if s else None, rnd.choice([*range(entities), None]), rn, at, at + n if n is not None else None))
            at += n or 0
    return spark.createDataFrame(m, "sent_id bigint, entity bigint, rn int, st bigint, en bigint")


def test_statements_by_head_are_those_of_both_ways(spark):
    m = _mentions(spark, 1, 60, 9)
    x = G.by_head(m).select("h", "sent_id", "hs", F.posexplode("near").alias("i", "v"))
    got = x.groupBy("h", "sent_id", "hs", F.floor(F.col("i") / 2)).count().agg(F.sum("count")).first()[0]
    want = G.both_ways(G.statements(m)).where("sent_id is not null")
    assert want.count() and got is not None
    rows = G.by_head(m).select("h", "sent_id", "hs", F.explode(F.transform(F.sequence(F.lit(0), F.size("near") - 2, F.lit(2)), lambda i: F.struct(F.get("near", i).alias("t"), F.get("near", i + 1).alias("ts")))).alias("x")).select("h", "x.t", "sent_id", "hs", "x.ts")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, want.select("h", "t", "sent_id", "hs", "ts").collect()))


def test_strong_negatives_equal_those_by_joins(spark):
    for seed, sentences, entities in ((2, 80, 6), (3, 12, 30)):
        m = _mentions(spark, seed, sentences, entities)
        e = R.with_ids(G.both_ways(G.statements(m)).where("sent_id is not null"))
        want = R.strong_negatives(e, G.neighbours(e), m)
        assert sorted(map(tuple, H.strong_negatives(m).collect())) == sorted(map(tuple, want.collect()))


def test_strong_negatives_shuffle_mentions_only(spark):
    assert _shuffles(QUERIES["pair_strong_negatives"](spark, SF)) == ["h", "sent_id"]
