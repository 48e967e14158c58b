"""What is written to disk: shuffles of the final plans, and no rows with vectors in them."""

import random
import re

from pyspark.sql import functions as F

from spanloom.operators import graph as G
from spanloom.operators import scoring as C
from spanloom.plans import load_all
from tests.oracle import SF

QUERIES, _ = load_all()


def _shuffles(df) -> list[str]:
    """What each shuffle by key of a plan is by."""
    return re.findall(r"Exchange hashpartitioning\((\w+)#", df._jdf.queryExecution().executedPlan().toString())


def test_statements_need_one_shuffle(spark):
    assert _shuffles(QUERIES["graph_edges"](spark, SF)) == ["sent_id"]


def test_statements_of_a_long_sentence_equal_brute_force(spark):
    rnd, at, m = random.Random(3), 0, []
    for rn in range(1, 400):
        n = rnd.choice([0, 1, 5, 30])  # also spans without any extent
        m.append((1, rnd.randrange(9), rn, at, at + n))
        at += n
    got = G.statements(spark.createDataFrame(m, "sent_id bigint, entity bigint, rn int, st bigint, en bigint"))
    want = sorted((a[1], b[1], 1, a[3], a[4], b[3], b[4]) for a in m for b in m if a[2] < b[2] and a[1] != b[1] and a[4] + 40 > b[3] and b[4] - a[3] <= 123)
    assert sorted(map(tuple, got.collect())) == want


def test_segment_sums_shuffle_no_vectors(spark):
    assert _shuffles(QUERIES["score_segment_sums"](spark, SF)) == ["h", "sent_id"]


def test_lookup_in_a_large_table_joins_by_key(spark):
    v = spark.range(50).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    rows = spark.range(200).select((F.col("id") % 50).alias("k"))
    sent, joined = (C.gather(rows, C.sized(v, limit), "k", "v").select("k", "v") for limit in (100, 99))
    assert "BroadcastHashJoin" in sent._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, sent.collect())) == sorted(map(str, joined.collect()))


def test_attention_layer_shuffles_no_vectors(spark):
    assert _shuffles(QUERIES["score_attention_layer"](spark, SF)) == ["h", "sent_id"]


def test_gated_sum_shuffles_no_vectors(spark):
    assert _shuffles(QUERIES["score_gated_sum"](spark, SF)) == ["h", "sent_id"]


def test_distance_classes_shuffle_statements_once_for_both_directions(spark):
    df = QUERIES["pair_distance_classes"](spark, SF)
    assert set(_shuffles(df)) == {"run", "u", "sent_id"}
    names = {c for c in re.findall(r"Exchange hashpartitioning\(run#.*\n.*Project \[(.*?)\]\n", df._jdf.queryExecution().executedPlan().toString())}
    assert names and not any(re.search(r"\bid#", x) for x in names)
