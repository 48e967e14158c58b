"""Layers over all common neighbours, summed where these are found: equal to the layer over joined ties, and nothing but ties is shuffled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import graph as G
from spanloom.operators import layers as L
from spanloom.operators import wedges as W
from spanloom.plans import load_all
from spanloom.plans import layers as P
from spanloom.plans.layers import weight
from tests.oracle import SF
from tests.test_disk import _shuffles
from tests.test_wedges import EDGE, _near

QUERIES, _ = load_all()


@pytest.mark.parametrize("n", [30, 10**6])  # fewer vectors than ties, and more
@pytest.mark.parametrize("kind", ["concat", "linear", "scored", "separate", "mutual"])
def test_equals_joined_layer(spark, kind, n):
    near = _near()
    edges = spark.createDataFrame([(h, t) for h in near for t in near[h]], EDGE)
    ids = sorted({(h + t) % n for h in near for t in near[h]})[::2] + [n - 1]  # half the ties lack a vector
    vec = spark.createDataFrame([(i, [((i * (k + 3)) % 11 - 5) / 10 for k in range(4)]) for i in dict.fromkeys(ids)], "vec_id bigint, v array<double>")
    of = lambda d, a, b, out: d.withColumn("vec_id", (F.col(a) + F.col(b)) % n).join(vec, "vec_id").drop("vec_id").withColumnRenamed("v", out)
    ties = of(of(G.all_common_neighbours(edges), "h", "c", "first"), "c", "t", "second").select("h", "t", "first", "second")
    want = L.layer(of(edges, "h", "t", "cand"), ties, ["h", "t"], kind, 4, weight)
    got = L.layer_of_pairs(edges, vec, n, kind, 4, weight)
    rows = lambda d: sorted((r.h, r.t, *(round(r[f"x{i}"], 9) + 0.0 for i in range(4))) for r in d.collect())
    assert rows(got) == rows(want)


def test_score_layer_linear_shuffles_no_ties(spark):
    assert _shuffles(QUERIES["score_layer_linear"](spark, SF)) == []


def test_score_layer_separate_shuffles_no_ties(spark):
    assert _shuffles(QUERIES["score_layer_separate"](spark, SF)) == []


def test_score_layer_mutual_shuffles_no_ties(spark):
    assert _shuffles(QUERIES["score_layer_mutual"](spark, SF)) == []


def test_score_graph_candidates_shuffles_no_ties(spark):
    assert _shuffles(QUERIES["score_graph_candidates"](spark, SF)) == []


def test_what_all_pairs_of_a_head_need_looks_for_common_neighbours_once(spark):
    near = _near()
    edges = spark.createDataFrame([(h, t) for h in near for t in near[h]], EDGE)
    looked = spark.sparkContext.accumulator(0)

    def prepare(x):
        common = x.common

        def counted(a, b):
            looked.add(len(a))
            return common(a, b)

        x.common = counted

    def visit(x, _, a, b, r, p, q):
        yield x.heads[a], x.heads[b], np.bincount(r, minlength=len(a))

    def finish(columns):
        h, t, n = columns
        heads, at = np.unique(h, return_inverse=True)
        yield heads, np.bincount(at), np.bincount(at, n).astype(np.int64)

    got = W.each_class(spark, W.ties(edges), "h bigint, t bigint, n bigint", visit, "h bigint, degree bigint, n bigint", finish, prepare)
    assert sorted(map(tuple, got.collect())) == sorted((h, len(near[h]), sum(len(near[h] & near[t]) for t in near[h])) for h in near if near[h])
    assert looked.value == sum(map(len, near.values())) // 2


def test_rivals_are_handed_on_in_portions(monkeypatch):
    h, t = np.repeat([4, 7, 9], [12, 1, 20]), np.r_[0:12, 5, 30:50]
    columns = [h, t, np.arange(len(h)) % 5 / 4]
    whole = list(P._beside_rival(columns))
    monkeypatch.setattr(P, "ROWS", 6)
    parts = list(P._beside_rival(columns))
    assert len(whole) == 1 and [len(x[0]) for x in parts] == [6, 6, 6, 6, 6, 2]
    assert all((np.concatenate(c) == w).all() for c, w in zip(zip(*parts), whole[0]))
