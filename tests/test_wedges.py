"""Common neighbours from classes of ties, in small classes and portions, against brute force; what their queries shuffle."""

import random
from collections import defaultdict
from hashlib import md5

import pytest

from spanloom.operators import graph as G
from spanloom.operators import pairs as R
from spanloom.operators import wedges as W
from spanloom.plans import load_all
from tests.oracle import SF
from tests.test_disk import _shuffles

QUERIES, _ = load_all()
from spanloom.plans import load_all
from tests.oracle import SF
from tests.test_disk import _shuffles

QUERIES, _ = load_all()
EDGE = "h bigint, t bigint"


def _near(n: int = 40, p: float = 0.2, seed: int = 5):
    """A random graph with large ids and a hot entity next to all others."""
    rnd, near = random.Random(seed), defaultdict(set)
    name = [rnd.randrange(2**40) for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if j == 0 or rnd.random() < p:
                near[name[i]].add(name[j])
                near[name[j]].add(name[i])
    return near


@pytest.mark.parametrize("most,chunk", [(10, 7), (60, 50), (10**6, 10**6)])
def test_common_neighbours_in_small_classes(spark, monkeypatch, most, chunk):
    near = _near()
    path = W.ties(spark.createDataFrame([(h, t) for h in near for t in near[h] for _ in range(2)], EDGE))
    monkeypatch.setattr(W, "CHUNK", chunk)
    groups = W.classes(path, most, 3)
    seen, got = set(), set()
    for i in range(len(groups)):
        for j in range(i, len(groups)):
            x = W.Ties(path, groups[i], groups[j] if i != j else [])
            for part in x.portions(False):
                a, b = x.a[part], x.b[part]
                for h, t in zip(x.heads[a].tolist(), x.heads[b].tolist(), strict=True):
                    assert (h, t) not in seen and (t, h) not in seen
                    seen.add((h, t))
                r, p, q = x.common(a, b)
                assert (x.to[p] == x.to[q]).all()
                got |= set(zip(x.heads[a][r].tolist(), x.heads[b][r].tolist(), x.to[p].tolist(), strict=True))
    assert seen | {(t, h) for h, t in seen} == {(h, t) for h in near for t in near[h]}
    assert got == {(h, t, c) for h, t in seen for c in near[h] & near[t]}


@pytest.mark.parametrize("of", ["h", "t"])
def test_exclusive_neighbours(spark, of):
    near = _near()
    got = W.exclusive_neighbours(spark.createDataFrame([(h, t) for h in near for t in near[h]], EDGE), of)
    want = {(h, t, c) for h in near for t in near[h] for c in (near[h] - near[t] - {t} if of == "h" else near[t] - near[h] - {h})}
    rows = list(map(tuple, got.collect()))
    assert len(rows) == len(want) and set(rows) == want


def test_no_ties(spark):
    assert W.common_neighbours(spark.createDataFrame([], EDGE)).count() == 0


def test_tail_only_neighbours_shuffle_nothing_but_ties(spark):
    assert _shuffles(QUERIES["graph_tail_only_neighbours"](spark, SF)) == []


def test_head_only_neighbours_shuffle_nothing_but_ties(spark):
    assert _shuffles(QUERIES["graph_head_only_neighbours"](spark, SF)) == []


def test_neighbour_classes_shuffle_nothing_but_ties(spark):
    near = _near()
    got = W.chosen_classes(spark.createDataFrame([(h, t) for h in near for t in near[h]], EDGE))
    first = {h: min(near[h]) for h in near}
    want = sorted((h, t, c, (first[h] == c) + (first[c] == t)) for h in near for t in near[h] for c in near[h] & near[t])
    assert sorted(map(tuple, got.collect())) == want
    assert _shuffles(QUERIES["graph_neighbour_classes"](spark, SF)) == []


@pytest.mark.parametrize("quotas", [[2, 1, 1, 1], [6, 3, 3, 2], [0, 0, 30]])
def test_waterfall_equals_joined_one(spark, quotas):
    near = _near()
    edges = spark.createDataFrame([(h, t) for h in near for t in near[h]], EDGE)
    rows = lambda d: sorted(map(tuple, d.select("h", "t", "c", "kind", "place").collect()))
    got, want = (rows(f(edges, quotas, n_entities=50)) for f in (W.waterfall, R.waterfall_of_pairs))
    assert got == want and len(got) == len(set(got)) > 0


def test_waterfall_shuffles_nothing_but_ties(spark):
    assert _shuffles(QUERIES["pair_waterfall_negatives"](spark, SF)) == []


def test_triangles_shuffle_no_wedges(spark):
    assert _shuffles(QUERIES["graph_triangles"](spark, SF)) == []


def test_thirds_of_statements_equal_brute_force(spark):
    rnd, m = random.Random(5), []
    for s in range(70):
        at = 0
        for rn in range(rnd.choice([2, 3, 4, 7])):
            m.append((s, rnd.randrange(9), rn, at, at + 20))
            at += 20
    m = spark.createDataFrame(m, "sent_id bigint, entity bigint, rn int, st bigint, en bigint")
    of = {}
    for h, t, s in G.both_ways(G.statements(m)).select("h", "t", "sent_id").collect():
        of.setdefault((h, t), set()).add(s)
    want = set()
    for (h, t), own in of.items():
        for s in own:
            cs = [c for c in range(9) if any(x != y for x in of.get((h, c), set()) - {s} for y in of.get((c, t), set()) - {s})]
            want |= {(h, t, s, min(cs))} if cs else set()
    got = list(map(tuple, W.third_of_statements(m).collect()))
    assert want and len(got) == len(want) and set(got) == want


def test_similar_negatives_shuffle_no_wedges(spark):
    df = QUERIES["pair_similar_strong_negatives"](spark, SF)
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString() and not {"a", "b", "u"} & set(_shuffles(df))


def test_subgraph_negatives_shuffle_nothing_after_the_ties(spark):
    df = QUERIES["subgraph_negatives"](spark, SF)
    assert _shuffles(df) == []
    rows = df.collect()
    per = defaultdict(list)
    for h, t, kind, x, y in rows:
        per[h, t].append((x, y, kind))
    assert rows and all(h < t and len(v) <= 8 and (h, t, "weak") not in v for (h, t), v in per.items())
    assert all((x, y, k) not in v for v in per.values() for x, y, kind in v if kind == "weak" for k in ("mutual", "single"))


def test_mutual_negatives_shuffle_no_wedges(spark):
    df = QUERIES["pair_mutual_strong_negatives"](spark, SF)
    assert not {"a", "b", "u"} & set(_shuffles(df)) and "RDDScan" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "ExistingRDD" not in plan


@pytest.mark.parametrize("far", [0, 2**40])
def test_mutual_negatives_equal_brute_force(spark, monkeypatch, far):
    rnd, m = random.Random(8), []
    for s in range(90):
        at = 0
        for rn in range(rnd.choice([2, 3, 4, 9])):
            m.append((s, far + rnd.randrange(12), rn, at, at + 20))
            at += 20
    names = defaultdict(set)
    for s, e, *_ in m:
        names[s].add(e)
    m = spark.createDataFrame(m, "sent_id bigint, entity bigint, rn int, st bigint, en bigint")
    monkeypatch.setattr(W, "CHUNK", 50)
    edges = R.with_ids(G.both_ways(G.statements(m)))
    of, key = defaultdict(list), lambda *x: (md5("|".join(map(str, x)).encode()).hexdigest(), x[-1])
    for e in edges.collect():
        of[e.h, e.t].append(e)
    near = defaultdict(set)
    for h, t in of:
        near[h].add(t)
    ring = {h: sorted(near[h], key=lambda t, h=h: key(1, h, t)) for h in near}
    step = lambda h, a, b: (ring[h].index(b) - ring[h].index(a)) % len(ring[h])
    want = set()
    for h, t in of:
        both = near[h] & near[t]
        if both:
            c = min(both, key=lambda c: step(h, t, c))
            rows = [(step(c, h, d), key(1, e.id), d, e.id) for d in both & near[c] for e in of[c, d] if not {h, t} & names[e.sent_id]]
            want |= {(h, t, c, *min(rows)[2:])} if rows else set()
    got = list(map(tuple, R.mutual_strong_negatives(edges, m).select("h", "t", "c", "d", "b_id").collect()))
    assert want and len(got) == len(want) and set(got) == want
