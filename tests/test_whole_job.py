"""Nothing is lost to a cap: brute force over small graphs, without SQL."""

import random
from collections import defaultdict
from hashlib import md5

from pyspark.sql import functions as F

from spanloom.operators import graph as G
from spanloom.operators import pairs as R
from spanloom.plans import graph as plans
from spanloom.plans import load_all
from tests.oracle import SF

EDGE = "h bigint, t bigint, sent_id bigint, hs bigint, he bigint, ts bigint, te bigint"


def _edges(spark, undirected):
    """Statements of (h, t, sent_id), both ways."""
    return R.with_ids(G.both_ways(spark.createDataFrame([(h, t, s, 0, 1, 5, 6) for h, t, s in undirected], EDGE)))


def _graph(n: int, p: float, seed: int):
    """A random graph with a hot entity next to all others, two statements for some ties."""
    rnd = random.Random(seed)
    ties = [(0, i) for i in range(1, n)] + [(i, j) for i in range(1, n) for j in range(i + 1, n) if rnd.random() < p]
    return [(h, t, 10 * k + s) for k, (h, t) in enumerate(ties) for s in range(rnd.randint(1, 2))]


def _near(rows):
    near = defaultdict(set)
    for h, t, _ in rows:
        near[h].add(t)
        near[t].add(h)
    return near


def _key(h, t):
    return md5(f"1|{h}|{t}".encode()).hexdigest(), t


def test_common_neighbours_of_all_pairs_equal_brute_force(spark):
    rows = _graph(40, 0.12, 1)
    near = _near(rows)
    got = G.all_common_neighbours(G.neighbours(_edges(spark, rows))).collect()
    want = {(h, t, c) for h in near for t in near[h] for c in near[h] & near[t]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_every_statement_with_a_mutual_tail_shares_one(spark):
    rows = _graph(60, 0.03, 2)
    near = _near(rows)
    e = _edges(spark, rows)
    ends = {r.id: (r.h, r.t) for r in e.collect()}
    least = {}
    for i, p in ends.items():
        least[p] = min(least.get(p, i), i)
    want = {}
    for i, (h, t) in ends.items():
        ring = sorted(near[h], key=lambda c: (_key(h, c) <= _key(h, t), _key(h, c)))
        c = next((c for c in ring if c != t and c in near[t]), None)
        if c is not None:
            want[i] = least[h, c]
    got = R.sharing_one(e, G.neighbours(e)).collect()
    assert len(got) == len(want) and {r.a_id: r.b_id for r in got} == want


def test_exclusive_neighbours_of_all_pairs_equal_brute_force(spark):
    rows = _graph(40, 0.12, 3)
    near = _near(rows)
    nb = G.neighbours(_edges(spark, rows))
    for of, want in (
        ("h", {(h, t, c) for h in near for t in near[h] for c in near[h] - near[t] - {t}}),
        ("t", {(h, t, c) for h in near for t in near[h] for c in near[t] - near[h] - {h}}),
    ):
        got = G.all_exclusive_neighbours(nb, of).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_neighbour_queries_answer_every_pair(spark):
    q, _ = load_all()
    near = defaultdict(set)
    for r in G.neighbours(plans.edges(spark, SF)).collect():
        near[r.h].add(r.t)
    common = {(h, t, c) for h in near for t in near[h] for c in near[h] & near[t]}
    assert {tuple(r) for r in q["graph_common_neighbours"](spark, SF).select("h", "t", "c").collect()} == common
    assert q["graph_head_only_neighbours"](spark, SF).count() == sum(len(near[h] - near[t] - {t}) for h in near for t in near[h])
    assert q["graph_tail_only_neighbours"](spark, SF).count() == sum(len(near[t] - near[h] - {h}) for h in near for t in near[h])
    chosen = {(h, min(near[h])) for h in near}
    classes = {(h, t, c, ((h, c) in chosen) + ((c, t) in chosen)) for h, t, c in common}
    assert {tuple(r) for r in q["graph_neighbour_classes"](spark, SF).select("h", "t", "c", "n_chosen").collect()} == classes


def test_every_statement_that_can_gets_a_strong_negative(spark):
    rnd = random.Random(5)
    # sentences of few entities, and a head of which a frequent tail stands in all sentences but one
    sents = [rnd.sample(range(20), rnd.randint(2, 4)) for _ in range(45)] + [[100, 101, 200 + k] for k in range(12)] + [[100, 211]]
    m = spark.createDataFrame([(s, e, k + 1, 10 * k, 10 * k + 3) for s, es in enumerate(sents) for k, e in enumerate(es)], "sent_id bigint, entity bigint, rn int, st bigint, en bigint")
    e = R.with_ids(G.both_ways(G.statements(m)))
    rows = {r.id: r for r in e.collect()}
    near, of = defaultdict(set), defaultdict(list)
    for r in rows.values():
        near[r.h].add(r.t)
        of[r.h, r.t].append((md5(f"1|{r.id}".encode()).hexdigest(), r.id))
    want = {}
    for i, r in rows.items():
        ring = sorted(near[r.h] - {r.t}, key=lambda c: (_key(r.h, c) <= _key(r.h, r.t), _key(r.h, c)))
        for c in ring:
            good = [x for x in of[r.h, c] if r.t not in sents[rows[x[1]].sent_id]]
            if good:
                want[i] = (min(good)[1], c)
                break
    got = R.strong_negatives(e, G.neighbours(e), m).collect()
    assert any((rows[i].h, rows[i].t) == (100, 101) for i in want)
    assert len(got) == len(want) and {r.a_id: (r.b_id, r.new_t) for r in got} == want
