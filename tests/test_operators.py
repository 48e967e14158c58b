"""Hand-computed cases and properties of the operators."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions import vectors as V
from spanloom.functions.spans import window_around
from spanloom.operators import graph as G
from spanloom.operators import masking as M
from spanloom.operators import metrics as X
from spanloom.operators import pairs as R
from spanloom.operators import prep as P
from spanloom.operators import sampling as S
from spanloom.operators import scoring as C
from spanloom.operators import subgraph as U
from spanloom.operators.intervals import overlap_join, stabbing, sweep_disjoint


def collect(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_sweep_keeps_what_a_dropped_span_would_block(spark):
    df = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 3, 8), (1, 2, 5, 7), (1, 3, 7, 9), (2, 0, 1, 2)], "doc int, idx int, s int, e int")
    assert collect(sweep_disjoint(df, ["doc"], "s", "e", ["idx"]), "doc", "idx") == [(1, 0), (1, 2), (1, 3), (2, 0)]


def test_sweep_leaves_no_overlap_and_equals_brute_force(spark):
    rnd = random.Random(3)
    rows = [(d, i, s, s + rnd.randint(1, 9)) for d in range(20) for i, s in enumerate(rnd.randint(0, 60) for _ in range(rnd.randint(1, 25)))]
    kept = collect(sweep_disjoint(spark.createDataFrame(rows, "doc int, idx int, s int, e int"), ["doc"], "s", "e", ["idx"]), "doc", "s", "idx", "e")
    want = []
    for d in range(20):
        until = -1
        for _, i, s, e in sorted((r for r in rows if r[0] == d), key=lambda r: (r[2], r[1])):
            if s >= until:
                want.append((d, s, i, e))
                until = e
    assert kept == sorted(want)


@pytest.mark.parametrize("width", [None, 4, 64])
def test_overlap_join_by_bins_equals_brute_force(spark, width):
    rnd = random.Random(5)
    span = lambda: (lambda s: (s, s + rnd.randint(1, 12)))(rnd.randint(0, 80))
    a = [(rnd.randint(0, 2), i, *span()) for i in range(60)]
    b = [(rnd.randint(0, 2), i, *span()) for i in range(60)]
    da = spark.createDataFrame(a, "k int, i int, s int, e int")
    db = spark.createDataFrame(b, "k int, j int, s2 int, e2 int")
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
    assert collect(overlap_join(da, db, ["k"], ("s", "e"), ("s2", "e2"), "inner", width), "i", "j") == want
    anti = overlap_join(da, db, ["k"], ("s", "e"), ("s2", "e2"), "left_anti", width, ["i"])
    assert collect(anti, "i") == sorted({(x[1],) for x in a} - {(i,) for i, _ in want})
    assert collect(stabbing(db, da, ["k"], ("s2", "e2"), ("s", "e"), width), "i", "j") == want


def _mentions(spark, rows):
    return spark.createDataFrame(rows, "sent_id bigint, entity bigint, rn int, st bigint, en bigint")


def test_statements_by_distance(spark):
    m = _mentions(spark, [(1, 10, 1, 0, 2), (1, 11, 2, 5, 6), (1, 12, 3, 45, 46), (1, 10, 4, 46, 47)])
    u = G.statements(m)
    assert collect(u, "h", "t") == [(10, 11), (11, 12), (12, 10)]
    assert G.both_ways(u).count() == 6


def test_statements_in_a_very_long_sentence_equal_brute_force(spark):
    rnd = random.Random(1)
    rows, at = [], 0
    for k in range(300):
        at += rnd.randint(0, 30)
        n = rnd.randint(1, 5)
        rows.append((1, rnd.randint(1, 40), k + 1, at, at + n))
        at += n
    want = sorted((a[1], b[1], a[3], b[3]) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[1] != b[1] and a[4] + 40 > b[3] and b[4] - a[3] <= 123)
    assert collect(G.statements(_mentions(spark, rows)), "h", "t", "hs", "ts") == want


def test_blocks_of_a_long_sentence(spark):
    df = spark.createDataFrame([(90, 105), (10, 25), (90, 106)], "s bigint, e bigint")
    a, b = window_around("s", "e", F.lit(0).cast("long"), F.lit(200).cast("long"), 123)
    assert [(r[0], r[1]) for r in df.select(a, b).collect()] == [(36, 159), (0, 123), (37, 159)]


def test_blocks_grow_over_whole_sentences(spark):
    from spanloom.operators import context as K

    sents = spark.createDataFrame([(0, 1, 10, 0), (1, 1, 20, 1), (2, 1, 1, 2), (3, 1, 30, 3), (4, 2, 50, 0), (5, 2, 60, 1), (6, 2, 40, 2)], "sent_id bigint, doc_id bigint, n_tokens bigint, day int")
    e = spark.createDataFrame([(1, 2, 1, 2, 4, 8, 10), (1, 2, 3, 2, 4, 8, 10), (1, 2, 5, 2, 4, 20, 30)], "h bigint, t bigint, sent_id bigint, hs bigint, he bigint, ts bigint, te bigint")
    got = {r.sent_id: (r.block_start, r.block_end) for r in K.grown_blocks(e, K.neighbour_sizes(sents, ["day"])).collect()}
    assert got == {1: (-10, 20), 3: (0, 30), 5: (-50, 60)}


def _grow(lefts, rights, n, lo, hi, limit=123):
    s, e, i, k = 0, n, 0, 0
    while True:
        left = i < len(lefts) and e - s + lefts[i] <= limit
        right = k < len(rights) and e - s + rights[k] <= limit
        if lo - s <= e - hi and left:
            s, i = s - lefts[i], i + 1
        elif right:
            e, k = e + rights[k], k + 1
        else:
            return s, e


def test_growth_equals_a_plain_loop(spark):
    from spanloom.operators import context as K

    rnd = random.Random(9)
    sents = [(d * 1000 + k, d, rnd.choice([1, 3, 5, 9, 14, 40]), k) for d in range(6) for k in range(150)]
    e = [(1, 2, s, 0, 1, n - 1, n) if rnd.random() < 0.5 else (1, 2, s, n // 2, n // 2 + 1, n - 1, n) for s, _, n, _ in sents if n > 3]
    df = spark.createDataFrame(e, "h bigint, t bigint, sent_id bigint, hs bigint, he bigint, ts bigint, te bigint")
    sizes = K.neighbour_sizes(spark.createDataFrame(sents, "sent_id bigint, doc_id bigint, n_tokens bigint, day int"), ["day"])
    got = {r.sent_id: (r.block_start, r.block_end) for r in K.grown_blocks(df, sizes).collect()}
    by = {d: [x for x in sents if x[1] == d] for d in range(6)}
    for _, _, s, hs, _, _, te in e:
        d, k = divmod(s, 1000)
        stop = lambda xs: next((xs[:i] for i, x in enumerate(xs) if x <= 1), xs)
        sizes_of = [x[2] for x in by[d]]
        assert got[s] == _grow(stop(sizes_of[:k][::-1]), stop(sizes_of[k + 1 :]), sizes_of[k], hs, te)


def test_capped_count(spark):
    e = spark.createDataFrame([(1, 2)] * 3 + [(1, 3)], "h bigint, t bigint")
    assert collect(G.capped_counts(e, 2), "h", "n_capped") == [(1, 3)]


def test_subset_pairs_equal_brute_force(spark):
    rnd = random.Random(2)
    und = {tuple(sorted(rnd.sample(range(12), 2))) for _ in range(22)}
    nb = {(a, b) for x in und for a, b in (x, x[::-1])}
    near = {a: {t for h, t in nb if h == a} for a, _ in nb}
    want = sorted((h, t) for h, t in nb if near[h] - {t} <= near[t] - {h})
    assert collect(G.subset_pairs(spark.createDataFrame(sorted(nb), "h bigint, t bigint")), "h", "t") == want and want


def test_cover_cost(spark):
    cases = [(3, 0, 1, False, 3, 4), (3, 2, 0, False, -1, 1), (0, 0, 0, False, 100_000_000, 100_000_000)]
    for total, both, single, present, literal, intended in cases:
        df = spark.createDataFrame([(total, both, single, present)], "total int, both int, single int, present boolean")
        args = (F.col("total"), F.col("both"), F.col("single"), F.col("present"), 1, 2)
        assert df.select(U.cover_cost(*args)).first()[0] == literal
        assert df.select(U.cover_cost(*args, "intended")).first()[0] == intended
    df = spark.createDataFrame([(3, 0, 1, True)], "total int, both int, single int, present boolean")
    assert df.select(U.cover_cost(F.col("total"), F.col("both"), F.col("single"), F.col("present"), 1, 2)).first()[0] == 4


def test_cover_marks_only_pairs_with_their_neighbours(spark):
    und = [(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 5)]
    e = spark.createDataFrame([(h, t, 10 * i) for i, p in enumerate(und) for h, t in (p, p[::-1])], "h bigint, t bigint, sent_id bigint")
    seeds = spark.createDataFrame([(7, 1, 2)], "seed bigint, h bigint, t bigint")
    rows = U.cover(seeds, G.neighbours(e), e, wanted=2).collect()
    got = {(r.h, r.t) for r in rows}
    assert {(1, 2), (1, 3), (2, 3), (1, 4), (2, 4)} == got
    assert next(r.covered for r in rows if (r.h, r.t) == (1, 2))
    assert len({r.sent_id for r in rows}) == len(rows)


def test_f1_reports(spark):
    p = spark.createDataFrame([(0, 0), (1, 2), (2, 2), (3, 4), (4, 4), (0, 1)], "target int, pred int")
    c = X.confusion(p, "target", "pred")
    ignored = F.col("label") == 4
    assert X.macro_f1(c, F.floor(F.col("label") / 2), ignored).first()[0] == pytest.approx(0.45)
    assert X.micro_f1(c, ignored).first()[0] == pytest.approx(4 / 9)
    assert X.accuracy(p, "target", "pred").first()["accuracy"] == pytest.approx(0.5)


def test_epoch_slices(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    slices = [{r.k for r in S.epoch_slice(df, ["k"], 4, e).collect()} for e in (1, 2, 3, 4)]
    assert [len(x) for x in slices] == [3, 3, 3, 3]
    assert len(slices[0] | slices[1] | slices[2]) == 9 and slices[3] != slices[0]


def test_length_clusters(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id int, n int")
    assert collect(X.length_bins(df, "n"), "id", "cluster") == [(1, 0), (2, 1), (3, 2)]


def test_masking(spark):
    df = spark.createDataFrame([(list("abcdef"), 1, 3, 3, 4)], "tokens array<string>, hs int, he int, ts int, te int")
    on = F.lit(True)
    assert df.select(M.start_end_masked(df, "tokens", ("hs", "he"), ("ts", "te"), on, on)).first()[0] == "a <s_head> <blank> <e_head> <s_tail> <blank> <e_tail> e f".split()
    text, h, t = M.concat_masked("tokens", ("hs", "he"), ("ts", "te"), on, on)
    assert list(df.select(text, h, t).first()) == ["a <blank> <blank> e f".split(), 1, 2]
    other = M.pieces("tokens", [("hs", "he", F.array(F.lit(M.BLANK))), ("ts", "te", F.array(F.lit(M.BLANK))), ("os", "oe", F.array(F.lit(M.BLANK_HEAD_OTHER)))])
    assert df.withColumns({"os": F.lit(5), "oe": F.lit(6)}).select(other).first()[0] == "a <blank> <blank> e <blank_head_other>".split()


def test_offsets_keep_the_spelling(spark):
    df = spark.createDataFrame([("x", "  Foo bar  ", 4)], "id string, surface string, offset int")
    text, offset = T.trim_shift("surface", "offset")
    assert list(df.select(text, offset).first()) == ["Foo bar", 6]
    d = spark.createDataFrame([("aa", "aaaa"), ("x", "abc"), ("", "abc"), ("abcd", "abc")], "n string, t string")
    assert [list(r[0]) for r in d.select(T.find_all("t", "n")).collect()] == [[0, 1, 2], [], [], []]


def test_simple_sentences_keep_offsets(spark):
    a = spark.createDataFrame([(1, "One. Two! x\nThree?  Four."), (2, None), (3, "")], "article_id int, text string")
    rows = P.simple_sentences(a).collect()
    assert [(r.s_start, r.s_end) for r in rows] == [(0, 4), (5, 9), (10, 11), (12, 18), (19, 25)]


def test_conservation_of_linker_mentions(spark):
    art = spark.createDataFrame([(1, "u/X", "abc def ghi", [("X", "abc", 0), ("Y", "ghi", 8)], [("X", "bc", 1), ("Y", "def", 4), ("Z", "def", 4)])], "article_id int, url string, text string, annotations array<struct<uri:string,surface_form:string,char_offset:int>>, el array<struct<uri:string,surface_form:string,char_offset:int>>")
    out = P.clean_mentions(art)
    assert collect(out, "layer", "uri", "start") == [("annotations", "X", 0), ("annotations", "Y", 8), ("el", "Y", 4)]


def test_ordered_ids_are_consecutive(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert collect(P.ordered_ids(df, [F.asc("k")], "n"), "n", "k") == [(i, i) for i in range(1000)]


def test_positives_pair_within_and_never_with_themselves(spark):
    e = spark.createDataFrame([(1, 2, s, 0, 1, 5, 6) for s in range(9)] + [(3, 4, 1, 0, 1, 2, 3)], "h bigint, t bigint, sent_id bigint, hs bigint, he bigint, ts bigint, te bigint")
    e = R.with_ids(e)
    pairs = collect(R.positives(e), "a_id", "b_id")
    assert len(pairs) == 9 and all(a != b for a, b in pairs) and len({b for _, b in pairs}) == 9


def test_strong_negatives_never_name_the_replaced(spark):
    rnd = random.Random(4)
    m = _mentions(spark, [(s, e, k + 1, 10 * k, 10 * k + 3) for s in range(40) for k, e in enumerate(rnd.sample(range(15), 4))])
    e = R.with_ids(G.both_ways(G.statements(m)))
    neg = R.strong_negatives(e, G.neighbours(e), m)
    a = e.select(F.col("id").alias("a_id"), F.col("h").alias("ah"), F.col("t").alias("old"))
    b = e.select(F.col("id").alias("b_id"), F.col("h").alias("bh"), F.col("sent_id").alias("bs"))
    full = neg.join(a, "a_id").join(b, "b_id")
    assert full.count() > 0 and full.where("ah <> bh").count() == 0
    assert full.join(m.select(F.col("sent_id").alias("bs"), F.col("entity").alias("old")).distinct(), ["bs", "old"], "left_semi").count() == 0


def test_top_k_equals_brute_force(spark):
    import numpy as np

    v = np.random.default_rng(0).normal(size=(50, 6)).round(3)
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "i_id bigint, i_vec array<double>").repartition(5)
    q = spark.createDataFrame([(i, v[i].tolist()) for i in (0, 20, 40)], "q_id bigint, q_vec array<double>")
    want = sorted((i, int(j), r) for i in (0, 20, 40) for r, j in enumerate(sorted(range(50), key=lambda j: (-round(float(v[i] @ v[j]), 9), j))[:7]))
    assert collect(C.top_k_dot(q, items, 7, block=2), "q_id", "i_id", "rank") == want
    assert C.top_k_dot(q.limit(0), items, 7).count() == 0


def test_vector_algebra(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0], [1.0, 0.5])], "a array<double>, b array<double>, m array<double>")
    r = df.select(V.dot("a", "b"), V.distmult("a", "b", "m"), V.rotation_gap("a", "b", "m"), V.cross_entropy("a", F.lit(1)), V.bce_with_logits(F.lit(0.0), F.lit(1.0))).first()
    assert r[0] == 11 and r[1] == pytest.approx(7 / 2**0.5) and r[2] == pytest.approx((4 + 9) / 2**0.5)
    assert r[3] == pytest.approx(0.3132616875) and r[4] == pytest.approx(0.6931471806)


def test_beam_assigns_no_candidate_twice(spark):
    s = spark.createDataFrame([(1, p, c, x) for p, c, x in [(0, 10, 0.9), (0, 11, 0.8), (1, 10, 0.9), (1, 11, 0.1)]], "question bigint, place int, candidate bigint, score double")
    assert collect(U.beam_assign(s, 4), "place", "candidate") == [(0, 11), (1, 10)]


def test_batches_stay_within_their_limits(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 37 % 90 + 1).alias("n"))
    b = S.token_batches(df, "k", "n", 400, 16, shards=3)
    assert b.count() == 500
    worst = b.join(df, "k").groupBy("shard", "batch").agg((F.max("n") * F.count("*")).alias("padded"), F.count("*").alias("rows")).agg(F.max("padded"), F.max("rows")).first()
    assert worst[0] <= 400 and worst[1] <= 16


def test_empty_tables(spark):
    m = _mentions(spark, [])
    e = R.with_ids(G.both_ways(G.statements(m)))
    for df in (G.degrees(e), G.capped_sample(e, 1), R.positives(e), G.triplets(m), S.epoch_slice(m, ["rn"], 5, 1), P.ordered_ids(m, [F.asc("rn")], "n")):
        assert df.count() == 0


def test_spaces_around_mentions(spark):
    a = spark.createDataFrame([(1, "abcdef gh"), (2, "xy"), (3, None)], "article_id int, text string")
    m = spark.createDataFrame([(1, 2, 4), (1, 7, 9), (2, 0, 2)], "article_id int, start bigint, end bigint")
    assert {r.article_id: r.spaced for r in P.spaced_mentions(a, m).collect()} == {1: "ab cd ef gh", 2: "xy", 3: None}


def test_waterfall_passes_on_what_is_lacking(spark):
    c = spark.createDataFrame([(1, 2, 10, 0), *[(1, 2, 20 + i, 1) for i in range(9)], *[(3, 4, 30 + i, 2) for i in range(9)]], "h bigint, t bigint, c bigint, kind int")
    got = R.negatives_waterfall(c, [2, 2, 1]).groupBy("h", "kind").count().collect()
    assert sorted((r.h, r.kind, r["count"]) for r in got) == [(1, 0, 1), (1, 1, 3), (3, 2, 5)]


def test_ranked_and_logistic_grid(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(120, 3))
    df = spark.createDataFrame([(v.tolist(), int(v[0] > 0)) for v in x], "f array<double>, y int")
    assert min(r.accuracy for r in C.logistic_grid(df, "f", "y", [10.0, 100.0], folds=2).collect()) > 0.85
