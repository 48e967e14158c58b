"""Further queries: growing blocks, usage caps, batch negatives, heads and criteria."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.functions import vectors as V
from spanloom.operators import context as K
from spanloom.operators import graph as G
from spanloom.operators import masking as M
from spanloom.operators import metrics as X
from spanloom.operators import pairs as R
from spanloom.operators import prep as P
from spanloom.operators import sampling as S
from spanloom.operators import scoring as C
from spanloom.operators import wedges as W
from spanloom.plans.fixtures import m_sql, mentions, sentences
from spanloom.plans.graph import SUPP, edges, first_pairs
from spanloom.plans.registry import query
from spanloom.plans.reports import _P, _preds
from spanloom.plans.samples import _BATCHES, _E, _WEAK, RING_SQL
from spanloom.runtime import hkey, table, u01


def _u(*xs: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(xs)})), 1, 8))::bigint / 4294967296.0)"


@query("graph_grown_blocks")
def grown_blocks(spark, sf_dir):
    """Statements with blocks grown over the customer's neighbouring orders."""
    sizes = K.neighbour_sizes(sentences(spark, sf_dir), ["day"])
    return K.grown_blocks(edges(spark, sf_dir), sizes)


@query("graph_pair_usage_cap", m_sql(SUPP) + ", c as (select h, t, count(*) as n from e group by h, t), a as (select sum(n) * 1.0 / count(distinct h) as mean from c) select h, t, n, n > 0.02 * mean as over_cap from c, a")
def pair_usage_cap(spark, sf_dir):
    """Uses of each pair against a multiple of the mean use per entity."""
    c = G.pair_counts(edges(spark, sf_dir, SUPP))
    mean = c.agg((F.sum("n") / F.count_distinct("h")).alias("mean"))
    return c.crossJoin(F.broadcast(mean)).select("h", "t", "n", (F.col("n") > 0.02 * F.col("mean")).alias("over_cap"))


@query("graph_edges_of_pairs", m_sql() + ", p as (select h, min(t) as t from e group by h) select e.* from e join p using (h, t)")
def edges_of_pairs(spark, sf_dir):
    e = edges(spark, sf_dir)
    return e.join(first_pairs(G.neighbours(e)), ["h", "t"], "left_semi")


@query("graph_mutual_of_three", m_sql() + ", n1 as (select distinct h, t from e), w as (select p.h, p.t, a.t as c from n1 p join n1 a on a.h = p.h join n1 b on b.h = p.t and b.t = a.t) select w.h, w.t, w.c, count(*) as n from w join n1 x on x.h = w.c join w w2 on w2.h = w.h and w2.t = w.t and w2.c = x.t group by 1, 2, 3")
def mutual_of_three(spark, sf_dir):
    """For each common neighbour of every pair: how many entities are next to all three. Four entities next to each other are found once and count for
    each of their triangles."""
    four = G.four_cliques(G.neighbours(edges(spark, sf_dir)))
    threes = F.array(*(F.struct(F.col(x).alias("h"), F.col(y).alias("t"), F.col(z).alias("c")) for x, y, z in permutations("abcd", 3)))
    return four.select(F.explode(threes).alias("w")).groupBy("w.h", "w.t", "w.c").agg(F.count("*").alias("n"))


@query("sample_length_chunks", "with o as (select example_id, row_number() over (order by len(tokens), example_id) - 1 as rn from tacred_examples where tokens is not null), n as (select count(*) as n from o) select example_id, rn, rn // ceil(n / 7.0)::bigint as chunk from o, n")
def length_chunks(spark, sf_dir):
    """Rows by length, in seven chunks of one size."""
    d = table(spark, sf_dir, "tacred_examples").where("tokens is not null").select("example_id", F.size("tokens").alias("n"))
    o = P.ordered_ids(d, [F.asc("n"), F.asc("example_id")], "rn")
    total = d.agg(F.ceil(F.count("*") / 7).alias("each"))
    return o.crossJoin(F.broadcast(total)).select("example_id", "rn", F.floor(F.col("rn") / F.col("each")).alias("chunk"))


@query("sample_batch_statistics", _BATCHES + ", p as (select sum(n) as words, count(*) as rows, max(n) * count(*) as padded from r group by shard, batch) select count(*) as batches, round(avg(words), 6) as words_per_batch, round(avg(rows), 6) as rows_per_batch, max(padded) as largest from p")
def batch_statistics(spark, sf_dir):
    """Words and rows per batch of the token-bounded batches."""
    d = table(spark, sf_dir, "tacred_examples").where("tokens is not null").select("example_id", F.size("tokens").alias("n"))
    b = S.token_batches(d, "example_id", "n", 2000, 64).join(d, "example_id")
    per = b.groupBy("shard", "batch").agg(F.sum("n").alias("words"), F.count("*").alias("rows"), (F.max("n") * F.count("*")).alias("padded"))
    return per.agg(F.count("*").alias("batches"), F.round(F.avg("words"), 6).alias("words_per_batch"), F.round(F.avg("rows"), 6).alias("rows_per_batch"), F.max("padded").alias("largest"))


@query("pair_bernoulli_roles", m_sql(SUPP) + f", x as (select *, md5(concat_ws('|', h, t, sent_id, hs, ts)) as id from e) select id, case when {_u(chr(39) + 'role' + chr(39), 'id')} < 0.3 then 'same_pair' else 'one_shared' end as role from x")
def bernoulli_roles(spark, sf_dir):
    """Which kind of positive each statement is to get."""
    e = R.with_ids(edges(spark, sf_dir, SUPP))
    return e.select("id", F.when(u01(F.lit("role"), "id") < 0.3, "same_pair").otherwise("one_shared").alias("role"))


@query("pair_filtered_weak_negatives", _E + _WEAK + """, j as (select wk.a_id, wk.b_id, (a.h in (b.h, b.t) or a.t in (b.h, b.t)) as bad from wk join x a on a.id = wk.a_id join x b on b.id = wk.b_id where rank < 6)
 select a_id, coalesce(list_sort(list(b_id) filter (not bad)), []) as negatives, count(*) filter (bad) as bad from j group by a_id""")  # fmt: skip
def filtered_weak(spark, sf_dir):
    """Weak negatives that share no entity with the statement, and how many were left out for sharing one."""
    e = R.with_ids(edges(spark, sf_dir, SUPP))
    weak = R.weak_negatives(R.positives(e, ends=True), 64, 6)
    a = e.select(F.col("id").alias("a_id"), F.col("h").alias("ah"), F.col("t").alias("at"))
    b = e.select(F.col("id").alias("b_id"), F.col("h").alias("bh"), F.col("t").alias("bt"))
    j = weak.join(a, "a_id").join(b, "b_id").withColumn("bad", (F.col("ah").isin(F.col("bh"), F.col("bt"))) | (F.col("at").isin(F.col("bh"), F.col("bt"))))
    return j.groupBy("a_id").agg(F.sort_array(F.collect_list(F.when(~F.col("bad"), F.col("b_id")))).alias("negatives"), F.count_if("bad").alias("bad"))


@query("pair_in_batch_targets", f"with b as (select example_id, floor({_u('1', 'example_id')} * 16)::int as batch from tacred_examples where tokens is not null) select example_id, batch, row_number() over (partition by batch order by example_id) - 1 as target, count(*) over (partition by batch) - 1 as negatives from b")
def in_batch_targets(spark, sf_dir):
    """Sentence targets within a batch: its own place is right, all others are negatives."""
    d = table(spark, sf_dir, "tacred_examples").where("tokens is not null").select("example_id", F.floor(u01(F.lit(1), "example_id") * 16).cast("int").alias("batch"))
    w = Window.partitionBy("batch")
    return d.select("example_id", "batch", (F.row_number().over(w.orderBy("example_id")) - 1).alias("target"), (F.count("*").over(w) - 1).alias("negatives"))


@query("answer_replaced_mentions", f"""with r as (select l_orderkey as sent_id, entity, rn, count(*) over (partition by l_orderkey) as n from (select l_orderkey, l_partkey as entity, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as rn from lineitem)),
 p as (select count(*) as parts from part) select sent_id, rn, entity, case when rn = 1 + floor({_u("'pick'", 'sent_id')} * n)::bigint then 1 + floor({_u("'new'", 'sent_id')} * parts)::bigint else entity end as shown from r, p""")  # fmt: skip
def replaced_mentions(spark, sf_dir):
    """One mention of every passage shows another entity."""
    m = mentions(spark, sf_dir)
    n = m.groupBy("sent_id").agg(F.count("*").alias("n"))
    parts = table(spark, sf_dir, "part").agg(F.count("*").alias("parts"))
    j = m.join(n, "sent_id").crossJoin(F.broadcast(parts))
    hit = F.col("rn") == 1 + F.floor(u01(F.lit("pick"), "sent_id") * F.col("n"))
    return j.select("sent_id", "rn", "entity", F.when(hit, 1 + F.floor(u01(F.lit("new"), "sent_id") * F.col("parts"))).otherwise(F.col("entity")).alias("shown"))


@query("answer_masked_questions", "select example_id, tokens || ['<mask>'] as tokens, len(tokens) as mask_at from fewrel_examples where tokens is not null")
def masked_questions(spark, sf_dir):
    d = table(spark, sf_dir, "fewrel_examples").where("tokens is not null")
    return d.select("example_id", F.concat("tokens", F.array(F.lit("<mask>"))).alias("tokens"), F.size("tokens").alias("mask_at"))


_LIN = " + ".join(f"coalesce(embedding[{i + 1}], 0) * ({_u(chr(39) + 'lin' + chr(39), str(i))} - 0.5)" for i in range(64))


@query("score_linear_head", f"select vec_id, round({_LIN}, 6) as logit, (1 / (1 + exp(-({_LIN}))) >= 0.5) as positive from (select vec_id, embedding::double[] as embedding from embeddings)")
def linear_head(spark, sf_dir):
    """A linear classifier with given weights, as one expression."""
    w = F.array(*[u01(F.lit("lin"), F.lit(i)) - 0.5 for i in range(64)])
    d = table(spark, sf_dir, "embeddings").select("vec_id", V.dot("embedding", w).alias("x"))
    return d.select("vec_id", F.round("x", 6).alias("logit"), (V.sigmoid("x") >= 0.5).alias("positive"))


@query("score_pair_dots", m_sql(SUPP) + """, x as (select *, md5(concat_ws('|', h, t, sent_id, hs, ts)) as id from e), r as (select id as a_id, coalesce(lead(id) over w, first_value(id) over w) as b_id from x window w as (partition by h, t order by md5(concat_ws('|', 1, id)), id)),
 nv as (select count(*) as n from embeddings), xv as (select id, embedding::double[] as v from (select id, sent_id % n as vec_id from x, nv) join embeddings using (vec_id))
 select a_id, b_id, round(list_dot_product(a.v, b.v), 6) as score from r join xv a on a.id = a_id join xv b on b.id = b_id where a_id <> b_id""")  # fmt: skip
def pair_dots(spark, sf_dir):
    """Dot products of statement pairs, each statement with the vector of its sentence."""
    e = R.with_ids(edges(spark, sf_dir, SUPP))
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = v.agg(F.count("*").alias("n"))
    s = e.select("id", "sent_id").crossJoin(F.broadcast(n)).select("id", (F.col("sent_id") % F.col("n")).alias("k"))
    side = lambda x: s.select(F.col("id").alias(f"{x}_id"), F.col("k").alias(f"{x}k"))
    j = R.positives(e).join(side("a"), "a_id").join(side("b"), "b_id")
    j = C.gather(C.gather(j, v, "ak", "av"), v, "bk", "bv")
    return j.select("a_id", "b_id", F.round(V.dot("av", "bv"), 6).alias("score"))


@query("score_pooled_words", "with t as (select example_id, unnest(tokens) as tok from fewrel_examples where tokens is not null), n as (select count(*) as n from embeddings), w as (select example_id, ('0x' || substr(md5(tok), 1, 8))::bigint % n as k from t, n where tok is not null and tok not in ('<head>', '<tail>', '<blank>', '.', ',')), v as (select vec_id, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as d from embeddings), g as (select example_id, d, avg(x) as x from w join v on v.vec_id = w.k group by example_id, d) select example_id, (d - 1)::int as dim, x from g")
def pooled_words(spark, sf_dir):
    """Mean vector of the words of a sentence, markers and stops left out; a word has the vector of its hash."""
    d = table(spark, sf_dir, "fewrel_examples").where("tokens is not null").select("example_id", F.explode("tokens").alias("tok"))
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = v.agg(F.count("*").alias("n"))
    d = d.where(F.col("tok").isNotNull() & ~F.col("tok").isin("<head>", "<tail>", "<blank>", ".", ",")).crossJoin(F.broadcast(n))
    d = d.select("example_id", (F.conv(F.substring(F.md5("tok"), 1, 8), 16, 10).cast("bigint") % F.col("n")).alias("k"))
    return C.vector_mean(C.gather(d, v, "k", "v"), ["example_id"], "v", 64).select("example_id", F.posexplode("mean").alias("dim", "x"))


@query("report_multi_criterion", f"with {_P}, s as (select split, sum(-ln(greatest(p, 1e-12))) as loss, count(*) as n from p group by split) select round(sum(loss / n * case split when 'train' then 1.0 when 'dev' then 0.5 else 0.25 end), 6) as loss, round(coalesce(sum(loss / n) filter (split = 'dev'), 0), 6) as dev_loss, round(coalesce(sum(loss / n) filter (split = 'none'), 0), 6) as none_loss from s")
def multi_criterion(spark, sf_dir):
    """Weighted sum of criteria, each by its sample size; 0 for one that is missing."""
    s = _preds(spark, sf_dir).groupBy("split").agg(F.sum(-F.ln(F.greatest("p", F.lit(1e-12)))).alias("loss"), F.count("*").alias("n"))
    each = F.col("loss") / F.col("n")
    w = F.when(F.col("split") == "train", 1.0).when(F.col("split") == "dev", 0.5).otherwise(0.25)
    part = lambda name: F.round(F.coalesce(F.sum(F.when(F.col("split") == name, each)), F.lit(0.0)), 6)
    return s.agg(F.round(F.sum(each * w), 6).alias("loss"), part("dev").alias("dev_loss"), part("none").alias("none_loss"))


@query("report_best_setting", f"with c as (select example_id, pow(2, c)::double as c, {_u(chr(39) + 'cv' + chr(39), 'example_id', 'c')} as score from tacred_examples, (select unnest(range(0, 6)) as c)), g as (select c, avg(score) as s from c group by c) select c, round(s, 9) as mean_score, row_number() over (order by round(s, 9) desc, c) = 1 as best from g")
def best_setting(spark, sf_dir):
    """Mean over folds per setting; the first of the best wins. A row a setting."""
    d = table(spark, sf_dir, "tacred_examples").select("example_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("c"))
    g = d.groupBy("c").agg(F.round(F.avg(u01(F.lit("cv"), "example_id", "c")), 9).alias("mean_score")).withColumn("c", F.pow(F.lit(2.0), "c"))
    return g.withColumn("best", F.row_number().over(Window.orderBy(F.desc("mean_score"), "c")) == 1)


@query("report_stat_keys", f"""with {_P}, s as (select split, count(*)::double as n, avg((target = pred)::int) as a, avg(-ln(greatest(p, 1e-12))) as l from p group by split),
 k as (select split || '_rows' as key, n as value from s union all select split || '_acc', a from s union all select split || '_loss', l from s) select key, round(value, 9) as value from k where regexp_matches(key, 'acc|f1')""")  # fmt: skip
def stat_keys(spark, sf_dir):
    """Of all statistics by split, those whose key names an accuracy or an F1."""
    s = _preds(spark, sf_dir).groupBy("split").agg(F.count("*").cast("double").alias("rows"), F.avg((F.col("target") == F.col("pred")).cast("int")).alias("acc"), F.avg(-F.ln(F.greatest("p", F.lit(1e-12)))).alias("loss"))
    long = F.array(*[F.struct(F.concat_ws("_", "split", F.lit(c)).alias("key"), F.col(c).alias("value")) for c in ("rows", "acc", "loss")])
    return s.select(F.explode(long).alias("k")).select("k.key", F.round("k.value", 9).alias("value")).where(F.col("key").rlike("acc|f1"))


@query("text_single_entity_masked", "with s as (select example_id, tokens, h.positions[1] as p from fewrel_examples where tokens is not null and len(h.positions) > 0) select example_id, array_to_string(list_transform(tokens[1:p[1]] || ['<blank>'] || tokens[p[len(p)] + 2:len(tokens)], lambda x: coalesce(x, '~')), ' ') as masked, p[1] as at from s")
def single_masked(spark, sf_dir):
    """The head's first mention as one blank, and where it stands."""
    d = table(spark, sf_dir, "fewrel_examples").where("tokens is not null and size(h.positions) > 0").withColumn("p", F.element_at("h.positions", 1))
    d = d.select("example_id", "tokens", F.array_min("p").alias("s"), (F.array_max("p") + 1).alias("e"))
    out = M.pieces("tokens", [("s", "e", F.array(F.lit(M.BLANK)))])
    return d.select("example_id", F.array_join(F.transform(out, lambda x: F.coalesce(x, F.lit("~"))), " ").alias("masked"), F.col("s").alias("at"))


@query("text_one_mention_per_entity", "select article_id, uri, mention_id from (select article_id, uri, mention_id, row_number() over (partition by article_id, uri order by md5(concat_ws('|', 1, mention_id)), mention_id) as r from (select distinct article_id, uri, mention_id from wiki_mentions where uri is not null)) where r = 1")
def one_mention(spark, sf_dir):
    """A mention of each entity of an article: the least by pseudo-random key, combined before the shuffle."""
    m = table(spark, sf_dir, "wiki_mentions").where("uri is not null")
    return m.groupBy("article_id", "uri").agg(F.min_by("mention_id", F.struct(hkey(F.lit(1), "mention_id"), "mention_id")).alias("mention_id"))


@query("report_log_losses_by_rank", f"with {_P} select split, example_id, row_number() over (partition by split order by p desc, example_id) - 1 as rank from p")
def ranks_by_split(spark, sf_dir):
    return X.ranked(_preds(spark, sf_dir), "p", ["example_id"], ["split"]).select("split", "example_id", "rank")


_WF = RING_SQL + f""",
 n as (select h, t, count(*) filter (kind = 0) as n0, count(*) filter (kind = 1) as n1, count(*) filter (kind = 2) as n2 from c group by h, t),
 al as (select q.h, q.t, coalesce(n0, 0) as n0, coalesce(n.n1, 0) as nt, coalesce(n2, 0) as n2 from n1 q left join n using (h, t)),
 k as (select h, t, least(n0, 6) as k0, least(nt, 6 - least(n0, 6) + 3) as k1, n2 from al), k2 as (select h, t, k0, k1, least(n2, 9 - k0 - k1 + 3) as k2 from k),
 r as (select *, row_number() over (partition by h, t, kind order by step) as place from c), parts as (select count(*) as parts from part)
 select h, t, c, kind, place::int as place from r join k2 using (h, t) where place <= case kind when 0 then k0 when 1 then k1 else k2 end
 union all select h, t, floor({_u("'any'", '1', 'h', 't', 'place')} * parts)::bigint, 3, place::int from (select h, t, unnest(range(1, 15 - k0 - k1 - k2)) as place from k2), parts"""


@query("pair_waterfall_negatives", _WF)
def waterfall(spark, sf_dir):
    """For every pair six common neighbours, three of the tail's own, three of the head's own, two of any; what a kind lacks goes to the next."""
    return W.waterfall(edges(spark, sf_dir), [6, 3, 3, 2], n_entities=table(spark, sf_dir, "part").count())


@query("score_gated_sum", m_sql() + """, n1 as (select distinct h, t from e), nv as (select count(*) as n from embeddings), ev as (select vec_id, embedding::double[] as v from embeddings), s as (select n1.h, b.v as v, 1 / (1 + exp(-list_dot_product(a.v, b.v))) as w from n1 join nv on true join ev a on a.vec_id = n1.h % n join ev b on b.vec_id = n1.t % n),
 uu as (select h, unnest(v) as x, generate_subscripts(v, 1) as d, w from s), g as (select h, d, sum(x * w) as x from uu group by h, d) select h, (d - 1)::int as dim, x from g""")  # fmt: skip
def gated_sum(spark, sf_dir):
    """Neighbour vectors summed with the sigmoid of their score as a gate."""
    from spanloom.plans.scores import _pair_scores

    p, look_up = _pair_scores(spark, sf_dir)
    return C.vector_sum(look_up(p), ["h"], "tv", 64, V.sigmoid("x")).select("h", F.posexplode("total").alias("dim", "x"))


@query("score_passage_compatibility", m_sql() + ", nv as (select count(*) as n from embeddings), v as (select sent_id, rn, embedding::double[] as v from (select sent_id, rn, entity % n as vec_id from m, nv) join embeddings using (vec_id)) select a.sent_id, round(sum(list_dot_product(a.v, b.v)) / (2.0 * 64 * count(*)), 6) as score from v a join v b on a.sent_id = b.sent_id group by a.sent_id")
def passage_compatibility(spark, sf_dir):
    """Mean compatibility of all ordered mention pairs of a passage: the square of its summed vectors, so no pair is formed."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = v.agg(F.count("*").alias("n"))
    m = mentions(spark, sf_dir).crossJoin(F.broadcast(n)).select("sent_id", (F.col("entity") % F.col("n")).alias("k"))
    g = C.gather(m, v, "k", "v")
    sums = C.vector_sum(g, ["sent_id"], "v", 64).join(m.groupBy("sent_id").agg(F.count("*").alias("n")), "sent_id")
    return sums.select("sent_id", F.round(V.dot("total", "total") / (2.0 * 64 * F.col("n") * F.col("n")), 6).alias("score"))


@query("score_entity_start_pooling", """with s as (select example_id, ('0x' || substr(md5(coalesce(tokens[subj_start + 1], '~')), 1, 8))::bigint as a, ('0x' || substr(md5(coalesce(tokens[obj_start + 1], '~')), 1, 8))::bigint as b from tacred_examples where tokens is not null and subj_start is not null and obj_start is not null), n as (select count(*) as n from embeddings)
 select example_id, list_transform(p.embedding::double[] || q.embedding::double[], lambda x: round(x, 6)) as pooled from s join n on true join embeddings p on p.vec_id = a % n join embeddings q on q.vec_id = b % n""")  # fmt: skip
def entity_start_pooling(spark, sf_dir):
    """Vectors of both entity starts side by side; a word has the vector of its hash."""
    d = table(spark, sf_dir, "tacred_examples").where("tokens is not null and subj_start is not null and obj_start is not null")
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = v.agg(F.count("*").alias("n"))
    key = lambda p: F.conv(F.substring(F.md5(F.coalesce(F.get("tokens", F.col(p)), F.lit("~"))), 1, 8), 16, 10).cast("bigint") % F.col("n")
    j = d.crossJoin(F.broadcast(n)).select("example_id", key("subj_start").alias("a"), key("obj_start").alias("b"))
    j = C.gather(C.gather(j, v, "a", "av"), v, "b", "bv")
    pooled = C.at_positions(F.array("av", "bv"), F.lit(0), F.lit(1))
    return j.select("example_id", F.transform(pooled.cast("array<double>"), lambda x: F.round(x, 6)).alias("pooled"))


@query("report_logistic_grid")
def logistic_grid(spark, sf_dir):
    return C.logistic_grid(table(spark, sf_dir, "embeddings"), "embedding", "label", [0.1, 10.0], folds=2, iterations=15)


@query("corpus_spaced_texts")
def spaced_texts(spark, sf_dir):
    a = table(spark, sf_dir, "wiki_articles")
    return P.spaced_mentions(a, P.clean_mentions(a).where("layer = 'annotations'").select("article_id", "start", "end"))
