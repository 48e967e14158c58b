"""Queries of score algebra over the embeddings table; entities take the vector of their id modulo the number of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import vectors as V
from spanloom.operators import graph as G
from spanloom.operators import scoring as C
from spanloom.plans.fixtures import m_sql
from spanloom.plans.graph import edges
from spanloom.plans.registry import query
from spanloom.runtime import table


def _vec(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _triples(spark, sf_dir):
    """(h, t, hv, tv, mv): every pair of neighbours, with a relation vector by their sum."""
    v = _vec(spark, sf_dir).select("vec_id", "embedding")
    n = _vec(spark, sf_dir).agg(F.count("*").alias("n"))
    p = G.neighbours(edges(spark, sf_dir)).crossJoin(F.broadcast(n))
    p = p.select("h", "t", (F.col("h") % F.col("n")).alias("hi"), (F.col("t") % F.col("n")).alias("ti"), ((F.col("h") + F.col("t")) % F.col("n")).alias("mi"))
    for k, out in (("hi", "hv"), ("ti", "tv"), ("mi", "mv")):
        p = C.gather(p, v, k, out)
    return p.select("h", "t", "hv", "tv", "mv")


_T = m_sql() + """, n1 as (select distinct h, t from e), nv as (select count(*) as n from embeddings), ev as (select vec_id, embedding::double[] as v from embeddings),
tr as (select n1.h, n1.t, a.v as hv, b.v as tv, c.v as mv from n1, nv, ev a, ev b, ev c where a.vec_id = n1.h % n and b.vec_id = n1.t % n and c.vec_id = (n1.h + n1.t) % n)"""


@query("score_distmult", _T + " select h, t, round(list_sum(list_transform(range(1, len(mv) + 1), lambda i: hv[i] * tv[i] * mv[i])) / sqrt(len(mv)), 6) as score from tr")
def distmult(spark, sf_dir):
    return _triples(spark, sf_dir).select("h", "t", F.round(V.distmult("hv", "tv", "mv"), 6).alias("score"))


@query("score_rotation", _T + " select h, t, round(list_sum(list_transform(range(1, len(mv) + 1), lambda i: (mv[i] * hv[i] - tv[i]) * (mv[i] * hv[i] - tv[i]))) / sqrt(len(mv)), 6) as score from tr")
def rotation(spark, sf_dir):
    return _triples(spark, sf_dir).select("h", "t", F.round(V.rotation_gap("hv", "tv", "mv"), 6).alias("score"))


@query("score_entity_dot", _T + " select h, t, round(list_dot_product(hv, tv), 6) as score, round(list_dot_product(hv || tv, mv || mv), 6) as joined from tr")
def entity_dot(spark, sf_dir):
    t = _triples(spark, sf_dir)
    return t.select("h", "t", F.round(V.dot("hv", "tv"), 6).alias("score"), F.round(V.dot(F.concat("hv", "tv"), F.concat("mv", "mv")), 6).alias("joined"))


@query("score_dual_side", _T + " select h, t, case when h < t then 'head' else 'tail' end as side, round(case when h < t then list_dot_product(hv, mv) else list_dot_product(tv, mv) end, 6) as score from tr")
def dual_side(spark, sf_dir):
    t = _triples(spark, sf_dir)
    head = F.col("h") < F.col("t")
    return t.select("h", "t", F.when(head, "head").otherwise("tail").alias("side"), F.round(F.when(head, V.dot("hv", "mv")).otherwise(V.dot("tv", "mv")), 6).alias("score"))


_P = "pr as (select label, d, avg(x) as m from (select label, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as d from embeddings) group by label, d), pv as (select label, list(m order by d) as m from pr group by label)"


@query("score_prototypes", f"with {_P} select label, (d - 1)::int as dim, m as x from pr")
def prototypes(spark, sf_dir):
    return C.vector_mean(_vec(spark, sf_dir), ["label"], "embedding", 64).select("label", F.posexplode("mean").alias("dim", "x"))


@query("score_few_shot_classes", f"with {_P}, s as (select vec_id, pv.label, round(list_dot_product(embedding::double[], m), 6) as score from embeddings, pv) select vec_id, arg_min(label, (-score, label)) as label, max(score) as score from s group by vec_id")
def few_shot_classes(spark, sf_dir):
    """The class whose prototype is closest by dot product. Prototypes are a row a class."""
    proto = C.vector_mean(_vec(spark, sf_dir), ["label"], "embedding", 64)
    s = _vec(spark, sf_dir).select("vec_id", "embedding").crossJoin(F.broadcast(proto)).select("vec_id", "label", F.round(V.dot("embedding", "mean"), 6).alias("score"))
    return C.argmax_class(s, ["vec_id"], "label", "score")


@query("score_class_cross_entropy", f"with {_P}, s as (select e.vec_id, e.label as target, pv.label as label, list_dot_product(e.embedding::double[], m) as x from embeddings e, pv) select vec_id, round(ln(sum(exp(x))) - max(x) filter (label = target), 6) as loss from s group by vec_id")
def class_cross_entropy(spark, sf_dir):
    proto = C.vector_mean(_vec(spark, sf_dir), ["label"], "embedding", 64).agg(F.sort_array(F.collect_list(F.struct("label", "mean"))).alias("ps"))
    logits = F.transform("ps", lambda p: V.dot("embedding", p["mean"]))
    return _vec(spark, sf_dir).crossJoin(F.broadcast(proto)).withColumn("z", logits).select("vec_id", F.round(V.cross_entropy("z", "label"), 6).alias("loss"))


@query("score_top_entities", """with q as (select vec_id, embedding::double[] as v from embeddings where vec_id % 20 = 0), s as (select q.vec_id as q_id, e.vec_id as i_id, round(list_dot_product(q.v, e.embedding::double[]), 6) as score from q, embeddings e)
 select q_id, i_id, score, rank from (select *, row_number() over (partition by q_id order by score desc, i_id) - 1 as rank from s) where rank < 10""")  # fmt: skip
def top_entities(spark, sf_dir):
    """Every id divisible by 20 is a query, against all rows."""
    v = _vec(spark, sf_dir)
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"))
    return C.top_k_dot(q, v.select(F.col("vec_id").alias("i_id"), F.col("embedding").alias("i_vec")), 10).select("q_id", "i_id", F.round("score", 6).alias("score"), "rank")


_NB = m_sql() + ", n1 as (select distinct h, t from e), nv as (select count(*) as n from embeddings), ev as (select vec_id, embedding::double[] as v from embeddings), "


@query("score_segment_softmax", _NB + "s as (select n1.h, n1.t, list_dot_product(a.v, b.v) as x from n1, nv, ev a, ev b where a.vec_id = n1.h % n and b.vec_id = n1.t % n), z as (select h, max(x) as m from s group by h), y as (select s.h, s.t, exp(x - m) as w from s join z using (h)) select h, t, round(w / sum(w) over (partition by h), 6) as weight from y")
def segment_softmax(spark, sf_dir):
    return C.segment_softmax(_pair_scores(spark, sf_dir)[0], ["h"], "x").select("h", "t", F.round("weight", 6).alias("weight"))


def _pair_scores(spark, sf_dir):
    """Pairs (h, t, ti, x) by head, with the product of their vectors, and the function that adds the tail's vector as tv."""
    v = _vec(spark, sf_dir).select("vec_id", "embedding")
    n = v.agg(F.count("*").alias("n"))
    v = C.sized(v)
    p = G.neighbours_by_head(edges(spark, sf_dir)).crossJoin(F.broadcast(n)).select("h", "t", (F.col("h") % F.col("n")).alias("hi"), (F.col("t") % F.col("n")).alias("ti"))
    p = C.gather(C.gather(p, v, "hi", "hv"), v, "ti", "tv")
    return p.select("h", "t", "ti", V.dot("hv", "tv").alias("x")), lambda d: C.gather(d, v, "ti", "tv")


@query("score_segment_sums", _NB + """s as (select n1.h, unnest(b.v) as x, generate_subscripts(b.v, 1) as d from n1, nv, ev b where b.vec_id = n1.t % n) select h, (d - 1)::int as dim, sum(x) as x from s group by h, d""")
def segment_sums(spark, sf_dir):
    """Sum of neighbour vectors per entity: a message-passing step."""
    v = _vec(spark, sf_dir).select("vec_id", "embedding")
    n = v.agg(F.count("*").alias("n"))
    p = C.gather(G.neighbours_by_head(edges(spark, sf_dir)).crossJoin(F.broadcast(n)).select("h", (F.col("t") % F.col("n")).alias("ti")), C.sized(v), "ti", "tv")
    return C.vector_sum(p, ["h"], "tv", 64).select("h", F.posexplode("total").alias("dim", "x"))


@query("score_attention_layer", _NB + """s as (select n1.h, n1.t, b.v as v, list_dot_product(a.v, b.v) as x from n1, nv, ev a, ev b where a.vec_id = n1.h % n and b.vec_id = n1.t % n), z as (select h, max(x) as m from s group by h),
 w as (select s.h, v, exp(x - m) as w from s join z using (h)), w2 as (select h, v, w / sum(w) over (partition by h) as w from w), uu as (select h, unnest(v) as x, generate_subscripts(v, 1) as d, w from w2), g as (select h, d, sum(x * w) as x from uu group by h, d)
 select h, (d - 1)::int as dim, x from g""")  # fmt: skip
def attention_layer(spark, sf_dir):
    p, look_up = _pair_scores(spark, sf_dir)
    return C.segment_attention(p, ["h"], "x", "tv", 64, look_up).select("h", F.posexplode("mean").alias("dim", "x"))


@query("score_similar_entities", """with s as (select a.vec_id as entity, b.vec_id as candidate, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)
 select entity, rank, candidate, score from (select *, row_number() over (partition by entity order by score desc, candidate) - 1 as rank from s) where rank < 8""")  # fmt: skip
def similar_entities(spark, sf_dir):
    """The similarity table in long form: the nearest by cosine, for every id divisible by 20 against all rows."""
    return _similar(spark, sf_dir).select("entity", "rank", "candidate", F.round("score", 6).alias("score"))


def _similar(spark, sf_dir, k: int = 8):
    v = _vec(spark, sf_dir).select("vec_id", V.scale("embedding", F.lit(1.0) / V.norm("embedding")).alias("u"))
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), F.col("u").alias("q_vec"))
    near = C.top_k_dot(q, v.select(F.col("vec_id").alias("i_id"), F.col("u").alias("i_vec")), k + 1).where("q_id <> i_id")
    from pyspark.sql import Window

    w = Window.partitionBy("q_id").orderBy(F.desc(F.round("score", 6)), "i_id")
    return near.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k).select(F.col("q_id").alias("entity"), "rank", F.col("i_id").alias("candidate"), "score")


@query("score_candidate_chunks", """with s as (select a.vec_id as entity, b.vec_id as candidate, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
 r as (select *, row_number() over (partition by entity order by score desc, candidate) - 1 as rank from s), t as (select *, ntile(3) over (partition by entity order by rank) - 1 as chunk from r where rank < 8)
 select entity, chunk, arg_min(candidate, rank) as candidate from t group by entity, chunk""")  # fmt: skip
def candidate_chunks(spark, sf_dir):
    from spanloom.operators.pairs import chunked_candidates

    return chunked_candidates(_similar(spark, sf_dir), "entity", "candidate", "rank", 3)


@query("score_temperature_weights", """with s as (select a.vec_id as entity, b.vec_id as candidate, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
 r as (select *, row_number() over (partition by entity order by score desc, candidate) - 1 as rank from s), e as (select entity, candidate, exp(score / 0.1) as w from r where rank < 8) select entity, candidate, round(w / sum(w) over (partition by entity), 5) as weight from e""")  # fmt: skip
def temperature_weights(spark, sf_dir):
    s = _similar(spark, sf_dir).withColumn("x", F.round("score", 6) / 0.1)
    return C.segment_softmax(s, ["entity"], "x").select("entity", "candidate", F.round("weight", 5).alias("weight"))


@query("score_bce", "select event_id, round(greatest(value, 0) - value * (event_type = 'click')::int + ln(1 + exp(-abs(value))), 6) as loss, (1 / (1 + exp(-value)) >= 0.5) as predicted from events where value is not null")
def bce(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null")
    return e.select("event_id", F.round(V.bce_with_logits("value", (F.col("event_type") == "click").cast("double")), 6).alias("loss"), (V.sigmoid("value") >= 0.5).alias("predicted"))
