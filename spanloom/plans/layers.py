"""Queries of layers over supporting ties, candidate scores, pooling heads and the distance classifier. Weights are fixed numbers from a formula; vectors are the first
four dimensions of the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import vectors as V
from spanloom.operators import graph as G
from spanloom.operators import layers as L
from spanloom.operators import pairs as R
from spanloom.plans.fixtures import m_sql
from spanloom.plans.graph import edges
from spanloom.plans.registry import query
from spanloom.runtime import durable, table

DIM = 4
_TAGS = {"update": 1, "pair": 2, "out": 3, "score": 4, "all": 5, "class": 6}


def weight(name: str, j: int, i: int) -> float:
    return ((7 * _TAGS[name] + 31 * j + 17 * i) % 13 - 6) / 10


def _short(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.slice(V.wide("embedding"), 1, DIM).alias("v")), v.agg(F.count("*").alias("n"))


def _supported(spark, sf_dir):
    """Candidates (h, t, cand) of every pair, and their supporting ties (h, t, first, second); a tie has the vector of the sum of its ends."""
    vec, n = _short(spark, sf_dir)
    nb = durable(G.neighbours(edges(spark, sf_dir)))
    of = lambda d, a, b, out: d.crossJoin(F.broadcast(n)).withColumn("vec_id", (F.col(a) + F.col(b)) % F.col("n")).drop("n").join(vec, "vec_id").drop("vec_id").withColumnRenamed("v", out)
    ties = of(of(G.all_common_neighbours(nb), "h", "c", "first"), "c", "t", "second")
    return nb, of(nb, "h", "t", "cand"), ties.select("h", "t", "first", "second")


def _row(name: str, j: int, columns: int, x: str) -> str:
    return f"list_dot_product([{', '.join(str(weight(name, j, i)) for i in range(columns))}]::double[], {x})"


def _matrix(name: str, rows: int, columns: int, x: str, relu: bool = True) -> str:
    each = [_row(name, j, columns, x) for j in range(rows)]
    return "[" + ", ".join(f"greatest({e}, 0)" if relu else e for e in each) + "]"


_BASE = m_sql() + """, n1 as (select distinct h, t from e), nv as (select count(*) as n from embeddings), ev as (select vec_id, embedding[1:4]::double[] as v from embeddings),
 ca as (select h, t, v as cand from (select h, t, (h + t) % n as vec_id from n1, nv) join ev using (vec_id)),
 cn as materialized (select q.h, q.t, a.t as c from n1 q join n1 a on a.h = q.h join n1 b on b.h = q.t and b.t = a.t), ck as materialized (select h, t, (h + c) % n as i, (c + t) % n as j from cn, nv),
 ti as (select ck.h, ck.t, x.v as f, y.v as s from ck join ev x on x.vec_id = i join ev y on y.vec_id = j)"""
_SAYS = {
    "concat": _matrix("update", 4, 12, "cand || f || s"),
    "linear": _matrix("update", 4, 8, f"cand || {_matrix('pair', 4, 8, 'f || s', False)}"),
    "scored": "o[2:5]",
    "separate": _matrix("update", 4, 12, "cand || f || s"),
    "mutual": _matrix("all", 12, 12, "cand || f || s"),
}


def _layer_sql(kind: str) -> str:
    scale = "1.0"
    source = "ti join ca using (h, t)"
    if kind == "scored":
        source = f"(select h, t, {_matrix('out', 5, 4, _matrix('update', 4, 12, 'cand || f || s'), False)} as o from ti join ca using (h, t))"
        scale = "o[1]"
    if kind == "separate":
        scale = f"greatest({_row('score', 0, 12, 'cand || f || s')}, 0)"
    return _BASE + f""", sy as (select h, t, {_SAYS[kind]} as m, {scale} as z from {source}),
 su as (select h, t, {', '.join(f'sum(m[{i}] * z) as s{i}' for i in range(1, 5))} from sy group by h, t),
 rp as (select ca.h, ca.t, cand, {', '.join(f'cand[{i}] + coalesce(s{i}, 0) as x{i - 1}' for i in range(1, 5))} from ca left join su using (h, t))"""


def _plain(spark, sf_dir):
    """(vectors, their number) if each id stands once and all numbers are there, else none."""
    vec, _ = _short(spark, sf_dir)
    whole = (F.size("v") == DIM) & ~F.exists("v", lambda x: x.isNull())
    x = vec.agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("ids"), F.count_if(whole & F.col("vec_id").isNotNull()).alias("whole")).first()
    return (vec, x["n"]) if 0 < x["n"] == x["ids"] == x["whole"] else None


def _rep(spark, sf_dir, kind):
    if plain := _plain(spark, sf_dir):
        return L.layer_of_pairs(edges(spark, sf_dir), *plain, kind, DIM, weight)
    _, cand, ties = _supported(spark, sf_dir)
    return L.layer(cand, ties, ["h", "t"], kind, DIM, weight)


def _register(kind: str) -> None:
    @query(f"score_layer_{kind}", _layer_sql(kind) + " select h, t, x0, x1, x2, x3 from rp")
    def run(spark, sf_dir):
        return _rep(spark, sf_dir, kind)


for _kind in _SAYS:
    _register(_kind)


#: Pairs whose keys are made and which are handed on at once.
ROWS = 100_000


def _score(before, after):
    return sum(x * y for x, y in zip(after, before, strict=True))


def _beside_rival(columns):
    """Of all pairs of some heads, the score of each and that of the next in the ring of its head."""
    import hashlib

    import numpy as np

    h, t, score = columns
    parts = [slice(at, at + ROWS) for at in range(0, len(h), ROWS)]  # numbers and digests as objects, a portion at a time
    key = np.concatenate([np.frombuffer(b"".join(hashlib.md5(b"1|%d|%d" % x).digest() for x in zip(h[k].tolist(), t[k].tolist(), strict=True)), ">u8").reshape(-1, 2) for k in parts])
    o = np.lexsort((t, key[:, 1], key[:, 0], h))
    h, t, score = h[o], t[o], score[o]
    new = np.r_[True, h[1:] != h[:-1]]
    first = np.flatnonzero(new)
    nxt = np.arange(1, len(h) + 1)
    nxt[np.r_[first[1:], len(h)] - 1] = first
    k = np.flatnonzero(nxt != np.arange(len(h)))
    for part in parts:
        i = k[part]
        j = nxt[i]
        yield h[i], t[i], t[j], score[i], score[j], score[i] >= score[j]


@query("score_graph_candidates", _layer_sql("concat") + """, sc as (select h, t, x0 * cand[1] + x1 * cand[2] + x2 * cand[3] + x3 * cand[4] as score from rp),
 rg as (select *, row_number() over (partition by h order by md5(concat_ws('|', 1, h, t)), t) as rn, count(*) over (partition by h) as n from n1)
 select a.h, a.t, b.t as rival, x.score, y.score as rival_score, x.score >= y.score as first from rg a join rg b on b.h = a.h and b.rn = a.rn % a.n + 1 and a.n > 1 join sc x on x.h = a.h and x.t = a.t join sc y on y.h = b.h and y.t = b.t""")  # fmt: skip
def graph_candidates(spark, sf_dir):
    """Every pair scored by its vector after the layer against the one before it, beside a rival: the head with its next neighbour in the ring."""
    if plain := _plain(spark, sf_dir):
        return L.layer_of_pairs(edges(spark, sf_dir), *plain, "concat", DIM, weight, "h bigint, t bigint, rival bigint, score double, rival_score double, first boolean", _score, _beside_rival)
    nb, cand, ties = _supported(spark, sf_dir)
    rep = L.layer(cand, ties, ["h", "t"], "concat", DIM, weight).join(cand, ["h", "t"]).select("h", "t", sum((F.col(f"x{i}") * F.get("cand", F.lit(i)) for i in range(DIM)), F.lit(0.0)).alias("score"))
    rep = durable(rep)
    turn = G.ring(nb)
    nxt = turn.where("size > 1").select("h", "t", F.pmod(F.col("place") + 1, F.col("size")).alias("place")).join(turn.select("h", "place", F.col("t").alias("rival")), ["h", "place"])
    j = nxt.join(rep, ["h", "t"]).join(rep.select("h", F.col("t").alias("rival"), F.col("score").alias("rival_score")), ["h", "rival"])
    return j.select("h", "t", "rival", "score", "rival_score", (F.col("score") >= F.col("rival_score")).alias("first"))


_CLS = [_row("class", j, 8, "a.v || b.v") for j in range(3)]


@query("score_distance_classes", f"""with ev as (select vec_id, embedding[1:4]::double[] as v from embeddings), n as (select count(*) as n from embeddings),
 l as (select a.vec_id, b.vec_id as other, {_CLS[0]} as both_, {_CLS[1]} as one_, {_CLS[2]} as none_ from ev a join n on true join ev b on b.vec_id = (a.vec_id * 7 + 1) % n)
 select vec_id, other, both_, one_, none_, case when both_ >= one_ and both_ >= none_ then 'both' when one_ >= none_ then 'one' else 'none' end as shared from l""")  # fmt: skip
def distance_classes(spark, sf_dir):
    """A linear classifier on two vectors side by side: how many entities their statements share."""
    vec, n = _short(spark, sf_dir)
    a = vec.crossJoin(F.broadcast(n)).select("vec_id", "v", ((F.col("vec_id") * 7 + 1) % F.col("n")).alias("other"))
    j = a.join(vec.select(F.col("vec_id").alias("other"), F.col("v").alias("w")), "other")
    z = j.withColumn("z", L.linear(F.concat("v", "w"), lambda r, c: weight("class", r, c), 3, 2 * DIM))
    z = z.select("vec_id", "other", *[F.get("z", F.lit(i)).alias(c) for i, c in enumerate(("both_", "one_", "none_"))])
    return z.withColumn("shared", F.when((F.col("both_") >= F.col("one_")) & (F.col("both_") >= F.col("none_")), "both").when(F.col("one_") >= F.col("none_"), "one").otherwise("none"))


_TOK = """s as (select example_id, tokens, subj_start as hs, subj_end + 1 as he, obj_start as ts, obj_end + 1 as te from tacred_examples where tokens is not null and subj_start is not null and obj_start is not null),
 n as (select count(*) as n from embeddings), k as (select example_id, unnest(range(0, len(tokens)))::int as pos, unnest(tokens) as tok, hs, he, ts, te from s),
 v as (select k.*, embedding[1:4]::double[] as v from k join n on true join embeddings on vec_id = ('0x' || substr(md5(coalesce(tok, '~')), 1, 8))::bigint % n)"""
_PLACES = {"cls": ["0"], "starts": ["hs", "ts"], "bounds": ["hs", "he - 1", "ts", "te - 1"], "all_relation": ["0", "hs", "ts"]}
_HEADS = " union all ".join(f"select example_id, '{h}' as head, {d} as dim, max(v[{d % 4 + 1}]) filter (pos = {ps[d // 4]}) as x from v group by example_id" for h, ps in _PLACES.items() for d in range(4 * len(ps)))
_HEADS += "".join(f" union all select example_id, '{h}', {d}, {f}(v[{d + 1}]) filter (pos >= hs and pos < he) from v group by example_id" for h, f in (("span_mean", "avg"), ("span_max", "max")) for d in range(4))
_W = "exp(v[1] * 0.1 + v[2] * 0.2 + v[3] * 0.3 + v[4] * 0.4)"
_HEADS += "".join(f" union all select example_id, 'attention', {d}, sum({_W} * v[{d + 1}]) / sum({_W}) from v group by example_id" for d in range(4))


@query("score_pooling_heads", f"with {_TOK}, p as ({_HEADS}) select example_id, head, dim, x from p where x is not null")
def pooling_heads(spark, sf_dir):
    """Relation examples by seven pooling heads; a word has the vector of its hash."""
    vec, n = _short(spark, sf_dir)
    d = table(spark, sf_dir, "tacred_examples").where("tokens is not null and subj_start is not null and obj_start is not null")
    d = d.select("example_id", F.col("subj_start").alias("hs"), (F.col("subj_end") + 1).alias("he"), F.col("obj_start").alias("ts"), (F.col("obj_end") + 1).alias("te"), F.posexplode("tokens").alias("pos", "tok"))
    key = F.conv(F.substring(F.md5(F.coalesce("tok", F.lit("~"))), 1, 8), 16, 10).cast("bigint") % F.col("n")
    return L.pooled_heads(d.crossJoin(F.broadcast(n)).withColumn("vec_id", key).join(vec, "vec_id"), "example_id", DIM, lambda i: (i + 1) / 10)
