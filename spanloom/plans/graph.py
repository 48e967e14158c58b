"""Queries over the co-occurrence graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators import graph as G
from spanloom.operators import wedges as W
from spanloom.plans.fixtures import m_sql, mentions, sentences, split_of
from spanloom.plans.registry import query
from spanloom.runtime import durable

PART, SUPP = "l_partkey", "l_suppkey"


def edges(spark: SparkSession, sf_dir: str, entity: str = PART) -> DataFrame:
    return G.both_ways(G.statements(mentions(spark, sf_dir, entity)))


@query("graph_mention_offsets", m_sql() + " select sent_id, entity, rn, st, en from m")
def mention_offsets(spark, sf_dir):
    return mentions(spark, sf_dir)


@query("graph_edges", m_sql() + " select * from e")
def all_edges(spark, sf_dir):
    return edges(spark, sf_dir)


@query("graph_edge_blocks", m_sql() + """, s as (select l_orderkey as sent_id, cast(sum(l_quantity) as bigint) as n from lineitem group by 1),
x as (select e.*, n, least(hs, ts) as a, greatest(he, te) as b from e join s using (sent_id)),
y as (select *, least(a, n - b, cast(floor((123 - (b - a)) / 2.0) as bigint)) as d from x),
z as (select *, a - d as p, b + d as q, 123 - (b - a + 2 * d) as r from y)
select h, t, sent_id, hs, he, ts, te,
  case when n <= 123 then 0 when r > 1 and p <> 0 and q = n then greatest(0, p - r) else p end as block_start,
  case when n <= 123 then n when r > 1 and p = 0 then least(n, q + r) else q end as block_end from z""")  # fmt: skip
def edge_blocks(spark, sf_dir):
    return G.with_blocks(edges(spark, sf_dir), sentences(spark, sf_dir))


@query("graph_degree", m_sql() + " select h, count(distinct t) as degree, count(*) as n_edges from e group by h")
def degree(spark, sf_dir):
    return G.degrees(edges(spark, sf_dir))


@query("graph_top_degree", m_sql() + " select h, count(distinct t) as degree, count(*) as n_edges from e group by h order by degree desc, n_edges desc, h limit 20")
def top_degree(spark, sf_dir):
    return G.degrees(edges(spark, sf_dir)).orderBy(F.desc("degree"), F.desc("n_edges"), "h").limit(20)


@query("graph_neighbour_lists", m_sql() + " select h, list_sort(list(distinct t)) as neighbours from e group by h")
def neighbour_lists(spark, sf_dir):
    return G.neighbours(edges(spark, sf_dir)).groupBy("h").agg(F.sort_array(F.collect_list("t")).alias("neighbours"))


@query("graph_edges_per_head", m_sql(SUPP) + " select h, count(*) as n from e group by h")
def edges_per_head(spark, sf_dir):
    return edges(spark, sf_dir, SUPP).groupBy("h").agg(F.count("*").alias("n"))


@query("graph_edges_per_pair", m_sql(SUPP) + " select h, t, count(*) as n from e group by h, t")
def edges_per_pair(spark, sf_dir):
    return G.pair_counts(edges(spark, sf_dir, SUPP))


@query("graph_capped_counts", m_sql(SUPP) + " select h, cast(sum(least(n, 2)) as bigint) as n_capped from (select h, t, count(*) as n from e group by h, t) group by h")
def capped_counts(spark, sf_dir):
    return G.capped_counts(edges(spark, sf_dir, SUPP), 2)


@query("graph_capped_sample", m_sql(SUPP) + """ select * from (select h, t, sent_id, hs, he, ts, te,
 row_number() over (partition by h, t order by md5(concat_ws('|', 1, 1, h, t, sent_id, hs, ts)), sent_id, hs, ts) as rank from e) where rank <= 2""")  # fmt: skip
def capped_sample(spark, sf_dir):
    return G.capped_sample(edges(spark, sf_dir, SUPP), 2)


@query("graph_capped_sample_next_epoch", m_sql() + """ select h, t, sent_id, hs from (select *,
 row_number() over (partition by h, t order by md5(concat_ws('|', 1, 2, h, t, sent_id, hs, ts)), sent_id, hs, ts) as rank from e) where rank <= 1""")  # fmt: skip
def capped_sample_next(spark, sf_dir):
    return G.capped_sample(edges(spark, sf_dir), 1, epoch=2).select("h", "t", "sent_id", "hs")


@query("graph_build_counters", m_sql() + """ select (select count(distinct o_custkey) from orders where o_orderkey in (select l_orderkey from lineitem)) as documents,
 (select count(distinct sent_id) from m) as sentences, (select count(*) from m) as mentions, (select count(*) from u) as undirected_edges""")  # fmt: skip
def build_counters(spark, sf_dir):
    m = mentions(spark, sf_dir)
    s = sentences(spark, sf_dir).agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("sentences"))
    return s.crossJoin(m.agg(F.count("*").alias("mentions"))).crossJoin(G.statements(m).agg(F.count("*").alias("undirected_edges")))


@query("graph_edge_rows", m_sql() + """ select h, row_number() over (partition by h order by t, sent_id, hs, he, ts, te) - 1 as local_index, t, sent_id, hs, he, ts, te from e""")
def edge_rows(spark, sf_dir):
    w = Window.partitionBy("h").orderBy("t", "sent_id", "hs", "he", "ts", "te")
    return edges(spark, sf_dir).select("h", (F.row_number().over(w) - 1).alias("local_index"), "t", "sent_id", "hs", "he", "ts", "te")


@query("graph_tail_runs", m_sql(SUPP) + """ select h, count(*) as runs from (select h, t, lag(t) over (partition by h order by t, sent_id, hs, ts) as p from e) where p is null or p <> t group by h""")
def tail_runs(spark, sf_dir):
    w = Window.partitionBy("h").orderBy("t", "sent_id", "hs", "ts")
    return edges(spark, sf_dir, SUPP).select("h", "t", F.lag("t").over(w).alias("p")).where("p is null or p <> t").groupBy("h").agg(F.count("*").alias("runs"))


_PAIRS = ", n1 as (select distinct h, t from e), p as (select h, min(t) as t from n1 group by h)"
#: Common neighbours of every pair.
_COMMON = _PAIRS + ", cn as (select q.h, q.t, a.t as c from n1 q join n1 a on a.h = q.h join n1 b on b.h = q.t and b.t = a.t)"


def first_pairs(nb: DataFrame) -> DataFrame:
    """One pair per head: with its least neighbour."""
    return nb.groupBy("h").agg(F.min("t").alias("t"))


@query("graph_common_neighbours", m_sql() + _COMMON + " select h, t, c from cn")
def common(spark, sf_dir):
    return W.common_neighbours(edges(spark, sf_dir))


@query("graph_head_only_neighbours", m_sql() + _PAIRS + " select q.h, q.t, a.t as c from n1 q join n1 a on a.h = q.h where a.t <> q.t and not exists (select 1 from n1 b where b.h = q.t and b.t = a.t)")
def head_only(spark, sf_dir):
    return W.exclusive_neighbours(edges(spark, sf_dir), "h")


@query("graph_tail_only_neighbours", m_sql() + _PAIRS + " select q.h, q.t, a.t as c from n1 q join n1 a on a.h = q.t where a.t <> q.h and not exists (select 1 from n1 b where b.h = q.h and b.t = a.t)")
def tail_only(spark, sf_dir):
    return W.exclusive_neighbours(edges(spark, sf_dir), "t")


@query("graph_neighbour_classes", m_sql() + _COMMON + """
 select c.h, c.t, c.c, (x.h is not null)::int + (y.h is not null)::int as n_chosen from cn c left join p x on x.h = c.h and x.t = c.c left join p y on y.h = c.c and y.t = c.t""")  # fmt: skip
def neighbour_classes(spark, sf_dir):
    """Common neighbours of every pair by how many of their two connections are in a chosen set of pairs, one of each head."""
    return W.chosen_classes(edges(spark, sf_dir))


@query("graph_subset_pairs", m_sql() + """, n1 as (select distinct h, t from e) select h, t from n1 where not exists
 (select 1 from n1 a where a.h = n1.h and a.t <> n1.t and not exists (select 1 from n1 b where b.h = n1.t and b.t = a.t))""")  # fmt: skip
def subset_pairs(spark, sf_dir):
    return G.subset_pairs(G.neighbours(edges(spark, sf_dir)))


_SPLIT = f", d as (select o_orderkey as sent_id, o_orderdate < timestamp '1997-01-01' as is_train from orders), es as (select e.*, is_train from e join d using (sent_id))"


def _trainable_sql(entity: str, which: str, min_pos: int) -> str:
    return m_sql(entity) + _SPLIT + f""", tr as (select * from es where is_train), pp as (select h, t from tr group by h, t having count(*) >= {min_pos}),
 ph as (select h from tr group by h having count(*) >= {min_pos} + 1), k as (select es.* from es join pp using (h, t) join ph using (h) where {which}),
 n1 as (select distinct h, t from tr), ms as (select distinct sent_id, entity from m), pr as (select distinct h, t from k),
 told as (select h, t from pr where exists (select 1 from n1 a where a.h = pr.h and a.t <> pr.t and not exists (select 1 from n1 b where b.h = pr.t and b.t = a.t))),
 silent as (select h, t from pr where exists (select 1 from tr where tr.h = pr.h and not exists (select 1 from ms where ms.sent_id = tr.sent_id and ms.entity = pr.t)))
 select h, t, sent_id, hs, ts from k where (h, t) in (select h, t from told union select h, t from silent)"""


@query("graph_trainable_train", _trainable_sql(SUPP, "is_train", 2))
def trainable_train(spark, sf_dir):
    e = split_of(spark, sf_dir, edges(spark, sf_dir, SUPP)).where("is_train")
    return G.trainable(e, e, mentions(spark, sf_dir, SUPP), 2).select("h", "t", "sent_id", "hs", "ts")


@query("graph_trainable_valid", _trainable_sql(SUPP, "not is_train", 1))
def trainable_valid(spark, sf_dir):
    e = split_of(spark, sf_dir, edges(spark, sf_dir, SUPP))
    return G.trainable(e.where("not is_train"), e.where("is_train"), mentions(spark, sf_dir, SUPP), 1).select("h", "t", "sent_id", "hs", "ts")


@query("graph_triplets", m_sql(SUPP) + """, mm as (select distinct sent_id, entity from m), p as (select a.sent_id, a.entity as e1, b.entity as e2 from mm a join mm b on a.sent_id = b.sent_id and a.entity <> b.entity)
 select sent_id, e1, e2 from p where (e1, e2) in (select e1, e2 from p group by e1, e2 having count(*) >= 2 and count(*) < (select count(*) from mm where entity = p.e1))""")  # fmt: skip
def triplets(spark, sf_dir):
    return G.triplets(mentions(spark, sf_dir, SUPP))


@query("graph_triangles", m_sql() + _COMMON + """, s as (select distinct h, t, sent_id from e),
 w as (select s.h, s.t, s.sent_id, cn.c, a.sent_id as sa, b.sent_id as sb from s join cn using (h, t) join s a on a.h = s.h and a.t = cn.c join s b on b.h = cn.c and b.t = s.t)
 select h, t, sent_id, min(c) as c from w where sa <> sent_id and sb <> sent_id and sa <> sb group by h, t, sent_id""")  # fmt: skip
def triangles(spark, sf_dir):
    """For every statement: the first third entity tied to both ends by statements of two further, different sentences."""
    return W.third_of_statements(mentions(spark, sf_dir))
