"""Queries of samples, splits, batches and statement pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import graph as G
from spanloom.operators import heads as H
from spanloom.operators import pairs as R
from spanloom.operators import sampling as S
from spanloom.plans.fixtures import m_sql, mentions
from spanloom.plans.graph import SUPP, edges
from spanloom.plans.registry import query
from spanloom.runtime import table


def _examples(spark, sf_dir, name="tacred"):
    return table(spark, sf_dir, f"{name}_examples")


def _u(*xs: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(xs)})), 1, 8))::bigint / 4294967296.0)"


@query("sample_epoch_slice", """with n as (select count(*) as n, ceil(count(*) / 100.0)::bigint as slices from tacred_examples),
 r as (select example_id, row_number() over (order by md5(concat_ws('|', 1, 6 // slices + 1, example_id)), example_id) - 1 as rn, n // slices as size, 6 % slices as k from tacred_examples, n)
 select example_id from r where rn >= k * size and rn < (k + 1) * size""")  # fmt: skip
def epoch_slice(spark, sf_dir):
    """The seventh epoch of slices of at most 100 rows."""
    return S.epoch_slice(_examples(spark, sf_dir).select("example_id"), ["example_id"], 100, 7)


@query("sample_fixed_size", "select example_id from tacred_examples order by md5(concat_ws('|', 1, example_id)), example_id limit 250")
def fixed_size(spark, sf_dir):
    return S.fixed_size(_examples(spark, sf_dir).select("example_id"), ["example_id"], 250)


@query("sample_shards", f"select example_id, floor({_u(chr(39) + 'shard' + chr(39), 'example_id')} * 16)::int as shard from tacred_examples")
def shards(spark, sf_dir):
    return _examples(spark, sf_dir).select("example_id", S.shard_of(16, "example_id").alias("shard"))


@query("sample_per_relation", "select relation, example_id from (select relation, example_id, row_number() over (partition by relation order by md5(concat_ws('|', 1, example_id)), example_id) as r from fewrel_examples where relation is not null) where r <= 5")
def per_relation(spark, sf_dir):
    return S.per_group(_examples(spark, sf_dir, "fewrel").where("relation is not null").select("relation", "example_id"), ["relation"], ["example_id"], 5)


@query("sample_some_relations", "select example_id, relation from fewrel_examples where relation in (select relation from (select distinct relation from fewrel_examples where relation is not null) order by md5(concat_ws('|', 1, relation)), relation limit 10)")
def some_relations(spark, sf_dir):
    d = _examples(spark, sf_dir, "fewrel").where("relation is not null").select("example_id", "relation")
    return d.join(F.broadcast(S.fixed_size(d.select("relation").distinct(), ["relation"], 10)), "relation", "left_semi")


@query("sample_weighted", f"""with w as (select relation, example_id, len(tokens)::double as w from fewrel_examples where relation is not null and len(tokens) > 0)
 select relation, example_id from (select relation, example_id, row_number() over (partition by relation order by -ln({_u('1', 'example_id')} + 1e-10) / w, example_id) as r from w) where r <= 3""")  # fmt: skip
def weighted(spark, sf_dir):
    d = _examples(spark, sf_dir, "fewrel").where("relation is not null and size(tokens) > 0").select("relation", "example_id", F.size("tokens").cast("double").alias("w"))
    return S.weighted_without_replacement(d, ["relation"], ["example_id"], "w", 3).select("relation", "example_id")


@query("sample_with_replacement", f"""with i as (select relation, example_id, row_number() over (partition by relation order by example_id) - 1 as i from tacred_examples where relation is not null),
 n as (select relation, count(*) as n from i group by relation), d as (select relation, draw, floor({_u('1', 'relation', 'draw')} * n)::bigint as i from n, (select unnest(range(0, 20)) as draw))
 select relation, draw, example_id from d join i using (relation, i)""")  # fmt: skip
def with_replacement(spark, sf_dir):
    d = _examples(spark, sf_dir).where("relation is not null")
    return S.with_replacement(d.select("relation").distinct(), d, "relation", "example_id", 20)


@query("sample_length_order", f"select example_id, round(len(tokens) + ({_u('1', 'example_id')} - 0.5) * 10, 6) as order_key from tacred_examples where tokens is not null")
def length_order(spark, sf_dir):
    d = _examples(spark, sf_dir).where("tokens is not null").withColumn("n", F.size("tokens"))
    return d.select("example_id", F.round(S.jittered_length_order(d, "n", ["example_id"]), 6).alias("order_key"))


@query("sample_interleaved_tasks", """with a as (select row_number() over (order by example_id) - 1 as rn, example_id as key from tacred_examples), b as (select row_number() over (order by example_id) - 1 as rn, example_id as key from fewrel_examples),
 c as (select least((select count(*) from a) // 3, (select count(*) from b) // 2) as cycles),
 x as (select rn // 3 as cycle, 0 as task_no, 'tacred' as task, rn % 3 as place, key from a union all select rn // 2, 1, 'fewrel', rn % 2, key from b) select x.* from x, c where cycle < cycles""")  # fmt: skip
def interleaved(spark, sf_dir):
    return S.interleaved([("tacred", _examples(spark, sf_dir), 3), ("fewrel", _examples(spark, sf_dir, "fewrel"), 2)], "example_id")


@query("sample_stratified_split", """with e as (select relation, example_id, s.split_no from tacred_examples, (select unnest(range(0, 3))::int as split_no) s where relation is not null)
 select split_no, relation, example_id, row_number() over (partition by split_no, relation order by md5(concat_ws('|', 1, split_no, example_id)), example_id) <= round(count(*) over (partition by split_no, relation) * 0.2) as is_test from e""")  # fmt: skip
def stratified(spark, sf_dir):
    return S.stratified_split(_examples(spark, sf_dir).where("relation is not null"), "relation", ["example_id"], 0.2, 3)


#: Batches by a fold over the rows of each shard, in order of length.
_BATCHES = f"""with recursive t as (select example_id, len(tokens)::bigint as n, floor({_u(chr(39) + 'shard' + chr(39), 'example_id')} * 8)::int as shard from tacred_examples where tokens is not null),
 o as (select *, row_number() over (partition by shard order by n, example_id) as rn from t),
 r as (select shard, rn, example_id, n, 0 as batch, 1 as rows from o where rn = 1 union all
  select o.shard, o.rn, o.example_id, o.n, case when greatest(r.n, o.n) * (r.rows + 1) > 2000 or r.rows >= 64 then r.batch + 1 else r.batch end,
   case when greatest(r.n, o.n) * (r.rows + 1) > 2000 or r.rows >= 64 then 1 else r.rows + 1 end from r join o on o.shard = r.shard and o.rn = r.rn + 1)"""


@query("sample_token_batches", _BATCHES + " select shard, batch, example_id from r")
def token_batches(spark, sf_dir):
    d = _examples(spark, sf_dir).where("tokens is not null").withColumn("n", F.size("tokens"))
    return S.token_batches(d, "example_id", "n", 2000, 64)


@query("sample_shuffled_columns", "select example_id, relation, row_number() over (order by md5(concat_ws('|', 3, example_id)), example_id) - 1 as place from tacred_examples")
def shuffled(spark, sf_dir):
    """All columns of a row move together."""
    from spanloom.operators.prep import ordered_ids
    from spanloom.runtime import hkey

    d = _examples(spark, sf_dir).select("example_id", "relation").withColumn("k", hkey(F.lit(3), "example_id"))
    return ordered_ids(d, [F.asc("k"), F.asc("example_id")], "place").select("example_id", "relation", "place")


def _ids(spark, sf_dir, entity=SUPP):
    return R.with_ids(edges(spark, sf_dir, entity))


_E = m_sql(SUPP) + ", x as (select *, md5(concat_ws('|', h, t, sent_id, hs, ts)) as id from e)"


@query("pair_positives", _E + """ select a_id, b_id from (select id as a_id, coalesce(lead(id) over w, first_value(id) over w) as b_id from x window w as (partition by h, t order by md5(concat_ws('|', 1, id)), id)) where a_id <> b_id""")
def positives(spark, sf_dir):
    return R.positives(_ids(spark, sf_dir))


@query("pair_strong_negatives", _E + """, n1 as (select distinct h, t from e), r as (select *, row_number() over (partition by h order by md5(concat_ws('|', 1, h, t)), t) as rn, count(*) over (partition by h) as n from n1), ms as (select distinct sent_id, entity from m),
 k as (select a.h, a.t as old_t, b.t as new_t, (b.rn - a.rn + a.n) % a.n as step from r a join r b on a.h = b.h and a.t <> b.t),
 c as (select k.h, old_t, new_t, step, x.id as b_id from k join x on x.h = k.h and x.t = k.new_t where not exists (select 1 from ms where ms.sent_id = x.sent_id and ms.entity = k.old_t)),
 s as (select h, old_t, min(step) as step from c group by h, old_t),
 f as (select h, old_t, arg_min(b_id, (md5(concat_ws('|', 1, b_id)), b_id)) as b_id, min(new_t) as new_t from c join s using (h, old_t, step) group by h, old_t)
 select x.id as a_id, f.b_id, f.new_t from x join f on x.h = f.h and x.t = f.old_t""")  # fmt: skip
def strong_negatives(spark, sf_dir):
    return H.strong_negatives(mentions(spark, sf_dir, SUPP))


_EP = m_sql() + ", x as (select *, md5(concat_ws('|', h, t, sent_id, hs, ts)) as id from e), n1 as (select distinct h, t from e)"


@query("pair_sharing_one_entity", _EP + """, o as (select h, t, min(id) as id from x group by h, t), r as (select *, row_number() over (partition by h order by md5(concat_ws('|', 1, h, t)), t) as rn, count(*) over (partition by h) as n from o),
 c as (select a.h, a.t, (b.rn - a.rn + a.n) % a.n as rank, b.id from r a join n1 q on q.h = a.t join r b on b.h = a.h and b.t = q.t),
 b as (select h, t, arg_min(id, rank) as b_id from c group by h, t) select x.id as a_id, b.b_id from x join b using (h, t)""")  # fmt: skip
def sharing_one(spark, sf_dir):
    e = _ids(spark, sf_dir, "l_partkey")
    return R.sharing_one(e, G.neighbours(e))


_WEAK = """, po as (select h, t, id as a_id, coalesce(lead(id) over w, first_value(id) over w) as b_id from x window w as (partition by h, t order by md5(concat_ws('|', 1, id)), id)),
 o as (select *, row_number() over (order by md5(concat_ws('|', 1, a_id)), a_id) - 1 as rn from po where a_id <> b_id), g as (select *, rn // 64 as g, count(*) over (partition by rn // 64) as n from o),
 wk as (select a.a_id, b.b_id, row_number() over (partition by a.a_id order by (b.rn - a.rn + a.n) % a.n) - 1 as rank from g a join g b on a.g = b.g and a.rn <> b.rn and (a.h <> b.h or a.t <> b.t))"""


@query("pair_weak_negatives", _E + _WEAK + " select a_id, b_id, rank from wk where rank < 4")
def weak_negatives(spark, sf_dir):
    return R.weak_negatives(R.positives(_ids(spark, sf_dir), ends=True), 64, 4)


@query("pair_distance_classes", _E + """, p as (select a_id, b_id from (select id as a_id, lead(id) over (order by md5(concat_ws('|', 5, id)), id) as b_id from (select min(id) as id from x group by h, t)) where b_id is not null)
 select a_id, b_id, case (a.h in (b.h, b.t))::int + (a.t in (b.h, b.t))::int when 2 then 'both' when 1 then 'one' else 'none' end as shared from p join x a on a.id = a_id join x b on b.id = b_id""")  # fmt: skip
def distance_classes(spark, sf_dir):
    """Statements of a pseudo-random ring of pairs, by the entities they share."""
    return R.distance_class(R.chain_of_pairs(G.statements(mentions(spark, sf_dir, SUPP)), 5), None).select("a_id", "b_id", "shared")


#: Replacements of every pair: common neighbours (0), the tail's own (1), the head's own (2), with their place in the ring.
RING_SQL = m_sql() + """, n1 as (select distinct h, t from e), rg as (select *, row_number() over (partition by h order by md5(concat_ws('|', 1, h, t)), t) as rn, count(*) over (partition by h) as n from n1),
 ho as (select q.h, q.t, a.t as c, (a.rn - q.rn + q.n) % q.n as step, exists (select 1 from n1 b where b.h = q.t and b.t = a.t) as shared from rg q join rg a on a.h = q.h and a.t <> q.t),
 c as (select h, t, c, 0 as kind, step from ho where shared union all select t, h, c, 1, step from ho where not shared union all select h, t, c, 2, step from ho where not shared)"""


@query("pair_tail_replacements", RING_SQL + """ select h, t, c, kind // 2 as kind, place from (select *, row_number() over (partition by h, t order by kind, step) as place from c where kind <> 1) where place <= 10""")
def tail_replacements(spark, sf_dir):
    """For every pair: ten entities for its tail, common neighbours first."""
    return R.negatives_by_class(G.neighbours(edges(spark, sf_dir)), 10)


@query("pair_entity_statement", m_sql() + " select h, sent_id, t, hs from (select *, row_number() over (partition by h order by md5(concat_ws('|', 4, h, t, sent_id, hs, ts)), t, sent_id, hs, ts) as r from e) where r = 1")
def entity_statement(spark, sf_dir):
    """A statement of every entity: uniform over entities, not over statements."""
    from pyspark.sql import Window

    from spanloom.runtime import hkey

    w = Window.partitionBy("h").orderBy(hkey(F.lit(4), "h", "t", "sent_id", "hs", "ts"), "t", "sent_id", "hs", "ts")
    return edges(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r = 1").select("h", "sent_id", "t", "hs")


@query("sample_single_batches", "select example_id, row_number() over (order by example_id) - 1 as batch from tacred_examples")
def single_batches(spark, sf_dir):
    """Batches of one row, in order of id."""
    from spanloom.operators.prep import ordered_ids

    return ordered_ids(_examples(spark, sf_dir).select("example_id"), [F.asc("example_id")], "batch").select("example_id", "batch")
