"""Queries of covering subgraphs, beam assignment, and lookups between dictionaries, ranks and permutations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import graph as G
from spanloom.operators import subgraph as S
from spanloom.operators.prep import ordered_ids
from spanloom.plans.fixtures import m_sql, mentions
from spanloom.plans.graph import edges, first_pairs
from spanloom.plans.registry import query
from spanloom.plans.scores import _similar
from spanloom.runtime import durable, hkey, table, u01


def _seeds(nb):
    """A pair of each entity: with its next greater neighbour."""
    return nb.where("h < t").groupBy("h").agg(F.min("t").alias("t")).withColumn("seed", F.col("h"))


@query("subgraph_cover")
def cover(spark, sf_dir):
    e = edges(spark, sf_dir)
    nb = G.neighbours(e)
    return S.cover(_seeds(nb), nb, e)


@query("subgraph_pair_uses")
def pair_uses(spark, sf_dir):
    """How many subgraphs use each pair, and which are used more than twice the mean."""
    c = cover(spark, sf_dir).groupBy("h", "t").agg(F.count("*").alias("n"))
    c = durable(c)
    return c.crossJoin(F.broadcast(c.agg(F.avg("n").alias("mean")))).select("h", "t", "n", (F.col("n") > 2 * F.col("mean")).alias("over_cap"))


@query("subgraph_statistics")
def statistics(spark, sf_dir):
    """Yield, and how far from one the number of uses of a sentence lies."""
    c = cover(spark, sf_dir)
    per = c.groupBy("seed").agg((F.count_if("covered") / F.count("*")).alias("y"), F.count("*").alias("n"))
    uses = c.groupBy("sent_id").agg(F.count("*").alias("k")).agg(F.round(F.avg(F.abs(F.col("k") - 1)), 6).alias("distance_from_one"))
    return per.agg(F.count("*").alias("seeds"), F.round(F.avg("y"), 6).alias("mean_yield"), F.round(F.percentile("y", 0.5), 6).alias("median_yield"), F.sum("n").alias("statements")).crossJoin(uses)


_C = m_sql() + """, n1 as (select distinct h, t from e), p as (select h, min(t) as t from n1 group by h), q as (select h, t from n1 where h < t),
 c as (select q.h, q.t, a.t as c, (x.h is not null)::int + (y.h is not null)::int as k from q join n1 a on a.h = q.h join n1 b on b.h = q.t and b.t = a.t left join p x on x.h = q.h and x.t = a.t left join p y on y.h = a.t and y.t = q.t),
 g as (select q.h, q.t, count(c.c) as total, count(*) filter (k = 2) as both_in, count(*) filter (k = 1) as single from q left join c using (h, t) group by q.h, q.t)"""


@query("subgraph_cover_costs", _C + """ select h, t, case when total < 1 then 100000000 else case when greatest(least(2, total) - both_in, 0) > 0 then
 case when single > greatest(least(2, total) - both_in, 0) then greatest(least(2, total) - both_in, 0) else single + 2 * (greatest(least(2, total) - both_in, 0) - single) end else -1 end + 1 end as cost,
 round(case when total = 0 then 1.0 else both_in / total end, 6) as coverage from g""")  # fmt: skip
def cover_costs(spark, sf_dir):
    """Cost and coverage of every pair, with the chosen pairs, one of each entity, as the subgraph."""
    nb = durable(G.neighbours(edges(spark, sf_dir)))
    chosen = first_pairs(nb)
    q = nb.where("h < t")
    c = G.all_common_neighbours(nb).where("h < t")
    x = chosen.select("h", F.col("t").alias("c"), F.lit(1).alias("x"))
    y = chosen.select(F.col("h").alias("c"), "t", F.lit(1).alias("y"))
    k = c.join(x, ["h", "c"], "left").join(y, ["c", "t"], "left").select("h", "t", (F.coalesce("x", F.lit(0)) + F.coalesce("y", F.lit(0))).alias("k"))
    g = q.join(k.groupBy("h", "t").agg(F.count("*").alias("total"), F.count_if(F.col("k") == 2).alias("both"), F.count_if(F.col("k") == 1).alias("single")), ["h", "t"], "left").fillna(0, ["total", "both", "single"])
    return g.select("h", "t", S.cover_cost(F.col("total"), F.col("both"), F.col("single"), F.lit(True), 1, 2).alias("cost"), F.round(S.relative_coverage(F.col("both"), F.col("total")), 6).alias("coverage"))


@query("subgraph_drawing", m_sql() + ", n1 as (select distinct h, t from e), p as (select h, min(t) as t from n1 group by h) select n1.h, n1.t, case when p.t is not null then 'red' else 'black' end as color from n1 left join p using (h, t) where n1.h < n1.t")
def drawing(spark, sf_dir):
    """Edge list with a colour for the chosen pairs."""
    nb = G.neighbours(edges(spark, sf_dir))
    return nb.where("h < t").join(first_pairs(nb).withColumn("c", F.lit(1)), ["h", "t"], "left").select("h", "t", F.when(F.col("c").isNotNull(), "red").otherwise("black").alias("color"))


@query("answer_beam_assignment")
def beam(spark, sf_dir):
    """Parts of an order assigned to its lines by made-up scores."""
    m = mentions(spark, sf_dir)
    w = m.select(F.col("sent_id").alias("question"), (F.col("rn") - 1).cast("int").alias("place"))
    c = m.select(F.col("sent_id").alias("question"), F.col("entity").alias("candidate")).distinct()
    s = w.join(c, "question").withColumn("score", u01(F.lit("b"), "question", "place", "candidate"))
    return S.beam_assign(s)


@query("answer_pair_beam")
def pair_beam(spark, sf_dir):
    """Parts of an order assigned to its lines by made-up scores and the likeness of the parts chosen."""
    m = mentions(spark, sf_dir)
    w = m.select(F.col("sent_id").alias("question"), (F.col("rn") - 1).cast("int").alias("place"))
    c = m.select(F.col("sent_id").alias("question"), F.col("entity").alias("candidate")).distinct()
    v = table(spark, sf_dir, "embeddings")
    n = v.agg(F.count("*").alias("n"))
    s = w.join(c, "question").withColumn("score", u01(F.lit("b"), "question", "place", "candidate")).crossJoin(F.broadcast(n))
    return S.pair_beam(s.withColumn("vec_id", F.col("candidate") % F.col("n")).join(v.select("vec_id", F.slice("embedding", 1, 4).alias("vec")), "vec_id"))


@query("answer_unravelled_index", "select q_id, i_id, q_id * 64 + i_id as flat, (q_id * 64 + i_id) // 64 as a, (q_id * 64 + i_id) % 64 as b from (select vec_id as q_id, label as i_id from embeddings)")
def unravelled(spark, sf_dir):
    """A flat position back to beam and choice."""
    d = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("q_id"), F.col("label").alias("i_id")).withColumn("flat", F.col("q_id") * 64 + F.col("i_id"))
    return d.withColumn("a", F.floor(F.col("flat") / 64)).withColumn("b", F.col("flat") % 64)


@query("lookup_dictionary_remap", "select mention_id, e.entity_id, coalesce(p.p_partkey, -1) as other_id from wiki_mentions m left join entity_dict e on m.uri = e.symbol left join part p on p.p_partkey = e.entity_id")
def remap(spark, sf_dir):
    """Mentions through two dictionaries; -1 where the second has no entry."""
    m = table(spark, sf_dir, "wiki_mentions").select("mention_id", "uri")
    e = table(spark, sf_dir, "entity_dict").select("entity_id", F.col("symbol").alias("uri"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_partkey").alias("other"))
    return m.join(e, "uri", "left").join(p, "entity_id", "left").select("mention_id", "entity_id", F.coalesce("other", F.lit(-1)).alias("other_id"))


@query("lookup_similar_neighbours", m_sql() + """, n1 as (select distinct h, t from e), s as (select a.vec_id as entity, b.vec_id as candidate, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
 r as (select *, row_number() over (partition by entity order by score desc, candidate) - 1 as rank from s) select entity, rank, candidate from r join n1 on n1.h = entity and n1.t = candidate where rank < 8""")  # fmt: skip
def similar_neighbours(spark, sf_dir):
    """Similar entities that are neighbours too, in order of rank. Every id divisible by 20 is asked, against all rows."""
    nb = G.neighbours(edges(spark, sf_dir)).select(F.col("h").alias("entity"), F.col("t").alias("candidate"))
    return _similar(spark, sf_dir).join(nb, ["entity", "candidate"]).select("entity", "rank", "candidate")


@query("lookup_passage_pairs", m_sql() + " select a.sent_id, a.rn as i, b.rn as j, a.entity as e1, b.entity as e2 from m a join m b on a.sent_id = b.sent_id")
def passage_pairs(spark, sf_dir):
    """All ordered mention pairs of a passage, itself included; passages are short."""
    m = mentions(spark, sf_dir)
    a = m.select("sent_id", F.col("rn").alias("i"), F.col("entity").alias("e1"))
    return a.join(m.select("sent_id", F.col("rn").alias("j"), F.col("entity").alias("e2")), "sent_id")


@query("lookup_inverse_permutation", "with p as (select example_id, row_number() over (order by example_id) - 1 as i, row_number() over (order by md5(concat_ws('|', 9, example_id)), example_id) - 1 as p from tacred_examples) select p as i, i as inverse from p")
def inverse_permutation(spark, sf_dir):
    d = table(spark, sf_dir, "tacred_examples").select("example_id", hkey(F.lit(9), "example_id").alias("k"))
    a = ordered_ids(d, [F.asc("example_id")], "i").select("example_id", "i")
    b = ordered_ids(d, [F.asc("k"), F.asc("example_id")], "p").select("example_id", "p")
    return a.join(b, "example_id").select(F.col("p").alias("i"), F.col("i").alias("inverse"))


@query("lookup_names_longest_first", "select uri, list_transform(list(distinct {'n': -length(surface_form), 's': surface_form} order by {'n': -length(surface_form), 's': surface_form}), lambda x: x.s) as names from wiki_mentions join entity_dict on uri = symbol where surface_form is not null group by uri")
def names_longest_first(spark, sf_dir):
    m = table(spark, sf_dir, "wiki_mentions").where("surface_form is not null").join(table(spark, sf_dir, "entity_dict").select(F.col("symbol").alias("uri")), "uri", "left_semi")
    d = m.select("uri", "surface_form").distinct()
    return d.groupBy("uri").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.length("surface_form")).alias("n"), F.col("surface_form").alias("s")))), lambda x: x["s"]).alias("names"))


@query("lookup_event_properties", "select event_id, props::json ->> 'k' as k, event_type as kind from events")
def event_properties(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("kind"))


@query("lookup_sane_tags", "select p_partkey, regexp_replace(regexp_replace(p_name || '/' || p_type, '[^A-Za-z0-9_.=-]+', '_', 'g'), '_+', '_', 'g') as tag from part")
def sane_tags(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.sane_tag(F.concat_ws("/", "p_name", "p_type")).alias("tag"))


_MLM = "(('0x' || substr(md5(concat_ws('|', '{}', example_id, i)), 1, 8))::bigint / 4294967296.0)"


@query("mask_language_model", f"""with t as (select example_id, unnest(range(0, len(tokens))) as i, unnest(tokens) as tok from fewrel_examples where tokens is not null)
 select example_id, i, case when {_MLM.format('m')} >= 0.15 then tok when {_MLM.format('k')} < 0.1 then tok when {_MLM.format('k')} < 0.2 then '<random>' else '<mask>' end as out, {_MLM.format('m')} < 0.15 as target from t""")  # fmt: skip
def mask_language_model(spark, sf_dir):
    """15 in 100 tokens are targets; of these a tenth stays, a tenth is replaced, the rest is masked."""
    t = table(spark, sf_dir, "fewrel_examples").where("tokens is not null").select("example_id", F.posexplode("tokens").alias("i", "tok"))
    m, k = u01(F.lit("m"), "example_id", "i"), u01(F.lit("k"), "example_id", "i")
    return t.select("example_id", "i", F.when(m >= 0.15, F.col("tok")).when(k < 0.1, F.col("tok")).when(k < 0.2, F.lit("<random>")).otherwise(F.lit("<mask>")).alias("out"), (m < 0.15).alias("target"))


@query("mask_token_blocks", """with recursive s as (select article_id, row_number() over (partition by article_id order by sent_no) as rn, len(string_split(sentence, ' ')) as n from (
 select article_id, generate_subscripts(p, 1) as sent_no, unnest(p) as sentence from (select article_id, string_split(text, chr(10)) as p from wiki_articles where text is not null))),
 r as (select article_id, rn, n as filled, 0 as block from s where rn = 1 union all select s.article_id, s.rn, case when r.filled + s.n > 128 then s.n else r.filled + s.n end, case when r.filled + s.n > 128 then r.block + 1 else r.block end
 from r join s on s.article_id = r.article_id and s.rn = r.rn + 1) select article_id, block, count(*) as n_lines, max(filled) as n_words from r group by article_id, block""")  # fmt: skip
def token_blocks(spark, sf_dir):
    """Whole lines of an article packed into blocks of at most 128 words, in order: a fold over each article's line sizes."""
    lines = table(spark, sf_dir, "wiki_articles").where("text is not null").select("article_id", F.transform(F.split("text", "\n"), lambda s: F.size(F.split(s, " "))).alias("sizes"))
    start = F.struct(F.lit(0).alias("filled"), F.lit(0).alias("n"), F.array().cast("array<struct<n_lines:int,n_words:int>>").alias("done"))
    step = lambda a, x: F.when((a["n"] > 0) & (a["filled"] + x > 128), F.struct(x.alias("filled"), F.lit(1).alias("n"), F.concat(a["done"], F.array(F.struct(a["n"].alias("n_lines"), a["filled"].alias("n_words")))).alias("done"))).otherwise(F.struct((a["filled"] + x).alias("filled"), (a["n"] + 1).alias("n"), a["done"].alias("done")))
    folded = F.aggregate("sizes", start, step, lambda a: F.concat(a["done"], F.array(F.struct(a["n"].alias("n_lines"), a["filled"].alias("n_words")))))
    return lines.select("article_id", F.posexplode(folded).alias("block", "b")).select("article_id", "block", F.col("b.n_lines").alias("n_lines"), F.col("b.n_words").alias("n_words"))
