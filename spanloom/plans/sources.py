"""Queries over files of each format: written from the tables to the shared folder, read back by the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanloom.plans.registry import query
from spanloom.runtime import shared_dir, table
from spanloom.sources import readers as R
from spanloom.sources import writers as W


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("source_articles", "select url, length(text) as n_chars, len(annotations) as n_annotations, len(el) as n_el, annotations[1].char_offset as first_offset, case when text is not null then false end as has_nbsp from wiki_articles")
def articles(spark, sf_dir):
    """Articles as JSON lines and back; no-break spaces are gone."""
    path = _folder(spark, "articles")
    ms = lambda c: F.transform(c, lambda m: F.struct(m["uri"].alias("uri"), m["surface_form"].alias("surface_form"), m["char_offset"].alias("offset")))
    table(spark, sf_dir, "wiki_articles").select("url", "text", ms("annotations").alias("annotations"), ms("el").alias("el")).write.json(path)
    d = R.articles(spark, f"{path}/*.json")
    n = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return d.select("url", F.length("text").alias("n_chars"), n("annotations").alias("n_annotations"), n("el").alias("n_el"), F.get("annotations", F.lit(0))["offset"].alias("first_offset"), F.contains("text", F.lit("\u00a0")).alias("has_nbsp"))


@query("source_entity_dictionary", "select row_number() over (order by entity_id) - 1 as entity_id, symbol, cnt from entity_dict where cnt is not null")
def entity_dictionary(spark, sf_dir):
    """The dictionary as lines and back; ids are line numbers."""
    path = _folder(spark, "dictionary")
    W.vocabulary_text(table(spark, sf_dir, "entity_dict").where("cnt is not null"), path)
    return R.entity_dictionary(spark, path)


@query("source_tacred", "select example_id::varchar as id, len(tokens) as n_tokens, subj_start as hs, subj_end + 1 as he, obj_start as ts, obj_end + 1 as te, relation from tacred_examples where tokens is not null")
def tacred(spark, sf_dir):
    """Examples as files of one JSON array each and back; a file holds the examples of one of 64 groups."""
    path = _folder(spark, "tacred")
    d = table(spark, sf_dir, "tacred_examples").where("tokens is not null")
    row = F.to_json(F.struct(F.col("example_id").cast("string").alias("id"), F.col("tokens").alias("token"), "subj_start", "subj_end", "obj_start", "obj_end", "relation"))
    d.groupBy(F.pmod("example_id", F.lit(64)).alias("part")).agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list(row)), F.lit("]")).alias("value")).write.partitionBy("part").text(path)
    return R.tacred(spark, f"{path}/*/*.txt").select("id", F.size("tokens").alias("n_tokens"), "hs", "he", "ts", "te", "relation")


@query("source_fewrel", """select relation, len(tokens) as n_tokens, list_min(flatten(h.positions)) as hs, list_max(flatten(h.positions)) + 1 as he, list_min(flatten(t.positions)) as ts, list_max(flatten(t.positions)) + 1 as te
 from fewrel_examples where tokens is not null and relation is not null""")  # fmt: skip
def fewrel(spark, sf_dir):
    """Examples as one JSON object a relation and back."""
    path = _folder(spark, "fewrel")
    d = table(spark, sf_dir, "fewrel_examples").where("tokens is not null and relation is not null")
    text = lambda x: F.to_json(F.struct(x.alias("v")))
    bare = lambda x: F.regexp_replace(text(x), r'^\{"v":|\}$', "")
    ends = lambda c: F.concat(F.lit("["), F.coalesce(bare(F.col(f"{c}.ent_name")), F.lit('""')), F.lit(',""'), F.lit(","), bare(F.col(f"{c}.positions")), F.lit("]"))
    row = F.concat(F.lit('{"tokens":'), bare(F.col("tokens")), F.lit(',"h":'), ends("h"), F.lit(',"t":'), ends("t"), F.lit("}"))
    d.groupBy("relation").agg(F.concat(F.lit("{"), bare(F.first("relation")), F.lit(":["), F.concat_ws(",", F.collect_list(row)), F.lit("]}")).alias("value")).withColumn("part", F.md5("relation")).select("value", "part").write.partitionBy("part").text(path)
    return R.fewrel(spark, f"{path}/*/*.txt").select("relation", F.size("tokens").alias("n_tokens"), "hs", "he", "ts", "te")


@query("sink_parquet_by_split", "select split, count(*) as n, count(distinct example_id) as examples from tacred_examples group by split")
def parquet_by_split(spark, sf_dir):
    """A table written with a folder a split, read back."""
    path = _folder(spark, "splits")
    W.parquet_by(table(spark, sf_dir, "tacred_examples"), path, "split")
    return R.parquet(spark, path).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("example_id").alias("examples"))


@query("sink_rebased_shards", """with s as (select o_orderkey % 8 as shard, o_orderkey as k, row_number() over (partition by o_orderkey % 8 order by o_orderkey) - 1 as pos from orders), n as (select shard, count(*) as n from s group by shard),
 b as (select shard, coalesce(sum(n) over (order by shard rows between unbounded preceding and 1 preceding), 0) as moved from n) select shard, k, (pos + moved)::bigint as pos from s join b using (shard)""")  # fmt: skip
def rebased_shards(spark, sf_dir):
    """Positions counted within eight shards, moved to one count over all."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 8).alias("shard"), F.col("o_orderkey").alias("k"))
    local = o.withColumn("at", F.row_number().over(Window.partitionBy("shard").orderBy("k")) - 1).withColumn("one", F.lit(1))
    return W.rebased(local, ["shard"], "one", "at").select("shard", "k", F.col("at").cast("bigint").alias("pos"))


@query("answer_surface_places")
def surface_places(spark, sf_dir):
    """Words of the linked surfaces of each article."""
    d = table(spark, sf_dir, "wiki_articles").withColumn("s", F.transform("annotations", lambda m: F.struct(m["surface_form"].alias("surface"), F.lit(None).cast("string").alias("type"))))
    return R.surface_places(d, "article_id", "text", "s")
