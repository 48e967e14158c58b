"""Queries over relation examples: masking, windows, token clean-up, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import masking as M
from spanloom.plans.registry import query
from spanloom.runtime import table, u01


def _spans(spark, sf_dir):
    """(example_id, tokens, hs, he, ts, te, relation): half-open spans that are disjoint."""
    d = table(spark, sf_dir, "tacred_examples").where("tokens is not null and subj_start is not null and obj_start is not null")
    d = d.select("example_id", "split", "tokens", F.col("subj_start").alias("hs"), (F.col("subj_end") + 1).alias("he"), F.col("obj_start").alias("ts"), (F.col("obj_end") + 1).alias("te"), "relation")
    return d.where("he <= ts or te <= hs")


_S = """s as (select example_id, split, tokens, subj_start as hs, subj_end + 1 as he, obj_start as ts, obj_end + 1 as te, relation from tacred_examples
 where tokens is not null and subj_start is not null and obj_start is not null and (subj_end + 1 <= obj_start or obj_end + 1 <= subj_start)),
u as (select *, ('0x' || substr(md5(concat_ws('|', 'h', example_id)), 1, 8))::bigint / 4294967296.0 < 0.7 as mh, ('0x' || substr(md5(concat_ws('|', 't', example_id)), 1, 8))::bigint / 4294967296.0 < 0.7 as mt from s),
o as (select *, least(hs, ts) as as_, case when hs < ts then he else te end as ae, greatest(hs, ts) as bs, case when hs < ts then te else he end as be from u)"""


def _masked(d):
    return d.withColumn("mh", u01(F.lit("h"), "example_id") < 0.7).withColumn("mt", u01(F.lit("t"), "example_id") < 0.7)


@query("text_start_end_masked", f"""with {_S}, r as (select *, case when mh then ['<blank>'] else tokens[hs + 1:he] end as hr, case when mt then ['<blank>'] else tokens[ts + 1:te] end as tr from o)
 select example_id, array_to_string(list_transform(tokens[1:as_] || case when hs < ts then ['<s_head>'] || hr || ['<e_head>'] else ['<s_tail>'] || tr || ['<e_tail>'] end
 || tokens[ae + 1:bs] || case when hs < ts then ['<s_tail>'] || tr || ['<e_tail>'] else ['<s_head>'] || hr || ['<e_head>'] end || tokens[be + 1:len(tokens)], lambda x: coalesce(x, '~')), ' ') as masked from r""")  # fmt: skip
def start_end(spark, sf_dir):
    d = _masked(_spans(spark, sf_dir))
    out = M.start_end_masked(d, "tokens", ("hs", "he"), ("ts", "te"), F.col("mh"), F.col("mt"))
    return d.select("example_id", F.array_join(F.transform(out, lambda x: F.coalesce(x, F.lit("~"))), " ").alias("masked"))


@query("text_concat_masked", f"""with {_S}, r as (select *, case when mh then ['<blank>'] else tokens[hs + 1:he] end as hr, case when mt then ['<blank>'] else tokens[ts + 1:te] end as tr from o)
 select example_id, array_to_string(list_transform(tokens[1:as_] || case when hs < ts then hr else tr end || tokens[ae + 1:bs] || case when hs < ts then tr else hr end || tokens[be + 1:len(tokens)], lambda x: coalesce(x, '~')), ' ') as masked,
 hs - case when ts < hs and mt then te - ts - 1 else 0 end as head_at, ts - case when hs < ts and mh then he - hs - 1 else 0 end as tail_at from r""")  # fmt: skip
def concat_masked(spark, sf_dir):
    d = _masked(_spans(spark, sf_dir))
    text, h, t = M.concat_masked("tokens", ("hs", "he"), ("ts", "te"), F.col("mh"), F.col("mt"))
    return d.select("example_id", F.array_join(F.transform(text, lambda x: F.coalesce(x, F.lit("~"))), " ").alias("masked"), h.alias("head_at"), t.alias("tail_at"))


@query("text_marker_counts", f"""with {_S} select count(*) as n, count(*) as each_once from u""")
def marker_counts(spark, sf_dir):
    """Every statement has each of the four markers once."""
    d = _masked(_spans(spark, sf_dir))
    d = d.withColumn("m", M.start_end_masked(d, "tokens", ("hs", "he"), ("ts", "te"), F.col("mh"), F.col("mt")))
    once = F.lit(True)
    for x in (M.S_HEAD, M.E_HEAD, M.S_TAIL, M.E_TAIL):
        once = once & (F.size("m") - F.size(F.array_remove("m", x)) == 1)
    return d.agg(F.count("*").alias("n"), F.count_if(once).alias("each_once"))


@query("text_with_bos", f"with {_S} select example_id, len(tokens) + 1 as n, hs + 1 as hs, he + 1 as he, ts + 1 as ts, te + 1 as te from s")
def with_bos(spark, sf_dir):
    d = _spans(spark, sf_dir)
    return d.select("example_id", *M.with_bos("tokens", "hs", "he", "ts", "te")).select("example_id", F.size("tokens").alias("n"), "hs", "he", "ts", "te")


@query("text_without_blank_tokens", f"""with {_S} select example_id, len(list_filter(tokens, lambda x: x is not null and trim(x, ' ') <> '')) as n,
 len(list_filter(tokens[1:hs], lambda x: x is not null and trim(x, ' ') <> '')) as hs, len(list_filter(tokens[1:ts], lambda x: x is not null and trim(x, ' ') <> '')) as ts from s""")  # fmt: skip
def without_blank(spark, sf_dir):
    d = _spans(spark, sf_dir)
    return d.select("example_id", F.size(T.drop_blank("tokens")).alias("n"), T.kept_before("tokens", "hs").alias("hs"), T.kept_before("tokens", "ts").alias("ts"))


@query("text_truncated_windows", f"""with {_S}, w as (select example_id, len(tokens) as n, least(hs, ts) as lo, greatest(he, te) as hi from s), v as (select *, 60 - 1 - (hi - lo) as room from w),
 x as (select *, ceil(room / 2.0) as hr, floor(room / 2.0) as hl from v)
 select example_id, case when room >= 0 then (lo - least(lo, hl + greatest(hr - (n - hi), 0)))::int end as w_start, case when room >= 0 then (hi + least(n - hi, hr + greatest(hl - lo, 0)))::int end as w_end from x""")  # fmt: skip
def truncated_windows(spark, sf_dir):
    d = _spans(spark, sf_dir).withColumn("lo", F.least("hs", "ts")).withColumn("hi", F.greatest("he", "te"))
    s, e = M.truncated(d, "tokens", "lo", "hi", 60)
    return d.select("example_id", s.alias("w_start"), e.alias("w_end"))


@query("text_fewrel_extents", """select example_id, least(list_min(list_transform(h.positions, lambda p: list_min(p))), list_min(list_transform(t.positions, lambda p: list_min(p)))) as first_place,
 list_max(list_transform(h.positions, lambda p: list_max(p))) + 1 as head_end, list_max(list_transform(t.positions, lambda p: list_max(p))) + 1 as tail_end from fewrel_examples""")  # fmt: skip
def fewrel_extents(spark, sf_dir):
    d = table(spark, sf_dir, "fewrel_examples")
    lo = lambda c: F.array_min(F.transform(c, lambda p: F.array_min(p)))
    hi = lambda c: F.array_max(F.transform(c, lambda p: F.array_max(p))) + 1
    return d.select("example_id", F.least(lo("h.positions"), lo("t.positions")).alias("first_place"), hi("h.positions").alias("head_end"), hi("t.positions").alias("tail_end"))


@query("text_name_spelling", """select example_id, replace(replace(replace(replace(lower(h.ent_name), '’', ''''), '–', '-'), '—', '-'), ' ', '') = replace(lower(array_to_string(list_transform(h.positions[1], lambda i: tokens[i + 1]), ' ')), ' ', '') as same
 from fewrel_examples where h.ent_name is not null and tokens is not null""")  # fmt: skip
def name_spelling(spark, sf_dir):
    """Is the head's name spelt as its first mention?"""
    d = table(spark, sf_dir, "fewrel_examples").where("h.ent_name is not null and tokens is not null")
    words = F.array_join(F.transform(F.element_at("h.positions", 1), lambda i: F.get("tokens", i)), " ")
    return d.select("example_id", (T.plain_punctuation("h.ent_name") == F.replace(F.lower(words), F.lit(" "), F.lit(""))).alias("same"))


@query("text_padded", "select example_id, tokens || list_resize([]::varchar[], greatest(0, 64 - len(tokens))::bigint, '<pad>') as padded from fewrel_examples where tokens is not null")
def padded(spark, sf_dir):
    return table(spark, sf_dir, "fewrel_examples").where("tokens is not null").select("example_id", T.pad("tokens", 64).alias("padded"))


@query("text_decoded", "select example_id, array_to_string(list_filter(tokens, lambda x: x is not null), ' ') as text from fewrel_examples where tokens is not null")
def decoded(spark, sf_dir):
    return table(spark, sf_dir, "fewrel_examples").where("tokens is not null").select("example_id", M.decoded("tokens").alias("text"))


@query("text_label_index", "select relation, list_sort(list(example_id)) as ids from tacred_examples where relation is not null group by relation")
def label_index(spark, sf_dir):
    return table(spark, sf_dir, "tacred_examples").where("relation is not null").groupBy("relation").agg(F.sort_array(F.collect_list("example_id")).alias("ids"))


@query("text_label_ids", "select example_id, label_id from tacred_examples join (select label_id, relation from relation_labels where source = 'tacred') using (relation) union all select example_id, label_id from fewrel_examples join (select label_id, relation from relation_labels where source = 'fewrel') using (relation)")
def label_ids(spark, sf_dir):
    """One label dimension for all splits."""
    labels = table(spark, sf_dir, "relation_labels")
    one = lambda name: table(spark, sf_dir, f"{name}_examples").select("example_id", "relation").join(labels.where(F.col("source") == name).select("label_id", "relation"), "relation").select("example_id", "label_id")
    return one("tacred").unionByName(one("fewrel"))


@query("text_mention_places", "select mention_id, len(list_filter(range(0, length(text) - length(surface_form) + 1), lambda i: substr(text, (i + 1)::bigint, length(surface_form)) = surface_form)) as n from (select mention_id, article_id, surface_form from wiki_mentions where length(surface_form) between 6 and 400 and layer = 'annotations') join (select article_id, text from wiki_articles where length(text) between 400 and 900) using (article_id)")
def mention_places(spark, sf_dir):
    """How often an article of middling length holds a link's spelling, overlaps included."""
    a = table(spark, sf_dir, "wiki_articles").where(F.length("text").between(400, 900)).select("article_id", "text")
    m = table(spark, sf_dir, "wiki_mentions").where((F.length("surface_form").between(6, 400)) & (F.col("layer") == "annotations")).select("mention_id", "article_id", "surface_form")
    return m.join(a, "article_id").select("mention_id", F.size(T.find_all("text", "surface_form")).alias("n"))


@query("text_relation_ids_by_key_order", "select relation, row_number() over (order by relation) - 1 as label from (select distinct relation from fewrel_examples where relation is not null)")
def relation_ids(spark, sf_dir):
    from spanloom.operators.prep import ordered_ids

    return ordered_ids(table(spark, sf_dir, "fewrel_examples").where("relation is not null").select("relation").distinct(), [F.asc("relation")], "label").select("relation", "label")


@query("text_mentions_zipped", "select example_id, relation, len(tokens) as n_tokens, label_id from tacred_examples left join (select label_id, relation from relation_labels where source = 'tacred') using (relation)")
def mentions_zipped(spark, sf_dir):
    """Named parts of a sample side by side, by key."""
    d = table(spark, sf_dir, "tacred_examples")
    labels = table(spark, sf_dir, "relation_labels").where("source = 'tacred'").select("label_id", "relation")
    return d.select("example_id", "relation", F.when(F.col("tokens").isNotNull(), F.size("tokens")).alias("n_tokens")).join(labels, "relation", "left")


_OTHER = "(('0x' || substr(md5(concat_ws('|', '{}', example_id)), 1, 8))::bigint / 4294967296.0 < 0.7)"


@query("text_other_mentions_masked", f"""with d as (select example_id, tokens, h.positions as hp, t.positions as tp, {_OTHER.format('h')} as mh, {_OTHER.format('t')} as mt from fewrel_examples where tokens is not null and len(h.positions) > 0 and len(t.positions) > 0),
 m as (select example_id, 0 as g, unnest(range(0, len(hp))) as k, unnest(hp) as p, mh as mask from d union all select example_id, 1, unnest(range(0, len(tp))), unnest(tp), mt from d),
 sp as (select example_id, g, k, list_min(p) as s, list_max(p) + 1 as e from m where mask),
 w as (select example_id, unnest(range(0, len(tokens))) as i, unnest(tokens) as tok from d),
 b as (select w.example_id, w.i, w.tok, arg_min(s, (g, k)) as s, min(g) as g, arg_min(k, (g, k)) as k from w left join sp on sp.example_id = w.example_id and w.i >= sp.s and w.i < sp.e group by w.example_id, w.i, w.tok),
 o as (select example_id, i, case when s is null then coalesce(tok, '~') when s = i then case when k = 0 then '<blank>' when g = 0 then '<blank_head_other>' else '<blank_tail_other>' end end as out from b)
 select example_id, string_agg(out, ' ' order by i) as masked from o where out is not null group by example_id""")  # fmt: skip
def other_masked(spark, sf_dir):
    """A masked entity's first mention becomes a blank and all its others that entity's other blank."""
    d = table(spark, sf_dir, "fewrel_examples").where("tokens is not null and size(h.positions) > 0 and size(t.positions) > 0")
    spans = lambda c: F.transform(c, lambda p: F.struct(F.array_min(p).alias("s"), (F.array_max(p) + 1).alias("e")))
    mask = lambda x: u01(F.lit(x), "example_id") < 0.7
    out = M.other_mentions_masked("tokens", [(spans("h.positions"), mask("h"), M.BLANK, M.BLANK_HEAD_OTHER), (spans("t.positions"), mask("t"), M.BLANK, M.BLANK_TAIL_OTHER)])
    return d.select("example_id", F.array_join(F.transform(out, lambda x: F.coalesce(x, F.lit("~"))), " ").alias("masked"))
