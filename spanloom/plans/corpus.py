"""Queries of corpus preparation, over linked articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import prep as P
from spanloom.operators.intervals import overlap_join, stabbing, sweep_disjoint
from spanloom.plans.registry import query
from spanloom.runtime import table


def _articles(spark, sf_dir):
    return table(spark, sf_dir, "wiki_articles")


def _x(col: str) -> str:
    return f"(select article_id, generate_subscripts({col}, 1) - 1 as idx, unnest({col}) as m from wiki_articles)"


def _wf(col: str) -> str:
    return f"""(select article_id, idx, uri, trim(sf, ' ') as surface_form, st + length(sf) - length(ltrim(sf, ' ')) as start, st + length(sf) - length(ltrim(sf, ' ')) + length(trim(sf, ' ')) as "end"
 from (select article_id, idx, m.uri as uri, m.surface_form as sf, cast(m.char_offset as bigint) as st from {_x(col)})
 where uri is not null and sf is not null and st is not null and not contains(sf, chr(160)) and not contains(uri, chr(10)) and length(trim(sf, ' ')) > 0)"""


@query("corpus_exploded_mentions", f"""select article_id, 'annotations' as layer, idx, m.uri as uri, m.surface_form as surface_form, cast(m.char_offset as bigint) as start from {_x('annotations')} where m.surface_form is not null and m.char_offset is not null
 union all select article_id, 'el', idx, m.uri, m.surface_form, cast(m.char_offset as bigint) from {_x('el')} where m.surface_form is not null and m.char_offset is not null""")  # fmt: skip
def exploded_mentions(spark, sf_dir):
    a = _articles(spark, sf_dir)
    return P.merged(P.exploded(a, "annotations"), P.exploded(a, "el"))


@query("corpus_well_formed_mentions", f"select * from {_wf('annotations')}")
def well_formed(spark, sf_dir):
    return P.well_formed(P.exploded(_articles(spark, sf_dir), "annotations"))


_HUMAN = f"h as (select * from {_wf('annotations')}), l as (select * from {_wf('el')}), own as (select article_id, split_part(url, '/', -1) as uri from wiki_articles)"


@query("corpus_linker_backed_by_human", f"with {_HUMAN} select * from l where (article_id, uri) in (select article_id, uri from h union select article_id, uri from own where uri is not null)")
def backed(spark, sf_dir):
    a = _articles(spark, sf_dir)
    return P.backed_by_human(P.well_formed(P.exploded(a, "el")), P.well_formed(P.exploded(a, "annotations")), a)


@query("corpus_linker_clear_of_human", f"""with {_HUMAN} select * from l where not exists (select 1 from h where h.article_id = l.article_id and h.start < l."end" and l.start < h."end")""")
def clear(spark, sf_dir):
    a = _articles(spark, sf_dir)
    return P.clear_of(P.well_formed(P.exploded(a, "el")), P.well_formed(P.exploded(a, "annotations")))


def _sweep_sql(source: str, name: str) -> str:
    return f"""{name}_o as (select *, row_number() over (partition by article_id order by start, idx) as rn from {source}),
{name}_r as (select article_id, idx, uri, surface_form, start, "end", rn, "end" as until, true as keep from {name}_o where rn = 1
 union all select o.article_id, o.idx, o.uri, o.surface_form, o.start, o."end", o.rn, case when o.start >= r.until then o."end" else r.until end, o.start >= r.until
 from {name}_r r join {name}_o o on o.article_id = r.article_id and o.rn = r.rn + 1),
{name} as (select article_id, idx, uri, surface_form, start, "end" from {name}_r where keep)"""


@query("corpus_disjoint_mentions", f"with recursive l as (select * from {_wf('el')}), {_sweep_sql('l', 'k')} select * from k")
def disjoint(spark, sf_dir):
    return sweep_disjoint(P.well_formed(P.exploded(_articles(spark, sf_dir), "el")), ["article_id"], "start", "end", ["idx"])


_CLEAN = f"""with recursive h0 as (select * from {_wf('annotations')}), {_sweep_sql('h0', 'h')}, own as (select article_id, split_part(url, '/', -1) as uri from wiki_articles),
l0 as (select * from {_wf('el')}), l1 as (select * from l0 where (article_id, uri) in (select article_id, uri from h union select article_id, uri from own where uri is not null)
 and not exists (select 1 from h where h.article_id = l0.article_id and h.start < l0."end" and l0.start < h."end")), {_sweep_sql('l1', 'k')},
c as (select *, 'annotations' as layer from h union all select *, 'el' from k)"""


@query("corpus_clean_mentions", _CLEAN + " select * from c")
def clean(spark, sf_dir):
    return P.clean_mentions(_articles(spark, sf_dir))


@query("corpus_vocabulary", _CLEAN + " select row_number() over (order by count(*) desc, uri) - 1 as entity_id, uri as symbol, count(*) as cnt from c group by uri having count(*) >= 3")
def vocabulary(spark, sf_dir):
    return P.vocabulary(P.clean_mentions(_articles(spark, sf_dir)), 3)


@query("corpus_known_mentions", _CLEAN + " select c.article_id, c.layer, c.idx, d.entity_id from c join entity_dict d on c.uri = d.symbol")
def known(spark, sf_dir):
    vocab = table(spark, sf_dir, "entity_dict").select("entity_id", F.col("symbol").alias("uri"))
    return P.clean_mentions(_articles(spark, sf_dir)).join(vocab, "uri").select("article_id", "layer", "idx", "entity_id")


_SENT = """sp as (select article_id, string_split(regexp_replace(replace(text, chr(13), chr(10)), '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)) as parts from wiki_articles where text is not null),
sx as (select article_id, generate_subscripts(parts, 1) - 1 as sent_no, unnest(parts) as sentence from sp),
sents as (select * from (select article_id, sent_no, s_start, s_start + length(sentence) as s_end, sentence from (
 select *, cast(coalesce(sum(length(sentence) + 1) over (partition by article_id order by sent_no rows between unbounded preceding and 1 preceding), 0) as bigint) as s_start from sx)) where trim(sentence, ' ') <> '')"""


@query("corpus_simple_sentences", f"with {_SENT} select * from sents")
def simple_sentences(spark, sf_dir):
    return P.simple_sentences(_articles(spark, sf_dir))


_PLACED = f"""{_CLEAN}, {_SENT}, placed as (select c.*, s.sent_no, s.s_start, s.s_end, c.start >= s.s_start and c."end" <= s.s_end as inside
 from c join sents s on s.article_id = c.article_id and c.start < s.s_end and s.s_start < c."end")"""


@query("corpus_mentions_in_sentences", _PLACED + " select article_id, layer, idx, sent_no, inside, start - s_start as local_start from placed")
def mentions_in_sentences(spark, sf_dir):
    a = _articles(spark, sf_dir)
    placed = P.in_sentences(P.clean_mentions(a), P.simple_sentences(a))
    return placed.select("article_id", "layer", "idx", "sent_no", "inside", (F.col("start") - F.col("s_start")).alias("local_start"))


@query("corpus_rich_sentences", _PLACED + " select article_id, sent_no, count(distinct uri) as n_entities, count(*) as n_mentions from placed where inside group by 1, 2 having count(distinct uri) >= 2")
def rich_sentences(spark, sf_dir):
    a = _articles(spark, sf_dir)
    return P.rich_sentences(P.in_sentences(P.clean_mentions(a), P.simple_sentences(a)))


@query("corpus_filter_counters", _PLACED + f""", raw as (select count(*) as n from {_x('annotations')}), rawl as (select count(*) as n from {_x('el')}), wfl as (select count(*) as n from l0)
 select (select n from raw) as human_in, (select count(*) from h0) as human_well_formed, (select count(*) from h) as human_disjoint, (select n from rawl) as linker_in, (select n from wfl) as linker_well_formed,
 (select count(*) from l1) as linker_agreeing, (select count(*) from k) as linker_disjoint, (select count(*) from placed where inside) as inside, (select count(*) from placed where not inside) as crossing""")  # fmt: skip
def filter_counters(spark, sf_dir):
    a = _articles(spark, sf_dir)
    out = a.agg(F.coalesce(F.sum(F.when(F.size("annotations") > 0, F.size("annotations"))), F.lit(0)).alias("human_in"), F.coalesce(F.sum(F.when(F.size("el") > 0, F.size("el"))), F.lit(0)).alias("linker_in"))
    h0 = P.well_formed(P.exploded(a, "annotations"))
    h = sweep_disjoint(h0, ["article_id"], "start", "end", ["idx"])
    l0 = P.well_formed(P.exploded(a, "el"))
    l1 = P.clear_of(P.backed_by_human(l0, h, a), h)
    k = sweep_disjoint(l1, ["article_id"], "start", "end", ["idx"])
    placed = P.in_sentences(P.merged(h, k), P.simple_sentences(a))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    for one in (n(h0, "human_well_formed"), n(h, "human_disjoint"), n(l0, "linker_well_formed"), n(l1, "linker_agreeing"), n(k, "linker_disjoint"), placed.agg(F.count_if("inside").alias("inside"), F.count_if(~F.col("inside")).alias("crossing"))):
        out = out.crossJoin(one)
    return out


_WM = "(select mention_id, article_id, layer, surface_form, cast(char_offset as bigint) as start, cast(char_offset as bigint) + length(surface_form) as \"end\" from wiki_mentions where surface_form <> '' and char_offset is not null)"


def _delivered(spark, sf_dir):
    m = table(spark, sf_dir, "wiki_mentions").where("surface_form <> '' and char_offset is not null")
    return m.select("mention_id", "article_id", "layer", "surface_form", F.col("char_offset").cast("long").alias("start"), (F.col("char_offset").cast("long") + F.length("surface_form")).alias("end"))


@query("corpus_stabbed_blocks", f"""with {_SENT}, w as {_WM} select s.article_id, s.sent_no, w.mention_id, greatest(w.start - s.s_start, 0) as clip_start, least(w."end", s.s_end) - s.s_start as clip_end
 from sents s join w on w.article_id = s.article_id and w."end" > s.s_start and w.start < s.s_end""")  # fmt: skip
def stabbed_blocks(spark, sf_dir):
    """Mentions of every block, clipped to it, by the binned interval join."""
    from spanloom.functions.spans import clip_end, clip_start

    blocks = P.simple_sentences(_articles(spark, sf_dir)).select("article_id", "sent_no", "s_start", "s_end")
    hit = stabbing(_delivered(spark, sf_dir).select("article_id", "mention_id", "start", "end"), blocks, ["article_id"], ("start", "end"), ("s_start", "s_end"), 256)
    return hit.select("article_id", "sent_no", "mention_id", clip_start("start", "s_start").alias("clip_start"), clip_end("end", "s_start", "s_end").alias("clip_end"))


@query("corpus_layer_overlaps", f"""with w as {_WM} select a.mention_id as human_id, b.mention_id as linker_id from w a join w b on a.article_id = b.article_id and a.layer = 'annotations' and b.layer = 'el' and a.start < b."end" and b.start < a."end" """)
def layer_overlaps(spark, sf_dir):
    w = _delivered(spark, sf_dir)
    a = w.where("layer = 'annotations'").select("article_id", F.col("mention_id").alias("human_id"), "start", "end")
    b = w.where("layer = 'el'").select("article_id", F.col("mention_id").alias("linker_id"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    return overlap_join(a, b, ["article_id"], ("start", "end"), ("l_start", "l_end"), "inner", 128).select("human_id", "linker_id")


@query("corpus_latest_mentions", "select mention_id, arg_max(article_id, ingested_at) as article_id, count(*) as deliveries from wiki_mentions group by mention_id")
def latest_mentions(spark, sf_dir):
    return table(spark, sf_dir, "wiki_mentions").groupBy("mention_id").agg(F.max_by("article_id", "ingested_at").alias("article_id"), F.count("*").alias("deliveries"))


@query("corpus_uri_counts", "select uri, count(*) as n, count(distinct article_id) as n_articles from wiki_mentions where uri is not null group by uri order by n desc, uri limit 100")
def uri_counts(spark, sf_dir):
    m = table(spark, sf_dir, "wiki_mentions").where("uri is not null").groupBy("uri").agg(F.count("*").alias("n"), F.count_distinct("article_id").alias("n_articles"))
    return m.orderBy(F.desc("n"), "uri").limit(100)


@query("corpus_squeezed_offsets", r"""select mention_id, length(regexp_replace(left(text, char_offset), ' {2,}', ' ', 'g')) as squeezed, len(string_split(left(text, char_offset), ' ')) - 1 as word from wiki_mentions join (select article_id, text from wiki_articles where text is not null) using (article_id) where char_offset >= 0""")
def squeezed_offsets(spark, sf_dir):
    a = _articles(spark, sf_dir).where("text is not null").select("article_id", "text")
    m = table(spark, sf_dir, "wiki_mentions").where("char_offset >= 0").join(a, "article_id")
    return m.select("mention_id", T.squeezed_offset("text", "char_offset").alias("squeezed"), T.word_index("text", "char_offset").alias("word"))


@query("corpus_titles_of_urls", "select article_id, split_part(url, '/', -1) as slug, replace(split_part(url, '/', -1), '_', ' ') as title from wiki_articles where url is not null")
def titles(spark, sf_dir):
    return _articles(spark, sf_dir).where("url is not null").select("article_id", T.last_segment("url").alias("slug"), F.replace(T.last_segment("url"), F.lit("_"), F.lit(" ")).alias("title"))
