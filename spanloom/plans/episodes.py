"""Queries of few-shot episodes and rule probes. Positive rules are made up: targets by hash of the evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.operators import episodes as E
from spanloom.operators.metrics import ranked
from spanloom.plans.registry import query
from spanloom.runtime import table, u01


def _u(*xs: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(xs)})), 1, 8))::bigint / 4294967296.0)"


def _fewrel(spark, sf_dir):
    return table(spark, sf_dir, "fewrel_examples").where("relation is not null").select("example_id", "relation")


@query("episode_few_shot", f"""with r as (select relation as lab, example_id, row_number() over (partition by relation order by example_id) - 1 as no from fewrel_examples where relation is not null),
 l as (select lab, count(*) as size, row_number() over (order by md5(concat_ws('|', 1, lab)), lab) - 1 as ring from r group by lab), n as (select count(*) as n from l),
 w as (select r.example_id as target, w.way, (l.ring + w.way) % n as ring from r join l using (lab), n, (select unnest(range(0, 5)) as way) w where w.way < n),
 s as (select target, way, shot, lab, floor({_u('1', 'target', 'way', 'shot')} * size)::bigint as no from w join l using (ring), (select unnest(range(0, 2)) as shot))
 select target, way, shot, lab, example_id as exemplar from s join r using (lab, no)""")  # fmt: skip
def few_shot(spark, sf_dir):
    """5-way 2-shot."""
    return E.episodes(_fewrel(spark, sf_dir), "example_id", "relation", 5, 2)


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "relation_labels").where("source = 'tacred'").select("label_id")


def _positives(spark, sf_dir):
    lab = _labels(spark, sf_dir)
    pairs = lab.select(F.col("label_id").alias("ev1")).crossJoin(lab.select(F.col("label_id").alias("ev2")))
    n = lab.agg(F.count("*").alias("n"))
    return pairs.where(u01(F.lit("r"), "ev1", "ev2") < 0.1).crossJoin(n).select(F.floor(u01(F.lit("t"), "ev1", "ev2") * F.col("n")).cast("int").alias("target"), "ev1", "ev2")


_R = f"""lab as (select label_id from relation_labels where source = 'tacred'), n as (select count(*) as n from lab),
pos as (select floor({_u("'t'", 'ev1', 'ev2')} * n)::int as target, ev1, ev2 from (select a.label_id as ev1, b.label_id as ev2 from lab a, lab b), n where {_u("'r'", 'ev1', 'ev2')} < 0.1),
space as (select a.label_id as target, b.label_id as ev1, c.label_id as ev2 from lab a, lab b, lab c where (a.label_id, b.label_id, c.label_id) not in (select target, ev1, ev2 from pos))"""


@query("probe_rule_space", f"with {_R} select target, ev1, ev2 from space")
def rule_space(spark, sf_dir):
    return E.rule_space(_labels(spark, sf_dir), _positives(spark, sf_dir))


_STRONG = f"""{_R}, own as (select ev1, ev2, min(target) as of_target from pos group by 1, 2),
strong as (select of_target, target, ev1, ev2 from (select own.of_target, s.*, row_number() over (partition by ev1, ev2 order by md5(concat_ws('|', 1, s.target, ev1, ev2)), s.target) as r from space s join own using (ev1, ev2)) where r <= 10)"""


@query("probe_strong_negatives", f"with {_STRONG} select of_target, target, ev1, ev2 from strong")
def strong(spark, sf_dir):
    return E.strong_rules(_positives(spark, sf_dir), E.rule_space(_labels(spark, sf_dir), _positives(spark, sf_dir)), 10)


_ALL = f"""{_STRONG}, allr as (select target, ev1, ev2, 'positive' as category from pos union all select target, ev1, ev2, 'strong' from strong),
sc as (select target, ev1, ev2, category, round(({' + '.join(_u('1', 'target', 'ev1', 'ev2', str(i)) for i in range(1, 5))}) / 4, 9) as mean_score from allr),
rk as (select *, row_number() over (order by mean_score desc, target, ev1, ev2) - 1 as rank from sc)"""


def _ranked(spark, sf_dir):
    pos = _positives(spark, sf_dir)
    rules = pos.withColumn("category", F.lit("positive")).unionByName(strong(spark, sf_dir).drop("of_target").withColumn("category", F.lit("strong")))
    scored = E.probe_scores(rules, 4).join(rules, ["target", "ev1", "ev2"])
    return ranked(scored, "mean_score", ["target", "ev1", "ev2"])


@query("probe_ranks", f"with {_ALL} select target, ev1, ev2, category, mean_score, rank from rk")
def ranks(spark, sf_dir):
    return _ranked(spark, sf_dir)


@query("probe_category_report", f"with {_ALL} select category, count(*) as n, round(avg(mean_score), 8) as mean_score, round(avg(rank), 6) as mean_rank, count(*) filter (rank < 100) as top_100, count(*) filter (rank >= (select count(*) from rk) - 100) as bottom_100, round(100.0 * count(*) filter (rank < 100) / count(*), 6) as top_share from rk group by category")
def category_report(spark, sf_dir):
    r = _ranked(spark, sf_dir)
    total = r.agg(F.count("*").alias("all"))
    return r.crossJoin(F.broadcast(total)).groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("mean_score"), 8).alias("mean_score"), F.round(F.avg("rank"), 6).alias("mean_rank"), F.count_if(F.col("rank") < 100).alias("top_100"), F.count_if(F.col("rank") >= F.col("all") - 100).alias("bottom_100"), F.round(100.0 * F.count_if(F.col("rank") < 100) / F.count("*"), 6).alias("top_share"))


@query("probe_rank_in_evidence", f"with {_ALL} select ev1, ev2, target, row_number() over (partition by ev1, ev2 order by mean_score desc, target) - 1 as rank from rk")
def rank_in_evidence(spark, sf_dir):
    return ranked(_ranked(spark, sf_dir).drop("rank"), "mean_score", ["target"], ["ev1", "ev2"]).select("ev1", "ev2", "target", "rank")


@query("probe_top_and_bottom", f"with {_ALL} select part, target, ev1, ev2 from ((select 'top' as part, target, ev1, ev2 from rk order by rank limit 50) union all (select 'bottom', target, ev1, ev2 from rk order by rank desc limit 50))")
def top_and_bottom(spark, sf_dir):
    r = _ranked(spark, sf_dir)
    one = lambda o, name: r.orderBy(o).limit(50).select(F.lit(name).alias("part"), "target", "ev1", "ev2")
    return one(F.asc("rank"), "top").unionByName(one(F.desc("rank"), "bottom"))


@query("probe_report_lines", f"with {_ALL} select rank, concat_ws(' ', '<<<' || target || '>>>', ev1, ev2, format('{{:.3f}}', mean_score)) as line from rk")
def report_lines(spark, sf_dir):
    return _ranked(spark, sf_dir).select("rank", F.concat_ws(" ", F.concat(F.lit("<<<"), F.col("target").cast("string"), F.lit(">>>")), "ev1", "ev2", F.format_string("%.3f", "mean_score")).alias("line"))


@query("probe_consecutive_labels", "select sent, label from (select *, lag(label) over (order by sent) as p from (select l_orderkey as sent, min(l_returnflag) as label from lineitem group by 1)) where p is null or p <> label")
def consecutive_labels(spark, sf_dir):
    """Orders whose label differs from the order before: windows within ranges of keys, with the last of each range carried over."""
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sent")).agg(F.min("l_returnflag").alias("label"))
    block = F.floor(F.col("sent") / 4096)
    with_lag = d.withColumn("b", block).withColumn("p", F.lag("label").over(Window.partitionBy("b").orderBy("sent")))
    heads = with_lag.where("p is null").select("b", "sent", "label")
    lasts = d.withColumn("b", block).groupBy("b").agg(F.max_by("label", "sent").alias("last"))
    prev = lasts.withColumn("nb", F.lead("b").over(Window.orderBy("b"))).select(F.col("nb").alias("b"), F.col("last").alias("p"))  # one row a block
    first = heads.join(F.broadcast(prev), "b", "left").select("sent", "label", "p")
    return with_lag.where("p is not null").select("sent", "label", "p").unionByName(first).where("p is null or p <> label").select("sent", "label")
