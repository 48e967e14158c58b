"""Queries of evaluation reports. Predictions are made up from a hash: right in two of three cases, else another label."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import metrics as X
from spanloom.plans.registry import query
from spanloom.runtime import table, u01


def _preds(spark, sf_dir):
    labels = table(spark, sf_dir, "relation_labels").where("source = 'tacred'").select(F.col("label_id").alias("target"), "relation")
    d = table(spark, sf_dir, "tacred_examples").where("relation is not null").join(labels, "relation")
    n = F.lit(42)
    wrong = F.floor(u01(F.lit("w"), "example_id") * n).cast("int")
    return d.select("example_id", "split", "target", F.when(u01(F.lit("p"), "example_id") < 2 / 3, F.col("target")).otherwise(wrong).alias("pred"), u01(F.lit("q"), "example_id").alias("p"))


def _u(tag: str, key: str = "example_id") -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{tag}', {key})), 1, 8))::bigint / 4294967296.0)"


_P = f"""p as (select example_id, split, label_id as target, case when {_u('p')} < 2.0 / 3 then label_id else floor({_u('w')} * 42)::int end as pred, {_u('q')} as p
 from tacred_examples join (select label_id, relation from relation_labels where source = 'tacred') using (relation)),
c as (select label, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from (
 select target as label, (target = pred)::int as tp, 0 as fp, (target <> pred)::int as fn from p union all select pred, 0, 1, 0 from p where target <> pred) group by label),
f as (select *, case when tp + fp > 0 then tp / (tp + fp)::double else 0 end as pr, case when tp + fn > 0 then tp / (tp + fn)::double else 0 end as re from c)"""


@query("report_confusion", f"with {_P} select label, tp, fp, fn from c")
def confusion(spark, sf_dir):
    return X.confusion(_preds(spark, sf_dir), "target", "pred")


@query("report_f1_per_label", f"with {_P} select label, round(case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end, 9) as f1 from f")
def f1_per_label(spark, sf_dir):
    return X.confusion(_preds(spark, sf_dir), "target", "pred").select("label", F.round(X.f1("tp", "fp", "fn"), 9).alias("f1"))


@query("report_micro_f1", f"with {_P}, s as (select sum(tp)::double as tp, sum(fp)::double as fp, sum(fn)::double as fn from c where label <> 0) select round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 9) as micro_f1 from s")
def micro(spark, sf_dir):
    return X.micro_f1(X.confusion(_preds(spark, sf_dir), "target", "pred"), F.col("label") == 0).select(F.round("micro_f1", 9).alias("micro_f1"))


@query("report_macro_f1", f"with {_P} select round(avg(case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end), 9) as macro_f1 from f where label <> 0")
def macro(spark, sf_dir):
    return X.macro_f1(X.confusion(_preds(spark, sf_dir), "target", "pred"), F.col("label"), F.col("label") == 0).select(F.round("macro_f1", 9).alias("macro_f1"))


@query("report_paired_macro_f1", f"""with {_P}, g as (select label // 2 as g, sum(tp)::double as tp, sum(fp)::double as fp, sum(fn)::double as fn from c where label <> 0 group by 1),
 h as (select case when tp + fp > 0 then tp / (tp + fp) else 0 end as pr, case when tp + fn > 0 then tp / (tp + fn) else 0 end as re from g) select round(avg(case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end), 9) as macro_f1 from h""")  # fmt: skip
def paired_macro(spark, sf_dir):
    """A relation and its inverse have one score."""
    return X.macro_f1(X.confusion(_preds(spark, sf_dir), "target", "pred"), F.floor(F.col("label") / 2), F.col("label") == 0).select(F.round("macro_f1", 9).alias("macro_f1"))


@query("report_accuracy", f"with {_P} select split, round(avg((target = pred)::int), 9) as accuracy, count(*) as n, round(avg(-ln(least(greatest(p, 1e-12), 1 - 1e-12))), 9) as log_loss from p group by split")
def accuracy(spark, sf_dir):
    p = _preds(spark, sf_dir)
    acc = X.accuracy(p, "target", "pred", ["split"])
    return acc.join(p.groupBy("split").agg(X.log_loss(F.col("p")).alias("log_loss")), "split").select("split", F.round("accuracy", 9).alias("accuracy"), "n", F.round("log_loss", 9).alias("log_loss"))


@query("report_shard_sums", f"with {_P} select (('0x' || substr(md5(concat_ws('|', 's', example_id)), 1, 1))::int)::int as shard, count(*) as n, count(*) filter (target = pred) as hits from p group by 1")
def shard_sums(spark, sf_dir):
    """Partial counts per shard, to be added up."""
    p = _preds(spark, sf_dir).withColumn("shard", F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("s"), "example_id")), 1, 1), 16, 10).cast("int"))
    return p.groupBy("shard").agg(F.count("*").alias("n"), F.count_if(F.col("target") == F.col("pred")).alias("hits"))


@query("report_weighted_and_pooled", f"""with {_P}, s as (select split, count(*) as n, avg((target = pred)::int) as a, nullif(sum((p < 0.01)::int), 0) as low from p group by split)
 select round(sum(a * n) / sum(n), 9) as pooled, round(avg(a), 9) as plain, round(avg(low), 9) as low_rows from s""")  # fmt: skip
def weighted(spark, sf_dir):
    """The training meter (means weighted by size) beside a plain mean; zeros are left out of the last."""
    s = _preds(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"), F.avg((F.col("target") == F.col("pred")).cast("double")).alias("a"), F.nullif(F.sum((F.col("p") < 0.01).cast("int")), F.lit(0)).alias("low"))
    return s.agg(F.round(F.sum(F.col("a") * F.col("n")) / F.sum("n"), 9).alias("pooled"), F.round(F.avg("a"), 9).alias("plain"), F.round(F.avg("low"), 9).alias("low_rows"))


@query("report_bits_and_perplexity", f"with {_P} select split, round(sum(-ln(greatest(p, 1e-12))) / count(*) / ln(2), 9) as bits, round(pow(2, sum(-ln(greatest(p, 1e-12))) / count(*) / ln(2)), 6) as ppl, count(*) filter (target = 0) as special, count(*) filter (target <> 0) as words from p group by split")
def bits(spark, sf_dir):
    p = _preds(spark, sf_dir)
    b = F.sum(-F.ln(F.greatest("p", F.lit(1e-12)))) / F.count("*") / F.ln(F.lit(2.0))
    return p.groupBy("split").agg(F.round(b, 9).alias("bits"), F.round(F.pow(F.lit(2.0), b), 6).alias("ppl"), F.count_if(F.col("target") == 0).alias("special"), F.count_if(F.col("target") != 0).alias("words"))


@query("report_length_bins", """with l as (select example_id, len(tokens) as n from tacred_examples where tokens is not null), s as (select avg(n) as m, stddev_pop(n) as sd from l),
 b as (select example_id, (n > m - 1.5 * sd)::int + (n > m - sd)::int + (n > m - 0.5 * sd)::int + (n > m)::int + (n > m + 0.5 * sd)::int + (n > m + sd)::int + (n > m + 1.5 * sd)::int as bin from l, s)
 select example_id, dense_rank() over (order by bin) - 1 as cluster from b""")  # fmt: skip
def length_bins(spark, sf_dir):
    d = table(spark, sf_dir, "tacred_examples").where("tokens is not null").select("example_id", F.size("tokens").alias("n"))
    return X.length_bins(d, "n").select("example_id", "cluster")


@query("report_running_best", "select strftime(d, '%Y-%m-%d') as d, v, max(v) over (order by d rows unbounded preceding) as best, row_number() over (partition by g order by d) - 1 as since_best from (select *, count(*) filter (v > coalesce(prev, -1)) over (order by d rows unbounded preceding) as g from (select *, max(v) over (order by d rows between unbounded preceding and 1 preceding) as prev from (select cast(o_orderdate as date) as d, cast(sum(cast(round(o_totalprice * 100) as bigint)) // count(*) as bigint) as v from orders group by 1)))")
def running_best(spark, sf_dir):
    """Best value so far and days since, over one row a day: a series of bounded length."""
    from pyspark.sql import Window

    day = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.expr("sum(cast(round(o_totalprice * 100) as bigint)) div count(*)").alias("v"))
    w = Window.orderBy("d")
    prev = F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = day.withColumn("best", F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("new", (F.col("v") > F.coalesce(prev, F.lit(-1))).cast("int"))
    x = x.withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.select(F.date_format("d", "yyyy-MM-dd").alias("d"), "v", "best", (F.row_number().over(Window.partitionBy("g").orderBy("d")) - 1).alias("since_best"))


@query("report_batch_f1", f"""with {_P}, b as (select *, floor({_u('batch')} * 8)::int as batch from p where target <> 0 or pred <> 0),
 cb as (select batch, label, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from (select batch, target as label, (target = pred)::int as tp, 0 as fp, (target <> pred)::int as fn from b union all select batch, pred, 0, 1, 0 from b where target <> pred) where label <> 0 group by batch, label),
 m as (select batch, sum(tp)::double as tp, sum(fp)::double as fp, sum(fn)::double as fn from cb group by batch), w as (select batch, count(*) as n from b group by batch),
 g as (select batch, n, case when tp + fp > 0 then tp / (tp + fp) else 0 end as pr, case when tp + fn > 0 then tp / (tp + fn) else 0 end as re from m join w using (batch)),
 a as (select sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from m)
 select round((select sum(n * case when pr + re > 0 then 2 * pr * re / (pr + re) else 0 end) / sum(n) from g), 9) as batch_mean, round((select 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) from a), 9) as pooled""")  # fmt: skip
def batch_f1(spark, sf_dir):
    """The training meter, F1 of each batch averaged by the batch's rows, beside the validation meter, F1 of all counts together."""
    p = _preds(spark, sf_dir).where("target <> 0 or pred <> 0").withColumn("batch", F.floor(u01(F.lit("batch"), "example_id") * 8).cast("int"))
    counts = X.confusion(p, "target", "pred", ["batch"])
    none = F.col("label") == 0
    each = X.micro_f1(counts, none, ["batch"]).join(p.groupBy("batch").agg(F.count("*").alias("n")), "batch")
    mean = each.agg(F.round(F.sum(F.col("micro_f1") * F.col("n")) / F.sum("n"), 9).alias("batch_mean"))
    return mean.crossJoin(X.micro_f1(counts, none).select(F.round("micro_f1", 9).alias("pooled")))


@query("report_token_accuracy", f"""with t as (select example_id, unnest(range(0, len(tokens))) as i, unnest(tokens) as tok from fewrel_examples where tokens is not null),
 p as (select (tok is null or trim(tok) = '' or not regexp_matches(tok, '[A-Za-z0-9]')) as special, {_u("'acc'", "example_id, i").replace("''acc''", "'acc'")} as u from t)
 select special, count(*) as n, round(avg((u < 0.75)::int), 9) as accuracy, round(avg(-ln(greatest(u, 1e-12)) / ln(2)), 9) as bits from p group by special""")  # fmt: skip
def token_accuracy(spark, sf_dir):
    """Accuracy and bits of made-up token predictions, for special tokens (blank or without letters and digits) and words apart."""
    t = table(spark, sf_dir, "fewrel_examples").where("tokens is not null").select("example_id", F.posexplode("tokens").alias("i", "tok"))
    special = F.col("tok").isNull() | (F.trim("tok") == "") | ~F.col("tok").rlike("[A-Za-z0-9]")
    u = u01(F.lit("acc"), "example_id", "i")
    return t.groupBy(special.alias("special")).agg(F.count("*").alias("n"), F.round(F.avg((u < 0.75).cast("int")), 9).alias("accuracy"), F.round(F.avg(-F.ln(F.greatest(u, F.lit(1e-12))) / F.ln(F.lit(2.0))), 9).alias("bits"))
