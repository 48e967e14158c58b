"""Reports on predictions: confusion counts, F1, accuracy, losses, and the ranking of rule probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(preds: DataFrame, target: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """(by..., label, tp, fp, fn) per label: one pass, every row giving at most two label counts."""
    by = by or []
    hit = F.col(target) == F.col(pred)
    rows = preds.where(F.col(target).isNotNull() & F.col(pred).isNotNull()).select(*by, F.explode(F.when(hit, F.array(F.struct(F.col(target).alias("label"), F.lit(1).alias("tp"), F.lit(0).alias("fp"), F.lit(0).alias("fn")))).otherwise(F.array(F.struct(F.col(target).alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.lit(1).alias("fn")), F.struct(F.col(pred).alias("label"), F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn"))))).alias("x"))
    return rows.groupBy(*by, "x.label").agg(F.sum("x.tp").alias("tp"), F.sum("x.fp").alias("fp"), F.sum("x.fn").alias("fn"))


def f1(tp, fp, fn) -> Column:
    """F1 with 0 where nothing is predicted or nothing is there."""
    tp, fp, fn = (F.col(x) if isinstance(x, str) else x for x in (tp, fp, fn))
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def micro_f1(counts: DataFrame, ignore: Column | None = None, by: list[str] | None = None) -> DataFrame:
    kept = counts.where(~ignore) if ignore is not None else counts
    sums = kept.groupBy(*(by or [])).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return sums.select(*(by or []), f1("tp", "fp", "fn").alias("micro_f1"))


def macro_f1(counts: DataFrame, group: Column, ignore: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """Mean F1 over groups of labels (each label, or a relation with its inverse), counts of a group added up first."""
    by = by or []
    kept = counts.where(~ignore) if ignore is not None else counts
    sums = kept.groupBy(*by, group.alias("__g")).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return sums.groupBy(*by).agg(F.avg(f1("tp", "fp", "fn")).alias("macro_f1"))


def accuracy(preds: DataFrame, target: str, pred: str, by: list[str] | None = None) -> DataFrame:
    return preds.where(F.col(target).isNotNull() & F.col(pred).isNotNull()).groupBy(*(by or [])).agg(F.avg((F.col(target) == F.col(pred)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def log_loss(probs: Column, eps: float = 1e-12) -> Column:
    """Mean of -ln p, p kept off 0 and 1."""
    return F.avg(-F.ln(F.least(F.greatest(probs, F.lit(eps)), F.lit(1 - eps))))


def ranked(scores: DataFrame, score: str, tie: list[str], by: list[str] | None = None) -> DataFrame:
    """Adds rank, from 0, by descending score within `by`; without `by` the order is global and the ranks come from range partitions."""
    if by:
        return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *tie)) - 1)
    from spanloom.operators.prep import ordered_ids

    return ordered_ids(scores, [F.desc(score), *[F.asc(t) for t in tie]], "rank")


def length_bins(df: DataFrame, length: str, by: list[str] | None = None) -> DataFrame:
    """Adds cluster: bins at mean + 0.5 k sd for k = -3..3, open below and closed above, empty ones left out and the rest numbered from 0."""
    stats = df.groupBy(*(by or [])).agg(F.avg(length).alias("__m"), F.stddev_pop(length).alias("__sd"))
    joined = df.join(F.broadcast(stats), by) if by else df.crossJoin(F.broadcast(stats))
    raw = sum(((F.col(length) > F.col("__m") + 0.5 * k * F.col("__sd")).cast("int") for k in range(-3, 4)), F.lit(0))
    with_bin = joined.withColumn("__bin", raw).drop("__m", "__sd")
    used = with_bin.select(*(by or []), "__bin").distinct()
    order = Window.partitionBy(*by).orderBy("__bin") if by else Window.orderBy("__bin")
    numbered = used.withColumn("cluster", F.row_number().over(order) - 1)  # at most 8 rows a group
    return with_bin.join(F.broadcast(numbered), [*(by or []), "__bin"]).drop("__bin")
