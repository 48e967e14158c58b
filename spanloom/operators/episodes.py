"""Few-shot episodes and relation-rule probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.runtime import hkey, u01


def episodes(rows: DataFrame, key: str, label: str, n_way: int, n_shot: int, seed: int = 1) -> DataFrame:
    """(target, way, shot, exemplar): for each row its own label as way 0 and n_way - 1 others, each with n_shot exemplars.

    Labels form a pseudo-random ring and each row takes those that follow its own; exemplars are drawn by number from each label's rows
    (the target itself may be drawn). The ring is a table of labels; no row meets all rows of a label."""
    numbered = rows.select(F.col(label).alias("lab"), F.col(key).alias("exemplar"), (F.row_number().over(Window.partitionBy(label).orderBy(key)) - 1).alias("no"))
    labels = rows.groupBy(F.col(label).alias("lab")).agg(F.count("*").alias("size"))
    ring = labels.withColumn("ring", F.row_number().over(Window.orderBy(hkey(F.lit(seed), "lab"), "lab")) - 1)  # one row a label
    total = ring.agg(F.count("*").alias("n_labels"))
    ways = rows.select(F.col(key).alias("target"), F.col(label).alias("own")).join(ring.select(F.col("lab").alias("own"), F.col("ring").alias("at")), "own").crossJoin(F.broadcast(total))
    ways = ways.withColumn("way", F.explode(F.sequence(F.lit(0), F.least(F.lit(n_way), F.col("n_labels").cast("int")) - 1))).withColumn("ring", F.pmod(F.col("at") + F.col("way"), F.col("n_labels")).cast("int"))
    shots = ways.join(ring.select("ring", "lab", "size"), "ring").withColumn("shot", F.explode(F.sequence(F.lit(0), F.lit(n_shot - 1))))
    shots = shots.withColumn("no", F.floor(u01(F.lit(seed), "target", "way", "shot") * F.col("size")).cast("int"))
    return shots.join(numbered, ["lab", "no"]).select("target", "way", "shot", "lab", "exemplar")


def rule_space(labels: DataFrame, positives: DataFrame) -> DataFrame:
    """Every (target, ev1, ev2) over the labels that is no positive rule. The label table has a fixed, small number of rows."""
    a = labels.select(F.col("label_id").alias("target"))
    b = labels.select(F.col("label_id").alias("ev1"))
    c = labels.select(F.col("label_id").alias("ev2"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c)).join(F.broadcast(positives.select("target", "ev1", "ev2")), ["target", "ev1", "ev2"], "left_anti")


def strong_rules(positives: DataFrame, space: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """At most n negatives of each positive rule: the same evidence with another target; a negative goes to the positive with the least target."""
    own = positives.groupBy("ev1", "ev2").agg(F.min("target").alias("of_target"))
    w = Window.partitionBy("ev1", "ev2").orderBy(hkey(F.lit(seed), "target", "ev1", "ev2"), "target")
    return space.join(F.broadcast(own), ["ev1", "ev2"]).withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).select("of_target", "target", "ev1", "ev2")


def probe_scores(rules: DataFrame, n_samples: int, seed: int = 1) -> DataFrame:
    """(target, ev1, ev2, mean_score): mean over n_samples stand-in scores of each rule."""
    s = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(n_samples)), lambda i: u01(F.lit(seed), "target", "ev1", "ev2", i)), F.lit(0.0), lambda a, x: a + x) / n_samples
    return rules.select("target", "ev1", "ev2", F.round(s, 9).alias("mean_score"))
