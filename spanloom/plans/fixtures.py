"""Mention tables from the star-schema fixture: a line is a mention, an order a sentence, a customer a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators.intervals import prefix_offsets
from spanloom.runtime import table

#: Order of the lines of an order. Lines that are equal in these give equal mentions, whatever their order, so price and date need not travel.
TIE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
#: First day of the validation split.
SPLIT_DAY = "1997-01-01"


def mentions(spark: SparkSession, sf_dir: str, entity: str = "l_partkey") -> DataFrame:
    """(sent_id, entity, rn, st, en): spans are running sums of l_quantity."""
    # named before the first window, so that one shuffle by sentence serves all
    raw = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sent_id"), F.col(entity).alias("entity"), *[c for c in TIE if c != entity])
    rn = F.row_number().over(Window.partitionBy("sent_id").orderBy(*["entity" if c == entity else c for c in TIE]))
    lines = raw.withColumn("rn", rn).select("sent_id", "entity", F.col("l_quantity").cast("long").alias("len"), "rn")
    return prefix_offsets(lines, ["sent_id"], ["rn"], "len", "st").select("sent_id", "entity", "rn", "st", (F.col("st") + F.col("len")).alias("en"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sent_id, doc_id, day, n_tokens)."""
    sizes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sent_id")).agg(F.sum("l_quantity").cast("long").alias("n_tokens"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sent_id"), F.col("o_custkey").alias("doc_id"), F.col("o_orderdate").alias("day"))
    return sizes.join(orders, "sent_id")


def split_of(spark: SparkSession, sf_dir: str, edges: DataFrame) -> DataFrame:
    """Edges with is_train: their sentence is dated before SPLIT_DAY."""
    days = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sent_id"), (F.col("o_orderdate") < F.lit(SPLIT_DAY).cast("timestamp")).alias("is_train"))
    return edges.join(days, "sent_id")


def m_sql(entity: str = "l_partkey") -> str:
    """CTEs m (mentions), u (statements) and e (both ways), for the oracle."""
    return f"""
with m0 as (
  select l_orderkey as sent_id, {entity} as entity, cast(l_quantity as bigint) as len,
         row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as rn
  from lineitem),
m as (
  select sent_id, entity, rn, st, st + len as en from (
    select *, cast(coalesce(sum(len) over (partition by sent_id order by rn rows between unbounded preceding and 1 preceding), 0) as bigint) as st from m0)),
u as (
  select a.entity as h, b.entity as t, a.sent_id, a.st as hs, a.en as he, b.st as ts, b.en as te
  from m a join m b on a.sent_id = b.sent_id and a.rn < b.rn
  where a.entity <> b.entity and a.en + 40 > b.st and b.en - a.st <= 123),
e as (select h, t, sent_id, hs, he, ts, te from u union all select t, h, sent_id, ts, te, hs, he from u)"""
