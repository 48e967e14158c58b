"""Joins of spans on overlap, and the sweep that keeps a set of disjoint ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.spans import overlaps


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], lspan: tuple[str, str], rspan: tuple[str, str], how: str = "inner", width: int | None = None, row_key: list[str] | None = None) -> DataFrame:
    """Rows of left and right with equal keys whose spans share a position; columns other than keys must differ by name.

    how: inner, left_semi or left_anti. width None joins on the keys and tests the rest, right where a key's group is small. A width
    cuts positions into bins of that size, so that no group of a key meets in one place; a pair that shares several bins is kept
    in the one where the later of its starts lies; semi and anti joins by bins need row_key, columns that tell left rows apart. Spans
    must be non-empty; nulls overlap nothing."""
    meet = overlaps(*lspan, *rspan)
    r = right
    if how != "inner":
        r = right.select(*keys, *rspan)
    if width is None:
        cond: Column = meet
        rk = r.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in r.columns if c not in keys])
        for k in keys:
            cond = cond & (F.col(k) == F.col(f"__r_{k}"))
        out = left.join(rk, cond, how)
        return out.drop(*[f"__r_{k}" for k in keys]) if how == "inner" else out
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    if how == "inner":
        a = left.where(F.col(lspan[0]) < F.col(lspan[1])).withColumn("__bin", bins(*lspan))
        b = r.where(F.col(rspan[0]) < F.col(rspan[1])).withColumn("__bin", bins(*rspan))
        first = F.floor(F.greatest(F.col(lspan[0]), F.col(rspan[0])) / width) == F.col("__bin")
        return a.join(b, [*keys, "__bin"]).where(meet & first).drop("__bin")
    if not row_key:
        raise ValueError("semi and anti joins by bins need row_key")
    a = left.select(*dict.fromkeys([*row_key, *keys, *lspan])).where(F.col(lspan[0]) < F.col(lspan[1])).withColumn("__bin", bins(*lspan))
    b = r.where(F.col(rspan[0]) < F.col(rspan[1])).withColumn("__bin", bins(*rspan))
    return left.join(a.join(b, [*keys, "__bin"]).where(meet).select(*row_key).distinct(), row_key, how).select(*left.columns)


def stabbing(mentions: DataFrame, blocks: DataFrame, keys: list[str], mspan: tuple[str, str], bspan: tuple[str, str], width: int | None = None) -> DataFrame:
    """All mentions that a block touches: mention.end > block.start and mention.start < block.end."""
    return overlap_join(blocks, mentions, keys, bspan, mspan, "inner", width)


def sweep_disjoint(spans: DataFrame, keys: list[str], start: str, end: str, tie: list[str]) -> DataFrame:
    """Greedy sweep per key: in order of (start, tie), a span is kept if no kept one is open; a span that is dropped blocks nothing.

    A close at a position comes before an open there. Runs inside the JVM as a fold over each key's sorted spans; a key is one
    document, whose spans fit one row."""
    order = F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(tie)], F.col(end).alias("e"), F.struct(*[F.col(c) for c in spans.columns]).alias("row"))))
    grouped = spans.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(order.alias("xs"))
    state = F.struct(F.lit(-(1 << 62)).cast("long").alias("until"), F.array().cast(f"array<{_row_type(spans)}>").alias("kept"))
    fold = F.aggregate(
        "xs",
        state,
        lambda acc, x: F.when(x["s"] >= acc["until"], F.struct(x["e"].cast("long").alias("until"), F.concat(acc["kept"], F.array(x["row"])).alias("kept"))).otherwise(acc),
        lambda acc: acc["kept"],
    )
    return grouped.select(F.explode(fold).alias("row")).select("row.*")


def _row_type(df: DataFrame) -> str:
    return "struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in df.schema.fields) + ">"


def prefix_offsets(sizes: DataFrame, keys: list[str], order: list[str], size: str, out: str = "offset") -> DataFrame:
    """Exclusive running sum of sizes per key: where each item starts."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn(out, F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))
