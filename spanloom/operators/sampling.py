"""Samples that repeat: every random order is an md5 of seed, epoch and keys, so it does not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.prep import ordered_ids
from spanloom.runtime import hkey, u01


def epoch_slice(df: DataFrame, keys: list[str], size: int, epoch: int, seed: int = 1) -> DataFrame:
    """The slice of an epoch (from 1): the rows in a pseudo-random order of the epoch's generation, cut into ceil(n / size) slices of
    floor(n / slices) rows; each generation has another order, and its last rows may be left out."""
    n = df.count()
    if not n:
        return df
    slices = -(-n // size)
    generation, offset = (epoch - 1) // slices + 1, (epoch - 1) % slices
    rows = n // slices
    ranked = ordered_ids(df.withColumn("__h", hkey(F.lit(seed), F.lit(generation), *keys)), [F.asc("__h"), *[F.asc(k) for k in keys]], "__rn")
    return ranked.where((F.col("__rn") >= offset * rows) & (F.col("__rn") < (offset + 1) * rows)).select(*df.columns)


def fixed_size(df: DataFrame, keys: list[str], size: int, seed: int = 1) -> DataFrame:
    """All rows, or `size` of them, the same ones every epoch: the least by pseudo-random key (a top-k, no full sort)."""
    return df.withColumn("__h", hkey(F.lit(seed), *keys)).orderBy("__h", *keys).limit(size).select(*df.columns)


def shard_of(shards: int, *keys) -> Column:
    return F.floor(u01(F.lit("shard"), *keys) * shards).cast("int")


def per_group(df: DataFrame, group: list[str], keys: list[str], n: int, seed: int = 1) -> DataFrame:
    """At most n rows of each group, by pseudo-random order."""
    w = Window.partitionBy(*group).orderBy(hkey(F.lit(seed), *keys), *keys)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def weighted_without_replacement(df: DataFrame, group: list[str], keys: list[str], weight: str, n: int, seed: int = 1) -> DataFrame:
    """At most n rows of each group with chances by weight, by exponential keys: order by -ln(u) / w (Efraimidis and Spirakis, 2006)."""
    key = -F.ln(u01(F.lit(seed), *keys) + F.lit(1e-10)) / F.col(weight)
    w = Window.partitionBy(*group).orderBy(key, *keys)
    return df.where(F.col(weight) > 0).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def with_replacement(groups: DataFrame, members: DataFrame, group: str, member: str, n: int, seed: int = 1) -> DataFrame:
    """(group, draw, member): n draws of each group's members, repeats allowed. Members are numbered, and draws joined on the number."""
    numbered = members.select(group, member, (F.row_number().over(Window.partitionBy(group).orderBy(member)) - 1).alias("__i"))
    sizes = members.groupBy(group).agg(F.count("*").alias("__n"))
    draws = groups.select(group).join(sizes, group).select(group, "__n", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    draws = draws.withColumn("__i", F.floor(u01(F.lit(seed), group, "draw") * F.col("__n")).cast("int"))
    return draws.join(numbered, [group, "__i"]).select(group, "draw", member)


def jittered_length_order(df: DataFrame, size: str, keys: list[str], jitter: float = 5.0, seed: int = 1) -> Column:
    """Sort key: length with a little noise, for batches of like length that differ by epoch."""
    return F.col(size) + (u01(F.lit(seed), *keys) - 0.5) * (2 * jitter)


def interleaved(tasks: list[tuple[str, DataFrame, int]], keys: str) -> DataFrame:
    """(cycle, task, place, key): in each cycle every task gives its number of rows; cycles end with the shortest task.

    tasks: (name, rows, rows a cycle)."""
    parts, lengths = [], None
    for k, (name, df, freq) in enumerate(tasks):
        numbered = ordered_ids(df.select(F.col(keys).alias("key")), [F.asc("key")], "rn")
        parts.append(numbered.select(F.floor(F.col("rn") / freq).alias("cycle"), F.lit(k).alias("task_no"), F.lit(name).alias("task"), (F.col("rn") % freq).alias("place"), "key"))
        whole = df.agg(F.floor(F.count("*") / freq).alias("cycles"))
        lengths = whole if lengths is None else lengths.unionByName(whole)
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    shortest = lengths.agg(F.min("cycles").alias("cycles"))
    return both.crossJoin(F.broadcast(shortest)).where("cycle < cycles").drop("cycles")


def stratified_split(df: DataFrame, label: str, keys: list[str], test_share: float, splits: int, seed: int = 1) -> DataFrame:
    """(split_no, keys..., is_test): per split and label, the first rows in pseudo-random order are the test part."""
    each = df.select(label, *keys).withColumn("split_no", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    w = Window.partitionBy("split_no", label)
    ranked = each.withColumn("__r", F.row_number().over(w.orderBy(hkey(F.lit(seed), "split_no", *keys), *keys))).withColumn("__n", F.count("*").over(w))
    return ranked.select("split_no", label, *keys, (F.col("__r") <= F.round(F.col("__n") * test_share)).alias("is_test"))


def token_batches(df: DataFrame, key: str, size: str, max_tokens: int, max_rows: int, shards: int | None = None) -> DataFrame:
    """(shard, batch, key): rows of like length batched greedily within hash shards, padded size (longest times rows) at most max_tokens.

    The greedy cut is sequential, so each shard's rows are sorted in one partition and cut as they stream by; shards bound what that holds: eight at
    least, and one for every million rows."""
    import pandas as pd

    if shards is None:
        shards = max(8, -(-df.count() // 1_000_000))

    kind = df.schema[key].dataType.simpleString()
    placed = df.select(key, F.col(size).cast("long").alias("__n"), shard_of(shards, key).alias("shard"))

    def cut(batches):
        shard, batch, rows, longest = None, 0, 0, 0
        for pdf in batches:
            out = []
            for s, k, n in zip(pdf["shard"], pdf[key], pdf["__n"], strict=True):
                if s != shard:
                    shard, batch, rows, longest = s, 0, 0, 0
                if rows and (max(longest, n) * (rows + 1) > max_tokens or rows >= max_rows):
                    batch, rows, longest = batch + 1, 0, 0
                rows, longest = rows + 1, max(longest, n)
                out.append((s, batch, k))
            yield pd.DataFrame(out, columns=["shard", "batch", key])

    return placed.repartition("shard").sortWithinPartitions("shard", "__n", key).mapInPandas(cut, f"shard int, batch int, `{key}` {kind}")
