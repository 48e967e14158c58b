"""Blocks that grow over whole neighbouring sentences of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.graph import MAX_POSITIONS
from spanloom.operators.prep import ordered_ids

#: Sentences of one bin; a block of max_positions tokens reaches fewer sentences than that to either side if each has two tokens or more.
BIN = 64


def neighbour_sizes(sentences: DataFrame, order: list[str], max_positions: int = MAX_POSITIONS, separator: int = 1) -> DataFrame:
    """(sent_id, n_tokens, lefts, rights): sizes of the sentences before and after in the document, nearest first, up to a separator (a sentence of at
    most `separator` tokens) and as far as a block can reach.

    Sentences are numbered in one global order of (document, order) and looked up by bins of numbers, so that a document of any length is spread
    over many tasks. sentences: (sent_id, doc_id, n_tokens, order...)."""
    numbered = ordered_ids(sentences.select("sent_id", "doc_id", "n_tokens", *order), [F.asc("doc_id"), *[F.asc(o) for o in order], F.asc("sent_id")], "no")
    s = numbered.select("no", "sent_id", "doc_id", "n_tokens", F.floor(F.col("no") / BIN).alias("bin"))
    bins = s.groupBy("bin").agg(F.sort_array(F.collect_list(F.struct("no", F.col("doc_id").alias("doc"), F.col("n_tokens").alias("n")))).alias("xs"))  # at most BIN rows each
    near = bins.select("xs", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    around = near.groupBy("bin").agg(F.sort_array(F.flatten(F.collect_list("xs"))).alias("xs"))
    j = s.join(around, "bin")
    same = lambda x: x["doc"] == F.col("doc_id")
    left = F.reverse(F.filter("xs", lambda x: same(x) & (x["no"] < F.col("no"))))
    right = F.filter("xs", lambda x: same(x) & (x["no"] > F.col("no")))

    def reach(xs: Column) -> Column:
        start = F.struct(F.lit(True).alias("on"), F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("out"))
        step = lambda a, x: F.when(a["on"] & (x["n"] > separator) & (a["sum"] + x["n"] + F.col("n_tokens") <= max_positions), F.struct(F.lit(True).alias("on"), (a["sum"] + x["n"]).cast("long").alias("sum"), F.concat(a["out"], F.array(x["n"].cast("long"))).alias("out"))).otherwise(F.struct(F.lit(False).alias("on"), a["sum"].alias("sum"), a["out"].alias("out")))
        return F.aggregate(xs, start, step, lambda a: a["out"])

    return j.select("sent_id", "n_tokens", reach(left).alias("lefts"), reach(right).alias("rights"))


def grown_blocks(edges: DataFrame, sizes: DataFrame, max_positions: int = MAX_POSITIONS) -> DataFrame:
    """Edges in sentences that fit, with (block_start, block_end) counted from their sentence's start: whole sentences are added in turn, on the left
    where the left context is not the longer one (on the right if that does not fit), else on the right; growth ends where the
    preferred right does not fit."""
    lo, hi = F.least("hs", "ts"), F.greatest("he", "te")
    j = edges.join(sizes, "sent_id").where(F.col("n_tokens") <= max_positions)
    start = F.struct(F.lit(0).cast("long").alias("s"), F.col("n_tokens").cast("long").alias("e"), F.lit(0).alias("i"), F.lit(0).alias("k"), F.lit(True).alias("on"))

    def step(a: Column, _x: Column) -> Column:
        l, r = F.get("lefts", a["i"]), F.get("rights", a["k"])
        room = F.lit(max_positions) - (a["e"] - a["s"])
        fits_l, fits_r = F.coalesce(l <= room, F.lit(False)), F.coalesce(r <= room, F.lit(False))
        prefer_left = (lo - a["s"]) <= (a["e"] - hi)
        go_left = a["on"] & prefer_left & fits_l
        go_right = a["on"] & ~go_left & fits_r
        as_left = F.struct((a["s"] - l).alias("s"), a["e"].alias("e"), (a["i"] + 1).alias("i"), a["k"].alias("k"), F.lit(True).alias("on"))
        as_right = F.struct(a["s"].alias("s"), (a["e"] + r).alias("e"), a["i"].alias("i"), (a["k"] + 1).alias("k"), F.lit(True).alias("on"))
        stop = F.struct(a["s"].alias("s"), a["e"].alias("e"), a["i"].alias("i"), a["k"].alias("k"), F.lit(False).alias("on"))
        return F.when(go_left, as_left).when(go_right, as_right).otherwise(stop)

    turns = F.concat("lefts", "rights")
    block = F.aggregate(turns, start, step)
    return j.select(*edges.columns, block.alias("b")).select(*edges.columns, F.col("b.s").alias("block_start"), F.col("b.e").alias("block_end"))
