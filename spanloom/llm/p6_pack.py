"""Problem 6: items of varying length put into containers of fixed capacity.

Bounded-space online packing: a partition keeps a fixed number of open containers, puts each item where it leaves the least room,
and emits the fullest when none fits. What is still open at the end of each partition, a bounded number of containers, is merged over groups of
partitions. Only those leftovers are shuffled. An item is divided only if it exceeds the capacity.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.runtime import durable, table

#: Open containers per partition, and partitions whose leftovers are merged together (at most OPEN * MERGED containers a task).
OPEN, MERGED = 64, 256
#: Split pattern of the byte-level BPE vocabulary, where the tokenizer package does not give it.
DEFAULT_TOKENIZER = "byte_bpe_50k.tiktoken"


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def load_tokenizer(path: str):
    """Byte-level BPE from a rank file; strings of special tokens are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(df: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """(id_col, n_tokens) of whole texts; null and empty texts have 0."""
    picked = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))

    def run(batches):
        enc = load_tokenizer(path)
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf["_id"], "n_tokens": [_count(enc, t) for t in pdf["_t"]]})

    return picked.mapInPandas(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_tokens bigint")


def _count(enc, text: str) -> int:
    return len(enc.encode_ordinary(text)) if text else 0


class Packer:
    """Open containers by free room: at most `spaces` at a time. add() gives (container, containers emitted now)."""

    def __init__(self, capacity: int, spaces: int):
        self.capacity, self.spaces = capacity, spaces
        self.open: list[tuple[int, int]] = []  # (free room, container), ascending
        self.made = 0

    def add(self, size: int) -> tuple[int, int | None]:
        k = bisect_left(self.open, (size, -1))
        emitted = None
        if k < len(self.open):
            free, c = self.open.pop(k)
        else:
            if len(self.open) >= self.spaces:
                emitted = self.open.pop(0)[1]
            free, c = self.capacity, self.made
            self.made += 1
        free -= size
        if free:
            insort(self.open, (free, c))
        return c, emitted


def pack(sizes: DataFrame, id_col: str, size_col: str = "n_tokens", capacity: int = 2048, spaces: int = OPEN) -> DataFrame:
    """(id_col, piece_no, piece_start, piece_end, container): every item, in pieces of `capacity` only where it exceeds that.

    Items of size 0 or null are given no room: one row with an empty piece and a null container. Repeated ids are packed row by row,
    in the order of the input; other columns are not read."""
    if capacity < 1 or spaces < 1:
        raise ValueError("capacity and spaces must be positive")
    picked = sizes.select(F.col(id_col).alias("_id"), F.coalesce(F.col(size_col), F.lit(0)).cast("bigint").alias("_n"))

    def run(batches):
        part = TaskContext.get().partitionId()
        packer = Packer(capacity, spaces)
        for pdf in batches:
            rows = []
            for i, n in zip(pdf["_id"], pdf["_n"], strict=True):
                if n <= 0:
                    rows.append((i, 0, 0, 0, None))
                    continue
                for k, s in enumerate(range(0, n, capacity)):
                    e = min(n, s + capacity)
                    c, _ = packer.add(e - s)
                    rows.append((i, k, s, e, f"{part}-{c}"))
            yield pd.DataFrame(rows, columns=["id", "no", "s", "e", "c"]).assign(id=lambda d: d["id"].astype(pdf["_id"].dtype))
        # containers still open are named in rows of their own, without an item
        yield pd.DataFrame([(None, -1, part, capacity - free, f"{part}-{c}") for free, c in packer.open], columns=["id", "no", "s", "e", "c"]).astype({"id": "Int64"} if not rows_text else {})

    kind = sizes.schema[id_col].dataType.simpleString()
    rows_text = kind == "string"
    placed = durable(picked.mapInPandas(run, f"id {kind}, no int, s bigint, e bigint, c string"))
    left = placed.where("no = -1").select(F.col("c").alias("window"), F.col("e").alias("fill"), F.floor(F.col("s") / MERGED).alias("grp"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        packer, names = Packer(capacity, len(pdf) + 1), {}
        pdf = pdf.sort_values(["fill", "window"], ascending=[False, True])
        out = []
        for w, n in zip(pdf["window"], pdf["fill"], strict=True):
            c, _ = packer.add(int(n))
            out.append((w, names.setdefault(c, w)))
        return pd.DataFrame(out, columns=["window", "merged"])

    merged = left.groupBy("grp").applyInPandas(merge, "window string, merged string").where("window <> merged")
    items = placed.where("no >= 0")
    return items.join(merged, items["c"] == merged["window"], "left").select(F.col("id").alias(id_col), F.col("no").alias("piece_no"), F.col("s").alias("piece_start"), F.col("e").alias("piece_end"), F.coalesce("merged", "c").alias("container"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents in containers of 2,048 tokens."""
    return pack(token_sizes(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path()), "doc_id")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: their number, tokens in them, and the least number that could hold them."""
    rows = p6_containers(spark, sf_dir).where("container is not null").groupBy("container").agg(F.sum(F.col("piece_end") - F.col("piece_start")).alias("fill"))
    return rows.agg(F.count("*").alias("containers"), F.sum("fill").alias("tokens"), F.max("fill").alias("fullest"), F.ceil(F.sum("fill") / 2048).alias("at_least"))


QUERIES = {"p6_containers": p6_containers, "p6_fill": p6_fill}
ORACLE: dict[str, str] = {}
