"""Scores over given vectors: pairs, triples, prototypes, segments, candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import vectors as V
from spanloom.runtime import open_store, stored


def vector_mean(df: DataFrame, by: list[str], vec: str, dim: int) -> DataFrame:
    """Mean vector per group: one average a dimension, combined before the shuffle; no vector is collected."""
    return df.groupBy(*by).agg(F.array(*[F.avg(F.get(F.col(vec), F.lit(i)).cast("double")) for i in range(dim)]).alias("mean"))


def vector_sum(df: DataFrame, by: list[str], vec: str, dim: int, weight: Column | None = None) -> DataFrame:
    w = weight if weight is not None else F.lit(1.0)
    return df.groupBy(*by).agg(F.array(*[F.sum(F.get(F.col(vec), F.lit(i)).cast("double") * w) for i in range(dim)]).alias("total"))


#: Numbers in a table of vectors up to which it is sent to every executor; a larger one is joined by key.
SENT_NUMBERS = 4_000_000


def sized(vectors: DataFrame, limit: int = SENT_NUMBERS) -> DataFrame:
    """The vectors (vec_id, embedding), marked to be sent to every executor if they have at most `limit` numbers in all: then a lookup shuffles nothing."""
    n = vectors.agg(F.sum(F.size("embedding")).alias("n")).first()["n"] or 0
    return F.broadcast(vectors) if n <= limit else vectors


def gather(rows: DataFrame, vectors: DataFrame, key: str, out: str) -> DataFrame:
    """Adds the vector of each key: the lookup as a join."""
    return rows.join(vectors.select(F.col("vec_id").alias(key), F.col("embedding").alias(out)), key)


def segment_softmax(df: DataFrame, segment: list[str], score: str) -> DataFrame:
    """Adds weight: softmax of score within each segment, from a sum per segment, kept stable by its maximum."""
    stats = df.groupBy(*segment).agg(F.max(score).alias("__m"))
    shifted = df.join(stats, segment).withColumn("__e", F.exp(F.col(score) - F.col("__m")))
    sums = shifted.groupBy(*segment).agg(F.sum("__e").alias("__z"))
    return shifted.join(sums, segment).withColumn("weight", F.col("__e") / F.col("__z")).drop("__m", "__e", "__z")


def segment_attention(df: DataFrame, segment: list[str], score: str, vec: str, dim: int, look_up: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Mean vector of each segment with softmax weights: one aggregate of sum(w * v) and sum(w), w = exp(score - max), combined before the shuffle.
    look_up: adds the vectors to the rows after the maximum is known, so that only narrow rows are sorted."""
    w = df.withColumn("__w", F.exp(F.col(score) - F.max(score).over(Window.partitionBy(*segment))))
    w = w if look_up is None else look_up(w)
    parts = F.array(*[F.sum(F.get(F.col(vec), F.lit(i)).cast("double") * F.col("__w")) for i in range(dim)])
    sums = w.groupBy(*segment).agg(parts.alias("__v"), F.sum("__w").alias("__z"))
    return sums.select(*segment, F.transform("__v", lambda x: x / F.col("__z")).alias("mean"))


def top_k_dot(queries: DataFrame, items: DataFrame, k: int, block: int = 2048, tile: int = 8192) -> DataFrame:
    """(q_id, i_id, score, rank): the k items of greatest dot product for each query, exactly; the least id wins a tie.

    Queries lie in the shared folder in blocks. Items are read once and never shuffled: a task holds its own partition of them, takes the query blocks
    one after another, and scores a block against a tile of items at a time, so that neither the driver nor a task holds all queries and what is
    shuffled is k rows a query and task. queries: (q_id, q_vec), a stated query set; items: (i_id, i_vec)."""
    import numpy as np
    import pandas as pd

    path = stored(queries.select("q_id", "q_vec"), "queries")

    def best(batches):
        import pyarrow.parquet as pq

        ids, vecs = [], []
        for pdf in batches:
            if len(pdf):
                ids.append(pdf["i_id"].to_numpy())
                vecs.append(np.array(pdf["i_vec"].tolist(), dtype=np.float64))
        if not ids:
            return
        ids, vecs = np.concatenate(ids), np.concatenate(vecs)
        store, files = open_store(path)
        for name in files:
            with store.open_input_file(name) as f:
                for rb in pq.ParquetFile(f).iter_batches(batch_size=block):
                    q_ids = rb.column(0).to_numpy(zero_copy_only=False)
                    mat = np.array(rb.column(1).to_pylist(), dtype=np.float64).reshape(len(q_ids), -1)
                    got_r, got_i, got_s = np.zeros(0, np.int64), np.zeros(0, ids.dtype), np.zeros(0)
                    for at in range(0, len(ids), tile):
                        s = np.round(mat @ vecs[at : at + tile].T, 9)
                        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), -np.inf)
                        r, c = np.nonzero(s >= least[:, None])
                        r, i, s = np.concatenate([got_r, r]), np.concatenate([got_i, ids[at + c]]), np.concatenate([got_s, s[r, c]])
                        order = np.lexsort((i, -s, r))
                        r, i, s = r[order], i[order], s[order]
                        first = np.searchsorted(r, r)
                        keep = np.arange(len(r)) - first < k
                        got_r, got_i, got_s = r[keep], i[keep], s[keep]
                    yield pd.DataFrame({"q_id": q_ids[got_r], "i_id": got_i, "score": got_s})

    out = items.select("i_id", "i_vec").mapInPandas(best, "q_id bigint, i_id bigint, score double")
    w = Window.partitionBy("q_id").orderBy(F.desc("score"), "i_id")
    return out.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def argmax_class(scores: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """The label of greatest score per group; the least label wins a tie."""
    return scores.groupBy(*by).agg(F.min_by(F.struct(F.col(label).alias("label"), F.col(score).alias("score")), F.struct(-F.col(score), F.col(label))).alias("b")).select(*by, "b.label", "b.score")


def bag_weight(head_head: Column, tail_tail: Column, head_tail: Column, tail_head: Column, w: float, strong_head: Column, strong_tail: Column) -> Column:
    """Weight of a bag candidate: likeness of heads and of tails, 0.5 for one that is unknown but a strong negative's, and w times the crossed ones."""
    z = lambda c, strong: F.coalesce(c, F.when(strong, F.lit(0.5)).otherwise(F.lit(0.0)))
    none = F.lit(False)
    return z(head_head, strong_head) + z(tail_tail, strong_tail) + w * (z(head_tail, none) + z(tail_head, none))


def bow_pool(tokens: Column, vectors: Column, special: tuple[str, ...], dim: int) -> Column:
    """Mean of the vectors of tokens that are no markers (arrays side by side)."""
    pairs = F.filter(F.arrays_zip(tokens.alias("t"), vectors.alias("v")), lambda x: ~x["t"].isin(*special))
    n = F.greatest(F.size(pairs), F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: V.total(F.transform(pairs, lambda x: F.get(x["v"], i).cast("double"))) / n)


def at_positions(vectors: Column, *positions: Column) -> Column:
    """Concatenation of the vectors at given positions (from 0): the pooling heads that read entity starts or ends."""
    return F.flatten(F.array(*[F.get(vectors, p) for p in positions]))


def logistic_grid(df: DataFrame, features: str, label: str, strengths: list[float], folds: int = 3, iterations: int = 50, seed: int = 1) -> DataFrame:
    """(c, accuracy): mean accuracy over folds of logistic regressions with inverse regularisation c. The grid is a row a setting; rows are
    read from storage once and cached for the fits."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    data = df.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    lr = LogisticRegression(maxIter=iterations)
    grid = ParamGridBuilder().addGrid(lr.regParam, [1.0 / c for c in strengths]).build()
    metric = MulticlassClassificationEvaluator(metricName="accuracy")
    model = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=metric, numFolds=folds, seed=seed).fit(data)
    rows = [(float(c), float(m)) for c, m in zip(strengths, model.avgMetrics, strict=True)]
    return df.sparkSession.createDataFrame(rows, "c double, accuracy double")
