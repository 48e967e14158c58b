"""Problem 3: sentence units of every document, across languages and scripts.

Spaced scripts go through a terminator lattice (every terminator is a candidate, judged by the word before it, what follows and
the quotation it stands in); Thai goes through a dictionary word lattice whose gaps are judged by final and opening words.
A narrow transformation: no shuffle, one Arrow batch at a time, so it scales with the scan.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.segment import units
from spanloom.runtime import table


def sentences(df: DataFrame, id_col: str = "article_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """One row per sentence unit: (id_col, unit_no from 0, sent_start, sent_end), offsets in code points, ends exclusive.

    Rows with null, empty or blank text give no rows. A null language is fine: scripts decide then. Repeated rows are handled
    row by row. Other columns of the input, whatever their names, are not read."""
    picked = df.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), (F.col(lang_col) if lang_col else F.lit(None).cast("string")).alias("_lang")
    ).where(F.length("_text") > 0)

    def run(batches):
        for pdf in batches:
            ids, no, starts, ends = [], [], [], []
            for i, t, lang in zip(pdf["_id"], pdf["_text"], pdf["_lang"], strict=True):
                for k, (s, e) in enumerate(units(t, lang)):
                    ids.append(i)
                    no.append(k)
                    starts.append(s)
                    ends.append(e)
            yield pd.DataFrame({id_col: pd.Series(ids, dtype=pdf["_id"].dtype), "unit_no": pd.Series(no, dtype="int32"), "sent_start": pd.Series(starts, dtype="int64"), "sent_end": pd.Series(ends, dtype="int64")})

    kind = df.schema[id_col].dataType.simpleString()
    return picked.mapInPandas(run, f"`{id_col}` {kind}, unit_no int, sent_start bigint, sent_end bigint")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "wiki_articles")).select("article_id", "sent_start", "sent_end")


def p3_units_per_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units per article, with articles without text at 0."""
    articles = table(spark, sf_dir, "wiki_articles")
    counted = sentences(articles).groupBy("article_id").agg(F.count("*").alias("n_units"), F.max(F.col("sent_end") - F.col("sent_start")).alias("longest"))
    return articles.select("article_id").join(counted, "article_id", "left").select("article_id", F.coalesce("n_units", F.lit(0)).alias("n_units"), F.coalesce("longest", F.lit(0)).alias("longest"))


QUERIES = {"p3_found": p3_found, "p3_units_per_article": p3_units_per_article}
ORACLE: dict[str, str] = {}
