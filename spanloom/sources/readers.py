"""Readers of corpus and example files, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MENTION = T.ArrayType(T.StructType([T.StructField("uri", T.StringType()), T.StructField("surface_form", T.StringType()), T.StructField("offset", T.IntegerType())]))
ARTICLE = T.StructType([T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("annotations", _MENTION), T.StructField("el", _MENTION)])
_TACRED = T.StructType([T.StructField("id", T.StringType()), T.StructField("token", T.ArrayType(T.StringType())), *[T.StructField(f"{w}_{x}", T.IntegerType()) for w in ("subj", "obj") for x in ("start", "end")], T.StructField("relation", T.StringType())])


def articles(spark: SparkSession, patterns: str) -> DataFrame:
    """Linked articles in JSON lines; patterns: globs, comma-separated. No-break spaces in texts become spaces."""
    df = spark.read.schema(ARTICLE).json([p.strip() for p in patterns.split(",")])
    return df.withColumn("text", F.replace("text", F.lit("\u00a0"), F.lit(" ")))


def parquet(spark: SparkSession, path: str) -> DataFrame:
    """A parquet scan; a missing path is an error."""
    return spark.read.parquet(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no from 0, value) of non-blank lines, in the order of file names and of bytes within a file, however the scan is cut into partitions."""
    from spanloom.operators.prep import ordered_ids

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    return ordered_ids(lines.where(F.trim("value") != ""), [F.asc("__file"), F.asc("__block"), F.asc("__at")], "line_no").select("line_no", "value")


def alternating(spark: SparkSession, path: str, period: int) -> DataFrame:
    """(rec_id, text, label) of files where every record takes `period` non-blank lines: text (after a tab, quoted), label, remarks."""
    lines = numbered_lines(spark, path).select(F.floor(F.col("line_no") / period).alias("rec_id"), (F.col("line_no") % period).alias("k"), "value")
    text = F.regexp_replace(F.element_at(F.split("value", "\t"), 2), '^"|"$', "")
    a = lines.where("k = 0").select("rec_id", text.alias("text"))
    return a.join(lines.where("k = 1").select("rec_id", F.trim("value").alias("label")), "rec_id")


def marked_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Words of a text with `<e1>..</e1> <e2>..</e2>` marks, and the half-open word spans of both; an empty entity becomes `<blank>`."""
    spaced = F.regexp_replace(F.regexp_replace(text, "(</?e[12]>)", " $1 "), " +", " ")
    filled = F.regexp_replace(spaced, "<(e[12])> </", "<$1> <blank> </")
    d = df.withColumn("__w", F.split(F.trim(filled), " "))
    at = lambda m: F.array_position("__w", m).cast("int") - 1
    marks = ("<e1>", "</e1>", "<e2>", "</e2>")
    before = lambda p: sum(((at(m) < p).cast("int") for m in marks), F.lit(0))
    pos = {m: at(m) - before(at(m)) for m in marks}
    return d.select(*df.columns, F.filter("__w", lambda w: ~w.isin(*marks)).alias("words"), pos["<e1>"].alias("hs"), pos["</e1>"].alias("he"), pos["<e2>"].alias("ts"), pos["</e2>"].alias("te"))


def tacred(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of examples; span ends become exclusive."""
    d = spark.read.schema(_TACRED).json(path, multiLine=True)
    return d.select("id", F.col("token").alias("tokens"), F.col("subj_start").alias("hs"), (F.col("subj_end") + 1).alias("he"), F.col("obj_start").alias("ts"), (F.col("obj_end") + 1).alias("te"), "relation")


def fewrel(spark: SparkSession, path: str) -> DataFrame:
    """`{relation: [samples]}`; the label is the place of the relation among the keys."""
    kind = "map<string, array<struct<tokens: array<string>, h: array<string>, t: array<string>>>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m"))
    keyed = raw.select("m", F.posexplode(F.map_keys("m")).alias("label", "relation"))
    rows = keyed.select("label", "relation", F.posexplode(F.element_at("m", F.col("relation"))).alias("no", "s"))
    places = lambda c: F.flatten(F.from_json(F.element_at(c, 3), "array<array<int>>"))
    ends = lambda c: (F.array_min(places(c)), F.array_max(places(c)) + 1)
    (hs, he), (ts, te) = ends("s.h"), ends("s.t")
    return rows.select("label", "relation", "no", F.col("s.tokens").alias("tokens"), hs.alias("hs"), he.alias("he"), ts.alias("ts"), te.alias("te"))


def trivia(spark: SparkSession, questions: str, annotations: str, known: DataFrame | None = None) -> DataFrame:
    """Questions with their aligned annotations: the two files join by position. known: (symbol), entities an answer must be one of."""
    q = spark.read.text(questions, wholetext=True).select(F.from_json("value", "Data array<struct<Question: string, Answer: struct<MatchedWikiEntityName: string>>>").alias("d")).select(F.posexplode("d.Data").alias("pos", "q"))
    kind = "array<array<struct<name: string, type: string, mentions: array<struct<content: string, begin_offset: int>>, metadata: map<string, string>>>>"
    a = spark.read.text(annotations, wholetext=True).select(F.from_json("value", kind).alias("d")).select(F.posexplode("d").alias("pos", "annotations"))
    named = q.where("q.Answer.MatchedWikiEntityName is not null")
    out = named.join(a, "pos").select("pos", F.col("q.Question").alias("question"), F.replace(F.col("q.Answer.MatchedWikiEntityName"), F.lit(" "), F.lit("_")).alias("answer"), "annotations")
    return out if known is None else out.join(known.select(F.col("symbol").alias("answer")).distinct(), "answer", "left_semi").select("pos", "question", "answer", "annotations")


def spaced_surfaces(text: str, entities: list[tuple[str, str | None]]) -> tuple[str, list[str | None]]:
    """A text with spaces round the first occurrence of each entity's surface, longest first, and the surfaces as they then stand (None: left out).

    entities: (surface, type), None as type for none. An `s` right after a DATE joins it. An entity that stands in the middle of a word is left out: one with
    two letters before it and no space among them, or two after it, is taken for a piece of that word."""
    out: list[str | None] = [None] * len(entities)
    for k in sorted(range(len(entities)), key=lambda i: -len(entities[i][0])):
        surface, kind = entities[k]
        s = text.find(surface) if surface else -1
        if s < 0:
            continue
        e = s + len(surface)
        if s > 0 and text[s - 1] != " ":
            if s > 2 and text[s - 2] != " " and text[s - 3] != " ":
                continue
            text, s, e = f"{text[:s]} {text[s:]}", s + 1, e + 1
        if kind == "DATE" and text[e : e + 1] == "s":
            surface, e = surface + "s", e + 1
        if e < len(text) and text[e] != " ":
            if e + 2 < len(text) and text[e + 1] != " " and text[e + 2] != " ":
                continue
            text = f"{text[:e]} {text[e:]}"
        out[k] = surface
    return text, out


def located_surfaces(words: list[str], surfaces: list[str | None]) -> list[tuple[int, int] | None]:
    """Words (first, last) of each surface: its first place at word boundaries, spaces aside, that no surface before it has taken; None for none."""
    starts, at = {}, 0
    ends = {}
    for i, w in enumerate(words):
        if w:
            starts[at] = i
            at += len(w)
            ends[at] = i
    squeezed, taken, out = "".join(words), set(), []
    for surface in surfaces:
        piece, found = (surface or "").replace(" ", ""), None
        s = squeezed.find(piece) if piece else -1
        while s >= 0 and found is None:
            e = s + len(piece)
            if s in starts and e in ends and (starts[s], ends[e]) not in taken:
                found = (starts[s], ends[e])
                taken.add(found)
            s = squeezed.find(piece, s + 1)
        out.append(found)
    return out


def surface_places(df: DataFrame, id_col: str, text: str, surfaces: str) -> DataFrame:
    """(id_col, k, first_word, last_word) of surfaces found in texts by the two rules above. surfaces: array of (surface, type); null texts give no rows."""
    kind = df.schema[id_col].dataType.simpleString()
    picked = df.where(F.col(text).isNotNull() & F.col(surfaces).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text).alias("__t"), F.transform(surfaces, lambda x: x["surface"]).alias("__s"), F.transform(surfaces, lambda x: x["type"]).alias("__k"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for i, t, ss, ks in zip(pdf["__id"], pdf["__t"], pdf["__s"], pdf["__k"], strict=True):
                spaced, kept = spaced_surfaces(t, list(zip((s or "" for s in ss), ks, strict=True)))
                rows += [(i, k, *p) for k, p in enumerate(located_surfaces(spaced.split(" "), kept)) if p]
            yield pd.DataFrame(rows, columns=[id_col, "k", "first_word", "last_word"])

    return picked.mapInPandas(run, f"`{id_col}` {kind}, k int, first_word int, last_word int")


def entity_dictionary(spark: SparkSession, path: str, drop_prefix: int = 0) -> DataFrame:
    """(entity_id, symbol[, cnt]) from lines `symbol count` (or tab-separated ones with a prefix to drop); the id is the line number."""
    d = numbered_lines(spark, path)
    parts = F.split("value", "\t| (?=[0-9]+$)")
    return d.select(F.col("line_no").alias("entity_id"), F.substring(F.element_at(parts, 1), F.lit(drop_prefix + 1), F.length("value")).alias("symbol"), F.try_element_at(parts, F.lit(2)).cast("long").alias("cnt"))
