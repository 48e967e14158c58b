"""From linked articles to clean mentions: the filters in their order, with a reason for every mention that goes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import last_segment, trim_shift
from spanloom.operators.intervals import overlap_join, sweep_disjoint

NBSP, NEWLINE = "\u00a0", "\n"


def exploded(articles: DataFrame, column: str, id_col: str = "article_id") -> DataFrame:
    """(id, idx, uri, surface_form, start) of one array of mentions; nulls in the array and null offsets are left out."""
    m = articles.select(id_col, F.posexplode(column).alias("idx", "m")).select(id_col, "idx", F.col("m.uri").alias("uri"), F.col("m.surface_form").alias("surface_form"), F.col("m.char_offset").cast("long").alias("start"))
    return m.where("surface_form is not null and start is not null")


def well_formed(mentions: DataFrame) -> DataFrame:
    """Without surfaces that hold a no-break space, without broken uris; trimmed, with offsets to match, and with an end."""
    ok = mentions.where(F.col("uri").isNotNull() & ~F.contains("surface_form", F.lit(NBSP)) & ~F.contains("uri", F.lit(NEWLINE)))
    text, start = trim_shift("surface_form", "start")
    moved = ok.select(*[c for c in mentions.columns if c not in ("surface_form", "start")], text.alias("surface_form"), start.alias("start"))
    return moved.withColumn("end", F.col("start") + F.length("surface_form")).where("end > start")


def backed_by_human(linked: DataFrame, human: DataFrame, articles: DataFrame, id_col: str = "article_id") -> DataFrame:
    """Linker mentions whose uri the article's own links name, or which is the article's own entity."""
    own = articles.select(id_col, last_segment("url").alias("uri")).where("uri is not null")
    return linked.join(human.select(id_col, "uri").unionByName(own).distinct(), [id_col, "uri"], "left_semi")


def clear_of(linked: DataFrame, human: DataFrame, id_col: str = "article_id") -> DataFrame:
    """Linker mentions that overlap no human one."""
    other = human.select(id_col, F.col("start").alias("h_start"), F.col("end").alias("h_end"))
    return overlap_join(linked, other, [id_col], ("start", "end"), ("h_start", "h_end"), "left_anti")


def merged(human: DataFrame, linked: DataFrame) -> DataFrame:
    return human.withColumn("layer", F.lit("annotations")).unionByName(linked.withColumn("layer", F.lit("el")))


def clean_mentions(articles: DataFrame, id_col: str = "article_id") -> DataFrame:
    """Human mentions and the linker's that agree with them and overlap none, disjoint within each layer."""
    human = sweep_disjoint(well_formed(exploded(articles, "annotations", id_col)), [id_col], "start", "end", ["idx"])
    linked = backed_by_human(well_formed(exploded(articles, "el", id_col)), human, articles, id_col)
    linked = sweep_disjoint(clear_of(linked, human, id_col), [id_col], "start", "end", ["idx"])
    return merged(human, linked)


def vocabulary(mentions: DataFrame, threshold: int) -> DataFrame:
    """(entity_id, symbol, cnt) of uris with at least `threshold` mentions; ids from 0 by descending count, then symbol.

    The ids need one global order; it is taken over the counts of kept uris, a table of the vocabulary's size."""
    counts = mentions.groupBy(F.col("uri").alias("symbol")).agg(F.count("*").alias("cnt")).where(F.col("cnt") >= threshold)
    return ordered_ids(counts, [F.desc("cnt"), F.asc("symbol")], "entity_id")


def ordered_ids(df: DataFrame, order: list, name: str) -> DataFrame:
    """Consecutive ids from 0 in a global order, without bringing the rows into one partition: sorted by range, counted per
    partition, numbered within it, and moved by the counts before it (one row a partition)."""
    from pyspark.sql import Window

    from spanloom.runtime import durable

    ranged = durable(df.sort(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("__part", "__first", before.alias("__before"))
    return ranged.join(F.broadcast(shifts), "__part").select((F.col("__at") - F.col("__first") + F.col("__before")).cast("long").alias(name), *df.columns)


def simple_sentences(articles: DataFrame, id_col: str = "article_id", text_col: str = "text") -> DataFrame:
    """(id, sent_no, s_start, s_end, sentence) by line breaks and by `.`, `!` or `?` before a space: a plain splitter that keeps offsets. Pieces of blanks are dropped."""
    marked = F.regexp_replace(F.regexp_replace(text_col, "\r", "\n"), "([.!?]) ", "$1\n")
    parts = articles.where(F.col(text_col).isNotNull()).select(id_col, F.split(marked, "\n").alias("parts"))
    sized = F.transform("parts", lambda p: F.length(p).cast("long") + 1)
    # running sum in one pass: a fold that carries the list of starts
    fold = F.aggregate(sized, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("xs")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["xs"], F.array(a["at"])).alias("xs")), lambda a: a["xs"])
    rows = parts.select(id_col, F.posexplode(F.arrays_zip(F.col("parts").alias("p"), fold.alias("s"))).alias("sent_no", "z"))
    return rows.select(id_col, "sent_no", F.col("z.s").alias("s_start"), (F.col("z.s") + F.length("z.p")).alias("s_end"), F.col("z.p").alias("sentence")).where(F.trim("sentence") != "")


def in_sentences(mentions: DataFrame, sentences: DataFrame, id_col: str = "article_id") -> DataFrame:
    """Each mention with the sentences it touches: inside (wholly within) or crossing."""
    s = sentences.select(F.col(id_col).alias("__id"), "sent_no", "s_start", "s_end")
    hit = (F.col(id_col) == F.col("__id")) & (F.col("start") < F.col("s_end")) & (F.col("s_start") < F.col("end"))
    return mentions.join(s, hit).drop("__id").withColumn("inside", (F.col("start") >= F.col("s_start")) & (F.col("end") <= F.col("s_end")))


def rich_sentences(placed: DataFrame, id_col: str = "article_id", min_entities: int = 2) -> DataFrame:
    """Sentences that hold mentions of at least min_entities distinct uris."""
    return placed.where("inside").groupBy(id_col, "sent_no").agg(F.count_distinct("uri").alias("n_entities"), F.count("*").alias("n_mentions")).where(F.col("n_entities") >= min_entities)


def spaced_mentions(articles: DataFrame, mentions: DataFrame, id_col: str = "article_id", text_col: str = "text") -> DataFrame:
    """(id, spaced): the text with a space on either side of every mention that lacks one. Mentions: (id, start, end), disjoint; a fold over each
    article's mentions in order, inside the JVM. Articles without mentions stay as they are; null texts stay null."""
    ms = mentions.groupBy(F.col(id_col).alias("__id")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__ms"))
    j = articles.select(F.col(id_col), F.col(text_col).alias("__t")).join(ms, F.col(id_col) == F.col("__id"), "left")
    at = lambda a, b: F.substring("__t", (a + 1).cast("int"), (b - a).cast("int"))

    def step(acc, m):
        before, own = at(acc["at"], m["start"]), at(m["start"], m["end"])
        lead = F.when((m["start"] > 0) & (at(m["start"] - 1, m["start"]) != " "), F.lit(" ")).otherwise(F.lit(""))
        trail = F.when((m["end"] < F.length("__t")) & (at(m["end"], m["end"] + 1) != " "), F.lit(" ")).otherwise(F.lit(""))
        return F.struct(F.concat(acc["out"], before, lead, own, trail).alias("out"), m["end"].cast("long").alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    folded = F.aggregate(F.coalesce("__ms", F.array().cast("array<struct<start:bigint,end:bigint>>")), start, step, lambda a: F.concat(a["out"], F.substring("__t", (a["at"] + 1).cast("int"), F.length("__t"))))
    return j.select(id_col, folded.alias("spaced"))
