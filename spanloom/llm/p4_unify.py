"""Problem 4: visually identical text with different characters, brought to one consistent form.

Every Arrow batch is handed to DuckDB inside the Python worker; embedded SQL maps compatibility forms, invisible characters, odd
spaces and look-alike letters (translate, regular expressions) and composes accents (nfc_normalize). The mapping is narrow; only
128-bit keys of the forms are shuffled to bring equal readings together.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.p5_terms import clean_uri
from spanloom.llm.textnorm import ACCENTED_FROM, ACCENTED_TO, HYPHENS, INVISIBLE, LOOKALIKE_FROM, LOOKALIKE_TO, SPACES
from spanloom.runtime import durable, table

#: One character that stands for several.
SEVERAL = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "…": "...", "‥": "..", "№": "No", "ํา": "ำ", "Ĳ": "IJ", "ĳ": "ij"}


def _single(code: int) -> str:
    """The compatibility form of a character if that is one other character, else nothing."""
    c = chr(code)
    form = unicodedata.normalize("NFKC", c)
    return form if len(form) == 1 and form != c and unicodedata.normalize("NFC", c) == c else ""


def _pairs(*ranges: tuple[int, int]) -> tuple[str, str]:
    codes = [x for a, b in ranges for x in range(a, b + 1) if _single(x)]
    return "".join(map(chr, codes)), "".join(map(_single, codes))


#: Built from a rule: full- and half-width forms; then the rarer compatibility blocks, looked up only in texts that hold any.
_WIDTH = _pairs((0xFF01, 0xFFEE))
_RARE_RANGES = ((0xAA, 0xBE), (0x17F, 0x17F), (0x2B0, 0x2E4), (0x1D2C, 0x1DBF), (0x2070, 0x209C), (0x2100, 0x214F), (0x2160, 0x217F), (0x2460, 0x24FF), (0x3200, 0x33FF), (0xFB20, 0xFEFC), (0x1D400, 0x1D7FF))
_RARE = _pairs(*_RARE_RANGES)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def form_sql(x: str) -> str:
    """DuckDB SQL for the consistent form of the string expression x: what stands at the place of each reading."""
    rare = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in _RARE_RANGES) + "]"
    e = f"case when regexp_matches({x}, '{rare}') then translate({x}, {_quoted(_RARE[0])}, {_quoted(_RARE[1])}) else {x} end"
    e = "regexp_replace(" + e + ", '[" + "".join(f"\\x{{{ord(c):X}}}" for c in INVISIBLE) + "]', '', 'g')"
    source = _WIDTH[0] + SPACES + HYPHENS + LOOKALIKE_FROM + ACCENTED_FROM
    target = _WIDTH[1] + " " * len(SPACES) + "-" * len(HYPHENS) + LOOKALIKE_TO + ACCENTED_TO
    # width first, so that a full-width letter that folds to a look-alike is caught as well
    e = f"nfc_normalize(translate({e}, {_quoted(source)}, {_quoted(target)}))"
    for a, b in SEVERAL.items():
        e = f"replace({e}, {_quoted(a)}, {_quoted(b)})"
    return e


def unify(df: DataFrame, text_col: str, keep: list[str], keys_only: bool = False) -> DataFrame:
    """The columns `keep` and the consistent form of text_col: `form`, or with keys_only `form_key` and `raw_key` (md5, hex).

    Texts that read the same throughout get the same form: compatibility, invisible, space, hyphen and look-alike variants and the
    composition of accents don't count; letter case and accents do. Nulls stay null, empty stays empty; repeated rows stay."""
    picked = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)], F.col(text_col).alias("_x"))
    plain = "regexp_full_match(_x, '[\\x00-\\x08\\x0A-\\x7F]*')"
    form = f"case when _x is null then null when {plain} then _x else {form_sql('_x')} end"
    out = "md5(form) as form_key, md5(_x) as raw_key" if keys_only else "form"
    cols = ", ".join(f"k{i}" for i in range(len(keep)))
    sql = f"select {cols}, {out} from (select *, {form} as form from batch)"

    def run(batches):
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        con.execute("set preserve_insertion_order = true")
        for rb in batches:
            batch = pa.Table.from_batches([rb])  # noqa: F841  (DuckDB finds it by name)
            yield from con.execute(sql).to_arrow_table().to_batches()

    types = [df.schema[k].dataType.simpleString() for k in keep]
    fields = ", ".join(f"k{i} {t}" for i, t in enumerate(types)) + (", form_key string, raw_key string" if keys_only else ", form string")
    done = picked.mapInArrow(run, fields)
    return done.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], *done.columns[len(keep) :])


def reading_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, class_id, n_texts, n_spellings): one row per non-empty text with its class of texts that read the same, how many are in it and how many
    differ in their characters. Counts are combined before the shuffle; no pair of a class is formed, whatever its size."""
    keys = durable(unify(df.select(id_col, text_col).where(F.length(text_col) > 0), text_col, [id_col], keys_only=True).distinct())
    spellings = keys.groupBy("form_key", "raw_key").agg(F.count("*").alias("n"))
    classes = spellings.groupBy("form_key").agg(F.sum("n").alias("n_texts"), F.count("*").alias("n_spellings"))
    return keys.join(classes, "form_key").select(id_col, F.col("form_key").alias("class_id"), "n_texts", "n_spellings")


def same_reading(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs (a_id, b_id), a_id smaller, of non-empty texts that read the same throughout but aren't equal."""
    keys = durable(unify(df.select(id_col, text_col).where(F.length(text_col) > 0), text_col, [id_col], keys_only=True).distinct())
    mixed = keys.groupBy("form_key").agg(F.min("raw_key").alias("lo"), F.max("raw_key").alias("hi")).where("lo <> hi").select("form_key")
    some = keys.join(mixed, "form_key", "left_semi")
    a, b = some.alias("a"), some.alias("b")
    return a.join(b, (F.col("a.form_key") == F.col("b.form_key")) & (F.col(f"a.{id_col}") < F.col(f"b.{id_col}")) & (F.col("a.raw_key") != F.col("b.raw_key"))).select(F.col(f"a.{id_col}").alias("a_id"), F.col(f"b.{id_col}").alias("b_id"))


def mention_variants(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, mention_id) where the surface form reads like the entity's title but isn't equal to it, plain end spaces aside."""
    titles = entities.select("entity_id", "symbol", "title")
    m = mentions.select("mention_id", clean_uri("uri").alias("symbol"), F.trim("surface_form").alias("surface")).where("symbol is not null and surface is not null")
    differing = m.join(titles, "symbol").where("surface <> title").select("entity_id", "mention_id", "surface", "title").distinct()
    # one form per spelling, not per mention
    spellings = unify(differing.select("surface").distinct(), "surface", ["surface"]).withColumnRenamed("form", "surface_read")
    titled = unify(titles, "title", ["entity_id"]).withColumnRenamed("form", "title_read")
    return differing.join(spellings, "surface").join(titled, "entity_id").where(F.trim("surface_read") == F.trim("title_read")).select("entity_id", "mention_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = same_reading(table(spark, sf_dir, "wiki_articles"), "article_id", "text").select(F.lit("text").alias("which_field"), "a_id", "b_id")
    names = mention_variants(table(spark, sf_dir, "wiki_mentions"), table(spark, sf_dir, "entity_dict"))
    return texts.unionByName(names.select(F.lit("surface_form").alias("which_field"), F.col("entity_id").alias("a_id"), F.col("mention_id").alias("b_id")).distinct())


def p4_reading_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_classes(table(spark, sf_dir, "wiki_articles"), "article_id", "text")


def p4_article_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify(table(spark, sf_dir, "wiki_articles"), "text", ["article_id"])


def p4_mention_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify(table(spark, sf_dir, "wiki_mentions"), "surface_form", ["mention_id"])


_ARTICLE_SQL = f"select article_id, {form_sql('text')} as form from wiki_articles"
_MENTION_SQL = f"select mention_id, {form_sql('surface_form')} as form from wiki_mentions"
_FOUND_SQL = (
    r"""
with a as (select article_id, text, """
    + form_sql("text")
    + r""" as form from wiki_articles where text <> ''),
m as (select distinct mention_id, trim(surface_form, ' ') as surface,
             replace(case when contains(u, '%') then url_decode(u) else u end, ' ', '_') as symbol
      from (select *, regexp_replace(uri, '^[\s\x0B\x1C-\x1F\x{85}\p{Z}]+|[\s\x0B\x1C-\x1F\x{85}\p{Z}]+$', '', 'g') as u from wiki_mentions)),
j as (select distinct entity_id, mention_id, surface, title from m join entity_dict using (symbol) where surface <> title)
select 'text' as which_field, x.article_id as a_id, y.article_id as b_id from a x join a y
on x.form = y.form and x.article_id < y.article_id and x.text <> y.text
union all
select distinct 'surface_form', entity_id, mention_id from (select *, """
    + form_sql("surface")
    + " as sr, "
    + form_sql("title")
    + " as tr from j) where trim(sr, ' ') = trim(tr, ' ')"
)

_CLASS_SQL = f"""with f as (select article_id, md5({form_sql('text')}) as class_id, text from wiki_articles where text <> '')
select article_id, class_id, count(*) over (partition by class_id) as n_texts, (select count(distinct g.text) from f g where g.class_id = f.class_id) as n_spellings from f"""

QUERIES = {"p4_found": p4_found, "p4_article_forms": p4_article_forms, "p4_mention_forms": p4_mention_forms, "p4_reading_classes": p4_reading_classes}
ORACLE = {"p4_found": _FOUND_SQL, "p4_article_forms": _ARTICLE_SQL, "p4_mention_forms": _MENTION_SQL, "p4_reading_classes": _CLASS_SQL}
