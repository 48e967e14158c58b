"""Problem 1: oversized items cut into pieces under a limit, at natural boundaries, with an overlap.

A piece ends at a natural boundary and begins exactly `overlap` before the end of the one before it, wherever that falls, as what is repeated has a
given size. Per item, dynamic programming over boundary positions minimises the sum of cut penalties and squared deviations from an even piece
size, subject to the maximum length and the overlap. The work is per row, hence narrow; nothing is shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.segment import units
from spanloom.llm.textnorm import reading_form
from spanloom.runtime import table

#: Penalties by kind of cut.
LINE, SENTENCE, WORD, INSIDE = 0.0, 0.2, 5.0, 25.0
#: Cost of one more piece, and of a piece that is off the even size by the whole limit.
PIECE, UNEVEN = 1.0, 4.0


def plan(length: int, limit: int, overlap: int, positions: np.ndarray, penalties: np.ndarray) -> list[int] | None:
    """Cuts 0 = c0 < c1 < ... < length of least total cost, or None where the positions leave a gap too wide.

    The first piece may hold `limit`, each later one `limit - overlap` of new content, as it repeats `overlap` before it."""
    p = np.concatenate([[0], positions, [length]])
    pen = np.concatenate([[0.0], penalties, [0.0]])
    room = limit - overlap
    n = max(1, int(np.ceil((length - overlap) / room)))
    even = (length + (n - 1) * overlap) / n
    m = len(p)
    cost, back = np.full(m, np.inf), np.zeros(m, dtype=np.int64)
    cost[0] = 0.0
    lo = 0
    for j in range(1, m):
        while p[j] - p[lo] > (limit if lo == 0 else room):
            lo += 1
            if lo == j:
                return None
        size = p[j] - p[lo:j] + overlap
        if lo == 0:
            size[0] -= overlap
        total = cost[lo:j] + UNEVEN * ((size - even) / limit) ** 2
        k = int(total.argmin())
        cost[j], back[j] = total[k] + pen[j] + PIECE, lo + k
    if not np.isfinite(cost[-1]):
        return None
    cuts, j = [], m - 1
    while j:
        cuts.append(int(p[j]))
        j = back[j]
    return [0, *cuts[::-1]]


def cut(length: int, limit: int, overlap: int, natural: list[tuple[int, float]], finer) -> list[tuple[int, int]]:
    """Ranges (start, end), overlap included, that cover 0..length.

    natural: (position, penalty) of line and sentence ends. finer(a, b): word ends between a and b, asked for only where
    natural boundaries stand too far apart; where even words are too long, single positions fill in."""
    if length <= limit:
        return [(0, length)]
    room = limit - overlap
    marks = dict(natural)
    edges = [0, *sorted(x for x in marks if 0 < x < length), length]
    marks = {x: marks[x] for x in edges[1:-1]}
    for a, b in zip(edges, edges[1:]):
        if b - a > room // 2:
            words = [x for x in finer(a, b) if a < x < b]
            marks.update((x, WORD) for x in words if x not in marks)
            ends = [a, *words, b]
            for u, v in zip(ends, ends[1:]):
                if v - u > room // 4:
                    step = max(1, room // 4)
                    marks.update((x, INSIDE) for x in range(u + step, v, step) if x not in marks)
    keys = np.array(sorted(marks), dtype=np.int64)
    cuts = plan(length, limit, overlap, keys, np.array([marks[x] for x in keys.tolist()]))
    assert cuts is not None
    return [(max(0, a - overlap) if a else 0, b) for a, b in zip(cuts, cuts[1:])]


_WORD_END = re.compile(r"\s+")


def text_pieces(text: str, lang: str | None, limit: int, overlap: int) -> tuple[list[tuple[int, int]], str]:
    if len(text) <= limit:
        return [(0, len(text))], "whole"
    found = units(text, lang)
    natural = []
    for (_, e), (s, _e) in zip(found, found[1:]):
        natural.append((s, LINE if any(c in text[e:s] for c in "\n\r") else SENTENCE))
    spans = cut(len(text), limit, overlap, natural, lambda a, b: [m.end() for m in _WORD_END.finditer(text, a, b)])
    return spans, kind_of([e for _, e in spans[:-1]], found or [(0, len(text))], limit)


def kind_of(cuts: list[int], sentences: list[tuple[int, int]], limit: int) -> str:
    """`forced` if a chosen cut lies inside a sentence that exceeds the limit by itself, else `natural`."""
    long = [(a, b) for a, b in sentences if b - a > limit]
    return "forced" if any(a < c < b for a, b in long for c in cuts) else "natural"


_ENDS = frozenset(".?!")


def token_pieces(tokens: list, limit: int, overlap: int) -> tuple[list[tuple[int, int]], str]:
    """Ranges over the given list; null and blank tokens ride along without counting."""
    real = [i for i, t in enumerate(tokens) if t is not None and t.strip()]
    n = len(real)
    if n <= limit:
        return [(0, len(tokens))], "whole"
    ends = [k + 1 for k, i in enumerate(real) if tokens[i].strip() in _ENDS or reading_form(tokens[i]).strip() in _ENDS]
    bounds = [0, *ends, *([n] if not ends or ends[-1] != n else [])]
    spans = cut(n, limit, overlap, [(x, SENTENCE) for x in ends if x < n], lambda a, b: range(a + 1, b))
    kind = kind_of([b for _, b in spans[:-1]], list(zip(bounds, bounds[1:])), limit)
    return [(real[a] if a else 0, real[b] if b < n else len(tokens)) for a, b in spans], kind


def split_texts(df: DataFrame, id_col: str, text_col: str = "text", lang_col: str | None = None, limit: int = 4000, overlap: int = 200, with_content: bool = True) -> DataFrame:
    """Pieces of every text: (id_col, piece_no, piece_start, piece_end, cut_kind[, piece]).

    cut_kind is `whole` within the limit, `forced` if one sentence exceeds it, else `natural`. Null and empty texts give no
    rows; repeated ids are split row by row; further columns are not read."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    picked = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_v"), (F.col(lang_col) if lang_col else F.lit(None).cast("string")).alias("_lang")).where(F.length("_v") > 0)
    return _pieces(picked, df.schema[id_col].dataType.simpleString(), id_col, lambda v, lang: text_pieces(v, lang, limit, overlap), with_content and "string")


def split_tokens(df: DataFrame, id_col: str, tokens_col: str = "tokens", limit: int = 123, overlap: int = 16, with_content: bool = True) -> DataFrame:
    """Pieces of every token list, ranges over the list as it stands; null and empty lists give no rows. Else as split_texts."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    picked = df.select(F.col(id_col).alias("_id"), F.col(tokens_col).alias("_v"), F.lit(None).cast("string").alias("_lang")).where(F.size("_v") > 0)
    return _pieces(picked, df.schema[id_col].dataType.simpleString(), id_col, lambda v, lang: token_pieces(v, limit, overlap), with_content and "array<string>")


def _pieces(picked: DataFrame, id_type: str, id_col: str, work, content: str | bool) -> DataFrame:
    def run(batches):
        for pdf in batches:
            out: dict[str, list] = {"id": [], "no": [], "s": [], "e": [], "kind": [], "piece": []}
            for i, v, lang in zip(pdf["_id"], pdf["_v"], pdf["_lang"], strict=True):
                spans, kind = work(v if isinstance(v, str) else list(v), lang)
                for k, (s, e) in enumerate(spans):
                    out["id"].append(i)
                    out["no"].append(k)
                    out["s"].append(s)
                    out["e"].append(e)
                    out["kind"].append(kind)
                    if content:
                        out["piece"].append(v[s:e])
            frame = {id_col: pd.Series(out["id"], dtype=pdf["_id"].dtype), "piece_no": pd.Series(out["no"], dtype="int32"), "piece_start": pd.Series(out["s"], dtype="int64"), "piece_end": pd.Series(out["e"], dtype="int64"), "cut_kind": pd.Series(out["kind"], dtype=object)}
            if content:
                frame["piece"] = pd.Series(out["piece"], dtype=object)
            yield pd.DataFrame(frame)

    schema = f"`{id_col}` {id_type}, piece_no int, piece_start bigint, piece_end bigint, cut_kind string" + (f", piece {content}" if content else "")
    return picked.mapInPandas(run, schema)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = split_tokens(table(spark, sf_dir, "tacred_examples"), "example_id", with_content=False).select(F.lit("tacred_examples").alias("table_name"), F.col("example_id").alias("record_id"), "cut_kind", "piece_no")
    texts = split_texts(table(spark, sf_dir, "wiki_articles"), "article_id", lang_col="lang", with_content=False).select(F.lit("wiki_articles").alias("table_name"), F.col("article_id").alias("record_id"), "cut_kind", "piece_no")
    return tokens.unionByName(texts).where("piece_no = 0 and cut_kind <> 'whole'").drop("piece_no")


def p1_token_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_tokens(table(spark, sf_dir, "tacred_examples"), "example_id")


def p1_text_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_texts(table(spark, sf_dir, "wiki_articles"), "article_id", lang_col="lang")


QUERIES = {"p1_found": p1_found, "p1_token_pieces": p1_token_pieces, "p1_text_pieces": p1_text_pieces}
ORACLE: dict[str, str] = {}
