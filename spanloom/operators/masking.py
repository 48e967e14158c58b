"""Relation statements with their mentions masked or marked, rebuilt as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marker tokens.
HEAD, TAIL, BLANK = "<head>", "<tail>", "<blank>"
S_HEAD, E_HEAD, S_TAIL, E_TAIL = "<s_head>", "<e_head>", "<s_tail>", "<e_tail>"
BLANK_HEAD_OTHER, BLANK_TAIL_OTHER = "<blank_head_other>", "<blank_tail_other>"
SPECIAL = (HEAD, TAIL, BLANK, S_HEAD, E_HEAD, S_TAIL, E_TAIL, BLANK_HEAD_OTHER, BLANK_TAIL_OTHER)


def pieces(tokens: str, spans: list[tuple[str, str, Column]]) -> Column:
    """Tokens with each disjoint, non-empty span (start, end, replacement array) replaced: every position yields nothing (inside a span), the
    replacement (at its start) or itself, and the pieces are flattened. Positions count from 0."""

    def at(tok: Column, i: Column) -> Column:
        out = F.array(tok)
        for s, e, rep in spans:
            out = F.when((i >= F.col(s)) & (i < F.col(e)), F.when(i == F.col(s), rep).otherwise(F.array().cast("array<string>"))).otherwise(out)
        return out

    return F.flatten(F.transform(tokens, at))


def replacement(mask: Column, tokens: str, s: str, e: str, before: str | None, after: str | None) -> Column:
    """`<blank>` if masked, else the mention's own tokens; between markers if given."""
    own = F.slice(tokens, F.col(s) + 1, F.col(e) - F.col(s))
    core = F.when(mask, F.array(F.lit(BLANK))).otherwise(own)
    return F.concat(F.array(F.lit(before)), core, F.array(F.lit(after))) if before else core


def start_end_masked(df: DataFrame, tokens: str, head: tuple[str, str], tail: tuple[str, str], mask_head: Column, mask_tail: Column) -> Column:
    """Mentions between start and end markers."""
    return pieces(tokens, [(*head, replacement(mask_head, tokens, *head, S_HEAD, E_HEAD)), (*tail, replacement(mask_tail, tokens, *tail, S_TAIL, E_TAIL))])


def concat_masked(tokens: str, head: tuple[str, str], tail: tuple[str, str], mask_head: Column, mask_tail: Column) -> tuple[Column, Column, Column]:
    """Tokens without markers, and the new starts of both mentions (moved by what shrank before them)."""
    text = pieces(tokens, [(*head, replacement(mask_head, tokens, *head, None, None)), (*tail, replacement(mask_tail, tokens, *tail, None, None))])
    lost_head = F.when(mask_head, F.col(head[1]) - F.col(head[0]) - 1).otherwise(0)
    lost_tail = F.when(mask_tail, F.col(tail[1]) - F.col(tail[0]) - 1).otherwise(0)
    new_head = F.col(head[0]) - F.when(F.col(tail[0]) < F.col(head[0]), lost_tail).otherwise(0)
    new_tail = F.col(tail[0]) - F.when(F.col(head[0]) < F.col(tail[0]), lost_head).otherwise(0)
    return text, new_head, new_tail


def with_bos(tokens: str, *positions: str, bos: str = "<s>") -> list[Column]:
    """Tokens with a first token put before them, and positions moved by one."""
    return [F.concat(F.array(F.lit(bos)), F.col(tokens)).alias(tokens), *[(F.col(p) + 1).alias(p) for p in positions]]


def decoded(tokens: str | Column, pads: tuple[str, ...] = ("<pad>", "<s>", "</s>")) -> Column:
    """Readable text of tokens: pads out, markers spelt."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.array_join(F.filter(t, lambda x: x.isNotNull() & ~x.isin(*pads)), " ")


def truncated(df: DataFrame, tokens: str, lo: str, hi: str, limit: int) -> tuple[Column, Column]:
    """(start, end) of a window of at most limit - 1 tokens around [lo, hi): grown in turns to the right and to the left, as far as either
    side has tokens; null where the span itself is too long."""
    size = F.size(tokens)
    room = F.lit(limit - 1) - (F.col(hi) - F.col(lo))
    left_has, right_has = F.col(lo), size - F.col(hi)
    half_r, half_l = F.ceil(room / 2), F.floor(room / 2)
    take_l = F.least(left_has, half_l + F.greatest(half_r - right_has, F.lit(0)))
    take_r = F.least(right_has, half_r + F.greatest(half_l - left_has, F.lit(0)))
    ok = room >= 0
    return F.when(ok, F.col(lo) - take_l).cast("int"), F.when(ok, F.col(hi) + take_r).cast("int")


def other_mentions_masked(tokens: str, groups: list[tuple[Column, Column, str, str]]) -> Column:
    """Tokens with mentions of masked entities blanked: of each group (mentions, mask, target, other), where masked, the first mention becomes `target` and every other
    one `other`; unmasked ones stay. mentions: array of (s, e) structs, ends exclusive, the target first; a place in several mentions goes by the first of them."""

    def at(tok: Column, i: Column) -> Column:
        out = F.array(tok)
        for mentions, mask, target, other in reversed(groups):
            hit = F.get(F.filter(F.transform(mentions, lambda m, k: F.struct(k.alias("k"), m["s"].alias("s"), m["e"].alias("e"))), lambda m: (i >= m["s"]) & (i < m["e"])), F.lit(0))
            blank = F.when(hit["k"] == 0, F.lit(target)).otherwise(F.lit(other))
            out = F.when(mask & hit.isNotNull(), F.when(hit["s"] == i, F.array(blank)).otherwise(F.array().cast("array<string>"))).otherwise(out)
        return out

    return F.flatten(F.transform(tokens, at))
