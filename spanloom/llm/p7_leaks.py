"""Problem 7: held-out passages that occur wholly or partly in corpus documents.

Training suffix arrays: documents are laid out in blocks of bounded size, each with a suffix array over its tokens, built once. The test set lies
in the shared folder in shards of bounded size; every suffix of every item is binary-searched in the array, token by token, which gives its
longest verbatim match and the places of all matches of a seed's length; these are grown to maximal ones. An exact check then chains the matches of
one (document, item) pair into at most two stretches with few changes. The corpus is read and laid out once and never shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.textnorm import caseless_form
from spanloom.runtime import open_store, stored, table

#: Tokens of one suffix array, characters of test items in one shard, and pairs of item suffix and place looked at together.
BLOCK_TOKENS, ITEM_CHARS, PAIRS = 1_500_000, 4_000_000, 4_000_000
#: Share of an item that a document must hold; changes per held token, and one more, that are still "about one in ten".
SHARE, CHANGED = 0.5, 0.1
#: Per mode (words, characters): tokens of a seed, widest gap within a stretch, and room for a sentence between two stretches.
MODES = {"w": (4, 6, 45), "c": (5, 9, 100)}

#: Scripts without spaces between words: Thai, Lao, Tibetan, Burmese, Khmer, kana, Han.
_SPACELESS = "\u0e00-\u0eff\u0f00-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_TAG = re.compile(r"<[^<>\n]{1,200}>|&(?:[a-z]{2,8}|#\d{1,6});")
_DROP = re.compile(r"[^\w\s]|_")
_ONE = re.compile(rf"[{_SPACELESS}]")
_CHAR = re.compile(r"[^\W_]")


def plain(text: str) -> str:
    """The text with case, markup and look-alikes set aside."""
    return caseless_form(_TAG.sub(" ", text) if "<" in text or "&" in text else text)


def tokens(text: str, mode: str) -> list[str] | str:
    """Of a plain text: words with punctuation deleted, or single letters and digits (as one string)."""
    return "".join(_CHAR.findall(text)) if mode == "c" else _DROP.sub("", text).split()


def _coded(texts: list, code: dict[str, int], mode: str, grow: bool) -> np.ndarray:
    """Tokens of all texts as numbers from 1 (0: not in `code`, unless it may grow)."""
    if mode == "w":
        get = (lambda t: code.setdefault(t, len(code) + 1)) if grow else (lambda t: code.get(t, 0))
        return np.fromiter(map(get, (t for ts in texts for t in ts)), dtype=np.int64, count=sum(map(len, texts)))
    letters = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    distinct, which = np.unique(letters, return_inverse=True)
    if grow:
        for c in distinct.tolist():
            code.setdefault(chr(c), len(code) + 1)
    return np.array([code.get(chr(c), 0) for c in distinct.tolist()], dtype=np.int64)[which] if len(letters) else np.zeros(0, np.int64)


def spaceless(text: str) -> int:
    """Letters of scripts without spaces."""
    return 0 if text.isascii() else len(_ONE.findall(text))


def mode_of(item: str) -> str:
    """How an item is read: by characters where more than three in ten are of a spaceless script, else by words."""
    return "c" if spaceless(item) > 0.3 * max(1, len(_CHAR.findall(item))) else "w"


def needed(item: str) -> int:
    """Letters of spaceless scripts that a document must have to hold an item read by characters: all of a short item's, else half of them less the
    changes, as half of the item without those would be names in another script."""
    n, own = len(_CHAR.findall(item)), spaceless(item)
    return own if n < 2 * MODES["c"][0] else int(SHARE * (1 - CHANGED) * own)


def suffix_array(ids: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` tokens, each as far as the end of its document. Prefix doubling, first by as many tokens as
    fit one number, then only within groups that are still tied. ids: tokens as numbers from 1."""
    n = len(ids)
    bits = max(1, int(ids.max(initial=0)).bit_length())
    h = max(1, 62 // bits)
    place = np.arange(n)
    key = np.zeros(n, dtype=np.int64)
    for j in range(h):
        key <<= bits
        if j < n:
            key[: n - j] |= np.where(place[j:] < end[: n - j], ids[j:], 0)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    while h < depth:
        first = np.flatnonzero(new)
        at = np.flatnonzero(np.repeat(np.diff(np.append(first, n)) > 1, np.diff(np.append(first, n))))
        if not len(at):
            break
        pos = order[at]
        nxt = pos + h
        key = rank[pos] * (n + 2) + np.where(nxt < end[pos], rank[np.minimum(nxt, n - 1)] + 1, 0)
        o = np.argsort(key, kind="stable")
        order[at], key = pos[o], key[o]
        fresh = np.append(True, key[1:] != key[:-1])
        new[at] = fresh
        rank[order[at]] = np.maximum.accumulate(np.where(fresh, at, 0))
        h *= 2
    return order


class Shelf:
    """A block of documents of one mode: their tokens as numbers, and the suffix array over them."""

    def __init__(self, docs: list[tuple], depth: int, mode: str):
        self.name = [i for i, _ in docs]
        self.code: dict[str, int] = {}
        lens = np.array([len(t) for _, t in docs], dtype=np.int64)
        self.ids = _coded([t for _, t in docs], self.code, mode, True)
        self.start = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(docs)), lens)
        self.end = self.start[self.doc + 1] if len(docs) else self.start[:0]
        self.order = suffix_array(self.ids, self.end, depth)

    def _at(self, rows: np.ndarray, level: int) -> np.ndarray:
        """Token `level` places into the suffixes of these rows; 0 beyond the end of the document."""
        p = self.order[rows]
        inside = p + level < self.end[p]
        return np.where(inside, self.ids[np.minimum(p + level, len(self.ids) - 1)], 0)

    def narrow(self, lo: np.ndarray, hi: np.ndarray, level: int, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the rows [lo, hi), whose suffixes agree in their first `level` tokens, those that go on with the token: binary search at either end."""
        out = []
        for right in (False, True):
            a, b = lo.copy(), hi.copy()
            while True:
                live = np.flatnonzero(a < b)
                if not len(live):
                    break
                mid = (a[live] + b[live]) >> 1
                x = self._at(mid, level)
                below = (x <= token[live]) if right else (x < token[live])
                a[live] = np.where(below, mid + 1, a[live])
                b[live] = np.where(below, b[live], mid)
            out.append(a)
        return out[0], out[1]


class Items:
    """Test items of one mode: tokens as numbers of a shelf (0 for what it does not hold) and all their suffixes."""

    def __init__(self, rows: list[tuple], code: dict[str, int], mode: str):
        self.item_id = [i for i, _ in rows]
        self.sizes = np.array([len(ts) for _, ts in rows], dtype=np.int64)
        self.ids = _coded([t for _, t in rows], code, mode, False)
        self.start = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(rows)), self.sizes)


def longest_matches(shelf: Shelf, items: Items, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every item suffix: (tokens of its longest match in the shelf, rows of the suffixes that share its first k tokens as [lo, hi), tokens asked).

    An item of fewer than k tokens is asked for as a whole, by its first suffix."""
    n = len(items.ids)
    left = items.start[items.owner + 1] - np.arange(n) if n else np.zeros(0, np.int64)
    asked = np.minimum(k, items.sizes[items.owner]) if n else left
    lo, hi = np.zeros(n, np.int64), np.full(n, len(shelf.ids))
    seed_lo, seed_hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    length = np.zeros(n, np.int64)
    live, level = np.flatnonzero(items.ids > 0), 0
    while len(live):
        a, b = shelf.narrow(lo[live], hi[live], level, items.ids[live + level])
        lo[live], hi[live] = a, b
        live = live[b > a]
        level += 1
        length[live] = level
        seed = live[asked[live] == level]
        seed_lo[seed], seed_hi[seed] = lo[seed], hi[seed]
        live = live[left[live] > level]
        live = live[items.ids[live + level] > 0]
    return length, seed_lo, seed_hi, asked


def matches(shelf: Shelf, items: Items, k: int):
    """Maximal verbatim matches of at least k tokens (or a whole shorter item) as rows (doc, item, place in item, place in doc, length), in portions of
    whole documents, so that no number of items with one opening fills the memory."""
    _, lo, hi, asked = longest_matches(shelf, items, k)
    size = hi - lo
    if not size.sum():
        return
    # the documents in stretches that hold about PAIRS pairs each
    if size.sum() > PAIRS:
        weight = np.zeros(len(shelf.name), dtype=np.int64)
        for a, b in _portions(size):
            rows = _rows(lo[a:b], size[a:b])
            weight += np.bincount(shelf.doc[shelf.order[rows]], minlength=len(weight))
        group = np.cumsum(weight) // PAIRS
    else:
        group = np.zeros(len(shelf.name), dtype=np.int64)
    for g in np.unique(group).tolist():
        parts = []
        for a, b in _portions(size):
            which = np.repeat(np.arange(a, b), size[a:b])
            q = shelf.order[_rows(lo[a:b], size[a:b])]
            d = shelf.doc[q]
            i = items.owner[which]
            p = which - items.start[i]
            before_q, before_p = q > shelf.start[d], p > 0
            same = before_q & before_p & (shelf.ids[q - 1] == items.ids[which - 1])
            keep = ~same & (group[d] == g)
            which, q, d, i, p = which[keep], q[keep], d[keep], i[keep], p[keep]
            n = asked[which].copy()
            live = np.arange(len(n))
            while len(live):
                x, y = which[live] + n[live], q[live] + n[live]
                inside = (x < items.start[i[live] + 1]) & (y < shelf.end[q[live]])
                live, x, y = live[inside], x[inside], y[inside]
                live = live[items.ids[x] == shelf.ids[y]]
                n[live] += 1
            parts.append(np.stack([d, i, p, q - shelf.start[d], n], axis=1))
        runs = np.concatenate(parts)
        yield runs[np.lexsort((runs[:, 2], runs[:, 3] - runs[:, 2], runs[:, 1], runs[:, 0]))]


def _portions(size: np.ndarray):
    ends = np.cumsum(size)
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
        yield a, b
        a = b


def _rows(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)


def candidates(runs: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Runs by (doc, item) pair, of pairs whose matches near some diagonal add up to a fifth of the item."""
    if not len(runs):
        return []
    pair = runs[:, 0] * len(sizes) + runs[:, 1]
    band = (runs[:, 3] - runs[:, 2] + (1 << 24)) >> 4
    both, inverse = np.unique(pair * (1 << 28) + band, return_inverse=True)
    held = np.bincount(inverse, weights=runs[:, 4])
    nxt = np.searchsorted(both, both + 1)
    joined = held + np.where((nxt < len(both)) & (both[np.minimum(nxt, len(both) - 1)] == both + 1), held[np.minimum(nxt, len(both) - 1)], 0)
    strong = np.unique((both >> 28)[joined >= 0.2 * sizes[(both >> 28) % len(sizes)]])
    edges = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    bounds = np.append(edges, len(pair))
    keep = np.isin(pair[edges], strong, assume_unique=True)
    return [runs[a:b] for a, b, k in zip(bounds[:-1], bounds[1:], keep, strict=True) if k]


def held(runs: np.ndarray, item: np.ndarray, text: np.ndarray, gap: int, between: int) -> tuple[int, int]:
    """(tokens of the item held, changes among them) of the best chain: one stretch, or two with at most `between` tokens between."""
    rs = sorted((int(q), int(p), int(n)) for _, _, p, q, n in runs)
    size = len(item)
    least = max(4, size // 6)
    state: list[list] = []
    best = (0, 0, 0)
    for j, (q, p, n) in enumerate(rs):
        # per number of jumps: (score, held, changes, length of the present stretch)
        here = [(n, n, 0, n), None]
        for i in range(j - 1, -1, -1):
            q0, p0, n0 = rs[i]
            if q - q0 > size + between + n0 + 4 * gap:
                if q - q0 > 3 * size + between:
                    break
                continue
            over = max(0, p0 + n0 - p, q0 + n0 - q)
            if over >= n:
                continue
            gp, gq = p + over - p0 - n0, q + over - q0 - n0
            if gp < 0 or gq < 0:
                continue
            new = n - over
            for jumps in (0, 1):
                s = state[i][jumps]
                if s is None:
                    continue
                if gp <= gap and gq <= gap + 4 * max(1, gp):
                    if gp == gq:
                        wrong = int((item[p0 + n0 : p + over] != text[q0 + n0 : q + over]).sum())
                    else:
                        wrong = max(gp, 1, gq // 5)
                    new_score = s[0] + new + max(0, gp - wrong) - 4 * wrong
                    if here[jumps] is None or new_score > here[jumps][0]:
                        here[jumps] = (new_score, s[1] + new + gp, s[2] + wrong, s[3] + new + gp)
                if jumps == 0 and gq <= between and gp <= size // 3 and s[3] >= least and new >= 4:
                    new_score = s[0] + new - 6
                    if here[1] is None or new_score > here[1][0]:
                        here[1] = (new_score, s[1] + new, s[2], new)
        state.append(here)
        for jumps in (0, 1):
            s = here[jumps]
            if s and s[0] > best[0] and (jumps == 0 or s[3] >= least):
                best = (s[0], s[1], s[2])
    return best[1], best[2]


def _search(shelf: Shelf, mode: str, rows: list[tuple]) -> list[tuple]:
    """(doc id, item id, share, changes) over one block of documents and one shard of items."""
    k, gap, between = MODES[mode]
    items = Items(rows, shelf.code, mode)
    found = []
    for portion in matches(shelf, items, k):
        # an item too short for a chain of seeds must stand there as a whole
        whole = portion[portion[:, 4] == items.sizes[portion[:, 1]]]
        whole = np.unique(whole[items.sizes[whole[:, 1]] < 2 * k][:, :2], axis=0)
        found += [(shelf.name[d], items.item_id[i], 1.0, 0) for d, i in whole.tolist()]
        for runs in candidates(portion[items.sizes[portion[:, 1]] >= 2 * k], items.sizes):
            d, i = int(runs[0, 0]), int(runs[0, 1])
            n, wrong = held(runs, items.ids[items.start[i] : items.start[i + 1]], shelf.ids[shelf.start[d] : shelf.start[d + 1]], gap, between)
            if n >= SHARE * items.sizes[i] and wrong <= CHANGED * n + 1:
                found.append((shelf.name[d], items.item_id[i], n / items.sizes[i], wrong))
    return found


def _written_items(passages: DataFrame, item_col: str, item_text: str) -> tuple[str, int]:
    """The test set in the shared folder, cut into shards of about ITEM_CHARS characters: (path, characters of the longest item)."""
    picked = passages.select(F.col(item_col).alias("i"), F.col(item_text).alias("t")).where(F.length("t") > 0)
    chars, longest = picked.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)), F.coalesce(F.max(F.length("t")), F.lit(0))).first()
    return stored(picked.repartition(max(1, -(-chars // ITEM_CHARS)), F.xxhash64("i", "t")), "items"), longest


def leaks(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id_col, item_col, share, changes): documents that hold at least half of an item, in order, in one or two stretches.

    Null and empty texts, in either table, match nothing, nor do texts without letters and digits; every copy of a document counts; repeated items
    are looked for once each; items of fewer than twice a seed's tokens (8 words, 10 characters) are found where they stand whole. Other columns are not read."""
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where(F.length("_t") > 0)
    kinds = docs.schema[id_col].dataType.simpleString(), passages.schema[item_col].dataType.simpleString()
    path, depth = _written_items(passages, item_col, item_text)

    def run(batches):
        import pyarrow.parquet as pq

        store, files = open_store(path)
        kept: list = []
        need = [1 << 60]

        def shards():
            """{mode: [(item, tokens)]} of one shard at a time; the only one is kept."""
            if len(files) == 1 and kept:
                yield kept[0]
                return
            for name in files:
                by: dict[str, list] = {"w": [], "c": []}
                with store.open_input_file(name) as f:
                    rows = set(zip(*(c.to_pylist() for c in pq.read_table(f, columns=["i", "t"]).columns), strict=True))
                for i, t in sorted(rows, key=lambda r: (str(r[0]), r[1])):
                    read = plain(t)
                    m = mode_of(read)
                    ts = tokens(read, m)
                    if ts:
                        by[m].append((i, ts))
                        if m == "c":
                            need[0] = min(need[0], needed(read))
                kept[:] = [by] if len(files) == 1 else []
                yield by

        for _ in shards():  # what the items need, before any document is read
            pass
        waiting: dict[str, list] = {m: [] for m in MODES}
        filled = dict.fromkeys(MODES, 0)

        def flush(m):
            best: dict[tuple, tuple] = {}
            if waiting[m]:
                shelf = Shelf(waiting[m], depth, m)
                for by in shards():
                    if by[m]:
                        for d, i, share, wrong in _search(shelf, m, by[m]):
                            best[d, i] = max(best.get((d, i), (0.0, 0)), (share, -wrong))
            waiting[m], filled[m] = [], 0
            return pd.DataFrame([(d, i, s, -w) for (d, i), (s, w) in best.items()], columns=[id_col, item_col, "share", "changes"])

        for pdf in batches:
            for i, t in zip(pdf["_id"], pdf["_t"], strict=True):
                read = plain(t)
                for m in ("w", "c") if spaceless(read) >= need[0] else ("w",):
                    ts = tokens(read, m)
                    if ts:
                        waiting[m].append((i, ts))
                        filled[m] += len(ts)
                        if filled[m] >= BLOCK_TOKENS:
                            yield flush(m)
        for m in MODES:
            yield flush(m)

    return picked.mapInPandas(run, f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}, share double, changes int")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_passages")).select("doc_id", "item_id").distinct()


def p7_clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and texts of documents that hold no test item."""
    docs = table(spark, sf_dir, "documents")
    return docs.join(p7_found(spark, sf_dir).select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "text")


def p7_leaks_per_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per benchmark and split: items leaked, documents affected."""
    items = table(spark, sf_dir, "eval_passages").select("item_id", "benchmark", "split")
    return p7_found(spark, sf_dir).join(items, "item_id").groupBy("benchmark", "split").agg(F.count_distinct("item_id").alias("items"), F.count_distinct("doc_id").alias("documents"))


QUERIES = {"p7_found": p7_found, "p7_clean_documents": p7_clean_documents, "p7_leaks_per_benchmark": p7_leaks_per_benchmark}
ORACLE: dict[str, str] = {}
