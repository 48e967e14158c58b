"""Problem 5: how often every distinct term occurs, in how many records, and whether that is too rare or too common.

Burst-trie counting. Each partition accumulates (occurrences, records) per term in a burst trie: containers of suffixes under a
prefix, which burst into children when they hold too many terms. The sizes of burst nodes, added up over all workers, give a routing table of
adaptive prefixes of about even load; every worker cuts its trie along it and sends compact subtrees, and matching subtrees are
merged where they meet. A hot term is one entry per worker, whatever its share of the rows.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.runtime import durable, table

#: Terms a container holds before it bursts, and how deep prefixes may grow.
BURST, DEEPEST = 512, 64
#: Subtrees aimed at over the whole collection at least, and terms in one at most; terms a worker holds before it sends its trie on.
ROUTES, ROUTE_TERMS, HELD = 256, 2_000_000, 1_000_000

_WS = r"[\s\u000B\u001C-\u001F\u0085\p{Z}]+"


def clean_uri(c: str | F.Column) -> F.Column:
    """White space of any kind trimmed at both ends, percent-decoded as UTF-8, spaces as underscores.

    Null for null and blank uris and those with a line break; broken escapes leave the uri as it stands."""
    c = F.col(c) if isinstance(c, str) else c
    trimmed = F.regexp_replace(c, f"^{_WS}|{_WS}$", "")
    decoded = F.when(F.instr(trimmed, "%") > 0, F.coalesce(F.try_url_decode(F.replace(trimmed, F.lit("+"), F.lit("%2B"))), trimmed)).otherwise(trimmed)
    out = F.replace(decoded, F.lit(" "), F.lit("_"))
    return F.when((F.length(out) > 0) & ~out.rlike(r"[\n\r\u000B\u000C\u0085\u2028\u2029]"), out)


class BurstTrie:
    """Counts per term: a node maps a character to a container (dict of suffix -> [occurrences, records]) or to a further node."""

    __slots__ = ("burst", "root", "terms")

    def __init__(self, burst: int = BURST):
        self.burst = burst
        self.terms = 0
        self.root: dict = {}

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, depth = self.root, 0
        while True:
            key = term[depth : depth + 1]
            child = node.get(key)
            if child is None:
                child = node[key] = (False, {})
            if child[0] and key:
                node, depth = child[1], depth + 1
                continue
            box = child[1]
            suffix = term[depth + 1 :]
            seen = box.get(suffix)
            if seen is None:
                box[suffix] = [occurrences, records]
                self.terms += 1
                if len(box) > self.burst and key and depth < DEEPEST:
                    node[key] = (True, self._burst(box))
            else:
                seen[0] += occurrences
                seen[1] += records
            return

    @staticmethod
    def _burst(box: dict) -> dict:
        node: dict = {}
        for suffix, counts in box.items():
            key = suffix[:1]
            if key not in node:
                node[key] = (False, {})
            node[key][1][suffix[1:]] = counts
        return node

    def containers(self):
        """(prefix, container) in depth-first order."""
        stack = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            for key, (inner, child) in node.items():
                if inner:
                    stack.append((prefix + key, child))
                else:
                    yield prefix + key, child

    def items(self):
        for prefix, box in self.containers():
            for suffix, (occurrences, records) in box.items():
                yield prefix + suffix, occurrences, records


def route_starts(sizes: list[tuple[str, int]], target: int) -> list[str]:
    """Starting points of the routes: leaf prefixes in order, closed whenever `target` terms have gathered."""
    starts, filled = [""], 0
    for prefix, n in sorted(sizes):
        if filled >= target and prefix:
            starts.append(prefix)
            filled = 0
        filled += n
    return starts


def _leaves(marks: dict[str, int]) -> list[tuple[str, int]]:
    """Prefixes with the terms under each that no longer prefix at hand counts."""
    left = dict(marks)
    for p in sorted(marks, key=len, reverse=True):
        up = next((p[:k] for k in range(len(p) - 1, -1, -1) if p[:k] in marks), None)
        if up is not None:
            left[up] -= marks[p]
    return list(left.items())


def term_frequencies(df: DataFrame, term_col: str, record_col: str) -> DataFrame:
    """(term, occurrences, records) of every distinct non-null term; records counts distinct non-null record_col values.

    One row is one occurrence: repeated rows count, ties need no order, an empty table gives no rows, and columns other than the
    two are not read. Terms of any length are kept whole."""
    per_record = df.select(F.col(term_col).alias("term"), F.col(record_col).alias("_record")).where("term is not null")
    # one row per (term, record), combined before the shuffle, so that a hot term or record is spread
    per_record = per_record.groupBy("term", "_record").agg(F.count("*").alias("occurrences"))
    local = per_record.select("term", "occurrences", F.col("_record").isNotNull().cast("bigint").alias("records"))

    def count(batches):
        trie = BurstTrie()

        def sent():
            rows = [(p, list(box), [c[0] for c in box.values()], [c[1] for c in box.values()]) for p, box in trie.containers()]
            for k in range(0, len(rows), 2000):
                part = rows[k : k + 2000]
                yield pd.DataFrame({"prefix": [r[0] for r in part], "suffixes": [r[1] for r in part], "occ": [r[2] for r in part], "rec": [r[3] for r in part]})

        for pdf in batches:
            for t, occ, rec in zip(pdf["term"], pdf["occurrences"], pdf["records"], strict=True):
                trie.add(t, int(occ), int(rec))
            if trie.terms > HELD:
                yield from sent()
                trie = BurstTrie()
        yield from sent()

    trees = durable(local.mapInPandas(count, "prefix string, suffixes array<string>, occ array<bigint>, rec array<bigint>"))
    total = trees.agg(F.sum(F.size("suffixes"))).first()[0] or 0
    routes = max(ROUTES, -(-total // ROUTE_TERMS))
    big = max(1, total // routes)
    # sizes by leading characters, deeper and deeper below prefixes that are too large, as far as the containers' own prefixes tell them apart; what
    # comes to the driver is at most 8 prefixes a route and depth
    marks: dict[str, int] = {}
    heavy, depth = None, 3
    while depth <= DEEPEST:
        below = trees if heavy is None else trees.join(F.broadcast(heavy), F.substring("prefix", 1, depth // 2) == F.col("p"), "left_semi")
        sizes = below.groupBy(F.substring("prefix", 1, depth).alias("p")).agg(F.sum(F.size("suffixes")).alias("n")).where(F.col("n") > big // 8).collect()
        marks |= {r["p"]: r["n"] for r in sizes}
        large = [(r["p"],) for r in sizes if r["n"] > big and len(r["p"]) == depth]
        if not large:
            break
        heavy, depth = trees.sparkSession.createDataFrame(large, "p string"), 2 * depth
    starts = route_starts(_leaves(marks), big)

    def cut(batches):
        for pdf in batches:
            out: dict[tuple[int, str], list] = {}
            for p, suffixes, occ, rec in zip(pdf["prefix"], pdf["suffixes"], pdf["occ"], pdf["rec"], strict=True):
                lo, hi = bisect_right(starts, p) - 1, bisect_right(starts, p + "\U0010ffff") - 1
                if lo == hi:
                    out.setdefault((lo, p), [[], [], []])
                    for box, values in zip(out[(lo, p)], (suffixes, occ, rec), strict=True):
                        box.extend(values)
                    continue
                for s, a, b in zip(suffixes, occ, rec, strict=True):  # a route starts inside this container
                    box = out.setdefault((bisect_right(starts, p + s) - 1, p), [[], [], []])
                    box[0].append(s)
                    box[1].append(a)
                    box[2].append(b)
            keys = list(out)
            yield pd.DataFrame({"route": [k[0] for k in keys], "prefix": [k[1] for k in keys], "suffixes": [out[k][0] for k in keys], "occ": [out[k][1] for k in keys], "rec": [out[k][2] for k in keys]})

    routed = trees.mapInPandas(cut, "route int, prefix string, suffixes array<string>, occ array<bigint>, rec array<bigint>")

    def merge(batches):
        trie = BurstTrie()
        for pdf in batches:
            for p, suffixes, occ, rec in zip(pdf["prefix"], pdf["suffixes"], pdf["occ"], pdf["rec"], strict=True):
                for s, a, b in zip(suffixes, occ, rec, strict=True):
                    trie.add(p + s, int(a), int(b))
        rows = trie.items()
        while part := [r for _, r in zip(range(20000), rows)]:
            yield pd.DataFrame(part, columns=["term", "occurrences", "records"])

    return routed.repartition(F.col("route")).mapInPandas(merge, "term string, occurrences bigint, records bigint")


def marked(freq: DataFrame, n_records: DataFrame, rare_at_most: int = 2, common_above: float = 0.04) -> DataFrame:
    """Adds mark: `rare`, `common` or null. n_records: one row, one column n, the number of records in all."""
    common = F.col("records") > F.lit(common_above) * F.col("n")
    return freq.crossJoin(F.broadcast(n_records)).withColumn("mark", F.when(F.col("occurrences") <= rare_at_most, F.lit("rare")).when(common, F.lit("common"))).drop("n")


def uri_frequencies(mentions: DataFrame) -> DataFrame:
    """Frequencies and marks of cleaned uris; each mention_id counts once, articles are those with any row."""
    once = mentions.groupBy("mention_id").agg(F.max_by(F.struct("uri", "article_id"), "ingested_at").alias("m")).select(clean_uri("m.uri").alias("uri"), F.col("m.article_id").alias("article_id"))
    n = mentions.agg(F.count_distinct("article_id").alias("n"))
    return marked(term_frequencies(once, "uri", "article_id"), n).withColumnRenamed("term", "uri")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uri_frequencies(table(spark, sf_dir, "wiki_mentions")).where("mark is not null").select("uri", "mark")


def p5_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uri_frequencies(table(spark, sf_dir, "wiki_mentions")).select("uri", "occurrences", "records", "mark")


_SQL = r"""
with trimmed as (
  select mention_id, article_id, regexp_replace(uri, '^[\s\x0B\x1C-\x1F\x{85}\p{Z}]+|[\s\x0B\x1C-\x1F\x{85}\p{Z}]+$', '', 'g') as u, ingested_at from wiki_mentions),
cleaned as (
  select mention_id, arg_max(article_id, ingested_at) as article_id,
         arg_max(replace(case when contains(u, '%') then url_decode(u) else u end, ' ', '_'), ingested_at) as uri
  from trimmed group by mention_id),
n as (select count(distinct article_id) as n from wiki_mentions),
f as (
  select uri, count(*) as occurrences, count(distinct article_id) as records from cleaned
  where uri <> '' and not regexp_matches(uri, '[\n\r\x0B\x0C\x{85}\x{2028}\x{2029}]') group by uri),
m as (select uri, occurrences, records, case when occurrences <= 2 then 'rare' when records > 0.04 * n then 'common' end as mark from f, n)
"""

QUERIES = {"p5_found": p5_found, "p5_frequencies": p5_frequencies}
ORACLE = {"p5_found": _SQL + "select uri, mark from m where mark is not null", "p5_frequencies": _SQL + "select uri, occurrences, records, mark from m"}
