"""The co-occurrence multigraph of mentions: edges, neighbourhoods, capped samples, and the tests on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.spans import window_around
from spanloom.operators.prep import ordered_ids
from spanloom.runtime import durable, hkey

#: Mentions closer than this pair up, within statements of at most so many positions.
MAX_DISTANCE, MAX_POSITIONS = 40, 123
#: Neighbours that travel in one list.
LIST = 8192


def statements(mentions: DataFrame, max_distance: int = MAX_DISTANCE, max_positions: int = MAX_POSITIONS) -> DataFrame:
    """Undirected co-occurrences (h, t, sent_id, hs, he, ts, te), the left mention first.

    mentions: (sent_id, entity, rn, st, en). Two mentions of a sentence pair up if they name different entities, the gap between them is
    below max_distance and both fit into max_positions. Each mention looks at those in its range of positions, a frame that slides over the sentence,
    so that a sentence of any length is never taken all against all, and what is partitioned by sentence already is not shuffled again."""
    w = Window.partitionBy("sent_id").orderBy("st").rangeBetween(-max_positions, 2 * max_positions)
    around = mentions.withColumn("near", F.collect_list(F.struct("entity", "rn", "st", "en")).over(w))
    near = lambda x: (F.col("rn") < x["rn"]) & (F.col("entity") != x["entity"]) & (F.col("en") + max_distance > x["st"]) & (x["en"] - F.col("st") <= max_positions)
    own = [F.col(a).alias(b) for a, b in (("entity", "h"), ("sent_id", "sent_id"), ("st", "hs"), ("en", "he"))]
    pairs = around.select(*own, F.explode(F.filter("near", near)).alias("x"))
    return pairs.select("h", F.col("x.entity").alias("t"), "sent_id", "hs", "he", F.col("x.st").alias("ts"), F.col("x.en").alias("te"))


def by_head(mentions: DataFrame, names: bool = False, starts: bool = True, max_distance: int = MAX_DISTANCE, max_positions: int = MAX_POSITIONS) -> DataFrame:
    """(h, sent_id, hs, near), with `names` also names: the statements of both_ways(statements(mentions)), a row a mention that has some, all of a head in one partition.

    near holds tail and start, tail and start, ..., without `starts` the tails alone, and there is no hs; names the entities of the sentence that are neither h nor among these tails. They travel as one text, which is
    shorter than a row a statement. Mentions without sentence or entity have no statements."""
    n = int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = Window.partitionBy("sent_id").orderBy("st").rangeBetween(-2 * max_positions, 2 * max_positions)
    pair = lambda a, b: (a["rn"] < b["rn"]) & (a["en"] + max_distance > b["st"]) & (b["en"] - a["st"] <= max_positions)
    own = {c: F.col(c) for c in ("rn", "st", "en")}
    near = F.filter(F.collect_list(F.struct("entity", "rn", "st", "en")).over(w), lambda x: (F.col("entity") != x["entity"]) & (pair(own, x) | pair(x, own)))
    d = mentions.withColumn("near", near)
    if names:
        d = d.withColumn("all", F.collect_set("entity").over(Window.partitionBy("sent_id")))
    d = d.where("sent_id is not null and entity is not null and size(near) > 0")
    each = (lambda x: F.concat_ws(",", x["entity"], x["st"])) if starts else (lambda x: x["entity"].cast("string"))
    text = F.concat_ws(",", *(["st"] if starts else []), F.concat_ws(",", F.transform("near", each)))
    if names:
        text = F.concat_ws(";", text, F.concat_ws(",", F.transform(F.array_except("all", F.array_append(F.transform("near", lambda x: x["entity"]), F.col("entity"))), lambda x: x.cast("string"))))
    d = d.select(F.col("entity").alias("h"), "sent_id", text.alias("text")).repartition(n, "h").withColumn("text", F.split("text", ";"))
    # tried, not cast: Spark may test what follows on mentions without statements too, before they are left out
    numbers = lambda x: F.when(x == "", F.array().cast("array<bigint>")).otherwise(F.split(x, ",").try_cast("array<bigint>"))
    own = numbers(F.get("text", F.lit(0)))
    spans = [F.get(own, F.lit(0)).alias("hs"), F.slice(own, 2, 2**31 - 1).alias("near")] if starts else [own.alias("near")]
    return d.select("h", "sent_id", *spans, *([numbers(F.get("text", F.lit(1))).alias("names")] if names else []))


def both_ways(undirected: DataFrame) -> DataFrame:
    """Every statement from either end; one pass over the statements, no second join."""
    pair = F.array(
        F.struct("h", "t", "sent_id", "hs", "he", "ts", "te"),
        F.struct(F.col("t").alias("h"), F.col("h").alias("t"), "sent_id", F.col("ts").alias("hs"), F.col("te").alias("he"), F.col("hs").alias("ts"), F.col("he").alias("te")),
    )
    return undirected.select(F.explode(pair).alias("e")).select("e.*")


def with_blocks(edges: DataFrame, sentences: DataFrame, max_positions: int = MAX_POSITIONS) -> DataFrame:
    """Adds the text block of each edge: its whole sentence where that fits, else a window around both mentions. sentences: (sent_id, n_tokens)."""
    s, e = F.least("hs", "ts"), F.greatest("he", "te")
    joined = edges.join(sentences.select("sent_id", "n_tokens"), "sent_id")
    ws, we = window_around(s, e, F.lit(0).cast("long"), F.col("n_tokens").cast("long"), max_positions)
    fits = F.col("n_tokens") <= max_positions
    return joined.select(*edges.columns, F.when(fits, F.lit(0)).otherwise(ws).cast("long").alias("block_start"), F.when(fits, F.col("n_tokens")).otherwise(we).cast("long").alias("block_end"))


def neighbours(edges: DataFrame) -> DataFrame:
    """Distinct (h, t)."""
    return edges.select("h", "t").distinct()


def neighbours_by_head(edges: DataFrame) -> DataFrame:
    """Distinct (h, t), all of a head in one partition: what is then grouped by head is not shuffled again."""
    return edges.select("h", "t").repartition("h").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(h, degree, n_edges): distinct neighbours, and statements. Two steps of counting, both combined before the shuffle."""
    return pair_counts(edges).groupBy("h").agg(F.count("*").alias("degree"), F.sum("n").alias("n_edges"))


def pair_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("h", "t").agg(F.count("*").alias("n"))


def capped_counts(edges: DataFrame, cap: int) -> DataFrame:
    """Per head: edges left when each pair keeps at most `cap`."""
    return pair_counts(edges).groupBy("h").agg(F.sum(F.least("n", F.lit(cap))).alias("n_capped"))


def capped_sample(edges: DataFrame, cap: int, seed: int = 1, epoch: int = 1) -> DataFrame:
    """At most `cap` statements of each (h, t), by a pseudo-random order that changes with the epoch."""
    score = hkey(F.lit(seed), F.lit(epoch), "h", "t", "sent_id", "hs", "ts")
    w = Window.partitionBy("h", "t").orderBy(score, "sent_id", "hs", "ts")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


def common_neighbours(nb: DataFrame, pairs: DataFrame) -> DataFrame:
    """(h, t, c): entities next to both ends of each given pair; the wedge starts from the pairs, not from all heads."""
    left = nb.select(F.col("h"), F.col("t").alias("c"))
    right = nb.select(F.col("h").alias("t"), F.col("t").alias("c"))
    return pairs.select("h", "t").join(left, "h").join(right, ["t", "c"]).select("h", "t", "c")


def triangles(nb: DataFrame) -> DataFrame:
    """(a, b, c): every three entities next to each other, once; nb holds both directions.

    Each tie points to its end of larger degree and the wedge starts from the end of smaller degree, of which less than the root of twice
    the ties can leave: a hot entity gets no wedge of its own, and nothing is left out."""
    nb = durable(nb)  # read four times below
    deg = nb.groupBy("h").agg(F.count("*").alias("n"))
    tied = nb.join(deg, "h").join(deg.select(F.col("h").alias("t"), F.col("n").alias("m")), "t")
    up = durable(tied.where((F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("h") < F.col("t")))).select("h", "t"))
    wedge = up.select(F.col("h").alias("a"), F.col("t").alias("b")).join(up.select(F.col("h").alias("a"), F.col("t").alias("c")), "a").where("b < c")
    return wedge.join(nb.select(F.col("h").alias("b"), F.col("t").alias("c")), ["b", "c"], "left_semi").select("a", "b", "c")


def all_common_neighbours(nb: DataFrame) -> DataFrame:
    """(h, t, c): the common neighbours of every pair of neighbours, from the triangles; nb holds both directions."""
    turns = F.array(*(F.struct(F.col(x).alias("h"), F.col(y).alias("t"), F.col(z).alias("c")) for x, y, z in ("abc", "acb", "bac", "bca", "cab", "cba")))
    return triangles(nb).select(F.explode(turns).alias("w")).select("w.*")


def four_cliques(nb: DataFrame) -> DataFrame:
    """(a, b, c, d): every four entities next to each other, once, b < c < d; nb holds both directions. Two triangles that start from one end of small
    degree make each, so that a hot entity starts none."""
    tri = durable(triangles(nb))
    abd = tri.select("a", "b", F.col("c").alias("d"))
    acd = tri.select("a", F.col("b").alias("c"), F.col("c").alias("d"))
    return tri.join(abd, ["a", "b"]).where("c < d").join(acd, ["a", "c", "d"], "left_semi").select("a", "b", "c", "d")


def ring(nb: DataFrame, seed: int = 1) -> DataFrame:
    """(h, t, place, size): the neighbours of each head in a pseudo-random ring. Places come from one global order sorted by range, so a hot head's
    ring is spread over partitions."""
    keyed = nb.select("h", "t", hkey(F.lit(seed), "h", "t").alias("key"))
    placed = ordered_ids(keyed, [F.asc("h"), F.asc("key"), F.asc("t")], "at")
    per = placed.groupBy("h").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    return placed.join(per, "h").select("h", "t", (F.col("at") - F.col("first")).cast("int").alias("place"), F.col("size").cast("int").alias("size"))


def exclusive_neighbours(nb: DataFrame, pairs: DataFrame, of: str = "h") -> DataFrame:
    """(h, t, c): neighbours of one end of each pair that are neither a neighbour of, nor, the other end."""
    other = "t" if of == "h" else "h"
    mine = nb.select(F.col("h").alias(of), F.col("t").alias("c"))
    theirs = nb.select(F.col("h").alias(other), F.col("t").alias("c"))
    return pairs.select("h", "t").join(mine, of).where(F.col("c") != F.col(other)).join(theirs, [other, "c"], "left_anti").select("h", "t", "c")


def all_exclusive_neighbours(nb: DataFrame, of: str = "h") -> DataFrame:
    """(h, t, c) as from exclusive_neighbours, for every pair of neighbours; nb holds both directions.

    Each head's neighbours travel as lists of about LIST entities and what is common is taken out of them pair by pair, so no wedge is shuffled
    and no list grows with the degree."""
    other = "t" if of == "h" else "h"
    nb = durable(nb)
    parts = nb.groupBy("h").agg(F.ceil(F.count("*") / LIST).cast("int").alias("parts"))
    part = lambda c: F.pmod(F.hash(c), F.col("parts")).alias("part")
    lists = nb.join(parts, "h").select("h", F.col("t").alias("c"), part("t")).groupBy("h", "part").agg(F.collect_list("c").alias("all"))
    shared = all_common_neighbours(nb).join(parts, "h").select("h", "t", "c", part("c")).groupBy("h", "t", "part").agg(F.collect_list("c").alias("shared"))
    out = F.when(F.col("shared").isNull(), F.array("t")).otherwise(F.array_append("shared", F.col("t")))
    left = nb.join(lists, "h").join(shared, ["h", "t", "part"], "left").select("h", "t", F.explode(F.array_except("all", out)).alias("c"))
    return left.select(F.col(of).alias("h"), F.col(other).alias("t"), "c")


def subset_pairs(nb: DataFrame, pairs: DataFrame | None = None, witnesses: int = 3) -> DataFrame:
    """Pairs (h, t), of those given (ties of nb) or of all neighbours, whose every other neighbour of h is a neighbour of t.

    Witnesses first: the rarest neighbours of h, one after another, must each be t or lie next to it, a semi join each, which few pairs of a sparse graph
    pass; a witness is a minimum, combined before the shuffle. Only for what is left whole neighbourhoods are compared, by an anti join."""
    nb = durable(nb)
    deg = nb.groupBy("h").agg(F.count("*").alias("n"))
    ranked = durable(nb.join(deg.select(F.col("h").alias("t"), "n"), "t").select("h", F.struct("n", "t").alias("k")))
    passed, last = nb if pairs is None else pairs.select("h", "t"), None
    for _ in range(witnesses):
        later = ranked if last is None else ranked.join(last.withColumnRenamed("k", "p"), "h").where(F.col("k") > F.col("p"))
        last = durable(later.groupBy("h").agg(F.min("k").alias("k")))
        asked = passed.join(last.select("h", F.col("k.t").alias("c")), "h", "left")
        easy = asked.where("c is null or c = t").select("h", "t")
        passed = durable(easy.unionByName(asked.where("c <> t").join(nb.select(F.col("h").alias("c"), "t"), ["c", "t"], "left_semi").select("h", "t")))
    return passed.join(exclusive_neighbours(nb, passed).select("h", "t").distinct(), ["h", "t"], "left_anti")


def trainable(split_edges: DataFrame, train_edges: DataFrame, mentions: DataFrame, min_pos: int = 2) -> DataFrame:
    """Edges of a split fit for contrastive training: the pair has at least min_pos training edges, the head at least min_pos + 1, and the head can be
    told from the tail: some other neighbour of its own, or a sentence of its edges that does not name the tail.

    The last is a comparison of counts: the sentences of h, and those of them that name t; every edge is built and read once."""
    train = durable(train_edges.select("h", "t", "sent_id"))
    counts = durable(pair_counts(train))
    per_pair = counts.where(F.col("n") >= min_pos).select("h", "t")
    per_head = counts.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= min_pos + 1).select("h")
    kept = durable(split_edges.join(per_pair, ["h", "t"], "left_semi").join(per_head, "h", "left_semi"))
    alike = subset_pairs(counts.select("h", "t"), kept.select("h", "t").distinct())
    head_sents = durable(train.select("h", "sent_id").distinct())
    alone = head_sents.groupBy("h").agg(F.count("*").alias("alone"))
    # sentences of h that name t, counted over the mentions of each sentence and not over pairs times sentences
    named = mentions.select("sent_id", F.col("entity").alias("t")).distinct()
    both = head_sents.join(named, "sent_id").groupBy("h", "t").agg(F.count("*").alias("both"))
    told = alike.join(alone, "h").join(both, ["h", "t"], "left").where(F.col("alone") > F.coalesce("both", F.lit(0))).select("h", "t")
    return kept.join(alike.join(told, ["h", "t"], "left_anti"), ["h", "t"], "left_anti")


def triplets(mentions: DataFrame) -> DataFrame:
    """(sent_id, e1, e2) of mentions of one sentence such that another sentence names both, and another names e1 but not e2."""
    m = mentions.select("sent_id", "entity").distinct()
    a = m.withColumnRenamed("entity", "e1")
    b = m.withColumnRenamed("entity", "e2")
    pairs = a.join(b, "sent_id").where("e1 <> e2")
    counts = pairs.groupBy("e1", "e2").agg(F.count("*").alias("both"))
    alone = m.groupBy(F.col("entity").alias("e1")).agg(F.count("*").alias("all"))
    good = counts.join(alone, "e1").where("both >= 2 and all > both").select("e1", "e2")
    return pairs.join(good, ["e1", "e2"], "left_semi").select("sent_id", "e1", "e2")
