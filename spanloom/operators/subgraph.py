"""Covering subgraphs: around a seed pair, statements chosen greedily so that pairs get their common neighbours."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEVER = 100_000_000


def cover_cost(total: Column, both: Column, single: Column, present: Column, required: int, wanted: int, mode: str = "reference") -> Column:
    """Statements still needed to cover a pair: one for each common neighbour that has one of its two, two for those that have none.

    mode `reference` counts from -1 where no neighbour is missing and adds 1 for a pair that is present; `intended` counts from 0 and adds 1
    for a pair that is absent."""
    missing = F.greatest(F.least(F.lit(wanted), total) - both, F.lit(0))
    need = F.when(single > missing, missing).otherwise(single + 2 * (missing - single))
    if mode == "reference":
        base = F.when(missing > 0, need).otherwise(F.lit(-1)) + present.cast("int")
    elif mode == "intended":
        base = F.when(missing > 0, need).otherwise(F.lit(0)) + (~present).cast("int")
    else:
        raise ValueError(f"unknown mode {mode}")
    return F.when(total < required, F.lit(NEVER)).otherwise(base)


def relative_coverage(both: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(1.0)).otherwise(both / total)


def balls(seeds: DataFrame, nb: DataFrame, max_entities: int) -> DataFrame:
    """(seed, entity): both ends of each seed pair and at most max_entities - 2 common neighbours, those of least degree first."""
    a = nb.select("h", F.col("t").alias("entity"))
    b = nb.select(F.col("h").alias("t"), F.col("t").alias("entity"))
    common = seeds.select("seed", "h", "t").join(a, "h").join(b, ["t", "entity"])
    deg = nb.groupBy(F.col("h").alias("entity")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("seed").orderBy("n", "entity")
    kept = common.select("seed", "entity").join(deg, "entity").withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_entities - 2).select("seed", "entity")
    ends = seeds.select("seed", F.explode(F.array("h", "t")).alias("entity"))
    return ends.unionByName(kept).distinct()


def cover(seeds: DataFrame, nb: DataFrame, edges: DataFrame, max_entities: int = 600, wanted: int = 3, required: int = 1, max_statements: int = 30) -> DataFrame:
    """(seed, h, t, sent_id, covered): greedy covering subgraph of each seed pair within its ball.

    A ball holds at most max_entities entities, rarest first, so its pairs are bounded. Per seed, pairs are taken in order of least cost (`intended`
    counting), ties by ids, until max_statements are in; a pair counts as covered once it is in with `wanted` common neighbours, or all it has.
    Statements of one sentence are taken once; a pair goes by the first of its sentences that is free, of which it brings so many that one always is
    unless all its own are taken. Costs are counted anew only for pairs that a taken tie touches. Seeds don't see each other's choices: the uses of a
    pair over all subgraphs are counted afterwards."""
    members = balls(seeds, nb, max_entities)
    pairs = members.withColumnRenamed("entity", "h").join(members.withColumnRenamed("entity", "t"), "seed").where("h < t")
    each = edges.where("h < t").select("h", "t", "sent_id").distinct()
    nth = F.row_number().over(Window.partitionBy("h", "t").orderBy("sent_id"))
    # at most max_statements + wanted sentences are in use when a pair asks for one
    one = each.withColumn("r", nth).where(F.col("r") <= max_statements + 2 * wanted + 1).groupBy("h", "t").agg(F.sort_array(F.collect_list("sent_id")).alias("sents"))
    local = pairs.join(one, ["h", "t"]).join(seeds.select("seed", F.least("h", "t").alias("sh"), F.greatest("h", "t").alias("st")), "seed")

    def fill(pdf) -> list[tuple]:
        sent = {(h, t): list(s) for h, t, s in zip(pdf["h"].tolist(), pdf["t"].tolist(), pdf["sents"].tolist(), strict=True)}
        near: dict = {}
        for h, t in sent:
            near.setdefault(h, set()).add(t)
            near.setdefault(t, set()).add(h)
        key = lambda a, b: (a, b) if a < b else (b, a)
        commons = {p: sorted(near[p[0]] & near[p[1]]) for p in sent}
        chosen: dict = {}
        used: set = set()
        covered: set = set()
        dead: set = set()

        def cost(p):
            total = len(commons[p])
            if total < required:
                return NEVER
            n = [(key(p[0], c) in chosen) + (key(p[1], c) in chosen) for c in commons[p]]
            missing = max(min(wanted, total) - n.count(2), 0)
            single = n.count(1)
            return (missing if single > missing else single + 2 * (missing - single)) + (p not in chosen)

        def take(p):
            new: dict = {}

            def want(q):
                if q in chosen or q in new:
                    return True
                free = next((s for s in sent[q] if s not in used and s not in new.values()), None)
                if free is None:
                    return False
                new[q] = free
                return True

            if not want(p):
                return False
            done = sum(key(p[0], c) in chosen and key(p[1], c) in chosen for c in commons[p])
            order = sorted(commons[p], key=lambda c: (-(key(p[0], c) in chosen) - (key(p[1], c) in chosen), c))
            for c in order:
                if done >= wanted:
                    break
                a, b = key(p[0], c), key(p[1], c)
                if a in chosen and b in chosen:
                    continue
                before = dict(new)
                if want(a) and want(b):
                    done += 1
                else:
                    new.clear()
                    new.update(before)
            if done < required:
                return False
            chosen.update(new)
            used.update(new.values())
            for q in {key(x, z) for pair in new for x in pair for z in near[x]}:
                heapq.heappush(waiting, (cost(q), q))
            return True

        waiting = [(cost(p), p) for p in sent]
        heapq.heapify(waiting)
        seed_pair = (pdf["sh"].iloc[0], pdf["st"].iloc[0])
        if seed_pair in sent and cost(seed_pair) < NEVER and take(seed_pair):
            covered.add(seed_pair)
            while len(chosen) < max_statements and waiting:
                c, p = heapq.heappop(waiting)
                if c >= NEVER or p in covered or p in dead or c != cost(p):
                    continue
                (covered if take(p) else dead).add(p)
        return [(pdf["seed"].iloc[0], h, t, s, (h, t) in covered) for (h, t), s in sorted(chosen.items())]

    kind = seeds.schema["seed"].dataType.simpleString()
    return by_group(local.select("seed", "h", "t", "sents", "sh", "st"), "seed", ["h", "t"], fill, f"seed {kind}, h bigint, t bigint, sent_id bigint, covered boolean")


def by_group(df: DataFrame, key: str, order: list[str], work, schema: str) -> DataFrame:
    """work(rows of one key, as a frame) -> list of tuples, for many small groups: partitions are sorted by key and streamed, which spares
    the cost of a call per group."""
    import pandas as pd

    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        held: list = []  # parts of the last key seen, put together once it ends
        for pdf in batches:
            if not len(pdf):
                continue
            edge = pdf[key].ne(pdf[key].shift()).to_numpy().nonzero()[0]
            rows: list = []
            if held and held[0][key].iloc[0] != pdf[key].iloc[0]:
                rows += work(pd.concat(held, ignore_index=True))
                held = []
            for a, b in zip(edge, [*edge[1:], len(pdf)], strict=True):
                held.append(pdf.iloc[a:b])
                if b < len(pdf):
                    rows += work(pd.concat(held, ignore_index=True))
                    held = []
            if rows:
                yield pd.DataFrame(rows, columns=names)
        if held:
            yield pd.DataFrame(work(pd.concat(held, ignore_index=True)), columns=names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def beam_assign(scores: DataFrame, beam: int = 4) -> DataFrame:
    """(question, place, candidate, total): candidates assigned to the places of each question, no candidate twice, by beam search over
    the places in order; the best beam's total is given with each. scores: (question, place, candidate, score)."""

    def search(pdf) -> list[tuple]:
        places: dict = {}
        for p, c, x in zip(pdf["place"].tolist(), pdf["candidate"].tolist(), pdf["score"].tolist(), strict=True):
            places.setdefault(p, []).append((c, x))
        beams: list = [(0.0, ())]
        for p in sorted(places):
            grown = [(s + x, (*taken, c)) for s, taken in beams for c, x in places[p] if c not in taken]
            beams = sorted(grown, key=lambda b: (-b[0], b[1]))[:beam] or beams
        total, best = beams[0]
        question = pdf["question"].iloc[0]
        return [(question, p, c, round(total, 9)) for p, c in zip(sorted(places), best, strict=False)]

    kind = scores.schema["question"].dataType.simpleString()
    return by_group(scores.select("question", "place", "candidate", "score"), "question", ["place", "candidate"], search, f"question {kind}, place int, candidate bigint, total double")


def pair_beam(scores: DataFrame, beam: int = 4) -> DataFrame:
    """(question, place, candidate, total): candidates for the places of each question by beam search over unary and pair scores.

    scores: (question, place, candidate, score, vec). A place keeps its candidates of at least half the sum of its best and its mean score. The total of an assignment
    over n places and vectors of d numbers is the sum of scores over d (n + 1) and of the dot products of all ordered pairs of different places over 2 d n (n + 1).
    A beam grows by any open place and any candidate; the best of the last beams is given. No candidate is taken twice unless only taken ones are left."""
    import numpy as np

    def search(pdf) -> list[tuple]:
        vec = {c: np.asarray(v, dtype=np.float64) for c, v in zip(pdf["candidate"].tolist(), pdf["vec"], strict=True)}
        by: dict = {}
        for p, c, x in zip(pdf["place"].tolist(), pdf["candidate"].tolist(), pdf["score"].tolist(), strict=True):
            by.setdefault(p, []).append((c, x))
        n, d = len(by), len(next(iter(vec.values())))
        kept = {p: [(c, x) for c, x in cs if x >= 0.5 * (max(y for _, y in cs) + sum(y for _, y in cs) / len(cs)) - 1e-12] for p, cs in by.items()}
        beams: list = [(0.0, ())]
        for _ in range(n):
            grown: dict = {}
            for total, taken in beams:
                filled, used = {p for p, _ in taken}, {c for _, c in taken}
                for p, cs in kept.items():
                    if p in filled:
                        continue
                    for c, x in [z for z in cs if z[0] not in used] or cs:
                        pair = sum(float(vec[c] @ vec[b]) for _, b in taken)
                        key = tuple(sorted((*taken, (p, c))))
                        grown[key] = max(grown.get(key, -np.inf), total + x / (d * (n + 1)) + 2 * pair / (2 * d * n * (n + 1)))
            beams = sorted(((t, k) for k, t in grown.items()), key=lambda z: (-round(z[0], 12), z[1]))[:beam]
        total, best = beams[0]
        question = pdf["question"].iloc[0]
        return [(question, p, c, round(total, 9)) for p, c in best]

    kind = scores.schema["question"].dataType.simpleString()
    return by_group(scores.select("question", "place", "candidate", "score", "vec"), "question", ["place", "candidate"], search, f"question {kind}, place int, candidate bigint, total double")
