"""Cross-split overlap, unified forms and leaks, against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import p2_overlap as O
from spanloom.llm import p4_unify as U
from spanloom.llm import p7_leaks as L
from spanloom.llm.textnorm import caseless_form, reading_form


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=20), st.lists(st.sampled_from("abcde"), max_size=20))
def test_common_words_is_the_longest_common_subsequence(a, b):
    assert O.common_words(a, b) == lcs(a, b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(-1, 5), max_size=20), st.lists(st.integers(-1, 5), max_size=80)), max_size=6))
def test_common_words_of_many_pairs(pairs):
    got = O.common_words_of([np.array(a, dtype=np.int32) for a, _ in pairs], [np.array(b, dtype=np.int32) for _, b in pairs])
    assert got.tolist() == [lcs([x if x >= 0 else ("a", k) for k, x in enumerate(a)], [x if x >= 0 else ("b", k) for k, x in enumerate(b)]) for a, b in pairs]


def test_index_counts_and_places_every_pattern():
    rnd = random.Random(1)
    seqs = [["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(1, 12))] for _ in range(30)]
    index = O.FullTextIndex.from_bytes(O.FullTextIndex(seqs).to_bytes())
    flat = ["".join(s) for s in seqs]
    assert len(index.run_start) < index.n and len(index.places) < index.n / 2
    for n in range(1, 9):
        for _ in range(30):
            pat = "".join(rnd.choice("abc") for _ in range(n))
            lo, hi = np.zeros(1, np.int64), np.full(1, index.n)
            for c in reversed(pat):
                lo, hi = index.step(index.codes(np.array([ord(c)], dtype=np.uint32)), lo, hi)
            want = sorted((i, k) for i, s in enumerate(flat) for k in range(len(s) - n + 1) if s[k : k + n] == pat)
            places = index.locate(np.arange(lo[0], hi[0]))
            owner = np.searchsorted(index.starts, places, "right") - 1
            assert sorted((int(e), int(p - index.starts[e])) for e, p in zip(owner, places)) == want


def _record(rnd, vocabulary):
    return [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 45))]


def _reworked(rnd, s, vocabulary):
    s = list(s)
    for _ in range(rnd.randint(0, max(1, len(s) // 8))):
        k = rnd.randrange(len(s)) if s else 0
        kind = rnd.random()
        if kind < 0.4 and s:
            s[k] = rnd.choice(vocabulary)
        elif kind < 0.7 and len(s) > 1:
            del s[k]
        else:
            s.insert(k, rnd.choice(vocabulary))
    return s


@pytest.mark.parametrize("size", [4, 40, 400])
def test_overlaps_lose_no_link(size):
    rnd = random.Random(size)
    vocabulary = [f"w{i}" for i in range(size)]
    train = [_record(rnd, vocabulary) for _ in range(80)]
    held = [_reworked(rnd, rnd.choice(train), vocabulary) for _ in range(60)] + [_record(rnd, vocabulary) for _ in range(30)]
    want = {(i, j) for i, a in enumerate(train) for j, b in enumerate(held) if O.agreement(a, b) >= 0.9}
    assert {(i, j) for i, j, _ in O.overlaps(train, held)} == want and len(want) > 20


def test_cross_split(spark, monkeypatch):
    base = "In April 1881 the old granary at Wipliri passed to Somi Vosen with some help".split()
    fuzzy = ["Іn", "A​pril", "", "1881", None, "THE", "old", "gran", "ary", "at", "Wipliri", ",", "passed", "to", "Somi", "Vosen", "with", "some", "help", "-LRB-", "-RRB-"]
    other = "Records kept by Zashaeth describe a private chapel that was sold near the quarry".split()
    rows = [(1, "train", base), (2, "dev", fuzzy), (3, "test", base), (4, "train", other), (5, "dev", other[:8]), (6, "dev", None), (7, "dev", []), (8, "dev", ["", None, "."]), (9, None, base), (3, "test", base), (10, "test", [w.upper() for w in other])]
    df = spark.createDataFrame(rows, "example_id bigint, split string, tokens array<string>")
    rec = lambda d: O.normalized(d, "example_id", "tokens", "split", "x")
    assert sorted((r.a_id, r.b_id) for r in O.cross_split(rec(df)).collect()) == [(1, 2), (1, 3), (4, 10)]
    monkeypatch.setattr(O, "SHARD_WORDS", 20)
    monkeypatch.setattr(O, "BLOCK_WORDS", 20)
    assert sorted((r.a_id, r.b_id) for r in O.cross_split(rec(df)).collect()) == [(1, 2), (1, 3), (4, 10)]
    assert O.cross_split(rec(df.limit(0))).count() == 0
    hot = spark.createDataFrame([(i, "train" if i % 2 else "dev", base) for i in range(60)], "example_id bigint, split string, tokens array<string>")
    assert O.class_links(rec(hot)).count() == 1 and O.cross_split(rec(hot)).count() == 900


def test_forms_bring_variants_together(spark):
    rows = [(1, "Orvélan Fiord"), (2, "Оrvе́l​an Ｆｉｏｒｄ"), (3, "Orvelan Fiord"), (4, "ORVÉLAN FIORD"), (5, None), (6, ""), (7, "ｺｻﾞ ﬁn…"), (8, "コザ fin..."), (1, "Orvélan Fiord"), (9, "K‑x"), (10, "K-x"), (11, "𝐀b"), (12, "Ab")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "article_id bigint, text string, form int")
    form = {r.article_id: r.form for r in U.unify(df, "text", ["article_id"]).collect()}
    assert form[1] == form[2] == "Orvélan Fiord" and form[3] == "Orvelan Fiord" and form[4] == "ORVÉLAN FIORD"
    assert form[5] is None and form[6] == "" and form[7] == form[8] and form[9] == form[10] and form[11] == form[12]
    pairs = sorted((r.a_id, r.b_id) for r in U.same_reading(df, "article_id", "text").collect())
    assert pairs == [(1, 2), (7, 8), (9, 10), (11, 12)]
    assert U.same_reading(df.limit(0), "article_id", "text").count() == 0


def test_mention_variants(spark):
    m = spark.createDataFrame([(1, " Orvélan_Fiord\t", "Orvélan Fiord "), (2, "Orv%C3%A9lan_Fiord", "Orvélan Fiord"), (3, "Orvélan Fiord", "Orvelan Fiord"), (4, "Orvélan_Fiord", "﻿Orvélan Fiord"), (5, None, "x"), (6, "Orvélan_Fiord", None), (2, "Orv%C3%A9lan_Fiord", "Orvélan Fiord")], "mention_id bigint, uri string, surface_form string")
    e = spark.createDataFrame([(7, "Orvélan_Fiord", "Orvélan Fiord")], "entity_id bigint, symbol string, title string")
    assert sorted((r.entity_id, r.mention_id) for r in U.mention_variants(m, e).distinct().collect()) == [(7, 2), (7, 4)]


def test_reading_and_caseless_forms():
    assert reading_form("Ｒаgaza F.C.") == "Ragaza F.C." and caseless_form("ВЕШЕДА") == caseless_form("вешеда")


ITEM = "Paethafru Inc. lies 19.92 km west of Baie de Drevedrour, against the advice of the glossary board of Porknindza. The ferry leaves Stoshe at 6 a.m. and reaches Klev by 1.30 p.m. on most days."


@pytest.mark.parametrize("pairs", [4_000_000, 20])
def test_suffix_array_matches_equal_brute_force(pairs, monkeypatch):
    monkeypatch.setattr(L, "PAIRS", pairs)
    rnd = random.Random(3)
    docs = [[rnd.choice("abcd") for _ in range(rnd.randint(0, 25))] for _ in range(12)]
    rows = [(i, [rnd.choice("abcde") for _ in range(rnd.randint(1, 10))]) for i in range(8)]
    shelf = L.Shelf(list(enumerate(docs)), 30, "w")
    suffixes = [shelf.ids[p : shelf.end[p]].tolist() for p in shelf.order]
    assert suffixes == sorted(suffixes)
    items = L.Items(rows, shelf.code, "w")
    length, *_ = L.longest_matches(shelf, items, 3)
    flat = ["".join(d) for d in docs]
    for n in range(len(items.ids)):
        i = int(items.owner[n])
        t = "".join(rows[i][1])[n - int(items.start[i]) :]
        assert length[n] == max(m for m in range(len(t) + 1) if any(t[:m] in d for d in flat))
    got = [tuple(map(int, r)) for part in L.matches(shelf, items, 3) for r in part]
    want = set()
    for d, s in enumerate(docs):
        for i, t in rows:
            for p in range(len(t)):
                for q in range(len(s)):
                    if (p and q and t[p - 1] == s[q - 1]) or t[p] != s[q]:
                        continue
                    n = 0
                    while p + n < len(t) and q + n < len(s) and t[p + n] == s[q + n]:
                        n += 1
                    if n >= min(3, len(t)):
                        want.add((d, i, p, q, n))
    assert set(got) == want and len(got) == len(want)


def test_no_document_and_no_item_goes_unread(spark):
    texts = {
        1: "What is the capital of France?", 2: "ສະບາຍດີທຸກຄົນທີ່ຢູ່ໃນເມືອງນີ້", 3: "วันนี้อากาศดีมากและเราจะไปตลาดด้วยกัน", 4: "So it is: Yes, we can!", 5: "ភាសាខ្មែរជាភាសាផ្លូវការរបស់ប្រទេសកម្ពុជា", 6: "word " * 3 + "thing",
    }
    items = {10: "what is the capital of France", 20: texts[2], 30: texts[3] + "x", 40: "yes we can", 50: texts[5], 60: "nothing", 70: "?!"}
    d = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    e = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in L.leaks(d, e).collect()} == {(1, 10), (2, 20), (3, 30), (4, 40), (5, 50)}


def test_a_large_vocabulary_changes_nothing():
    item = [f"i{k}" for k in range(12)]
    docs = [(0, [f"v{k}" for k in range(100_000)]), (1, ["x", *item, "y"])]
    shelf = L.Shelf(docs, 12, "w")
    assert L._search(shelf, "w", [(7, item)]) == [(1, 7, 1.0, 0)]


def test_leaks(spark):
    words = ITEM.split()
    filler = "The old museum stood near the river and nobody came to see it for years."
    changed = " ".join(w if k % 11 else "zzz" for k, w in enumerate(words))
    docs = [
        (1, f"{filler} {ITEM} {filler}"), (2, f"{filler} {changed}"), (3, " ".join(words[: len(words) * 6 // 10]) + " " + filler), (4, " ".join(words[:8]) + " " + filler),
        (5, f"{' '.join(words[:17])} {filler} {' '.join(words[17:])}"), (6, None), (7, ""), (8, ITEM.upper().replace(",", "").replace("e", "е")), (9, filler), (10, f"<b>{ITEM}</b>".replace(" west", "\nwest")), (1, f"{filler} {ITEM} {filler}"),
        (11, "多么啊！这座天文台撑得住吗？我看不行。溪竹东的图书馆归河所有，不顾云河青的反对被出售。"),
    ]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(50, ITEM), (51, None), (52, ""), (53, "溪竹东的图书馆归河所有，不顾云河青的反对被出售。柏宁安峰的运河"), (50, ITEM)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in L.leaks(d, items).collect()}
    assert got == {(1, 50), (2, 50), (3, 50), (5, 50), (8, 50), (10, 50), (11, 53)}
    assert L.leaks(d, items.limit(0)).count() == 0 and L.leaks(d.limit(0), items).count() == 0


def test_leaks_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(L, "ITEM_CHARS", 250)
    items = spark.createDataFrame([(i, f"{ITEM} Number {i} of {i * 7} was sold.") for i in range(4)], "item_id bigint, text string")
    d = spark.createDataFrame([(1, f"{ITEM} Number 2 of 14 was sold.")], "doc_id bigint, text string")
    assert {r.item_id for r in L.leaks(d, items).collect()} == {0, 1, 2, 3}


def test_overlap_survives_one_deletion_and_two_insertions():
    a = [f"w{k}" for k in range(19)]
    b = a[:3] + a[4:9] + ["x"] + a[9:14] + ["y"] + a[14:]
    assert len(b) == 20 and O.agreement(a, b) == 0.9
    assert O.overlaps([a], [b]) == [(0, 0, 0.9)]


def test_seeds_outnumber_what_edits_can_break():
    for n in range(1, 130):
        broken = max(n + m - 2 * c for m in range(1, 2 * n + 2) for c in range(min(n, m) + 1) if 10 * c >= 9 * max(n, m))
        assert O._plain_seeds(n) == broken + 1 <= O.seeds_of(n)
        assert sum(x for _, _, x in O.segments(n)) >= min(n, O.seeds_of(n))


def test_no_link_is_lost_at_any_length_by_edits_and_divisions():
    rnd = random.Random(11)
    vocabulary = [a + b + c for a in "bdfgk" for b in "aeiou" for c in ("n", "r", "st")]
    links = 0
    for n in [*range(1, 61), 150, 400]:
        train = [[rnd.choice(vocabulary) for _ in range(n)] for _ in range(3)]
        held = []
        for s in train * 3:
            s = list(s)
            for _ in range(rnd.randint(0, max(1, n // 8))):
                k, x = rnd.randrange(len(s)), rnd.random()
                if x < 0.4:
                    s.insert(k, rnd.choice(vocabulary))
                elif x < 0.55:
                    s[k] = rnd.choice(vocabulary)
                elif x < 0.7 and len(s) > 1:
                    del s[k]
                elif len(s[k]) > 1:
                    s[k : k + 1] = [s[k][:1], s[k][1:]]
            held.append(s)
        got = {(i, j): x for i, j, x in O.overlaps(train, held)}
        want = {(i, j): O.agreement(a, b) for i, a in enumerate(train) for j, b in enumerate(held)}
        assert got == {k: x for k, x in want.items() if x >= 0.9}
        links += len(got)
    assert links > 200


def test_division_does_not_matter_to_agreement():
    words = [f"word{k}" for k in range(19)]
    split = [x for k, w in enumerate(words) for x in ([w[:2], w[2:]] if k in (3, 9, 12, 16) else [w])]
    assert O.agreement(words, split) == 1.0
    split[0] = "other"
    assert O.agreement(words, split) == pytest.approx(22 / 23)
    assert O.overlaps([words], [split]) == [(0, 0, pytest.approx(22 / 23))] and O.overlaps([split], [words]) == [(0, 0, pytest.approx(22 / 23))]
    assert O.agreement(["ab", "c"], ["a", "bc"]) == 1.0 and O.agreement([], []) == 0.0


def test_a_very_long_record_is_chosen_in_segments():
    rnd = random.Random(3)
    long = [f"w{rnd.randrange(3000)}" for _ in range(30_000)]
    other = long[:9000] + ["new"] * 500 + long[9500:]
    assert max(x for _, x, _ in O.segments(30_000)) <= O.SEGMENT
    assert O.overlaps([long], [other]) == [(0, 0, pytest.approx(29_500 / 30_000))]
