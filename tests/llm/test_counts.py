"""Term counting, packing and personal information."""

import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import p5_terms as C
from spanloom.llm import p6_pack as K
from spanloom.llm import p8_pii as I
from spanloom.llm.queries import ORACLE, QUERIES
from tests.llm.heldout import SENTENCES, UNSEEN
from tests.oracle import SF, same


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    same(spark, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=9), max_size=80))
def test_burst_trie_counts(terms):
    trie = C.BurstTrie(burst=2)
    for t in terms:
        trie.add(t, 1, 1)
    assert {t: n for t, n, _ in trie.items()} == Counter(terms)
    assert sum(1 for _ in trie.items()) == len(set(terms))


def test_term_frequencies(spark, monkeypatch):
    monkeypatch.setattr(C, "ROUTES", 4)
    rnd = random.Random(2)
    rows = [(rnd.choice(["http://x/" + str(rnd.randint(0, 60)), "", "hot", "日本", "z" * 3000]), rnd.randint(0, 9) or None, "x") for _ in range(3000)] + [(None, 1, "x")]
    df = spark.createDataFrame(rows, "t string, r int, occurrences string").repartition(6)
    got = {r.term: (r.occurrences, r.records) for r in C.term_frequencies(df, "t", "r").collect()}
    want = {t: (sum(1 for x in rows if x[0] == t), len({x[1] for x in rows if x[0] == t and x[1] is not None})) for t in {x[0] for x in rows} - {None}}
    assert got == want
    assert C.term_frequencies(df.limit(0), "t", "r").count() == 0


def test_clean_uri(spark):
    raw = ["  A b\t", "Orv%C3%A9lan", "a+b%20c", "x\ny", "", "  ", None, "%zz", "a%0Ab"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, u string")
    assert [r[0] for r in df.orderBy("i").select(C.clean_uri("u")).collect()] == ["A_b", "Orvélan", "a+b_c", None, None, None, None, "%zz", None]


def test_packing(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([0, None, rnd.randint(1, 900), 2048, 5000])) for i in range(2000)]
    df = spark.createDataFrame([(i, n, "x") for i, n in rows], "doc_id bigint, n_tokens bigint, container string").repartition(5)
    got = K.pack(df, "doc_id", spaces=8).collect()
    sizes = dict(rows)
    fill = Counter()
    parts = Counter()
    for r in got:
        fill[r.container] += r.piece_end - r.piece_start
        parts[r.doc_id] += r.piece_end - r.piece_start
        assert r.piece_end - r.piece_start == sizes[r.doc_id] or sizes[r.doc_id] is None or sizes[r.doc_id] > 2048
    assert fill.pop(None) == 0 and max(fill.values()) <= 2048
    assert all(parts[i] == (n or 0) for i, n in rows) and len(got) == sum(max(1, -(-(n or 0) // 2048)) for _, n in rows)
    assert len(fill) <= 1.03 * sum(n or 0 for _, n in rows) / 2048 + 2
    assert K.pack(df.limit(0), "doc_id").count() == 0


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, "a b " * 50_000)], "doc_id bigint, text string")
    n = {r.doc_id: r.n_tokens for r in K.token_sizes(df, "doc_id", "text", K.tokenizer_path()).collect()}
    assert n[1] == 2 and n[2] == n[3] == 0 and n[4] > 1 and n[5] > 50_000


@pytest.fixture(scope="module")
def lexicon():
    import duckdb

    return tuple(duckdb.connect().execute(f"select distinct token, name_part, script from '{SF}/name_lexicon.parquet' order by 1, 2, 3").fetchall())


def _marked(sentence):
    text, places = "", []
    for k, part in enumerate(re.split(r"\[(\w+\|[^\]]*)\]", sentence)):
        if k % 2:
            kind, value = part.split("|")
            places.append((kind, len(text), len(text) + len(value)))
            text += value
        else:
            text += part
    return text, places


@pytest.mark.parametrize("sentences, least", [(SENTENCES, 0.95), (UNSEEN, 0.85)])
def test_sentences_and_names_never_seen(lexicon, sentences, least):
    rows = [_marked(s) for s in sentences]
    found = I.Finder(I.train(lexicon), *I.names_of(lexicon)).find([t for t, _ in rows])
    want = sum(len(p) for _, p in rows)
    hit = sum(len(set(p) & set(f)) for (_, p), f in zip(rows, found))
    assert hit / want >= least and hit / sum(map(len, found)) >= 0.95


def test_a_name_table_holds_its_words():
    words = [f"Name{k}" for k in range(2000)]
    table = I.NameTable([I.xxhash.xxh64_intdigest(w.encode(), 42) % I.NAME_BITS for w in words])
    assert all(w in table for w in words) and sum(f"Other{k}" in table for k in range(2000)) < 10


def test_titles_of_entities_are_no_names(spark, lexicon):
    names = spark.createDataFrame(list(lexicon), "token string, name_part string, script string")
    docs = spark.createDataFrame([(1, "My name is Zathdan Sheimsen."), (2, "My name is Stiabronez Visindan.")], "doc_id bigint, text string")
    titles = spark.createDataFrame([("ZATHDAN SHEIMSEN",), (None,), ("Port Other",)], "title string")
    assert {r.doc_id for r in I.find_pii(docs, names).collect()} == {1, 2}
    assert {r.doc_id for r in I.find_pii(docs, names, titles).collect()} == {2}
    masked = {r.doc_id: r.text for r in I.find_pii(docs, names, titles, redact=True).collect()}
    assert masked == {1: "My name is Zathdan Sheimsen.", 2: "My name is [NAME]."}


def test_held_out_accuracy(lexicon):
    from spanloom.llm.pii_table import Filler, labelled_rows

    pick = lambda p, s: sorted(t for t, a, b in lexicon if a == p and b == s)
    rows = labelled_rows(Filler(pick("given", "latin"), pick("family", "latin"), pick("given", "ru"), pick("family", "ru"), seed=2024), 2)
    found = I.Finder(I.train(lexicon), *I.names_of(lexicon)).find([t for t, _ in rows])
    hit = sum(len(set(s) & set(g)) for (_, s), g in zip(rows, found))
    assert hit / sum(len(s) for _, s in rows) > 0.95 and hit / sum(map(len, found)) > 0.95


def test_personal_information(spark, lexicon):
    text = "The form names Zathdan von Sheimsen with ID QQ 23 49 34 C and phone +44 (0)20 7946 0882.\nPlease write to Stiabronez, Visindan, Flat 7, 24 Gragâ St., Apt 23C, before August. Contact: office [dot] goby [at] foo-bar [dot] test\nIts book (ISBN 979-0-2971-0635-7) of 1833-1835 sold 7 547 743 tickets."
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x"), (1, text, "x"), (4, "word " * 100_000, "x")], "doc_id bigint, text string, pii_kind string")
    names = spark.createDataFrame(list(lexicon) + [(None, None, None)], "token string, name_part string, script string")
    rows = I.find_pii(docs, names).where("doc_id = 1").distinct().collect()
    got = {(r.pii_kind, text[r.char_start : r.char_end]) for r in rows}
    assert {("email", "office [dot] goby [at] foo-bar [dot] test"), ("phone", "+44 (0)20 7946 0882"), ("id_number", "QQ 23 49 34 C"), ("name", "Zathdan von Sheimsen")} <= got
    assert not any("ISBN" in t or "979" in t or "547" in t for _, t in got)
    masked = {r.doc_id: (r.text, r.n_found) for r in I.find_pii(docs, names, redact=True).collect()}
    assert "[PHONE]" in masked[1][0] and "7946" not in masked[1][0] and masked[2] == (None, 0) and masked[3] == ("", 0)
    assert I.find_pii(docs.limit(0), names).count() == 0


def test_terms_with_one_long_opening_are_spread(spark, monkeypatch):
    monkeypatch.setattr(C, "BURST", 16)
    monkeypatch.setattr(C, "HELD", 500)
    opening = "https://example.org/articles/"
    rows = [(f"{opening}{k % 700:03d}", k) for k in range(2100)] + [("short", 1), (None, 2)]
    got = {r.term: (r.occurrences, r.records) for r in C.term_frequencies(spark.createDataFrame(rows, "t string, r int"), "t", "r").collect()}
    assert got == {f"{opening}{k:03d}": (3, 3) for k in range(700)} | {"short": (1, 1)}
    assert C.route_starts(C._leaves({"a": 9, "ab": 6, "abc": 5, "b": 2}), 4) == ["", "abc", "b"]
