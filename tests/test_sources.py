"""Readers, writers, configuration and the streaming twins."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.plans.config import compose
from spanloom.sources import readers as R
from spanloom.sources import writers as W
from spanloom.streaming import windows


def test_articles(spark, tmp_path):
    row = {"url": "u/A", "text": "a\u00a0b", "annotations": [{"uri": "X", "surface_form": "a", "offset": 0}], "el": []}
    (tmp_path / "a.jsonl").write_text(json.dumps(row) + "\n")
    (tmp_path / "b.jsonl").write_text(json.dumps(row | {"url": "u/B"}) + "\n")
    rows = R.articles(spark, f"{tmp_path}/a*.jsonl, {tmp_path}/b*.jsonl").orderBy("url").collect()
    assert [r.url for r in rows] == ["u/A", "u/B"] and rows[0].text == "a b" and rows[0].annotations[0].uri == "X"
    with pytest.raises(Exception):
        R.parquet(spark, str(tmp_path / "none")).count()


def test_alternating_records_with_marks(spark, tmp_path):
    p = tmp_path / "k.txt"
    p.write_text('1\t"The <e1> big dog</e1> saw <e2></e2> ."\nlives(e1,e2)\n\n2\t"<e1>A</e1> of <e2>B C</e2>"\nOther\n\n')
    rows = R.marked_spans(R.alternating(spark, str(p), 2)).orderBy("rec_id").collect()
    assert rows[0].words == ["The", "big", "dog", "saw", "<blank>", "."] and (rows[0].hs, rows[0].he, rows[0].ts, rows[0].te) == (1, 3, 4, 5)
    assert rows[1].label == "Other" and rows[1].words[rows[1].ts : rows[1].te] == ["B", "C"]


def test_json_example_files(spark, tmp_path):
    t = tmp_path / "t.json"
    t.write_text(json.dumps([{"id": "1", "token": ["a", "b"], "subj_start": 0, "subj_end": 0, "obj_start": 1, "obj_end": 1, "relation": "r"}]))
    r = R.tacred(spark, str(t)).first()
    assert (r.hs, r.he, r.ts, r.te) == (0, 1, 1, 2)
    f = tmp_path / "f.json"
    f.write_text(json.dumps({"P1": [{"tokens": ["a", "b", "c"], "h": ["a", "Q1", [[0]]], "t": ["b c", "Q2", [[1, 2]]]}], "P2": []}))
    r = R.fewrel(spark, str(f)).first()
    assert (r.relation, r.label, r.hs, r.he, r.ts, r.te) == ("P1", 0, 0, 1, 1, 3)
    q, a = tmp_path / "q.json", tmp_path / "a.json"
    q.write_text(json.dumps({"Data": [{"Question": "Who?", "Answer": {"MatchedWikiEntityName": "A B"}}, {"Question": "What?", "Answer": {}}]}))
    a.write_text(json.dumps([[{"name": "x", "type": "PERSON", "mentions": [], "metadata": {"mid": "m"}}], None]))
    rows = R.trivia(spark, str(q), str(a)).collect()
    assert len(rows) == 1 and rows[0].answer == "A_B" and rows[0].annotations[0].metadata == {"mid": "m"}


def test_vocabulary_round_trip(spark, tmp_path):
    v = spark.createDataFrame([(i, f"s_{i}", 100 - i) for i in range(50)], "entity_id bigint, symbol string, cnt bigint")
    W.vocabulary_text(v, str(tmp_path / "v"))
    assert sorted(map(tuple, R.entity_dictionary(spark, str(tmp_path / "v")).collect())) == sorted(map(tuple, v.collect()))


def test_rebased_shards(spark):
    d = spark.createDataFrame([(0, 3, 0), (0, 2, 3), (1, 4, 0), (2, 1, 0)], "shard int, n int, start bigint")
    assert sorted(r.start for r in W.rebased(d, ["shard"], "n", "start").collect()) == [0, 3, 5, 9]


def test_partitioned_parquet(spark, tmp_path):
    W.parquet_by(spark.createDataFrame([(1, "a"), (2, "b")], "id int, split string"), str(tmp_path / "p"), "split")
    assert spark.read.parquet(str(tmp_path / "p")).where("split = 'b'").count() == 1


def test_config_first_definition_wins(tmp_path):
    (tmp_path / "base.json").write_text('{"a": 1, "b": {"x": 1, "y": 2} /* low */}')
    (tmp_path / "top.json").write_text('{"add_configs": ["base.json"], "b": {"x": 9}, // a comment\n "url": "http://x"}')
    assert compose([tmp_path / "top.json"]) == {"b": {"x": 9, "y": 2}, "url": "http://x", "a": 1}
    (tmp_path / "loop.json").write_text('{"add_configs": ["loop.json"]}')
    with pytest.raises(ValueError):
        compose([tmp_path / "loop.json"])


def _stream(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{m:02d}:00", i % 2, "a", 1.0) for i, m in enumerate((0, 3, 5, 20, 40, 58))]
    d = spark.createDataFrame(rows, "event_id bigint, t string, user_id bigint, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    d.write.parquet(str(tmp_path / "in"))
    return d, spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))


@pytest.mark.parametrize("twin, mode", [(windows.windowed_counts, "update"), (windows.cooccurrence, "append")])
def test_stream_equals_batch(spark, tmp_path, twin, mode):
    batch, stream = _stream(spark, tmp_path)
    q = twin(stream).writeStream.format("memory").queryName(f"out_{twin.__name__}").outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table(f"out_{twin.__name__}").collect())) == sorted(map(str, twin(batch).collect()))


def test_surfaces_are_spaced_and_located():
    text, kept = R.spaced_surfaces("In the 1990s, Paris and Anyone met one.", [("Paris", "LOC"), ("1990", "DATE"), ("one", "N"), ("none", "N")])
    assert kept == ["Paris", "1990s", None, None] and text == "In the 1990s , Paris and Anyone met one."
    assert R.located_surfaces("a New York b New York".split(), ["New York", "New York", "New York", "b N", None]) == [(1, 2), (4, 5), None, None, None]


def test_answers_must_be_known(spark, tmp_path):
    q, a = tmp_path / "q.json", tmp_path / "a.json"
    q.write_text(json.dumps({"Data": [{"Question": "Who?", "Answer": {"MatchedWikiEntityName": "A B"}}, {"Question": "What?", "Answer": {"MatchedWikiEntityName": "C"}}]}))
    a.write_text(json.dumps([[], []]))
    known = spark.createDataFrame([("A_B",), ("A_B",)], "symbol string")
    assert [r.answer for r in R.trivia(spark, str(q), str(a), known).collect()] == ["A_B"]


def test_a_wide_pair_beam_finds_the_best(spark):
    import itertools
    import random

    from spanloom.operators.subgraph import pair_beam

    rnd = random.Random(4)
    rows = [(q, p, c, rnd.random(), [rnd.random() * 0 + (q + 2 * c + k) % 3 - 1.0 for k in range(2)]) for q in range(4) for p in range(3) for c in range(4)]
    got = {r.question: r.total for r in pair_beam(spark.createDataFrame(rows, "question int, place int, candidate bigint, score double, vec array<double>"), 500).collect()}
    for q in range(4):
        mine = {(p, c): (x, v) for a, p, c, x, v in rows if a == q}
        keep = {p: [c for c in range(4) if mine[p, c][0] >= 0.5 * (max(mine[p, k][0] for k in range(4)) + sum(mine[p, k][0] for k in range(4)) / 4)] for p in range(3)}
        best = -9.0
        for cs in itertools.product(*keep.values()):
            if len(set(cs)) == 3:
                pairs = sum(sum(x * y for x, y in zip(mine[i, cs[i]][1], mine[j, cs[j]][1])) for i in range(3) for j in range(3) if i != j)
                best = max(best, sum(mine[p, c][0] for p, c in enumerate(cs)) / (2 * 4) + pairs / (2 * 2 * 3 * 4))
        if best > -9.0:
            assert got[q] >= best - 1e-6
