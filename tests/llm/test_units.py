"""Sentence units and splitting."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import p1_split as S
from spanloom.llm import p3_sentences as P
from spanloom.llm.segment import units


def cut(text, lang=None):
    return [text[a:b] for a, b in units(text, lang)]


@pytest.mark.parametrize(
    "lang, text, want",
    [
        ("en", "Dr. Foo met J. Bar at 6 a.m. on No. 7. The F.C. won 3.5 pts.", ["Dr. Foo met J. Bar at 6 a.m. on No. 7.", "The F.C. won 3.5 pts."]),
        ("en", '"Will it hold?" asked a guide. “It is old! It is new!” a man wrote.', ['"Will it hold?" asked a guide.', "“It is old! It is new!” a man wrote."]),
        ("en", "It was sold in 1763.The castle stood... and fell. wania lies far.", ["It was sold in 1763.", "The castle stood... and fell.", "wania lies far."]),
        ("en", "Sold to Foo & Co. The rest of it stayed with Bar Inc. (see p. 4).", ["Sold to Foo & Co.", "The rest of it stayed with Bar Inc. (see p. 4)."]),
        ("en", "History\n- Foo Inc. 1994. Bar\nSt. Foo 1980\n| A 1 | B. C 2 |", ["History", "- Foo Inc. 1994. Bar", "St. Foo 1980", "| A 1 | B. C 2 |"]),
        ("de", "Am 16. Juli 1702 kam Dr. Gizi, d. h. spät, usw. Das war z. B. gut.", ["Am 16. Juli 1702 kam Dr. Gizi, d. h. spät, usw.", "Das war z. B. gut."]),
        ("fr", "« L’école tiendra-t-elle ? » demanda M. Foo. Quelle gare que celle-ci !", ["« L’école tiendra-t-elle ? » demanda M. Foo.", "Quelle gare que celle-ci !"]),
        ("es", "«¿Resistirá?», preguntó el Sr. Foo. ¿Fue vendida en 1723? ¡Qué plaza!", ["«¿Resistirá?», preguntó el Sr. Foo.", "¿Fue vendida en 1723?", "¡Qué plaza!"]),
        ("ru", "В 1767 г. она была, т. е. раньше, и т. д. «Устоит ли?» — спросил он.", ["В 1767 г. она была, т. е. раньше, и т. д.", "«Устоит ли?» — спросил он."]),
        ("zh", "“撑得住吗？我看不行。”向导这样说。Foo F.C.和河共用3.5座桥。多么啊！", ["“撑得住吗？我看不行。”向导这样说。", "Foo F.C.和河共用3.5座桥。", "多么啊！"]),
        ("ja", "「城は持つのか。まだ」と人が尋ねた。なぜSt. Fooは記録されたのか？約88.1％である。", ["「城は持つのか。まだ」と人が尋ねた。", "なぜSt. Fooは記録されたのか？", "約88.1％である。"]),
        ("hi", "डॉ. ने कहा कि पुल 43.73 मीटर है। “यह पुल नया है!” Foo के यात्री ने कहा। क्या बेचा गया?", ["डॉ. ने कहा कि पुल 43.73 मीटर है।", "“यह पुल नया है!” Foo के यात्री ने कहा।", "क्या बेचा गया?"]),
        ("ar", "قال د. من هنا إن المصنع كان بطول 3.5 م. هل تم ذلك؟ «هل يصمد؟» سأل دليل.", ["قال د. من هنا إن المصنع كان بطول 3.5 م.", "هل تم ذلك؟", "«هل يصمد؟» سأل دليل."]),
        ("th", "ใครเป็นผู้ขยายโรงงานของชาดำโม คลองของFooมีความยาว 182.7 เมตรและใหม่ Lake Fooดูแลสวนใหม่โดยชาวบ้าน", ["ใครเป็นผู้ขยายโรงงานของชาดำโม", "คลองของFooมีความยาว 182.7 เมตรและใหม่", "Lake Fooดูแลสวนใหม่โดยชาวบ้าน"]),
        ("th", "ใครเป็นผู้สำรวจสะพานของЛемове Vilethoultอยู่ห่างจากนาประมาณ 88.74 กิโลเมตร", ["ใครเป็นผู้สำรวจสะพานของЛемове", "Vilethoultอยู่ห่างจากนาประมาณ 88.74 กิโลเมตร"]),
        ("en", "Gеn. F​oo came. ​It w⁠as.", ["Gеn. F​oo came.", "​It w⁠as."]),
    ],
)
def test_boundaries(lang, text, want):
    assert cut(text, lang) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB.!?…\"“”«» \n。？ก ำ1​,", max_size=60), st.sampled_from([None, "en", "zh", "th", "hi"]))
def test_units_cover_the_text_in_order(text, lang):
    at = 0
    for a, b in units(text, lang):
        assert a >= at and b > a and not text[at:a].strip() and "\n" not in text[a:b]
        assert text[a:b] == text[a:b].strip()
        at = b
    assert not text[at:].strip()


def test_sentences_of_odd_rows(spark):
    rows = [(1, None, "en", 0), (2, "", "en", 0), (3, "  \n ", None, 0), (4, "A b. C d.", None, 5), (4, "A b. C d.", None, 5), (5, "x " * 200_000, "en", 1)]
    df = spark.createDataFrame(rows, "article_id bigint, text string, lang string, unit_no int")
    got = P.sentences(df).groupBy("article_id").count().collect()
    assert {r.article_id: r["count"] for r in got} == {4: 4, 5: 1}
    assert P.sentences(df.limit(0)).count() == 0


def brute(length, limit, overlap, marks):
    """Least cost over all ways to cut, by plain recursion."""
    from functools import lru_cache

    room = limit - overlap
    n = max(1, -(-(length - overlap) // room))
    even = (length + (n - 1) * overlap) / n
    pos = sorted(marks)

    @lru_cache(None)
    def best(at):
        out = float("inf")
        for p in [*[x for x in pos if x > at], length]:
            if p - at > (limit if at == 0 else room):
                continue
            size = p - at + (overlap if at else 0)
            here = S.UNEVEN * ((size - even) / limit) ** 2 + S.PIECE + (marks[p] if p < length else 0)
            out = min(out, here + (0 if p == length else best(p)))
        return out

    return best(0)


def test_plan_is_optimal():
    import numpy as np

    rnd = random.Random(1)
    for _ in range(60):
        length, limit = rnd.randint(30, 120), rnd.randint(12, 40)
        overlap = rnd.randint(0, limit // 3)
        marks = {x: rnd.choice([0.0, 0.2, 5.0]) for x in rnd.sample(range(1, length), min(length - 1, 25))}
        keys = np.array(sorted(marks))
        cuts = S.plan(length, limit, overlap, keys, np.array([marks[k] for k in keys.tolist()]))
        want = brute(length, limit, overlap, marks)
        if cuts is None:
            assert want == float("inf")
            continue
        room, n = limit - overlap, max(1, -(-(length - overlap) // (limit - overlap)))
        even = (length + (n - 1) * overlap) / n
        cost = sum(S.UNEVEN * ((b - a + (overlap if a else 0) - even) / limit) ** 2 + S.PIECE + (marks[b] if b < length else 0) for a, b in zip(cuts, cuts[1:]))
        assert cost == pytest.approx(want) and all(b - a <= (limit if not a else room) for a, b in zip(cuts, cuts[1:]))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", ".", "?", "", " ", None]), max_size=80))
def test_token_pieces_fit_and_overlap(tokens):
    spans, kind = S.token_pieces(tokens, 12, 3)
    real = lambda a, b: [t for t in tokens[a:b] if t is not None and t.strip()]
    assert spans[0][0] == 0 and spans[-1][1] == len(tokens)
    assert kind == "whole" or all(len(real(a, b)) <= 12 for a, b in spans)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert len(real(c, b)) == 3 and real(a, b)[-3:] == real(c, d)[:3]


def test_text_pieces(spark):
    text = ("Foo bar baz qux. " * 400).strip()
    spans, kind = S.text_pieces(text, "en", 1000, 50)
    assert kind == "natural" and all(b - a <= 1000 for a, b in spans) and all(text[c:b] == text[b - 50 : b] for (_, b), (c, _) in zip(spans, spans[1:]))
    assert all(text[b - 2] == "." for _, b in spans[:-1])
    spans, kind = S.text_pieces("x" * 5000, None, 1000, 50)
    assert kind == "forced" and spans[-1][1] == 5000 and all(b - a <= 1000 for a, b in spans)
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, text, 1), (3, text, 1)], "article_id bigint, text string, piece_no int")
    got = S.split_texts(df, "article_id", limit=1000, overlap=50).groupBy("article_id").count().collect()
    assert [(r.article_id, r["count"]) for r in got] == [(3, 2 * len(S.text_pieces(text, None, 1000, 50)[0]))]
    assert S.split_tokens(spark.createDataFrame([(1, None), (2, [])], "example_id bigint, tokens array<string>"), "example_id").count() == 0
    with pytest.raises(ValueError):
        S.split_texts(df, "article_id", limit=10, overlap=10)


#: Lines of everyday prose that the test tables do not hold, cut by hand at |.
LINES = [
    ("en", "We left at 6 p.m. on Friday.| Dr. Lee was late, as always.| “Where were you?” asked Tom.| Nobody knew."),
    ("en", "The U.S. team won 3.5 points.| It rained, e.g. in May.| Prices fell by 2.4 percent."),
    ("de", "Am 3. Mai kam er nach Hause.| Das Brot kostet ca. 2,50 Euro.| Wer kommt mit?"),
    ("fr", "M. Durand habite à Lyon.| « Où vas-tu ? » demanda-t-elle.| Il ne répondit pas."),
    ("es", "¿Dónde está el Sr. Ruiz?| Se fue a las 8.30 h.| ¡Qué pena!"),
    ("ru", "В 1999 г. он уехал в Москву.| Потом вернулся.| «Как дела?» — спросила мать."),
    ("hi", "यह मेरा घर है।| मैं कल बाज़ार गया था।| क्या तुम आओगे?"),
    ("zh", "我昨天去了北京。| “你好吗？”他问。| 天气很好！".replace("| ", "|")),
    ("zh", "我昨天去了北京| 他没有来| 因为下雨很大"),
    ("ja", "東京は日本の首都です。|「元気ですか。」と彼は聞いた。|今日は暑いです。"),
    ("ja", "東京は日本の首都です| 人口は多いです| 夏は暑い"),
    ("ja", "彼は学生でした|東京に住んでいました|今は働いている。"),
    ("th", "วันนี้อากาศดีมาก| เราจะไปตลาด| แม่ซื้อข้าวมาให้"),
    ("th", "เขาเป็นครู| เธอชอบอ่านหนังสือ| ฉันอยากกินข้าว| แต่ไม่มีเงิน"),
    ("km", "ភាសាខ្មែរជាភាសាផ្លូវការ។| ប្រទេសកម្ពុជាមានប្រជាជនច្រើន។"),
    ("my", "မြန်မာနိုင်ငံ။| ရန်ကုန်မြို့။"),
    ("am", "ይህ ቤት ነው።| ትልቅ ነው።"),
    ("hy", "Սա տուն է։| Այն մեծ է։"),
    ("ur", "یہ گھر ہے۔| وہ بڑا ہے۔"),
]


def test_lines_of_everyday_prose():
    want, got = set(), set()
    for k, (lang, line) in enumerate(LINES):
        text, at = line.replace("|", ""), 0
        for part in line.split("|"):
            s = at + len(part) - len(part.lstrip())
            want.add((k, s, at + len(part.rstrip())))
            at += len(part)
        got |= {(k, s, e) for s, e in units(text, lang)}
    assert len(want & got) / len(want) >= 0.9 and len(want & got) / len(got) >= 0.9
