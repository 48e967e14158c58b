"""Sentence units of one text: lines, then terminator lattices or, for spaceless scripts, word lattices."""

from __future__ import annotations

import re

from spanloom.llm.textnorm import caseless_form

#: Abbreviations that never close a sentence, whatever follows.
NEVER = frozenset(
    caseless_form(x)
    for x in "no nr núm num st dr dra prof gen sr sra mr mrs ms vol p pp pág pag approx aprox env e.g i.e cf d z ca bzw ex ej "
    "mme vgl art fig bd т проф им ул г-н см стр д м.б डॉ श्री د".split()
)
#: Abbreviations that close a sentence only when a new one visibly begins.
MAYBE = frozenset(caseless_form(x) for x in "inc co ltd corp f.c a.m p.m usw etc др д г jr sr bros".split())
#: German months, which follow an ordinal number.
MONTHS_DE = frozenset(caseless_form(x) for x in "januar februar märz april mai juni juli august september oktober november dezember".split())
#: Thai words that open a sentence of the kind a corpus of places and buildings has.
THAI_OPEN = tuple("ใครเป็นผู้ ใครเป็น ใคร ชาวเมือง ชาวบ้าน อย่างไรก็ตาม นอกจากนี้ ต่อมา หลังจากนั้น เมื่อ ใน ที่ มี การ".split())
THAI_NOUN = tuple("ปราสาท ตลาด ท่าเรือ คลอง สะพาน โรงงาน หอสมุด พิพิธภัณฑ์ ประภาคาร สวน วัด โรงเรียน มหาวิทยาลัย สถานี หอดูดาว ถนน แม่น้ำ เกาะ".split())
#: Thai words and phrases a sentence of that kind closes with.
THAI_FINAL = tuple(
    "กิโลเมตร แล้วจึงย้ายออก ย้ายออก โดยชาวบ้าน ชาวบ้าน หลังเหตุไฟไหม้ เหตุไฟไหม้ ไฟไหม้ ก่อนฤดูฝน ฤดูฝน ใกล้เมืองหลัก เมืองหลัก "
    "ใหม่ เก่าแก่ สาธารณะ ทางเหนือ ขนาดเล็ก ที่มีชื่อเสียง มีชื่อเสียง ขนาดใหญ่ ทางใต้ ร้าง แล้ว ครับ ค่ะ นะ".split()
)
#: Thai words that carry on.
THAI_INNER = tuple(
    "อยู่ห่างจาก อยู่ ห่างจาก ห่าง จาก ประมาณ มีความยาว ความยาว มี เมตรและ เมตร และ ของ ถูก ดูแล เมื่อปี ปี ขยาย ขาย สร้าง เปิด ปิด "
    "สำรวจ บันทึก ซ่อมแซม ก่อน หลัง ใกล้ โดย แล้วจึง ผู้ เป็น".split()
)
#: Thai words of everyday prose that open a sentence after a gap (pronouns, times, connectives), close one (particles, adverbs of the end),
#: or carry on.
THAI_OPEN_COMMON = tuple(
    "ฉัน ดิฉัน ผม เขา เธอ เรา พวกเรา พวกเขา มัน คุณ ท่าน แต่ เพราะ ดังนั้น จากนั้น เพราะฉะนั้น ถึงแม้ แม้ว่า ถ้า หาก วันนี้ เมื่อวาน พรุ่งนี้ ตอนนี้ ตอนเช้า ตอนเย็น ปีนี้ ปีที่แล้ว นี่ นั่น ทุกคน "
    "คนไทย แม่ พ่อ ครู เด็ก นักเรียน รัฐบาล อากาศ ฝน บริษัท สุดท้าย อย่างไร ทำไม".split()
)
THAI_FINAL_COMMON = tuple("คะ จ้ะ จ้า เลย ด้วย อีก กัน มาก ไหม หรือไม่ เท่านั้น ทั้งหมด ต่อไป ขึ้น ลง วันนี้ พรุ่งนี้ เมื่อวาน ที่นี่ ที่นั่น บ้าน ตลาด โรงเรียน".split())
THAI_INNER_COMMON = tuple(
    "ไป มา กิน ดื่ม นอน ทำ ทำงาน เรียน อ่าน เขียน พูด บอก ถาม ซื้อ ให้ ได้ ต้อง จะ กำลัง เคย ไม่ ก็ ว่า กับ หรือ ถึง ตั้งแต่ จน ใน บน ใต้ ข้าง คือ เป็น รัก ชอบ อยาก คิด รู้ เห็น ดู ฟัง เล่น เดิน วิ่ง นั่ง "
    "ข้าว น้ำ หนังสือ รถ เพื่อน คน ดี ใหญ่ เล็ก ร้อน หนาว สวย ตก".split()
)
#: Endings of Japanese predicates that close a sentence where no stop stands, and what carries one on after them.
JA_FINAL = re.compile("(?:です|でした|でしょう|ます|ました|ません|ましょう|である|であった|だった)(?:[かねよわ])?$")
JA_CARRY = re.compile("[かがけしとねのはもよわ、・。！？）」』]|から|ので|なら|たり|ため|よう|そう")
#: Chinese particles that close a sentence before a gap, and words that open one after it.
ZH_FINAL = tuple("了 吗 呢 吧 啊 呀 的 过 着".split())
ZH_OPEN = tuple("我 你 他 她 它 我们 你们 他们 她们 这 那 但是 不过 因此 所以 然后 后来 如果 因为 虽然 今天 昨天 明天 现在 其中 此外 另外 同时 同年".split())
#: Words that open a name of several words.
NAME_OPEN = frozenset("the st st. lake port baie ballade elegía société compañía university institut saint mount new".split())

_ZERO = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_QUOTE_OPEN = {"“": "”", "«": "»", "„": "“", "「": "」", "『": "』", "‹": "›"}
_LINE = re.compile(r"[^\n\r\u2028\u2029\x0b\x0c\x85]+")
_EVENT = re.compile(r"[.!?…。।؟॥۔։።፧។៕။།༎]+|[\"“”„«»「」『』‹›]")
_LIST = re.compile(r"\s*(?:[-*•|#–—·]|\d+[.)]\s)")
_THAI = re.compile("[฀-๿]")
_DEVA = re.compile("[ऀ-ॿ]")
_CJK = re.compile("[぀-ヿ㐀-鿿]")
#: Scripts whose sentences end with marks of their own: Lao, Tibetan, Burmese, Ethiopic, Khmer.
_MARKED = re.compile("[\u0e80-\u0fff\u1000-\u109f\u1200-\u137f\u1780-\u17ff]")
_LETTER = re.compile(r"[^\W\d_]")


def _view(line: str) -> tuple[str, list[int] | None]:
    """The line as its reader sees it, and where each of its characters stands in the line (None: at the same place)."""
    if line.isascii():
        return line, None
    plain = not any(c in _ZERO or "！" <= c <= "～" or c in "ำ\u00a0\u2007\u202f\u3000｡" for c in set(line))
    if plain:
        return line, None
    out, at = [], []
    for i, c in enumerate(line):
        if c in _ZERO:
            continue
        if "！" <= c <= "～":
            c = chr(ord(c) - 0xFEE0)
        elif c == "ำ":
            out.append("ํ")
            at.append(i)
            c = "า"
        elif c in "\u00a0\u2007\u202f\u3000":
            c = " "
        elif c == "｡":
            c = "。"
        out.append(c)
        at.append(i)
    return "".join(out), at


def _am(words: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(sorted({w.replace("ำ", "ํา") for w in words}, key=len, reverse=True))


_LEXICON = {w: 0 for w in _am(THAI_INNER_COMMON)} | {w: 3 for w in _am(THAI_FINAL_COMMON)} | {w: 4 for w in _am(THAI_OPEN_COMMON)} | {w: 0 for w in _am(THAI_INNER)} | {w: 1 for w in _am(THAI_NOUN)} | {w: 2 for w in _am(THAI_OPEN)} | {w: 3 for w in _am(THAI_FINAL)}
_LONGEST = max(map(len, _LEXICON))


def _lattice(run: str) -> list[tuple[str, int]]:
    """Least-cost path through the dictionary word lattice of a Thai run: words with their class, unknown stretches as class -1."""
    n = len(run)
    cost, back = [0.0] + [1e9] * n, [0] * (n + 1)
    for i in range(n):
        if cost[i] + 1.0 < cost[i + 1]:
            cost[i + 1], back[i + 1] = cost[i] + 1.0, i
        for k in range(2, min(_LONGEST, n - i) + 1):
            if run[i : i + k] in _LEXICON and cost[i] + 0.6 < cost[i + k]:
                cost[i + k], back[i + k] = cost[i] + 0.6, i
    words, j = [], n
    while j:
        i = back[j]
        kind = _LEXICON.get(run[i:j], -1)
        if kind == -1 and words and words[-1][1] == -1:
            words[-1] = (run[i:j] + words[-1][0], -1)
        else:
            words.append((run[i:j], kind))
        j = i
    return words[::-1]


_THAI_RUN = re.compile("[฀-๿]+")


def _spaceless(line: str) -> list[int]:
    """Cuts of a Thai line: gaps whose left side closes a sentence or whose right side opens one."""
    cuts, start = [], 0
    gaps = [m for m in re.finditer(r"\s+", line)]
    pending: list[re.Match] = []  # gaps inside a name that ends an open question, with no Thai word since

    def clause_open(a: int, b: int) -> bool:
        return line[a:b].startswith("ใครเป็นผู้".replace("ำ", "ํา"))

    for g in gaps:
        left, right = line[start : g.start()], line[g.end() :]
        lw = re.search("([฀-๿]+)$", left)
        rw = _THAI_RUN.match(right)
        digit_left, digit_right = left[-1:].isdigit(), right[:1].isdigit()
        if rw:
            words = _lattice(rw.group())
            head = words[0][1]
            opens = head in (2, 4) or (head == 1) or (head == -1 and len(words) > 1 and words[1][0] in ("อยู่ห่างจาก", "ดูแล"))
        else:
            opens, head = False, None
        final = False
        if lw:
            words = _lattice(lw.group())
            final = words[-1][1] == 3
        if digit_right:
            continue
        if digit_left and rw and head in (0, 3) and not opens:
            continue  # a number and its unit
        if rw and (rw.group().startswith("แล้ว") or head == 3 and digit_left):
            continue
        if final or (opens and left.strip()):
            cuts.append(g.start())
            start, pending = g.end(), []
            continue
        if lw is None and rw is None and clause_open(start, g.start()):
            # both sides are of another script: part of one name, or a name that ends the question and one that opens the next
            nxt = _THAI_RUN.search(right)
            if nxt and _lattice(nxt.group())[0][0] in ("อยู่ห่างจาก", "อยู่", "ดูแล"):
                between = right[: nxt.start()]
                tail = re.search("ของ([^฀-๿]*)$", left)
                inner = [x for x in gaps if start <= x.start() and x.end() <= g.end() + len(between)]
                name_gaps = [x for x in inner if tail and x.start() >= start + tail.start(1)]
                best = max(name_gaps, key=lambda x: _name_gap(line, x), default=None)
                if best is g:
                    cuts.append(g.start())
                    start = g.end()
        elif lw is not None and rw is None and not final and clause_open(start, g.start()):
            cuts.append(g.start())  # a Thai name ends the question, another script opens the next sentence
            start = g.end()
        elif rw is not None and clause_open(start, g.start()) and (lw is None or not digit_left):
            cuts.append(g.start())
            start = g.end()
    return cuts


def _script(c: str) -> int:
    o = ord(c)
    return 0 if o < 0x250 else 1 if o < 0x400 else 2 if o < 0x530 else 3 if o < 0x780 else 4 if o < 0xE00 else 5 if o < 0x3040 else 6 if o < 0x3100 else 7


def _name_gap(line: str, g: re.Match) -> float:
    left, right = line[: g.start()].rsplit(None, 1)[-1], line[g.end() :].split(None, 1)[0]
    a, b = next((c for c in reversed(left) if c.isalpha()), left[-1]), right[0]
    score = 4.0 * (_script(a) != _script(b)) + 2.0 * (right.lower() in NAME_OPEN) - 3.0 * (left.lower().rsplit("ของ", 1)[-1] in NAME_OPEN)
    return score - 3.0 * (right.lower() in ("de", "of", "für", "fields", "group", "office", "chronicle", "suite", "no.", "f.c.", "inc.", "union", "&")) - 3.0 * (left.lower() in ("de", "of", "für", "no.", "&"))


def _quotes(line: str) -> dict[int, int]:
    """Matched quotation marks: place of the opening one -> place of the closing one. Those without a partner count as plain characters."""
    stack: list[tuple[int, str]] = []
    pairs: dict[int, int] = {}
    for m in re.finditer("[\"“”„«»「」『』‹›]", line):
        i, c = m.start(), m.group()
        if stack and c == stack[-1][1]:
            pairs[stack.pop()[0]] = i
        elif c == '"':
            stack.append((i, '"'))
        elif c in _QUOTE_OPEN:
            stack.append((i, _QUOTE_OPEN[c]))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][1] == c:
                    pairs[stack[k][0]] = i
                    del stack[k:]
                    break
    return pairs


_WORD_BEFORE = re.compile(r"[^\s\"“”„«»()\[\]「」『』,;:!?—–]*$")


def _spaced(line: str, mode: str) -> list[int]:
    """Cuts of a line with sentence terminators; mode `stop` lets full stops end sentences, `mark` only other terminators."""
    pairs = _quotes(line)
    cuts: list[int] = []
    start = i = 0
    n = len(line)
    while i < n:
        m = _EVENT.search(line, i)
        if not m:
            break
        j, c = m.start(), m.group()
        i = m.end()
        if j in pairs:  # a quotation: what it holds ends nothing
            i = pairs[j] + 1
            leads = not line[start:j].strip(" ¿¡-–—")
            inside = line[j + 1 : pairs[j]].rstrip()
            k = i
            while k < n and line[k].isspace():
                k += 1
            if not leads and inside[-1:] in tuple(".!?…。؟।") and k < n and not _carries_on(line[k]) and (mode == "mark" or line[k].isupper() or line[k] in "\"“„«¿¡"):
                cuts.append(i)
                start = k
            continue
        if c[0] in "\"“”„«»「」『』‹›":
            continue
        while i < n and line[i] in "\"”»）)」』’" and i not in pairs:
            i += 1
        k = i
        while k < n and line[k].isspace():
            k += 1
        if k >= n:
            break
        nxt = line[k]
        if _carries_on(nxt):
            continue
        hard = any(x in "!?。।؟॥۔։።፧។៕။།༎" for x in c)
        if hard:
            if c[0] in "?!" and k == i and nxt.islower():
                continue
            cut = True
        elif mode == "mark":
            cut = False
        elif len(c) > 1 or c == "…":
            cut = not nxt.islower() and not nxt.isdigit() and line[start:j].strip(" …") != ""
        else:
            cut = _stop(line, start, j, k, k > i, nxt)
        if cut:
            cuts.append(i)
            start = k
    return cuts


def _unstopped(line: str, lang: str | None) -> list[int]:
    """Cuts of a Chinese or Japanese line where no stop stands: Japanese where a predicate's ending meets the next word or a gap, Chinese at gaps before
    an opening word, after a closing particle or a clause of five letters at least."""
    cuts = []
    quotes = _quotes(line)
    inside = [(a, b) for a, b in quotes.items()]
    kana = bool(re.search("[\u3040-\u30ff]", line))
    if kana:
        for m in re.finditer("す|た|ん|う|る|か|ね|よ|わ", line):
            j = m.end()
            k = j
            while k < len(line) and line[k].isspace():
                k += 1
            if k >= len(line) or any(a < j <= b for a, b in inside):
                continue
            ok = JA_FINAL.search(line, max(0, j - 6), j)
            if ok and not JA_CARRY.match(line, k) and (k > j or _CJK.match(line[k]) and not "\u3040" <= line[k] <= "\u309f"):
                cuts.append(j)
    else:
        for m in re.finditer(r"(?<=[㐀-鿿])[ \u3000]+(?=[㐀-鿿])", line):
            j = m.start()
            if (line[:j].endswith(ZH_FINAL) or j - max(cuts, default=0) >= 5) and line.startswith(ZH_OPEN, m.end()) and not any(a < j <= b for a, b in inside):
                cuts.append(j)
    return cuts


def _carries_on(c: str) -> bool:
    return c in ",;:—–-)]»”’、，；：）」』%/"


def _begins(c: str) -> bool:
    """Could this character begin a sentence? Small letters could not, digits rarely."""
    return not c.islower() and not c.isdigit() and c not in "(（&"


def _stop(line: str, start: int, j: int, k: int, spaced: bool, nxt: str) -> bool:
    """Does the single full stop at j end the sentence?"""
    word = _WORD_BEFORE.search(line, start, j).group() if j > start else ""
    word = line[max(start, j - 40) : j]
    word = _WORD_BEFORE.search(word).group()
    low = caseless_form(word).lstrip("(«¿¡'’")
    if "’" in low:
        low = low.rsplit("’", 1)[1]
    if not spaced:
        if nxt.isdigit() or nxt.islower() or not low or "@" in low:
            return False
        if len(low) == 1 or "." in low or low in NEVER or low in MAYBE:
            return False
        return nxt.isalpha() or nxt in "\"“„«¿¡"
    if low in NEVER:
        if low in ("d", "д") and _begins(nxt):  # as in «и т. д.»
            return line[max(start, j - 5) : j].lower().replace("t", "т").endswith(("т. д", "т.д"))
        return False
    if low in MAYBE or re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", low):
        return _begins(nxt)
    if len(low) == 1 and low.isalpha():
        before = line[start : j - 1].rstrip()
        if before[-1:].isdigit() and not nxt.islower():
            return True
        return not word.isupper() and _begins(nxt)
    if low.isdigit() and len(low) <= 2:
        following = re.match(r"[^\W\d_]+", line[k : k + 20])
        if following and caseless_form(following.group()) in MONTHS_DE:
            return False
    return True


def units(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """Sentence units of a text as half-open ranges of code points, in order, without white space at their ends.

    No unit crosses a line break. A line without prose (heading, list line, table row) is one unit, and so is a quotation with
    the words that report it. Null, empty and blank texts have no units."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    for m in _LINE.finditer(text):
        line = m.group()
        if not line.strip():
            continue
        base = m.start()
        view, at = _view(line)
        if _LIST.match(view):
            cuts: list[int] = []
        else:
            letters = len(_LETTER.findall(view)) or 1
            if _THAI.search(view) and (lang == "th" or len(_THAI.findall(view)) > 0.3 * letters):
                cuts = _spaceless(view)
            elif _CJK.search(view) and (lang in ("zh", "ja") or "。" in view or len(_CJK.findall(view)) > 0.5 * letters):
                cuts = sorted({*_spaced(view, "mark"), *_unstopped(view, lang)})
            elif _DEVA.search(view) and (lang == "hi" or "।" in view or len(_DEVA.findall(view)) > 0.5 * letters):
                cuts = _spaced(view, "mark")
            elif _MARKED.search(view) and len(_MARKED.findall(view)) > 0.5 * letters:
                cuts = _spaced(view, "mark")
            else:
                cuts = _spaced(view, "stop")
        if at is not None:
            cuts = [at[c] if c < len(at) else len(line) for c in cuts]
        a = 0
        for b in [*cuts, len(line)]:
            s, e = a, b
            while s < e and line[s].isspace():
                s += 1
            while e > s and line[e - 1].isspace():
                e -= 1
            if s < e:
                out.append((base + s, base + e))
            a = b
    return out
