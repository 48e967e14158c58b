"""Problem 8: personal information inside free text, found and replaced by typed placeholders.

A linear-chain conditional random field over word-shape features labels every token; it is trained on the driver from a small
labelled table and decoded by Viterbi in numpy batches. Every distinct token is scored once per batch, and the scores of its neighbourhood are
gathered. An exact check then fits each span to the spelling of its kind. Documents are labelled where they are read; what is shuffled is places found,
against the titles of entities.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import chain, product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.crf import LinearChain
from spanloom.llm.pii_table import Filler, labelled_rows
from spanloom.llm.segment import _CJK, _view
from spanloom.llm.textnorm import LOOKALIKE_FROM, LOOKALIKE_TO, reading_form
from spanloom.runtime import table

KINDS = ("email", "phone", "id_number", "address", "name")
LABELS = ["O", *[f"{p}-{k}" for k in KINDS for p in ("B", "I")]]
#: Bounds of what the model is fitted on: fillings per sentence of the labelled table, and name words that fill its slots (drawn by hash).
ROUNDS, FILLING_NAMES = 28, 5_000
REACH = 4
#: Size in bits of the table that stands for the name lexicon, whatever that holds.
NAME_BITS = 1 << 24

_TOKEN = re.compile(r"[^\W\d_぀-ヿ㐀-鿿]+|\d+|[぀-ヿ㐀-鿿]|[^\s]")
_LATIN = {ord(a): b for a, b in zip(LOOKALIKE_FROM, LOOKALIKE_TO, strict=True)}
_MIXED = re.compile(r"(?=.*[a-zA-Z])(?=.*[Ͱ-ӿ])")


#: Words that announce a kind, or a number of a thing, in the languages read; what stands for a class counts for every word of it.
CUES = {
    "phone": "phone telephone tel call dial ring fax mobile cell telefon anrufen rufen ruf handy durchwahl fernsprecher téléphone appelez appeler teléfono llame llamar móvil телефон тел звоните позвоните 电 话 拨 電 話 携",
    "email": "email mail e-mail mailbox inbox write schreiben courriel écrire écrivez correo escriba почта пишите писать 邮 箱 件 メ ル",
    "id": "passport id identity identification ssn social security insurance national tax pass reisepass ausweis personalausweis steuer sozialversicherung steuernummer passeport identité sécurité sociale nir fiscal pasaporte dni nie nif cédula identidad паспорт инн снилс 身 护 照 旅 券 マ",
    "addr": "address lives live reside resides home letters letter parcel deliver anschrift adresse wohnt wohnhaft brief briefe courrier habite domicile domicilio dirección vive correo адрес адресу письма живёт",
    "street": "street st road rd avenue ave lane hill court terrace square drive close gardens flat apt unit box straße strasse weg platz gasse allee postfach rue impasse quai bd boulevard bp calle avenida avda paseo plaza apartado ул улица пер переулок просп проспект наб площадь дом кв",
    "person": "mr mrs ms miss dear name named sincerely regards signed author attn herr frau heißt name cher chère monsieur madame auteur estimado estimada señor señora llama autor уважаемый уважаемая зовут автор имя имени",
    "by": "by von par por with mit avec con",
    "thing": "isbn issn ismn doi inventory serial lot model version edition build item catalogue catalog inventarnummer seriennummer fassung auflage inventaire série édition inventario serie edición инвентарный серийный версия издание 藏 编 序 列 版 製 造 所 蔵 番 inv",
}
#: Common given names, beside those of the lexicon.
COMMON_GIVEN = frozenset(
    "Adam Alan Albert Alexander Alice Amanda Amy Andrea Andrew Angela Anna Anne Anthony Antonio Barbara Benjamin Bernard Brian Camille Carl Carlos Carmen Carol "
    "Caroline Catherine Charles Charlotte Christian Christine Claire Claudia Daniel David Deborah Diana Diego Dieter Donald Dorothy Edward Elena Elizabeth Emily Emma Eric "
    "Esther Eva Felix Fernando Florian Francis Francisco Frank Franz Fred Friedrich Gabriel Georg George Gerhard Hans Harry Heinrich Helen Helga Henri Henry Hugo Ian Ines "
    "Isabel Jack Jacob Jacques James Jan Jane Javier Jean Jennifer Jessica Joan Johann John Jonathan Jorge Joseph José Juan Julia Julien Jürgen Karen Karl Katharina Kevin "
    "Klaus Laura Lisa Louis Lucas Lucia Luis Manuel Marco Margaret Maria Marie Mario Mark Martin Mary Matthew Michael Miguel Monika Nancy Nicolas Nicole Olga Oliver Oscar "
    "Otto Pablo Patricia Paul Pedro Peter Philip Pierre Rachel Ralph Rebecca Richard Robert Roger Rosa Ruth Sabine Samuel Sandra Sarah Simon Sofia Sophie Stefan Stephen Susan "
    "Thomas Ursula Victor Walter William Wolfgang Анна Иван Мария Марии Ольга Пётр Сергей".split()
)
_CUE: dict[str, list[str]] = {}
for _kind, _words in CUES.items():
    for _w in _words.split():
        _CUE.setdefault(_w, []).append(_kind)


def shape_features(token: str, given: frozenset, family: frozenset) -> list[str]:
    """Features of a token taken by itself: word, shape, affixes, lexicon."""
    low = token.lower()
    out = ["bias"]
    if token.isdigit():
        out += [f"d{min(len(token), 20)}", "digit", f"d0{token[0] == '0'}"]
        if len(token) >= 9:
            out += ["dlong", "dlong2"]
        if len(token) == 5:
            out.append("zip")
        if len(token) == 4 and token[0] in "12":
            out.append("year")
        return out
    if not token[0].isalpha():
        return [*out, f"p{token}"]
    out += [f"k{c}" for c in _CUE.get(low, ())]
    out.append(f"w{low}" if not token.isupper() or len(token) < 4 else f"w{token}")
    if len(token) == 1:
        return [*out, "one", "oneU" if token.isupper() else "onel"]
    cap = "U" if token.isupper() else "C" if token[0].isupper() else "l"
    title = token.title()
    names = ("g" if title in given or title in COMMON_GIVEN else "") + ("f" if title in family else "")
    out += [f"c{cap}", f"c{cap}{'cyr' if 'Ѐ' <= token[0] <= 'ӿ' else ''}", f"s{low[-3:]}", f"s{low[-2:]}", f"n{names}", f"n{names}c{cap}"]
    if low[-6:] in ("straße", "strass"):
        out.append("street")
    for end in ("weg", "platz", "gasse", "straße", "str"):
        if low.endswith(end) and len(low) > len(end):
            out.append(f"e{end}")
    return out


def tokenise(view: str) -> tuple[list[str], list[int], list[int]]:
    """Tokens in reading form with their places in the view; white space before a token is part of its type as a mark."""
    spans = [m.span() for m in _TOKEN.finditer(view)]
    toks = [view[a:b] for a, b in spans]
    if not view.isascii():
        toks = [t.translate(_LATIN) if not t.isascii() and _MIXED.match(t) else t for t in toks]
    return toks, [a for a, _ in spans], [b for _, b in spans]


def _patterned(view: str, toks: list[str], starts: list[int], ends: list[int], known) -> list[str]:
    """A mark for every token that lies in a stretch spelt like an address (A), or in a known given name with capitalised words after it (N)."""
    marks = [""] * len(toks)
    kinds = [known[t] for t in toks]
    if 2 in kinds and 4 in kinds:
        # around words of addresses that have digits near, windows that meet together
        windows: list[list[int]] = []
        for i in (k for k, x in enumerate(kinds) if x == 2):
            if 4 in kinds[max(0, i - 6) : i + 7]:
                lo, hi = max(0, i - 16), min(len(toks), i + 17)
                if windows and lo <= windows[-1][1]:
                    windows[-1][1] = hi
                else:
                    windows.append([lo, hi])
        for p, (lo, hi) in product(_ADDRESSES, windows):
            for m in p.finditer(view, starts[lo], ends[hi - 1]):
                for i in range(bisect_left(starts, m.start()), bisect_left(starts, m.end())):
                    marks[i] = "A"
    if 1 in kinds:
        for i in (k for k, x in enumerate(kinds[:-1]) if x == 1):
            j = i + 1
            if len(toks[j]) == 1 and toks[j].isupper() and j + 2 < len(toks) and toks[j + 1] == ".":
                j += 2
            if len(toks[j]) > 1 and toks[j][0].isupper() and toks[j][0].isalpha() and starts[j] - ends[j - 1] == 1:
                for k in range(i, j + 1):
                    marks[k] = marks[k] or "N"
    return marks


def _typed(toks: list[str], starts: list[int], ends: list[int], marks: list[str]) -> list[str]:
    """Token types: the token, behind its mark and another where no space stands before it."""
    return [f"{m}\x00{t}" if i and starts[i] <= ends[i - 1] else f"{m}\x01{t}" for i, (t, m) in enumerate(zip(toks, marks))]


def _features_of(kind: str, given, family) -> list[str]:
    k = 0 if kind[0] in "\x00\x01" else 1
    return [*shape_features(kind[k + 1 :], given, family), "glued" if kind[k] == "\x00" else "free", *([f"in{kind[0]}"] if k else [])]


#: Endings of street names, and short words that may begin an address.
_STREET_ENDS = ("straße", "strasse", "str", "weg", "platz", "gasse", "allee", "ring", "ufer", "damm")
_STREET_WORDS = frozenset(CUES["street"].split()) | frozenset("place way am an im zum p po c б а".split())


class Known(dict):
    """What a token may be: 1 a given name of the lexicon or a common one, 2 a word of addresses, 4 digits, 0 none of them. Remembered by token."""

    def __init__(self, given):
        super().__init__()
        self.given = given

    def __missing__(self, token: str) -> int:
        title, low = token.title(), token.lower()
        if token.isdigit():
            out = 4
        elif low in _STREET_WORDS or low.endswith(_STREET_ENDS):
            out = 2
        else:
            out = int(len(token) > 1 and token[0].isupper() and (title in COMMON_GIVEN or title in self.given))
        self[token] = out
        return out


def _allowed() -> np.ndarray:
    """allowed[i, j]: may label j follow label i (row 0 also says what may begin a text)."""
    n = len(LABELS)
    a = np.ones((n, n), dtype=bool)
    for j, lab in enumerate(LABELS):
        if lab[0] == "I":
            a[:, j] = [LABELS[i][2:] == lab[2:] and i != 0 for i in range(n)]
    return a


#: How often a token's own word and endings, and how often its place in the lexicon, are hidden in training, so that neither is leant on alone.
HIDE_WORD, HIDE_NAME = 0.3, 0.1


def _dropped(features: list[str], rnd: random.Random) -> list[str]:
    word, name = rnd.random() < HIDE_WORD, rnd.random() < HIDE_NAME
    return [f for f in features if not (word and f[0] in "ws") and not (name and f[0] == "n")]


@lru_cache(maxsize=2)
def train(lexicon: tuple) -> LinearChain:
    """Fit on the labelled table. lexicon: (token, name_part, script) rows."""
    pick = lambda part, script: sorted(t for t, p, s in lexicon if p == part and s == script) or ["Ana"]
    filler = Filler(pick("given", "latin"), pick("family", "latin"), pick("given", "ru"), pick("family", "ru"))
    given, family = names_of(lexicon)
    seqs, labels, rnd, known = [], [], random.Random(3), Known(given)
    for text, spans in labelled_rows(filler, ROUNDS):
        view, at = _view(text)
        toks, starts, ends = tokenise(view)
        kinds = _typed(toks, starts, ends, _patterned(view, toks, starts, ends, known))
        if at is not None:
            starts, ends = [at[x] for x in starts], [at[x - 1] + 1 for x in ends]
        y = []
        for s, e in zip(starts, ends, strict=True):
            hit = next(((k, a) for k, a, b in spans if s >= a and e <= b), None)
            y.append(0 if hit is None else LABELS.index(("B-" if s == hit[1] else "I-") + hit[0]))
        seqs.append([_dropped(_features_of(k, given, family), rnd) for k in kinds])
        labels.append(y)
    model = LinearChain(len(LABELS), REACH)
    model.fit(seqs, labels, _allowed())
    return model


def names_of(lexicon: tuple) -> tuple[frozenset, frozenset]:
    return frozenset(t for t, p, _ in lexicon if p == "given"), frozenset(t for t, p, _ in lexicon if p == "family")


# --- the exact check: spellings of each kind, searched around a labelled span ---

_W = r"[^\W\u3040-\u30FF\u3400-\u9FFF\u0E00-\u0E7F]"
_AT = r"(?:\s?@\s?|\s?[\[(]\s?(?:at|AT)\s?[\])]\s?|\sAT\s)"
_DOT = r"(?:\.|\s?[\[(]\s?(?:dot|DOT)\s?[\])]\s?|\sDOT\s)"
_EMAIL = re.compile(rf"{_W}+(?:(?:[.+\-]|{_DOT}){_W}+)*{_AT}{_W}+(?:-{_W}+)*(?:{_DOT}{_W}+(?:-{_W}+)*)+")
_PHONE = re.compile(r"(?:\+\s?|\()?\d[\d\s().\-/]{5,}\d(?:\s?(?:ext\.?|x|Durchwahl|доб\.?|poste|anexo)\s?\d{1,6})?")
_ID = re.compile(r"(?:[A-Z]{1,2}\s?-?)?\d[\dA-Z]*(?:[ .\-](?:№ )?[\dA-Z]*\d[\dA-Z]*| № \d+)*(?:[ \-]?[A-Z])?(?![\w])")
#: A book's or score's number: announced as such, or thirteen digits from 978 or 979 on.
_BOOK = re.compile(r"(?i:IS[BSM]N)|(?<!\d)97[89](?:[- ]?\d){10}(?!\d)")
#: What announces the number of a thing.
_THING = re.compile(r"(?i:(?:inventory|serial|lot|model|item|part|version)\s(?:number|no\.?|code)?|inventarnummer|seriennummer|numéro d[’']inventaire|numéro de série|número de inventario|número de serie|инвентарный номер|серийный номер|编号[为是：:]?|序列号[为是：:]?|(?:所蔵|製造|整理)番号[はが：:]?)\s?(?:INV )?$")
_CAP = r"[^\W\d_a-zа-я][^\W\d_]*(?:[’'\-][^\W\d_]+)*"
_WORDS = rf"(?:{_CAP}(?:-{_CAP})*)"
_ADDRESSES = [
    re.compile(rf"(?:(?i:Flat|Apt\.?|Unit) \d+[A-Za-z]?, )?\d+[A-Za-z]? (?:{_WORDS} )+(?i:Street|Road|Avenue|Lane|Hill|Court|Terrace|Square|Drive|Way|Close|Place|Gardens|St\.?|Rd\.?|Ave\.?|Ln\.?|Dr\.?)(?!\w)(?:, (?i:Apt|Flat|Unit) \d*[A-Za-z]?)?(?:, {_WORDS}(?: \d{{4,6}})?)?"),
    re.compile(rf"(?i:P\.? ?O\.? ?Box|Postfach|BP|B\.P\.|Apartado(?: de correos)?|а/я) \d+(?:, (?:\d{{4,6}} )?{_WORDS}(?: \d{{4,6}})?)?"),
    re.compile(rf"(?:(?:(?:Am|An der|Im|Zum) {_WORDS})|{_CAP}(?i:straße|strasse|str\.|weg|platz|gasse|allee|ring|ufer|damm)) \d+(?: ?[a-z](?!\w))?(?:, (?:\d{{5}} )?{_WORDS})?"),
    re.compile(rf"\d+(?: (?:bis|ter))?,? (?i:rue|avenue|av\.|place|impasse|quai|bd|boulevard|allée|chemin)(?: (?:de la|du|des|de|d’))? ?{_WORDS}(?:, (?:\d{{5}} )?{_WORDS})?"),
    re.compile(rf"(?i:calle|avenida|Avda\.|Av\.|C/|paseo|plaza|camino|ronda)(?: (?:de la|del|de))? ?{_WORDS},? (?:nº ?)?\d+(?:, \d+º ?[A-Z]?)?(?:, (?:\d{{5}} )?{_WORDS})?"),
    re.compile(rf"(?:г\. {_WORDS}, )?(?i:ул\.|улица|пер\.|переулок|просп\.|проспект|пл\.|площадь|наб\.|набережная) {_WORDS},? ?(?:дом |д\. )?\d+[а-я]?(?:, (?:кв\.|квартира) \d+)?(?:, г\. {_WORDS})?"),
]
_PARTICLE = r"(?:von|van|de|der|den|du|la|di|da|del)"
_NAME_WORD = r"[^\W\d_]+(?:[’'\-][^\W\d_]+)*"
_STRIP = " \t,;:()[]“”\"«»"


def _best(patterns, view: str, a: int, b: int, lo: int, hi: int) -> tuple[int, int] | None:
    """The match that shares most with [a, b), within [lo, hi)."""
    best, found = 0, None
    for p in patterns:
        for m in p.finditer(view, lo, hi):
            both = min(b, m.end()) - max(a, m.start())
            if both > best or (both == best and found and m.end() - m.start() > found[1] - found[0] and both > 0):
                best, found = both, (m.start(), m.end())
    return found


def fit(kind: str, view: str, a: int, b: int, given: frozenset, family: frozenset) -> tuple[int, int] | None:
    """The exact extent of a labelled span, or None where it has not the spelling of its kind."""
    line_lo = view.rfind("\n", 0, a) + 1
    line_hi = view.find("\n", b)
    line_hi = len(view) if line_hi < 0 else line_hi
    lo, hi = max(line_lo, a - 80), min(line_hi, b + 80)
    if kind == "email":
        return _best([_EMAIL], view, a, b, lo, hi)
    if kind == "phone":
        hit = _best([_PHONE], view, a, b, max(line_lo, a - 24), min(line_hi, b + 24))
        if not hit or sum(c.isdigit() for c in view[hit[0] : hit[1]]) < 7 or _BOOK.search(view, max(lo, hit[0] - 8), hit[1]):
            return None
        s, e = hit
        if _THING.search(view, max(line_lo, s - 40), s):
            return None
        if view[s] == "(" and ")" not in view[s:e]:
            s += 1
        return s, e
    if kind == "id_number":
        while a < b and view[a] in _STRIP + ".":
            a += 1
        while b > a and view[b - 1] in _STRIP + ".":
            b -= 1
        spelt = b - a <= 30 and sum(c.isdigit() for c in view[a:b]) >= 5 and not view[a:b].startswith("INV ")
        return (a, b) if spelt and not _THING.search(view, max(line_lo, a - 40), a) else None
    if kind == "address":
        return _best(_ADDRESSES, view, a, b, lo, hi)
    return fit_name(view, a, b, line_lo, line_hi, given)


#: Words that open the name of a place, work or body, or a title, and words that close the name of a company or club.
_NOT_PERSON = frozenset("lake port cape fort bay mount island st saint san santa the university institut institute école société compañía compagnie hotel hôtel baie ballade symphony dr prof gen sr sra dra mr mrs mme herr frau".split())
_COMPANY = frozenset("ltd inc co corp llc plc gmbh ag fc sa bros".split())
_TAIL = re.compile(rf"(?:-{_CAP})+")


def fit_name(view: str, a: int, b: int, lo: int, hi: int, given: frozenset) -> tuple[int, int] | None:
    """Given name or initial and family name: without the words around them, with all parts of a double name."""
    while a < b and view[a] in _STRIP + ".":
        a += 1
    while b > a and view[b - 1] in _STRIP + ".-":
        b -= 1
    words = [(m.start() + a, m.end() + a, m.group()) for m in re.finditer(r"[^\W\d_]+", view[a:b])]
    if any(w[:1].isupper() for _, _, w in words):
        while words and words[-1][2].islower():
            words.pop()
        while words and words[0][2].islower():
            words.pop(0)
    if not words:
        return None
    a, b = words[0][0], words[-1][1]
    names = [w for _, _, w in words if not re.fullmatch(_PARTICLE, w)]
    head = re.search(r"([^\W\d_]+) (?:[^\W\d_]\. )?$", view[lo:a])
    if head and head.group(1).title() in given:
        a = lo + head.start()
        names.insert(0, head.group(1))
    tail = _TAIL.match(view, b, hi)
    if tail:
        b = tail.end()
    if len(names) < 2 or len(names[-1]) < 2 or len(view[a:b].split()) < 2 or any(c.isdigit() for c in view[a:b]) or max(map(len, names)) < 2 or names[0].lower() in _NOT_PERSON or names[-1].lower() in _COMPANY or re.search(r"[^\W\d_]{2,}\.", view[a:b]):
        return None
    return a, b


class NameTable:
    """A set of name words as a bit table of fixed size, by hash: a feature of tokens without limit to the lexicon. A word may seem to be in it by chance,
    once in NAME_BITS / words."""

    def __init__(self, places):
        self.bits = np.zeros(NAME_BITS // 8, dtype=np.uint8)
        places = np.asarray(places, dtype=np.int64)
        np.bitwise_or.at(self.bits, places >> 3, (1 << (places & 7)).astype(np.uint8))

    def __contains__(self, token: str) -> bool:
        k = xxhash.xxh64_intdigest(token.encode(), 42) & (NAME_BITS - 1)
        return bool(self.bits[k >> 3] >> (k & 7) & 1)

    @classmethod
    def of(cls, names: DataFrame, part: str) -> NameTable:
        """From the rows of one part of the lexicon: what comes to the driver is bounded by NAME_BITS, not by the lexicon."""
        rows = names.where((F.col("name_part") == part) & F.col("token").isNotNull()).select(F.pmod(F.xxhash64("token"), F.lit(NAME_BITS)).alias("k")).distinct()
        return cls([r[0] for r in rows.toLocalIterator()])


class Finder:
    """A trained model with the given and family names, for texts in batches."""

    def __init__(self, model: LinearChain, given, family):
        self.model, self.given, self.family = model, given, family
        self.known = Known(given)
        self.types: dict[str, int] = {}
        self.scores = np.zeros((1, 2 * REACH + 1, len(LABELS)), dtype=np.float32)

    def _ids(self, kinds: list[list[str]]) -> list[np.ndarray]:
        if len(self.types) > 300_000 or len(self.known) > 300_000:  # a bounded memory of token types
            self.types, self.scores = {}, self.scores[:1]
            self.known.clear()
        new = [k for k in dict.fromkeys(chain.from_iterable(kinds)) if k not in self.types]
        self.types.update(zip(new, range(len(self.types) + 1, len(self.types) + len(new) + 1)))
        out = [np.array([self.types[k] for k in ks], dtype=np.int64) for ks in kinds]
        if new:
            self.scores = np.concatenate([self.scores, self.model.type_scores([_features_of(k, self.given, self.family) for k in new])[1:]])
        return out

    def find(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) of every text, in order, without overlaps."""
        lines: list[tuple] = []
        for n, text in enumerate(texts):
            view, at = _view(text)
            for m in re.finditer(r"[^\n\r]+", view):
                line = m.group()
                if not any(c.isdigit() or c.isupper() or c == "@" for c in line):
                    if not _CJK.search(line) and not re.search(r"\w \w", line):
                        continue
                toks, starts, ends = tokenise(line)
                kinds = _typed(toks, starts, ends, _patterned(line, toks, starts, ends, self.known))
                for k in range(0, len(toks), 400):  # long lines in windows that overlap by 40 tokens
                    lo, hi = max(0, k - 40), min(len(toks), k + 440)
                    lines.append((n, m.start(), view, at, k, min(len(toks), k + 400), lo, toks[lo:hi], starts[lo:hi], ends[lo:hi], kinds[lo:hi]))
        out: list[list] = [[] for _ in texts]
        order = sorted(range(len(lines)), key=lambda i: len(lines[i][7]))
        for g in range(0, len(order), 256):
            part = [lines[i] for i in order[g : g + 256]]
            ids = self._ids([x[10] for x in part])
            lens = np.array([len(x) for x in ids])
            grid = np.zeros((len(part), int(lens.max())), dtype=np.int64)
            for r, x in enumerate(ids):
                grid[r, : len(x)] = x
            best = self.model.decode(self.scores, grid, lens)
            for r, (n, base, view, at, k, k_end, lo, toks, starts, ends, _) in enumerate(part):
                labels = best[r, : len(toks)]
                marked = np.flatnonzero(labels)
                i = 0
                while i < len(marked):
                    s = e = int(marked[i])
                    kind = LABELS[labels[s]][2:]
                    while e + 1 < len(toks) and LABELS[labels[e + 1]] == f"I-{kind}":
                        e += 1
                    while i < len(marked) and marked[i] <= e:
                        i += 1
                    if not k <= s + lo < k_end:
                        continue
                    if kind == "name" and "@" in line_of(view, base, starts[s], ends[e]):
                        kind = "email"
                    hit = fit(kind, view, base + starts[s], base + ends[e], self.given, self.family)
                    if hit:
                        a, b = hit
                        out[n].append((kind, a if at is None else at[a], b if at is None else at[b - 1] + 1))
        return [_apart(x) for x in out]


def line_of(view: str, base: int, a: int, b: int) -> str:
    return view[base + a : base + b]


def _apart(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Without repeats and overlaps: the longer of two that overlap stays."""
    kept: list[tuple[str, int, int]] = []
    for s in sorted(set(spans), key=lambda x: (x[1] - x[2], x[1], x[0])):
        if all(s[2] <= k[1] or s[1] >= k[2] for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda x: x[1])


def _filling(names: DataFrame) -> tuple:
    """Name words that fill the slots of the labelled table: at most FILLING_NAMES, drawn by hash."""
    rows = names.select("token", "name_part", "script").where("token is not null and name_part is not null").distinct().orderBy(F.xxhash64("token"), "token", "name_part", "script").limit(FILLING_NAMES).collect()
    return tuple(sorted((r[0], r[1], r[2] or "") for r in rows))


def _read(name: str) -> str:
    return reading_form(name).lower()


def _titles(entities: DataFrame) -> DataFrame:
    """(name_key): titles of entities as names are compared with them."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"name_key": [_read(t) for t in pdf["title"]]})

    return entities.select("title").where("title is not null").distinct().mapInPandas(run, "name_key string").distinct()


def find_pii(docs: DataFrame, names: DataFrame, entities: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """(id_col, pii_kind, char_start, char_end), one row per place; with redact, (id_col, text, n_found) with typed placeholders.

    Null and empty texts have no places (redacted, they stay as they are); every copy of a document counts; repeated rows have the same places each;
    other columns are not read. names is the lexicon: its words are a feature of tokens, all of them. What equals the title of an entity is not the
    name of a private person; titles are taken out of the found names by an anti join, all of them."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((train(_filling(names)), NameTable.of(names, "given"), NameTable.of(names, "family")))
    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where(F.length("_t") > 0)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        finder = Finder(*sent.value)
        for pdf in batches:
            for k in range(0, len(pdf), 1000):
                part = pdf.iloc[k : k + 1000]
                rows = []
                for i, t, spans in zip(part["_id"], part["_t"], finder.find(list(part["_t"])), strict=True):
                    digest = hashlib.md5(t.encode()).hexdigest() if redact and spans else ""
                    # what is no name has a key that no title can have, another in every place
                    rows += [(i, digest, q, a, b, _read(t[a:b]) if q == "name" else f"\n{i} {a}") for q, a, b in spans]
                yield pd.DataFrame(rows, columns=[id_col, "digest", "pii_kind", "char_start", "char_end", "name_key"])

    found = picked.mapInPandas(run, f"`{id_col}` {kind}, digest string, pii_kind string, char_start bigint, char_end bigint, name_key string")
    if entities is not None:
        found = found.join(_titles(entities), "name_key", "left_anti")
    if not redact:
        return found.select(id_col, "pii_kind", "char_start", "char_end")
    spans = found.groupBy(F.col(id_col).alias("_i"), "digest").agg(F.array_sort(F.collect_set(F.struct("char_start", "char_end", "pii_kind"))).alias("spans"))
    j = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).withColumn("_d", F.md5("_t")).join(spans, (F.col("_id") == F.col("_i")) & (F.col("_d") == F.col("digest")), "left")
    part = lambda a, b: F.substring(F.col("_t"), (a + 1).cast("int"), (b - a).cast("int"))
    step = lambda acc, x: F.struct(F.concat(acc["out"], part(acc["at"], x["char_start"]), F.lit("["), F.upper(x["pii_kind"]), F.lit("]")).alias("out"), x["char_end"].alias("at"))
    text = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")), step, lambda acc: F.concat(acc["out"], part(acc["at"], F.length("_t").cast("bigint"))))
    return j.select(F.col("_id").alias(id_col), F.when(F.col("spans").isNull(), F.col("_t")).otherwise(text).alias("text"), F.coalesce(F.size("spans"), F.lit(0)).alias("n_found"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_lexicon"), table(spark, sf_dir, "entity_dict"))


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"), table(spark, sf_dir, "name_lexicon"), table(spark, sf_dir, "entity_dict"), redact=True)


QUERIES = {"p8_found": p8_found, "p8_redacted": p8_redacted}
ORACLE: dict[str, str] = {}
