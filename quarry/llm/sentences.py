"""Sentence units of documents in many languages and scripts.

Cascading tables of ordered (break or no break, before, after) rules, as in the public SRX
format: at each candidate position the first rule whose two expressions match decides; the
table of the document's language comes before those of its scripts, those before the common one.
The language is the one whose function words the text holds most of, else that of the tag; only a
text that shows none takes the tables of all languages of its script.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    breaks: bool
    before: str  # matched against the text that ends at the position
    after: str  # matched at the position


_CLOSE = "\"'”’»)\\]}」』）】〉》›“‘*_`"
_DIGIT = r"\s*[\"'(\[«„“]*[#§]?\d"
# Abbreviations that take a number or a name after them and never end a sentence before a digit or a small letter.
_WITH_NUMBER = {
    "en": "No Nos Fig Figs Sec Secs Ch Chap Eq Eqs Art Vol Vols pp p ed approx est ca Ver ver Ref Refs Tab App Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec max min",
    "de": "Nr Abs Abb Art Bd Kap S Tab Ziff Anm ca Jh Aufl Hrsg max min Std Min Sek Mio Mrd Tel",
    "fr": "art fig chap env p pp vol no n° éd av apr réf tab al",
    "es": "pág págs art fig cap vol núm n.º aprox ed tel",
    "ru": "рис табл стр гл ст п пп см См илл Рис Табл ср тыс млн млрд руб ок",
    "it": "n nn fig figg art artt pag pagg cap vol tab par sez ca sec tel ed",
    "pt": "n nº fig figs art arts pág págs cap vol tab núm tel aprox ed séc",
    "nl": "nr nrs fig art blz p pag hfst deel tab ca tel jrg afb",
    "pl": "nr rys tab str s art ust pkt rozdz tel godz ok t poz zał",
    "tr": "s no sf ss bkz Bkz şek Şek tab böl cilt tel yy",
}
# Abbreviations after which the sentence always goes on.
_NEVER = {
    "en": r"e\.\s?g i\.\s?e vs cf viz Mr Mrs Ms Dr Prof Rev Gen Sen Rep Gov Capt Sgt Col Lt St Mt Messrs Hon resp",
    "de": r"z\.\s?B d\.\s?h u\.\s?a i\.\s?d\.\s?R o\.\s?ä s\.\s?o s\.\s?u v\.\s?a z\.\s?T m\.\s?E u\.\s?U i\.\s?A bzw vgl evtl ggf inkl exkl sog Dr Prof Hr Fr Frl St gem lt bspw insb allg z d h i",
    "fr": r"p\.\s?ex c\.-à-d c\.\s?à\.?\s?d M MM Mme Mlle Dr cf St Ste p\.\s?éx p",
    "es": r"p\.\s?ej p\.\s?e Sr Sra Sres Srta Dr Dra D Dña Ud Uds EE Vd",
    "ru": r"т\.\s?е т\.\s?к т\.\s?н т\.\s?о напр г-н г-жа т",
    "it": r"sig sigg dott dr prof avv ing arch geom on rag spett cfr es p\.\s?es ad\s+es v",
    "pt": r"Sr Sra Srs Sras Dr Dra Prof Profa Eng Exmo Exma p\.\s?ex cf V Av",
    "nl": r"dhr mevr mw dr drs ir ing prof mr bijv bv d\.\s?w\.\s?z t\.\s?a\.\s?v m\.\s?b\.\s?t o\.\s?a z\.\s?g vgl incl excl resp St",
    "pl": r"np dr prof mgr inż hab tzn tzw m\.\s?in ul al pl św im por zob wg ks gen płk",
    "tr": r"Dr Prof Doç Av Sn Öğr örn Örn vb\.\s?gibi krş çev haz",
}
# Abbreviations that may stand at the end of a sentence; a capital after them begins the next.
_MAYBE = {
    "en": r"etc Inc Ltd Co Corp Jr Sr al a\.m p\.m U\.S U\.K E\.U dept Bros",
    "de": r"usw etc u\.\s?ä u\.\s?s\.\s?w GmbH Co n\.\s?Chr v\.\s?Chr",
    "fr": r"etc Cie Sté J\.-C",
    "es": r"etc Cía S\.\s?A a\.\s?C d\.\s?C",
    "ru": r"т\.\s?д т\.\s?п др пр г гг в вв",
    "it": r"ecc S\.\s?p\.\s?A S\.\s?r\.\s?l a\.\s?C d\.\s?C",
    "pt": r"etc Ltda Cia S\.\s?A a\.\s?C d\.\s?C",
    "nl": r"enz etc e\.\s?d N\.\s?V B\.\s?V v\.\s?Chr n\.\s?Chr",
    "pl": r"itd itp r w n\.\s?e p\.\s?n\.\s?e",
    "tr": r"vb vs vd A\.\s?Ş Ltd Şti",
}
# Frequent words that tell a language from the others of its script.
_FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as was are this be by on not or have from at which",
    "de": "der die und das ist nicht ein eine zu den mit von für auf dem des wird sich auch bei nach im werden",
    "fr": "le la les et des est une pour dans que qui du pas sur au avec ce sont par plus nous vous ne",
    "es": "el los las y una que en por con para es del se no al lo como más su está son pero sin",
    "it": "il di che è per un una non sono del della con gli si nel alla dei anche come le questo più",
    "pt": "o os as um uma que não em para com do da dos das é por se no na mais ao está são como",
    "nl": "de het een van en is dat niet op te voor met zijn aan er ook bij naar wordt worden deze",
    "pl": "i w nie na się z jest do to że dla przez są od po jak oraz przy ale który tego",
    "tr": "ve bir bu için ile de da olarak olan daha çok gibi değil var her ne kadar sonra en",
}
_MONTHS = (
    "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jan|Feb|Mär|Apr|Jun|Jul|Aug|Sep|Okt|Nov|Dez|Jahrhundert|Kapitel|Quartal|Auflage|Platz|Tag|Woche|Monat|Jahr|Stock|Etage"
)
_START_CODE = r"\s+[a-zа-я][\w]*(?:[A-Z(]|_\w)"  # an identifier in running text can begin a sentence
_LOWER = r"[\"'(\[«„“*_`]*\s*(?:[a-zà-öø-ÿœßąćęłńóśźżčďěňřšťůžа-яё])"


def _words(table: dict[str, str], lang: str) -> str:
    return "(?:" + "|".join(sorted(table[lang].split(), key=len, reverse=True)) + ")"


def _abbreviations(lang: str) -> list[Rule]:
    edge = r"(?<![^\W\d_])"
    return [
        Rule(False, edge + _words(_NEVER, lang) + r"\.", r"\s+\S|[,;:)]"),
        Rule(False, edge + _words(_WITH_NUMBER, lang) + r"\.", _DIGIT + r"|\s+[IVXLC]+\b|\s+" + _LOWER),
        Rule(False, edge + _words(_MAYBE, lang) + r"\.", r"\s+" + _LOWER + r"|\s*[,;:]"),
    ]


_LATIN = tuple(_FUNCTION_WORDS)
TABLES: dict[str, list[Rule]] = {
    "en": _abbreviations("en"),
    "de": [
        # an ordinal in a date or before a counted noun
        Rule(False, r"(?<![\d.,])\d{1,2}\.", rf"\s+(?:{_MONTHS})\b"),
        Rule(False, r"\b(?:[Aa]m|[Vv]om|[Zz]um|[Bb]is|[Dd]er|[Dd]ie|[Dd]as|[Dd]en|[Dd]em|[Dd]es|[Ii]m|[Uu]nd|[Aa]b|[Ss]eit)\s+\d{1,4}\.", r"\s+[A-ZÄÖÜ]"),
        *_abbreviations("de"),
    ],
    "fr": _abbreviations("fr"),
    "es": _abbreviations("es"),
    "ru": _abbreviations("ru"),
    "it": _abbreviations("it"),
    "pt": _abbreviations("pt"),
    "nl": _abbreviations("nl"),
    "pl": _abbreviations("pl"),
    "tr": _abbreviations("tr"),
    # scripts
    "latin": [
        # initials of names, dotted capitals
        Rule(False, r"(?<![^\W_])[A-ZÀ-Ý]\.", r"\s*[A-ZÀ-Ý]\.|\s+[A-ZÀ-Ý][a-zà-ÿ]+"),
    ],
    "cyrillic": [Rule(False, r"(?<![^\W_])[А-ЯЁ]\.", r"\s*[А-ЯЁ]\.|\s+[А-ЯЁ][а-яё]+")],
    "cjk": [
        # behind an ideographic mark: a closed quotation inside a running sentence goes on, otherwise the sentence ends
        Rule(False, r"[。！？｡．!?…]+[”’」』）】〉》)\]]+", r"[^\s“‘「『（【〈《(\[]"),
        Rule(False, r"…+", r"[，、,]"),
        Rule(True, r"[。！？｡][”’」』）】〉》)\]\"']*", r""),
    ],
    "thai": [
        # a space ends a sentence unless it touches a digit or a Latin letter
        Rule(False, r"[0-9A-Za-z๐-๙]", r"\s"),
        Rule(False, r"[,;:(\[{“\"'-]", r"\s"),
        Rule(False, r"", r"\s+[0-9A-Za-z๐-๙,;:)\]}ฯๆ-]"),
        Rule(True, r"[฀-๿]", r"\s"),
        Rule(True, r"[^\s]", r"\s+[฀-๿]"),
    ],
    "indic": [Rule(True, r"[।॥][\"'”’)\]]*", r"")],
    "arabic": [Rule(True, r"[؟۔][\"'”’»)\]]*", r"\s"), Rule(False, r"\.", r"\s+[a-z]")],
    # for every text, last
    "common": [
        Rule(False, r"", r"\S"),  # a mark inside a word, number, address or before a closing sign
        Rule(False, r"(?:\.{2,}|…)[" + _CLOSE + r"]*", r"\s+" + _LOWER),
        Rule(True, r"[^\s.][.!?]+[" + _CLOSE + r"]*", _START_CODE),
        Rule(False, r"", r"\s+" + _LOWER),  # a small letter goes on, behind a quotation above all
        Rule(False, r"", r"\s+[,;:–—]"),
        Rule(True, r"", r"\s"),
    ],
}

_SCRIPTS = (
    ("thai", re.compile(r"[฀-๿]")), ("cjk", re.compile(r"[぀-ヿ㐀-䶿一-鿿！-｠]")), ("indic", re.compile(r"[ऀ-෿]")),
    ("arabic", re.compile(r"[֐-ۿݐ-ݿ]")), ("cyrillic", re.compile(r"[Ѐ-ӿ]")),
)
_MARK = re.compile(r"[.!?…。！？｡．।॥؟۔]+[" + _CLOSE + r"]*(?:\s+[»”\"](?=\s|$))?")
_LAST_MARK = re.compile(r"[.!?…](?=\s|$)")
_SPACE = re.compile(r"\s+")


# A compiled rule: whether it breaks, what must end at the position (read backwards, of any length; None: anything), what must begin there.
Compiled = tuple[bool, "regex.Pattern | None", re.Pattern]


class Cascade(NamedTuple):
    """The rules of a text in the order in which they are tried, once for all marks and once for those that end in no full stop."""

    rules: list[Compiled]
    no_stop: list[Compiled]
    inside: bool  # whether a rule can break where no space follows


def _compiled(rules: list[Rule]) -> list[Compiled]:
    return [(r.breaks, regex.compile(f"(?r)(?:{r.before})") if r.before else None, re.compile(r.after)) for r in rules]


@lru_cache(maxsize=512)
def cascade(lang: str, scripts: tuple[str, ...]) -> Cascade:
    """The tables of a language ("" if it is unknown) and of the scripts of a text, then the common one."""
    order = [s for s in scripts if s in TABLES and s != "thai"]
    if "cyrillic" in scripts:
        order.append("ru")
    if lang in TABLES and lang not in ("common", "thai"):
        order.insert(0, lang)
    else:
        order += _LATIN
    rules = [r for name in dict.fromkeys([*order, "latin", "common"]) for r in TABLES[name]]
    no_stop = [r for r in rules if not r.before.endswith("\\.")]
    return Cascade(_compiled(rules), _compiled(no_stop), any(r.breaks and not r.after.startswith("\\s") for r in rules))


@lru_cache(maxsize=1)
def _thai() -> list[Compiled]:
    return _compiled(TABLES["thai"])


_WORD = re.compile(r"[^\W\d_]+")
_SPEAKS: dict[str, list[str]] = {}
for _lang, _list in _FUNCTION_WORDS.items():
    for _w in _list.split():
        _SPEAKS.setdefault(_w, []).append(_lang)


def _votes(text: str) -> dict[str, int]:
    score: dict[str, int] = {}
    get = _SPEAKS.get
    for word in _WORD.findall(text.lower()):
        for x in get(word, ()):
            score[x] = score.get(x, 0) + 1
    return score


def language(text: str, tag: str = "") -> str:
    """The Latin-script language whose function words ``text`` uses most, if it uses three at least and more than any other; else ``tag``, without one whatever leads."""
    score = _votes(text)
    best = max(score.values(), default=0)
    first = [x for x, n in score.items() if n == best]
    if len(first) == 1 and (best >= 3 or not tag):
        return first[0]
    return tag


# Last words of abbreviations with the languages that have them: a sentence in another language than its document's brings its own.
_ABBREVIATED: dict[str, set[str]] = {}
for _table in (_WITH_NUMBER, _NEVER, _MAYBE):
    for _lang, _list in _table.items():
        for _w in _list.split():
            _ABBREVIATED.setdefault(re.split(r"\\s[?+]|\\.", _w)[-1], set()).add(_lang)


def _foreign(body: str, begin: int, at: int, stop: int, own: str, scripts: tuple[str, ...]) -> bool:
    """Whether a full stop at ``at`` belongs to an abbreviation of the language that the sentence around it is in, another than ``own``."""
    k = at - 1
    while k > begin and body[k - 1].isalpha():
        k -= 1
    word = body[k : at - 1]
    langs = _ABBREVIATED.get(word)
    if not langs or langs == {own}:
        return False
    nxt = _LAST_MARK.search(body, at + 1, stop)
    score = _votes(body[begin : nxt.end() if nxt else stop].replace(word + ".", " "))
    best = max(score.values(), default=0)
    here = [x for x, n in score.items() if n == best and x != own]
    return any(x in langs and score.get(own, 0) < best and not _decide(cascade(x, scripts).rules, body, at) for x in here)


def _decide(rules: list[Compiled], text: str, at: int) -> bool:
    for breaks, before, after in rules:
        if after.match(text, at) and (before is None or before.match(text, 0, at)):
            return breaks
    return False


_ATX = re.compile(r" {0,3}#{1,6}(?:[ \t ]+|$)")
_FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})")
_ITEM = re.compile(r"[ \t]*(?:[-*+•‣◦·]|\d{1,9}[.)]|[a-z][.)])[ \t ]+(?:\[[ xX]\][ \t]+)?")
_NUMBER = re.compile(r"[ \t]*(\d{1,9}|[a-z])[.)]")
_QUOTE = re.compile(r"[ \t]{0,3}>[ \t]?")
_RULE = re.compile(r"[ \t]*(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|={3,})[ \t]*$")
_LINE = re.compile(r"([^\r\n]*)(\r\n|\n|\r|$)")


def blocks(text: str) -> Iterator[tuple[int, str, bool]]:
    """(offset, text, is heading) of each paragraph, list item and heading; marks of continuation lines are blanked so that offsets hold."""
    start, parts, fence = 0, [], ""
    size, ordered = 0, False

    def flush():
        nonlocal parts
        if parts:
            body = "".join(parts)
            parts = []
            if body.strip():
                return [(start, body, False)]
        parts = []
        return []

    pos, n = 0, len(text)
    while pos < n:
        m = _LINE.match(text, pos)
        line, at = m[1], pos
        pos = m.end()
        f = _FENCE.match(line)
        if fence:
            if f and f[1][0] == fence[0] and len(f[1]) >= len(fence) and not line[f.end() :].strip():
                fence = ""
            continue
        if f and "`" not in line[f.end() :]:
            yield from flush()
            fence = f[1]
            continue
        if not line.strip():
            yield from flush()
            continue
        if _ATX.match(line):
            yield from flush()
            yield at, line, True
            continue
        if _RULE.match(line):
            if parts and size == 1 and line.lstrip()[0] in "=-":
                body = "".join(parts)
                parts = []
                yield start, body, True
            else:
                yield from flush()
            continue
        lead = 0
        q = _QUOTE.match(line)
        while q:
            lead += q.end()
            q = _QUOTE.match(line[lead:])
        item = _ITEM.match(line, lead)
        number = _NUMBER.match(line, lead) if item else None
        if number and parts and not ordered and number[1] not in ("1", "a"):
            item = None  # a wrapped number: only a list's first item can interrupt a paragraph
        if lead and not parts or item and item.end() < len(line):
            ordered = bool(number)
            yield from flush()
            lead = item.end() if item else lead
        if not parts:
            start, size = at, 0
            ordered = ordered and item is not None
        parts.append(" " * lead + line[lead:] + text[at + len(line) : pos].replace("\r", " ").replace("\n", " "))
        size += 1
    yield from flush()


def ends(text: str, lang: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence of ``text`` in code points, trailing white space left out. An empty text has none."""
    tag = (lang or "").strip().lower().replace("_", "-").split("-")[0]
    tag = language(text, tag if tag in TABLES else "")
    out: list[tuple[int, int]] = []
    for offset, body, heading in blocks(text):
        stop = len(body.rstrip())
        begin = len(body) - len(body.lstrip())
        if heading or stop <= begin:
            if stop > begin:
                out.append((offset + begin, offset + stop))
            continue
        scripts = () if body.isascii() else tuple(name for name, pattern in _SCRIPTS if pattern.search(body))
        rules, no_stop, inside = cascade(tag, scripts)
        cuts = []
        for m in _MARK.finditer(body, begin, stop):
            at = m.end()
            if not inside and at < stop and not body[at].isspace() and body[at - 1] in ".!?…":
                continue
            # closing signs that open the next quotation instead belong to what follows
            while at > m.start() + 1 and at < stop and body[at - 1] in "\"'*_`“‘" and not body[at].isspace() and body[at - 2].isspace():
                at -= 1
            if at >= stop:
                break
            stopped = body[at - 1] == "."
            if _decide(rules if stopped else no_stop, body, at) and not (stopped and tag and _foreign(body, cuts[-1] if cuts else begin, at, stop, tag, scripts)):
                cuts.append(at)
        if "thai" in scripts:
            seen = set(cuts)
            for m in _SPACE.finditer(body, begin, stop):
                if m.start() not in seen and _decide(_thai(), body, m.start()):
                    cuts.append(m.start())
            cuts.sort()
        last = begin
        for cut in [*cuts, stop]:
            piece = body[last:cut]
            first = last + len(piece) - len(piece.lstrip())
            end = last + len(piece.rstrip())
            if end > first:
                out.append((offset + first, offset + end))
            last = cut
    return out


def sentences(documents: DataFrame, with_text: bool = True) -> DataFrame:
    """(doc_id, position, start_char, end_char[, sentence]) of every sentence of every document.

    Offsets count code points of ``text``. Null ids or texts give nothing; a repeated row counts once.
    """
    fields = "doc_id long, position int, start_char int, end_char int" + (", sentence string" if with_text else "")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, places, texts = [], [], []
            for doc, text, lang in zip(pdf["doc_id"].to_list(), pdf["text"], pdf["lang"], strict=True):
                units = ends(text, lang)
                ids += [doc] * len(units)
                places += [(k, a, b) for k, (a, b) in enumerate(units)]
                if with_text:
                    texts += [text[a:b] for a, b in units]
            at = np.array(places, np.int32).reshape(-1, 3)
            out = {"doc_id": np.array(ids, np.int64), "position": at[:, 0], "start_char": at[:, 1], "end_char": at[:, 2]}
            yield pd.DataFrame(out | {"sentence": texts} if with_text else out)

    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    return rows.mapInPandas(split, fields).dropDuplicates(["doc_id", "start_char", "end_char"])
