"""Candidate mentions of personal data in a text, with the context each stands in. Pure Python; decides nothing yet."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple


class Mention(NamedTuple):
    start: int
    end: int
    kind: str
    text: str
    shape: str  # what it is made like; of a person: given name, family name and order
    left: str  # pattern before it
    right: str  # pattern after it
    tail: str  # of a code: more words before it; of a person: "seed" or nothing


# Each search pattern begins with a set of characters or of literal words, by which the engine skips what can't match;
# what stands before a match is looked at afterwards.
_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĪİŁŃŇŐŒŘŚŞŠŢŤŪŮŰŹŻŽ"
_LOW = "a-zß-öø-ÿ"
_U = f"[{_UP}]"
_PARTICLE = r"(?:(?:van|von|de|del|der|den|da|di|du|la|al|el|ten|ter|dos) )"
_WORD = r"[^\W\d_]*(?:['’-][^\W\d_]+)*"
_NAME = rf"(?:{_U}\.(?!\w)|(?:al-|el-)?{_U}{_WORD})"
_NAME_RUN = re.compile(rf"{_U}(?:\.|{_WORD})(?:,? {_PARTICLE}*{_NAME})+")
_TOKEN = re.compile(rf"(,?) ?((?:{_PARTICLE})*)({_NAME})")
_LOW_BODY = rf"[{_LOW}]{{2,}}(?:-[{_LOW}]+)?,? [^\n,;|<(:\".@0-9]{{0,24}}[{_LOW}]{{3,}}"
_LOW_SLOT = re.compile(rf"[:;|\"\n.] ?({_LOW_BODY})(?= ?[,;|<(:\"\n.]| wrote| noted| handed|$)")
_LOW_WORD = re.compile(rf"(?:by|for|to|an|por|par|bei|Escribe a|ask|Frau|Mme|Sr\.|Dr\.|Prof\.|As|Contactez|that) ({_LOW_BODY})(?= ?[,;|<(:\"\n.]| (?:at|en|wrote|noted|handed|will|for|about) |$)")
#: Words that begin sentences and are no part of a name.
_STARTERS = frozenset("The A An Our Every Any Most One This In By Since As When For Of And Or Der Die Das Ein Eine La Le El Les Un Une Los Las Use See Set If To Dr Prof Mr Mrs Ms Frau Herr Mme Sr Sra Don Mlle Dr. Prof. Mr. Mrs. Ms. Sr. Sra.".split())
_AT = re.compile(r"@|\((?:at|AT)\)|\[(?:at|AT)\]|&#64;|&#x40;| (?:AT (?=[\w-]+ DOT )|at (?=[\w-]+ dot ))")
_LOCAL = re.compile(r"[\w.+%'-]*[\w+%-](?= ?$)")
_HOST = re.compile(r" ?((?:[\w-]+(?:\.| ?\[(?:dot|DOT)\] ?| ?\((?:dot|DOT)\) ?| DOT | dot ))+[^\W\d_]{2,})")
_DIGITS = re.compile(r"[0-9０-９][0-9０-９ \u00a0()./‑–-]{4,40}[0-9０-９]")
_JOIN = re.compile(r"[\w-]*[^\W\d_][\w-]*(?<!dot)(?<!DOT)| ")
_GROUPS = re.compile(r"\d\d(?: \d\d){2}$")
_EXTENSION = re.compile(r"(?:,? ext\.? ?| ?x ?)\d{1,5}(?!\w)")
_DIGIT_WORDS = tuple(tuple(x.split()) for x in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro deux trois quatre cinq sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve"))
_SPOKEN = tuple(re.compile(rf"(?:(?:{'|'.join(w)})(?:,? |-)){{6,}}(?:{'|'.join(w)})(?!\w)") for w in _DIGIT_WORDS)

_TOWN = rf"{_U}[^\W\d_]+(?:(?:[-' ](?:sur|am|an|de|del|la|der|upon))*[-' ]{_U}[^\W\d_]+)*"
_TOWN1 = rf"{_U}[^\W\d_]+(?:-[^\W\d_]+)*"
_POST = r"(?:[A-Z]{1,2}\d{1,3}[A-Z]? \d[A-Z]{2}|(?:[A-Z]{2} )?\d{5})"
_UNIT = r"(?:(?:, | )(?i:Flat|Apt\.?|Unit|Suite|Room|Ste\.?) ?\w{1,4}|(?:, | )#\w{1,4}|, \d{1,2}\.[ºª] ?\w(?!\w)|, (?i:bajo)|, entlo\.?)"
_EN = rf"[0-9]{{1,5}}(?:[A-Z]|-\d{{1,5}})?,? (?:(?:(?i:Old|New|Upper|Lower|Great|Little|North|South|East|West)|[NSEW]\.) )?{_TOWN1}(?: {_TOWN1})? (?i:Street|Close|Lane|Road|Court|Terrace|Drive|Avenue|Hill|Row|Way|Place|Square|Crescent|Gardens|Grove|Mews|Park|(?:St|Rd|Ave|Ln|Dr|Ct|Blvd|Pl|Sq|Ter)\b\.?)"
_FR = rf"[0-9]{{1,5}}(?: (?:bis|ter|quater))?,? (?i:rue|avenue|boulevard|impasse|chemin|quai|allée|place|cours|passage) (?:(?i:du|de la|des|de l['’]|de) ?)?{_TOWN1}"
_DE = rf"{_U}[^\W\d_]++\.? [0-9]{{1,5}}(?![0-9]) ?(?:[a-z](?![\w]))?"
_DE_ENDS = ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ring", "ufer", "damm", "steig", "wall", "markt", "graben", "chaussee", "stieg", "pfad")
_DE2 = rf"(?:Am|An der|An den|Auf der|Auf dem|Im|In der|In den|Zum|Zur|Unter den|Kleine|Große|Alte|Neue|Obere|Untere|Hintere|AM|IM|KLEINE|ALTE|NEUE) {_U}[^\W\d_]+ \d{{1,5}} ?(?:[a-zA-Z](?![\w]))?"
_ES = rf"(?:Calle|CALLE|C/|Plaza|PLAZA|Avenida|AVENIDA|Avda\.?|Paseo|Camino|Ronda) (?:(?i:del|de la|de los|de las|de) )?{_TOWN1},? (?:[nN]\.º ?)?\d{{1,5}}"
_STREETS = tuple(re.compile(rf"{x}(?![^\W\d_])(?:{_UNIT})*") for x in (_EN, _FR, _DE, _DE2, _ES))
_AFTER = re.compile(rf"(?:,\s|\n| ){_POST},? {_TOWN}|(?:,\s|\n| ){_TOWN1}(?: {_TOWN1})?,? {_POST}(?!\w)|(?:,\s|\n| ){_POST}(?!\w)")
_UNITS = re.compile(_UNIT)
_FRENCH = frozenset("rue avenue boulevard impasse chemin quai allée place cours passage bis ter quater".split())
_MAYBE = re.compile(rf"(?:,\s|\n| )({_TOWN1}(?: {_TOWN1})?)(?![^\W\d_])")
_HAS_DIGIT, _AFTER_DIGIT = re.compile(r"\d"), re.compile(r"\D*$")
_RIGHT = re.compile(r"[^\S\n]*(\n|[^\w\s]+(?=\s|\w|$)|[^\W\d_]+)")


def _before(text: str, at: int, words: int = 1) -> str:
    """The last words before, in lower case, with their punctuation; a line's start counts as a word, a number ends them."""
    out: list[str] = []
    for w in reversed(text[max(0, at - 48) : at].replace("\n", " ^ ").split()):
        if w == "^" or w[-1].isdigit():
            out.append(w if w == "^" else "")
            break
        if _HAS_DIGIT.search(w):
            w = _AFTER_DIGIT.search(w)[0]
        out.append("." if words == 1 and w[-1] in ".?!" and len(w) > 6 else w.lower()[-18:])
        if len(out) == words:
            break
    if len(out) < words and at < 48 and out[-1:] != ["^"]:
        out.append("^")
    return " ".join(reversed(out))


def _after(text: str, at: int) -> str:
    m = _RIGHT.match(text, at, at + 40)
    if not m or m[1] == "\n":
        return "$"
    return "Aa" if m[1][0].isupper() else m[1][:12]


def _shape(s: str) -> str:
    return re.sub(r"[^\W\d_]", "A", re.sub(r"\d", "0", re.sub(r"ext\.?|x", "~", s.replace(" ", " "))))


def _person(text: str, start: int, end: int, given: str, family: str, style: str) -> Mention:
    key = given.lower()
    return Mention(start, end, "person", text[start:end], f"{key}|{family.lower()}|{style}", _before(text, start), _after(text, end), "")


def persons(text: str) -> Iterator[Mention]:
    for m in _NAME_RUN.finditer(text):
        if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "@./&#_"):
            continue
        run, at, tokens = m[0], m.start(), []
        p = 0
        while p < len(run) and (t := _TOKEN.match(run, p)):
            tokens.append((t[1], t[2], t[3], at + t.start(3), at + t.end(3), at + (t.start(2) if t[2] else t.start(3))))
            p = t.end()
        for i, (_, part, first, s, _, _) in enumerate(tokens):
            if (part and i) or first in _STARTERS:
                continue
            for j in range(i + 1, min(i + 4, len(tokens))):
                comma, _, last, _, e, _ = tokens[j]
                if comma or (tokens[j - 1][1] and j - 1 > i):
                    break
                if len(last) > 2:
                    yield _person(text, s, e, first, last, "f")
        for i in range(len(tokens) - 1):
            comma, part, given, _, e, _ = tokens[i + 1]
            family = tokens[i][2]
            if comma and not part and len(family) > 2 and family not in _STARTERS:
                first = tokens[i][5] if tokens[i][1] else tokens[i][3]
                if i + 2 < len(tokens) and not tokens[i + 2][0] and len(tokens[i + 2][2]) == 2:
                    yield _person(text, first, tokens[i + 2][4], given, family, "r")
                yield _person(text, first, e, given, family, "r")
    for pattern in (_LOW_SLOT, _LOW_WORD):
        for m in pattern.finditer(text):
            words = m[1].split(" ")
            if len(words) > 5:
                continue
            if words[0].endswith(","):
                yield _person(text, m.start(1), m.end(1), words[1], words[0][:-1], "r")
            elif not m[1].count(",") and words[-1][0].islower():  # "ask Harbquist" is no name in small letters
                yield _person(text, m.start(1), m.end(1), words[0], words[-1], "f")


def emails(text: str) -> Iterator[Mention]:
    for m in _AT.finditer(text):
        host = _HOST.match(text, m.end())
        local = _LOCAL.search(text, max(0, m.start() - 256), m.start())
        if host and local:
            gap = local.end() != m.start(), host[0].startswith(" ")
            if m[0] == "@" and gap[0] != gap[1]:
                continue
            s = local.start()
            while text[s] in ".'-":
                s += 1
            dot = "." if "[" not in host[0] and "(" not in host[0] and " " not in host[0].strip() else _JOIN.sub("", host[0].lower())
            yield Mention(s, host.end(), "email", text[s : host.end()], f"{m[0].strip().lower()}|{dot}", _before(text, s), _after(text, host.end()), "")


def _phone(text: str, s: int, e: int) -> Mention | None:
    """The number from s to e, with a country code's sign and an extension."""
    if text[s - 1 : s] in ("+", "(") and s:
        s -= 1
    if text[s - 1 : s] == "+" and s:
        s -= 1
    if text[s] == "(" and ")" not in text[s:e]:
        s += 1
    if s and (text[s - 1].isalnum() or text[s - 1] in ".,-/_=") or text[e : e + 1].isalpha() and not _EXTENSION.match(text, e):
        return None
    if text[e : e + 1] in (".", ",", "-", "/") and text[e + 1 : e + 2].isdigit():
        return None
    digits = sum(map(str.isdigit, text[s:e]))
    if not 8 <= digits <= 15 or "  " in text[s:e]:
        return None
    if more := _EXTENSION.match(text, e):
        e = more.end()
    return Mention(s, e, "phone", text[s:e], _shape(text[s:e]), _before(text, s), _after(text, e), "")


def _code(text: str, s: int, e: int) -> Mention | None:
    """The number from s to e, with up to three capitals before and one after it."""
    cut = s
    if cut > 1 and text[cut - 2].isupper() and (text[cut - 1] == "-" or text[cut - 1] == " " and _GROUPS.match(text, s, e) and not text[cut - 4 : cut - 3].isalpha()):
        cut -= 1
    while cut and s - cut < 4 and "A" <= text[cut - 1] <= "Z":
        cut -= 1
    if text[cut : cut + 1] in (" ", "-") or cut and (text[cut - 1].isalnum() or text[cut - 1] in "-./_"):
        cut = s
    if cut and (text[cut - 1].isalnum() or text[cut - 1] in "-./_"):
        return None
    end = e
    if text[end : end + 1] in ("-", " ") and text[end + 1 : end + 2].isupper() and not text[end + 2 : end + 3].isalnum():
        end += 2
    elif text[end : end + 1].isalnum() or text[end : end + 1] in ("-", "/") and text[end + 1 : end + 2].isalnum():
        return None
    got = text[cut:end]
    digits = sum(map(str.isdigit, got))
    if digits > 12 or digits < (6 if cut < s else 7) or any(c in got for c in "()./"):
        return None
    words = _before(text, cut, 4).split(" ")
    return Mention(cut, end, "id_number", got, _shape(got), " ".join(words[-2:]), _after(text, end), " ".join(words[:-1])[-24:])


def numbers(text: str) -> Iterator[Mention]:
    """Numbers that may be phone numbers, and codes that may be identity numbers."""
    for m in _DIGITS.finditer(text):
        s, e = m.span()
        got = m[0]
        if len(got) == 10 and got[4] == got[7] == "-" and got[:4].isdigit():
            continue  # a date
        if x := _phone(text, s, e):
            yield x
        if x := _code(text, s, e):
            yield x
    for words, spoken in zip(_DIGIT_WORDS, _SPOKEN, strict=True):
        if sum(w in text for w in words) >= 3 and sum(map(text.count, words)) >= 7:
            for m in spoken.finditer(text):
                yield Mention(m.start(), m.end(), "phone", m[0], f"spoken {words[0]}", _before(text, m.start()), _after(text, m.end()), "")


def _context(text: str, s: int, e: int) -> str:
    return f"{_before(text, s)}|{_after(text, e)}"


def _street_kind(street: str) -> str:
    """What makes a street one: its word for a street, or the ending of a name that has none."""
    words = [w for w in re.split(r"[\s,]+", _UNITS.sub("", street).lower()) if w and not any(c.isdigit() for c in w) and len(w) > 1]
    if not words:
        return ""
    if street[0].isdigit():
        return words[0] if words[0] in _FRENCH else words[-1].rstrip(".")
    return next((x for x in _DE_ENDS if words[0].endswith(x)), words[0].rstrip("."))


def addresses(text: str) -> Iterator[Mention]:
    found = sorted((m.start(), -m.end(), m.end()) for p in _STREETS for m in p.finditer(text) if (p is not _STREETS[2] or m[0].split(" ")[0].lower().endswith(_DE_ENDS)) and (not m.start() or not (text[m.start() - 1].isalnum() or text[m.start() - 1] in "-_")))
    seen = -1
    for s, _, e in found:
        if s < seen:
            continue
        kind = _street_kind(text[s:e])
        if after := _AFTER.match(text, e):
            town = re.sub(_POST, "", after[0]).strip(" ,\n")
            e = after.end()
            yield Mention(s, e, "address", text[s:e], "full", town, _context(text, s, e), kind)
        else:
            yield Mention(s, e, "address", text[s:e], "bare", "", _context(text, s, e), kind)
            if maybe := _MAYBE.match(text, e):
                one = maybe[1].split(" ")[0]
                for town in {one, maybe[1]}:
                    end = maybe.start(1) + len(town)
                    yield Mention(s, end, "address", text[s:end], "open", town, _context(text, s, e), kind)
        seen = e


def _plain(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if c.isalnum())


def mentions(text: str) -> Iterator[Mention]:
    """All candidates. The tail of a person tells a seed: the family name stands in an email address of the text."""
    locals_ = []
    for m in emails(text):
        yield m
        locals_.append(_plain(_AT.split(m.text)[0]))
    for m in persons(text):
        if locals_:
            family = _plain(re.split(r"[ -]", m.text.split(",")[0])[-1])
            if len(family) >= 5 and any(family in x for x in locals_):
                m = m._replace(tail="seed")
        yield m
    yield from numbers(text)
    yield from addresses(text)
