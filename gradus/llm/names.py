"""Spelling of names: folding, tokens, keys that near spellings share, and the similarity of two tokens. Pure Python."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

#: Letters of other scripts and special letters by the Latin ones they look like or stand for.
LOOK_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "ł": "l", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i",
}
#: Digits by the letters that scanning turns into them.
DIGITS = str.maketrans("0156389", "olsbebg")
#: Words that surround a name without being part of it.
FILLERS = frozenset(
    "a an the of le la les el un une der die das ein eine what is was ist are qu est que es on in to for and notes note basics basic notion idea see also above same as before re topic term "
    "understanding introduction intro overview etc exam definition def concept about chapter lecture".split()
)
_LOOK = str.maketrans({**LOOK_ALIKE, **{k.upper(): v for k, v in LOOK_ALIKE.items() if len(k.upper()) == 1}})
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_ALL_CAMEL = re.compile(r"(?:[A-Z][a-z]+){2,}")
_POSSESSIVE = re.compile(r"['’`´]s\b", re.IGNORECASE)
_WORD = re.compile(r"[a-z0-9]+")


def fold(text: str) -> list[str]:
    """Lower-case tokens of letters: compatibility forms, look-alikes, accents, digits in words, possessives and camel case undone.

    Tokens that only repeat the initials of the others, and numbers, are left out; other fillers stay.
    """
    text = unicodedata.normalize("NFKC", text).translate(_LOOK)
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    text = _POSSESSIVE.sub("", text)
    text = " ".join(_CAMEL.sub(" ", w) if _ALL_CAMEL.fullmatch(w) else w for w in re.split(r"[^\w'’]+|_", text) if w)
    tokens = [t.translate(DIGITS) for t in _WORD.findall(text.lower().replace("'", "").replace("’", "")) if not t.isdigit()]
    for i, t in enumerate(tokens):
        if 2 <= len(t) <= 8:
            rest = [x for j, x in enumerate(tokens) if j != i]
            if len(rest) >= 2 and t in ("".join(x[0] for x in rest), "".join(x[0] for x in rest if x not in FILLERS)):
                return rest
    return tokens


def singular(t: str) -> str:
    for end, new in (("ities", "ity"), ("ies", "y"), ("omata", "omaton"), ("sses", "ss"), ("xes", "x"), ("ches", "ch"), ("isation", "ization")):
        if t.endswith(end) and len(t) > len(end) + 2:
            return t[: -len(end)] + new
    return t[:-1] if t.endswith("s") and not t.endswith("ss") and len(t) > 4 else t


_SCAN = re.compile(r"rn|ri|rl|cl|vv|li|[lij1]|q|c")
_SCANNED = {"rn": "m", "ri": "n", "rl": "n", "cl": "d", "vv": "w", "li": "h", "q": "g", "c": "e", "l": "i", "i": "i", "j": "i", "1": "i"}
_SOUND = re.compile(r"ck|ph|(.)\1+|h|[cwyz]")


def scanned(t: str) -> str:
    """A form in which letters that scanning confuses are the same."""
    return _SCAN.sub(lambda m: _SCANNED[m[0]], t)


def sounded(t: str) -> str:
    """A form in which letters that sound alike are the same, doubled ones single and h silent."""
    once = re.sub(r"(.)\1+", r"\1", _SOUND.sub(lambda m: m[1] if m[1] else {"ck": "k", "ph": "f", "h": "", "c": "k", "w": "v", "y": "i", "z": "s"}[m[0]], t))
    return once


def skeleton(t: str) -> str:
    return re.sub(r"[aeiou]", "", t)


def distance(a: str, b: str, most: int = 3) -> int:
    """Edit distance with swaps of neighbours (optimal string alignment); ``most`` + 1 for anything beyond ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def _dropped(s: str, times: int) -> set[str]:
    out = last = {s}
    for _ in range(times):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        out = out | last
    return out


def _allowed(n: int) -> int:
    return 0 if n <= 3 else 1 if n <= 5 else 2 if n <= 11 else 3


#: Tokens up to this length are matched by what is left after deletions, longer ones by pieces, of which some stay whole.
SHORT = 20


def edit_keys(s: str, edits: int, listed: bool) -> Iterator[str]:
    """Keys such that a typed and a listed text within ``edits`` edits (swaps of neighbours too) share one.

    Deletions: after as many edits as there are, two texts still have a common rest that lacks so many letters of each.
    Pieces, for long texts: an edit spoils two pieces at most (a swap across a border), so one of 2 * edits + 1 stays whole,
    moved by no more than the edits. Lengths between the two ways are listed both ways.
    """
    n = len(s)
    if n <= SHORT or listed and n <= SHORT + edits:
        yield from _dropped(s, edits)
    if n <= SHORT - edits or n <= SHORT and not listed:
        return
    for m in (n,) if listed else range(n - edits, n + edits + 1):
        size = m // (2 * edits + 1)
        for k in range(2 * edits + 1):
            at, end = k * size, m if k == 2 * edits else (k + 1) * size
            for a in (at,) if listed else range(max(0, at - edits), min(n - (end - at), at + edits) + 1):
                yield f"{k}.{m}.{s[a : a + end - at]}"


def _common(t: str, listed: bool) -> Iterator[tuple[str, str]]:
    for s in {t, singular(t)}:
        for x in edit_keys(s, _allowed(len(t)), listed):
            yield "e", x
    for kind, f in (("o", scanned), ("s", sounded)):
        for x in _dropped(f(singular(t)), min(1, _allowed(len(t)))):
            yield kind, x


def entry_keys(v: str) -> Iterable[tuple[str, str]]:
    """Keys of a token of the reference list."""
    yield from _common(v, True)
    for n in range(3, len(v)):
        for x in _dropped(v[:n], int(n >= 5)):
            yield "p", x
    for x in _dropped(skeleton(v), int(len(skeleton(v)) >= 5)):
        yield "k", x


def typed_keys(t: str) -> Iterable[tuple[str, str]]:
    """Keys of a typed token: it shares one with every token of the list that ``similarity`` finds like it."""
    yield from _common(t, False)
    for x in _dropped(t, int(len(t) >= 5)) if len(t) >= 3 else ():
        yield "p", x
    if _clipped(t):
        for x in _dropped(skeleton(t), int(len(skeleton(t)) >= 5)):
            yield "k", x


def _clipped(t: str) -> bool:
    return len(t) >= 3 and len(t) - len(skeleton(t)) <= max(1, len(t) // 6)


def similarity(t: str, v: str) -> float:
    """Of a typed token to one of the list: 1 if equal, 0 if they are different words."""
    if t == v:
        return 1.0
    best = 0.0
    s, w = singular(t), singular(v)
    most = min(_allowed(len(t)), _allowed(len(v)))
    if s == w:
        return 0.99
    d = min(distance(t, v, most), distance(s, w, most))
    if d <= most:
        best = 1 - d / max(len(t), len(v))
    for f in (scanned, sounded):
        d = distance(f(s), f(w), min(1, most))
        if d <= min(1, most):
            best = max(best, 0.95 - d / max(len(t), len(v)))
    if len(t) < len(v):
        if len(t) >= 3 and v.startswith(t):
            best = max(best, 0.9 - 0.02 * (len(v) - len(t)))
        elif len(t) >= 5 and min(distance(t, v[:n], 1) for n in (len(t) - 1, len(t), len(t) + 1)) <= 1:
            best = max(best, 0.7 - 0.02 * (len(v) - len(t)))
        if _clipped(t):
            a, b = skeleton(t), skeleton(v)
            d = distance(a, b, 1)
            if d == 0 or d == 1 and len(b) >= 5:
                best = max(best, 0.85 - 0.15 * d)
    return max(best, 0.0)
