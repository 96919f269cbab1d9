"""One consistent form for text that is drawn alike.

The form is NFC text in which every character drawn like an ordinary
Vietnamese letter, digit, mark or blank is that ordinary character, and
characters that are not drawn at all are gone.  Letters of another script
and phonetic letters are replaced only inside a word that also has Latin
letters; everything else (words in another script, single Greek symbols,
superscripts, en dashes, curly quotes, runs of blanks) stays as it is.

The tables are built by rule from ``unicodedata``; only the short lists of
look-alikes are written out.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import regex

# Look-alikes that are replaced wherever they stand.
ALWAYS = {"Ð": "Đ", "Ɖ": "Đ", "ð": "đ", "‐": "-", "‑": "-"}
# Letters replaced only inside a word that has Latin letters.
MIXED_FROM = "АВЕКМНОРСТУХЅІЈԚԜаеорсухѕіјһԁԛԝҺӀΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹοαϲıɑɡɩ"
MIXED_TO = "ABEKMHOPCTYXSIJQWaeopcyxsijhdqwhIABEZHIKMNOPTYXCoaciagi"
# Invisible characters outside the category Cf, and control characters that are kept.
INVISIBLE_EXTRA = "͏ᅟᅠ឴឵ㅤﾠ"
KEPT_CONTROLS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85"

WORD_RUN = r"[\p{L}\p{M}\p{N}]+"
LATIN = r"[A-Za-zÀ-ɏḀ-ỿ]"


def _is_invisible(ch: str) -> bool:
    code = ord(ch)
    return (
        unicodedata.category(ch) == "Cf"
        or ch in INVISIBLE_EXTRA
        or 0xFE00 <= code <= 0xFE0F
        or 0xE0100 <= code <= 0xE01EF
        or (unicodedata.category(ch) == "Cc" and ch not in KEPT_CONTROLS)
    )


@lru_cache(maxsize=1)
def single_map() -> dict[str, str]:
    """Characters replaced wherever they stand, with their replacement ('' = removed)."""
    out = dict(ALWAYS)
    for code in [*range(0x80, 0x10000), *range(0xE0000, 0xE0200), *range(0, 0x20), 0x7F]:
        if 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        tag = unicodedata.decomposition(ch).partition(">")[0]
        if _is_invisible(ch):
            out[ch] = ""
        elif ch != " " and unicodedata.category(ch) == "Zs":
            out[ch] = " "
        elif tag == "<wide" or 0x2160 <= code <= 0x217F or 0xFB00 <= code <= 0xFB06:
            plain = unicodedata.normalize("NFKC", ch)
            if plain.isascii():
                out[ch] = plain
    return out


@lru_cache(maxsize=1)
def mixed_map() -> dict[str, str]:
    """Look-alike letters, with or without marks, and the Latin letter each is drawn like."""
    base = dict(zip(MIXED_FROM, MIXED_TO, strict=True))
    out = dict(base)
    for code in [*range(0x370, 0x530), *range(0x1F00, 0x2000)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0] in base:
            latin = unicodedata.normalize("NFC", base[parts[0]] + parts[1:])
            if len(latin) == 1:
                out[chr(code)] = latin
    return out


@lru_cache(maxsize=1)
def unsafe_table() -> np.ndarray:
    """For each BMP code point: may a text holding it differ from its form?  (True is always allowed.)"""
    table = np.zeros(0x10000, dtype=bool)
    table[0xD800:0xE000] = True
    table[0x1100:0x1200] = True
    table[0xFFFF] = True  # stands for all code points beyond
    for code in range(0x80, 0x10000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        if unicodedata.combining(ch) or unicodedata.normalize("NFC", ch) != ch or unicodedata.category(ch)[0] == "M":
            table[code] = True
    for ch in [*single_map(), *mixed_map()]:
        if ord(ch) < 0x10000:
            table[ord(ch)] = True
    return table


@lru_cache(maxsize=2)
def safe_class(form: str = "\\u{:04X}") -> str:
    """Ranges for a regular-expression class of characters that never need work (code points under 0x2200)."""
    bad, ranges, start = unsafe_table(), [], None
    for code in range(0x2201):
        good = code < 0x2200 and not bad[code]
        if good and start is None:
            start = code
        elif not good and start is not None:
            ranges.append(form.format(start) + "-" + form.format(code - 1))
            start = None
    return "".join(ranges)


@lru_cache(maxsize=1)
def _tools():
    single = {ord(k): v for k, v in single_map().items()}
    mixed = {ord(k): v for k, v in mixed_map().items()}
    has_mixed = regex.compile("[" + "".join(mixed_map()) + "]")
    word, latin = regex.compile(WORD_RUN), regex.compile(LATIN)
    unsafe = regex.compile("[^" + safe_class() + "]")

    def word_form(match):
        word = match[0]
        if has_mixed.search(word) and latin.search(word):
            return word.translate(mixed)
        return word

    return single, has_mixed, word, unsafe, word_form


def _unsafe_places(text: str) -> np.ndarray:
    """Places of the characters of ``text`` that may need work; a fast test by table."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.flatnonzero(unsafe_table()[np.minimum(codes, 0xFFFF)])


def is_plain(text: str) -> bool:
    """Whether no character of ``text`` can need work."""
    return not len(_unsafe_places(text))


def _whole_form(text: str) -> str:
    single, has_mixed, word, _, word_form = _tools()
    text = text.translate(single)
    if has_mixed.search(text):
        text = word.sub(word_form, text)
    return unicodedata.normalize("NFC", text)


def _form_around(text: str, places: list[int]) -> str:
    """The form of ``text``, worked out only for the runs between blanks that hold one of the ``places``; nothing composes across a blank."""
    out, done = [], 0
    for place in places:
        if place >= done:
            start = max(done, text.rfind(" ", done, place) + 1)
            stop = text.find(" ", place)
            stop = len(text) if stop < 0 else stop
            out += [text[done:start], _whole_form(text[start:stop])]
            done = stop
    return "".join([*out, text[done:]])


def consistent_form(text: str | None) -> str | None:
    """The consistent form of one text; null stays null, an empty text empty."""
    if not text:
        return text
    if len(text) <= 100:
        return _whole_form(text) if _tools()[3].search(text) else text
    places = _unsafe_places(text)
    return _form_around(text, places.tolist()) if len(places) else text


def consistent_forms(texts: list[str | None]) -> list[str | None]:
    """``consistent_form`` of each text, with one test for all."""
    known = [t or "" for t in texts]
    places, out = _unsafe_places("\n".join(known)), list(texts)
    starts = np.cumsum([0, *(len(t) + 1 for t in known)])
    owners = np.searchsorted(starts, places, side="right") - 1
    for owner in np.unique(owners).tolist():
        mine = places[np.searchsorted(owners, owner) : np.searchsorted(owners, owner, side="right")]
        out[owner] = _form_around(known[owner], (mine - starts[owner]).tolist())
    return out


def number_key(number: str | None) -> str | None:
    """The key under which two written document numbers are the same number; blank gives ''."""
    if number is None:
        return None
    key = consistent_form(number).upper()
    key = regex.sub(r"[\p{Pd}−]", "-", key)
    key = regex.sub(r"\s+", "", key)
    return key.strip(".,;:()[]")
