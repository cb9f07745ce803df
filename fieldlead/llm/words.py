"""Words of a text, the same for every spelling of the same letters."""

from __future__ import annotations

import re
import unicodedata

_ASCII_WORD = re.compile(r"[a-z0-9]+")
_WORD = re.compile(r"[^\W_]+")
#: A line break with what surrounds it: blanks, then whatever starts the next line (quote marks, comment signs).
_BREAK = "[^\\S\n]*+[\n\r\x0b\x0c\u0085  ][\\s>|*#]*+"
#: A hyphen between letters at the end of a line: of the layout or of the word, nobody can tell.
_BROKEN = re.compile("(?<=[^\\W_])[-‐‑]" + _BREAK + "(?=[^\\W_])")
#: Stands for such a hyphen while a text is cut into words.
_MARK = "\x01"
_MARKED_WORD = re.compile(rf"[^\W_]+{_MARK}?")
#: A soft hyphen at the end of a line is always of the layout.
_SOFT = re.compile("­" + _BREAK)
#: Characters without a shape of their own.
_INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤﻿]")
_LETTERS = str.maketrans({"œ": "oe", "æ": "ae", "ø": "o", "ł": "l", "đ": "d", "ı": "i"})


def folded(text: str) -> str:
    """Lower case, compatibility forms resolved, accents and invisible characters removed."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", _INVISIBLE.sub("", _SOFT.sub("", text)))
    text = "".join(c for c in text if not unicodedata.combining(c))
    return unicodedata.normalize("NFKC", text.casefold()).translate(_LETTERS)


def atoms(text: str) -> tuple[list[str], list[int]]:
    """(runs of letters and digits of the folded text, the places of those that a hyphen at a line end ties to the next).

    A tie leaves both readings open: the halves are words of their own ('well-known'), or one word that the
    layout broke ('won-derful'). Any number of halves may hang together.
    """
    text = folded(text)
    plain = _ASCII_WORD if text.isascii() else _WORD
    if not _BROKEN.search(text):
        return plain.findall(text), []
    found = _MARKED_WORD.findall(_BROKEN.sub(_MARK, text.replace(_MARK, " ")))
    return [w.removesuffix(_MARK) for w in found], [i for i, w in enumerate(found) if w.endswith(_MARK)]


def words(text: str) -> list[str]:
    """The runs of letters and digits, halves around a line end apart."""
    return atoms(text)[0]
