"""How texts fall into chunks that byte-level vocabularies treat on their own: at single spaces before something that isn't white space,
where a pre-token always ends."""

from __future__ import annotations

import re

#: Letters, then signs but the apostrophe: one pre-token or two in every byte-level vocabulary; perhaps a line end and the same again.
_LETTERS, _SIGNS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", r"[!-&(-/:-@\[-`{-~]*"
_MORE = f"(?:\n({_LETTERS})({_SIGNS}))?"
#: A simple chunk with its space before, and one that begins a text.
SIMPLE, HEAD = re.compile(f"( {_LETTERS})({_SIGNS}){_MORE}"), re.compile(f"({_LETTERS})({_SIGNS}){_MORE}")
#: The parts of a chunk without a space before it (for Arrow): letters a and signs b, and of the line after it c and d.
PARTS = rf"\A(?P<a>{_LETTERS})(?P<b>{_SIGNS})(?:\n(?P<c>{_LETTERS})(?P<d>{_SIGNS}))?\z"
#: Texts with a space before white space or at the end, or with control characters that libraries class differently (for Arrow).
ODD = r" (?:[\s\x0b\x{85}\p{Z}]|$)|[\x1c-\x1f]"


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, the others follow from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


LETTER = dict(enumerate(_byte_letters()))


def spell(piece: str) -> str:
    """A pre-token in the letters of the vocabulary."""
    if piece.isascii() and piece.isprintable():
        return piece.replace(" ", LETTER[32])
    return piece.encode().decode("latin-1").translate(LETTER)
