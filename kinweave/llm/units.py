"""Pieces of a text that a byte-level tokenizer encodes independently of each other.

The tokenizer's pattern starts a new word before every single blank, so a text without two blanks in a row
may be cut there and its pieces encoded apart, each distinct piece once. Other texts are cut by
the pattern itself.
"""

from __future__ import annotations

import regex

#: Fixed value: the pattern of the byte-level pre-tokenizer.
WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")

#: A worker remembers the codes of about so many pieces: memory, not results.
REMEMBERED = 400_000
_SHORT = 9


def forget(known: dict, limit: int = REMEMBERED) -> dict:
    """What stays of a full memory: the short pieces, which come again most often, unless they fill it alone."""
    if len(known) <= limit:
        return known
    short = {p: c for p, c in known.items() if len(p) <= _SHORT}
    return short if len(short) < limit * 2 // 3 else {}


def pieces(text: str) -> list[str]:
    """``text`` cut where a word must begin; the pieces join to the text."""
    if "  " in text:
        return WORDS.findall(text)
    first, *others = text.split(" ")
    out = [" " + x for x in others]
    if first:
        out.insert(0, first)
    return out


def byte_letters() -> dict[str, int]:
    """The letter a byte-level vocabulary writes for each byte: printable Latin-1 as itself, the rest above 255."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
