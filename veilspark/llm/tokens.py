"""Pre-tokens and vocabulary tables of the public tokenizer files.

Texts made of ASCII and Latin letters are cut by an ``re`` pattern that equals the
library's on those characters; any other text goes through the library's own
pre-tokenizer, so Unicode versions never matter.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

LATIN = "A-Za-zÀ-ÖØ-öø-įı-ſ"  # closed under lower-casing
#: Characters on which the fast patterns and the libraries are known to agree.
PLAIN = re.compile(rf"[\t\n\r\x20-\x7e{LATIN}¡¿«»§–—‘’“”…€]*")
BYTE_LEVEL = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+")
WORD_LEVEL = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[^\s{LATIN}0-9]+")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in kept}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(kept))
    return table


TO_CHAR = byte_alphabet()
TO_BYTE = {c: b for b, c in TO_CHAR.items()}
_MAPPED = {b: c for b, c in TO_CHAR.items()}


def mapped(piece: str) -> str:
    """UTF-8 bytes of a pre-token, written in the byte alphabet."""
    return piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(_MAPPED)


def unmapped(token: str) -> bytes:
    return bytes(map(TO_BYTE.__getitem__, token))


@lru_cache(maxsize=4)
def library(path: str):
    """The tokenizer as its library loads it, without truncation or padding."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=4)
def specials(path: str) -> tuple[re.Pattern, dict[str, int]]:
    """A pattern that splits off added tokens, and their ids."""
    with open(path, encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    longest = sorted(added, key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, longest)) + ")"), added


def byte_pretokens(text: str, path: str) -> list[str]:
    """Pre-tokens of a text that holds no added token."""
    if PLAIN.fullmatch(text):
        return BYTE_LEVEL.findall(text)
    pieces = library(path).pre_tokenizer.pre_tokenize_str(text)
    return [text[a:b] for _, (a, b) in pieces]


def chunks(text: str, size: int = 1 << 20) -> list[str]:
    """A long text cut before spaces that follow a non-space, where pre-tokens always end."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size and (m := _CUT.search(text, start + size)):
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


_CUT = re.compile(r"(?<=\S) ")


def parts(text: str, path: str) -> list[str]:
    """The text cut at added tokens; odd places hold the added tokens."""
    pattern, added = specials(path)
    return pattern.split(text) if "<|" in text or not all(s.startswith("<|") for s in added) else [text]
