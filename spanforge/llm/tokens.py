"""Encoding of whole texts with the tokenizers library, word by word through a bounded cache."""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters among which only blank, tab, newline and carriage return are white space to every library here.
PLAIN = re.compile("[\t\n\r -~\xa1-\xac\xae-\xffŒœ–—‘’“”…€]*")


def byte_letters() -> list[str]:
    """The letter for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows 255 in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


#: Those characters, their letters and numerals, and the byte-level letters they stand for in vocabularies.
CHARACTERS = [chr(c) for c in range(0x2100) if PLAIN.fullmatch(chr(c))]
L, N = ("".join(c for c in CHARACTERS if unicodedata.category(c)[0] == k) for k in "LN")
LETTERS = {ord(c): "".join(byte_letters()[b] for b in c.encode()) for c in CHARACTERS}
#: The two tokenizers' own splits, fixed values, over those characters; the first keeps white space, the second drops it.
SPACED = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+").findall
UNSPACED = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^\s{L}{N}]+").findall
#: Encodings kept in each of two generations; the older one goes when the newer one is full.
CACHED = 500_000
#: Characters of a part that is kept; so caches are bounded in bytes too.
LONGEST = 64
#: Characters of a text handled at once.
BLOCK = 1 << 20


def blocks(text: str, size: int = BLOCK, space: str = r"\s"):
    """Parts of a text, each cut where white space begins; without white space there is one part."""
    at, cut = 0, re.compile(rf"(?<!{space}){space}")
    while at < len(text):
        m = cut.search(text, at + size)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def plain(text: str) -> bool:
    return text.isascii() and text.replace("\n", "").isprintable() or PLAIN.fullmatch(text) is not None


class Encoder:
    """ids(text): the ids that the library gives the whole text, as little-endian uint32 bytes.

    Both kinds of tokenizer split at white space before their merges, so a plain
    text's ids are those of its parts joined: of its words where white space is
    dropped, of words with the white space before them where it is kept. A part
    that the cache lacks is split here and merged by the library's model. Texts
    with other characters go to the library whole.
    """

    def __init__(self, path: str, keeps_space: bool):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.merge, self.keeps_space = self.library.model.tokenize, keeps_space
        self.pieces = SPACED if keeps_space else UNSPACED
        self.bytes = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        self.known: dict[str, bytes] = {}
        self.parts = re.compile(r"\s*\S+|\s+").findall if keeps_space else str.split
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def part(self, part: str) -> bytes:
        """ids of a part of a plain text: the library's model merges each piece of its split."""
        out, whole = [], part if self.keeps_space else part.lower()
        # letters, after one blank at most, are one piece
        one = whole.isascii() and (whole.isalpha() or self.keeps_space and whole[0] == " " and whole[1:].isalpha())
        for piece in (whole,) if one else self.pieces(whole):
            ids = self.known.get(piece)
            if ids is None:
                ids = b"".join([self.bytes[t.id] for t in self.merge(piece.translate(LETTERS))])
                if len(piece) <= LONGEST:
                    if len(self.known) > CACHED:
                        self.known.clear()
                    self.known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def block(self, text: str) -> bytes:
        parts = self.parts(text)
        found = list(map(self.cache.get, parts))
        if None in found:
            if len(self.cache) > CACHED:
                self.old, self.cache = self.cache, {}
            for i in [i for i, x in enumerate(found) if x is None]:
                p = parts[i]
                found[i] = self.cache.get(p) or self.old.get(p) or self.part(p)
                if len(p) <= LONGEST:
                    self.cache[p] = found[i]
        return b"".join(found)

    def ids(self, text: str) -> bytes:
        if "<|" in text or not plain(text):
            return self.whole(text)
        return self.block(text) if len(text) <= BLOCK else b"".join(map(self.block, blocks(text)))


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, keeps_space: bool) -> Encoder:
    """One per Python worker and file."""
    key = (path, keeps_space)
    if key not in _encoders:
        _encoders[key] = Encoder(path, keeps_space)
    return _encoders[key]


def public(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
