"""Token ids of whole texts by the tokenizers library, with a bounded cache of the pieces between white space.

A vocabulary file is given by its name in the installed package of public tokenizers, or by its path.

Both pre-tokenizers used here begin a new token wherever white space follows a character that isn't white space, and
no merge crosses it. So a text's ids are the concatenation of the ids of units `white space* other+`, and equal
units have equal ids. Texts in which other white space than ASCII's, or the text of a special token, occurs
are encoded whole."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

UNIT = re.compile(rb"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
#: White space beyond ASCII's, and the controls that some libraries count as such.
ODD = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff]")
#: One word of Latin letters, with what may stand before and after it: its pre-tokens are plain, so that the
#: library's BPE model takes them without the library's normaliser and pre-tokenizer.
PLAIN = re.compile(rb"([ \n]?)((?:[a-zA-Z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
#: Units kept, about 200 bytes each; as many that were kept before are given up only when the next ones are this many.
CACHE = 200_000


def vocabulary(name: str) -> str:
    """The path of a vocabulary file."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for 256 and on, in order."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: b for b in kept} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in kept)}


BYTES = byte_letters()


class UnitEncoder(dict):
    """ids(texts): for each text the little-endian uint32 bytes of its ids, as the library's encode(add_special_tokens=False)."""

    #: unit -> ids; a unit that is asked for and missing is encoded and kept.
    def __init__(self, name: str, spaces: bool) -> None:
        """spaces: whether white space before a word is part of its token, as in byte-level BPE; else the vocabulary lower-cases and drops white space."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.largest = max(self.tokenizer.get_vocab().values())
        self.lower = not spaces
        self.cut = UNIT.findall if spaces else bytes.split
        self.old: dict[bytes, bytes] = {}  #: the units kept before
        self.parts: dict[bytes, bytes] = {}  #: what stands before and after words
        self.model = self.tokenizer.model.tokenize

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _model(self, part: bytes) -> bytes:
        """The ids of one pre-token."""
        if part.isascii():
            letters = part.decode() if part[0] > 32 else chr(BYTES[part[0]]) + part[1:].decode()  # the rest stands for itself
        else:
            letters = part.decode("latin-1").translate(BYTES)
        return array("I", [x.id for x in self.model(letters)]).tobytes()

    def _part(self, part: bytes) -> bytes:
        ids = self.parts[part] = self._model(part)
        return ids

    def __missing__(self, unit: bytes) -> bytes:
        """Plain words go straight to the library's model, other units through all of the library. A word is kept as the unit that it would be alone."""
        old, parts = self.old, self.parts
        if not (ids := old.get(unit)):
            if m := PLAIN.fullmatch(unit):
                before, word, after = m.groups()
                if self.lower:
                    word = word.decode().lower().encode()
                elif before == b" ":
                    word = before + word
                if not (ids := self.get(word) or old.get(word)):
                    ids = self._model(word)
                self[word] = ids
                if before == b"\n" and not self.lower:
                    ids = (parts.get(before) or self._part(before)) + ids
                if after:
                    ids += parts.get(after) or self._part(after)
            else:
                ids = self._encode(unit.decode())
        self[unit] = ids
        return ids

    def ids(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        cut, of = self.cut, self.__getitem__
        for t in texts:
            if not t:
                yield b""
            elif "<|" in t or ODD.search(t):
                yield self._encode(t)
            else:
                yield b"".join(map(of, cut(t.encode("utf-8", "replace"))))
                if len(self) > CACHE:
                    self.old = dict(self)
                    self.clear()
                if len(self.parts) > CACHE:
                    self.parts.clear()
