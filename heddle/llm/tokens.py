"""Exact token ids by the tokenizers library, with a bounded cache of words."""

from __future__ import annotations

from array import array

import public_tokenizers
from tokenizers import Tokenizer

NAME = "byte_bpe_50k.json"
END = 0
#: Characters of the longest word that is kept.
LONGEST = 64

#: The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


class _Odd(Exception):
    """A word holds white space of another kind, so cutting at spaces may not be exact."""


class _Words(dict):
    """Ids (as bytes) of words, by word; lead is what stands before each in its text."""

    def __init__(self, encoder: Encoder, lead: str):
        self.encoder, self.lead, self.held = encoder, lead, 0
        self.old: dict[str, bytes] = {}

    def age(self) -> None:
        """The words so far become old; of them, those that were old already and weren't met again go."""
        self.old = dict(self)
        self.clear()
        self.held = 0

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            if word.isalpha():
                out = self.encoder.letters(self.lead, word)
            elif word[-1:] in (".", ",") and word[:-1].isalpha():
                out = self[word[:-1]] + self.encoder.first[word[-1]]
            elif any(map(str.isspace, word)):
                raise _Odd
            else:
                out = self.encoder.raw(self.lead + word)
        if len(word) <= LONGEST:  # longer runs without a space are no words that come again
            self[word] = out
            self.held += len(word) + len(out)
        return out


class Encoder:
    """Ids of whole texts, as encode(text, add_special_tokens=False) gives them.

    The byte-level pre-tokenizer always starts a new piece at a single space or line break between
    other characters, and pieces are encoded independently. Words cut there are therefore looked up
    one by one; the library encodes each new word, and every text with other white space or with a
    special token's mark as a whole.
    """

    def __init__(self, name: str = NAME, limit: int = 300_000, most_bytes: int = 12_000_000):
        """name: a file of public_tokenizers, or a path. limit, most_bytes: words, some 150 bytes each beside their
        characters and ids, and these, that each of two tables keeps in each of two generations."""
        self.library = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))
        self.model = self.library.model
        self.dtype = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.dtype == "<u2" else "I"
        self.limit, self.most_bytes = limit, most_bytes
        self.space = chr(ALPHABET[32])
        self.first, self.later = _Words(self, ""), _Words(self, " ")
        self.line = self.raw("\n")

    def raw(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def letters(self, lead: str, word: str) -> bytes:
        """raw(lead + word) of a word of letters. With at most a space before it, that is one piece, which
        the library's model takes as it is, its bytes written as the byte-level alphabet's characters."""
        if word.isascii():  # these bytes stand for themselves
            return array(self.code, [x.id for x in self.model.tokenize(self.space + word if lead else word)]).tobytes()
        try:
            word.encode("latin-1")  # of later scripts, versions of Unicode may know different letters
        except UnicodeEncodeError:
            return self.raw(lead + word)
        piece = (lead + word).encode().decode("latin-1").translate(ALPHABET)
        return array(self.code, [x.id for x in self.model.tokenize(piece)]).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids' bytes, in dtype; no end id."""
        if not text:
            return b""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or "<|" in text or text[0] in " \n" or text[-1] in " \n":
            return self.raw(text)
        for table in (self.first, self.later):
            if len(table) > self.limit or table.held > self.most_bytes:
                table.age()
        later, parts = self.later.__getitem__, []
        try:
            for line in text.split("\n"):
                words = line.split(" ")
                parts.append(self.first[words[0]])
                parts += map(later, words[1:])
                parts.append(self.line)
        except _Odd:
            return self.raw(text)
        parts.pop()
        return b"".join(parts)


_encoders: dict[str, Encoder] = {}


def encoder(name: str = NAME) -> Encoder:
    """One for each Python worker."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]
