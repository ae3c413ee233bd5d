"""Token ids of whole texts with a public tokenizer file, word by word through a bounded memory of words seen.

Both tokenizer kinds cut a text at white space before they merge, so the ids of a text are the ids of its words in order. Words
repeat, so each Python worker keeps their ids. A new word is cut by the tokenizer's own pattern and goes straight to its merge
model; words with characters beyond Latin-1, where normal forms matter, go through the whole tokenizer, and so does a text with
white space other than single spaces and single line ends, or with the opening of a special token (the library gives a special
token's string in a text its own id).
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import regex

#: Words kept by a worker, and the characters of a word that is kept: under 150 MB in all. A full memory starts anew at once, within a
#: text too; long words (encoded data, say) are worked out wherever they stand.
MOST_WORDS, MOST_CHARS = 400_000, 64

# The patterns by which the two tokenizer files cut words.
_BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_WORD_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_ODD_WORDS = re.compile(r"[\x1c-\x1f]")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Memory(dict):
    """Ids of words; a word that is not there is learnt as it is asked for, so each word of a text is looked up once."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, key: str) -> bytes:
        ids = self.learn(key)
        if len(key) <= MOST_CHARS:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[key] = ids
        return ids


class WordIds:
    """encode(texts) gives the ids of each text as little-endian uint32 bytes."""

    def __init__(self, path: str, byte_level: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.openings = sorted({t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.byte_level = byte_level
        self.model = self.tokenizer.model
        self.pattern = _BYTE_LEVEL if byte_level else _WORD_LEVEL
        self.letters = str.maketrans(byte_letters())
        self.short: dict[str, list[int]] = {}
        self.ends = {x: array("I", self.part(x)).tobytes() for x in ".,"}
        self.seen = Memory(self.learn)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, text: str) -> list[str] | None:
        """Keys of the words: for byte-level ids a bare key stands for a space before it, one from \\n on for itself, \\r is the start."""
        if any(x in text for x in self.openings):
            return None
        if not self.byte_level:
            return None if _ODD_WORDS.search(text) else text.split()
        flat = text.replace("\n", " ")
        if not text or " ".join(text.split()) != flat:
            return None
        words = text.replace("\n", " \n").split(" ")
        words[0] = "\r" + words[0]
        return words

    def part(self, part: str) -> list[int]:
        """Ids of one cut of a word, by the merge model."""
        if len(part) <= 4 and part in self.short:
            return self.short[part]
        if part.isascii() and part[1:].isalnum() and part[0] != "\n":
            spelt = "\u0120" + part[1:] if part[0] == " " else part
        else:
            spelt = part.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(spelt)]
        if len(part) <= 4:
            self.short[part] = ids
        return ids

    def learn(self, key: str) -> bytes:
        if key.isascii():
            stem = key[:-1] if key[-1:] in self.ends else key
            if stem.isalpha():  # one cut, its letters stand for themselves
                ids = array("I", [t.id for t in self.model.tokenize("\u0120" + stem if self.byte_level else stem.lower())]).tobytes()
                return ids if stem is key else ids + self.ends[key[-1]]
        word = self.spelled(key)
        try:
            word.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole([word])[0]
        if not self.byte_level:
            word = word.lower()
        body = word[1:] if word[0] == " " else word
        if body.isalpha():
            parts = (word,)
        elif body[:-1].isalpha() and body[-1] in ".,":
            parts = (word[:-1], body[-1])
        else:
            parts = self.pattern.findall(word)
        ids: list[int] = []
        for p in parts:
            ids += self.part(p)
        return array("I", ids).tobytes()

    def spelled(self, key: str) -> str:
        if not self.byte_level or key[0] == "\n":
            return key
        return key[1:] if key[0] == "\r" else " " + key

    def encode(self, texts: list[str]) -> list[bytes]:
        get = self.seen.__getitem__
        return [b"".join(map(get, words)) if (words := self.words(text)) is not None else self.whole([text])[0] for text in texts]


@lru_cache(maxsize=4)
def word_ids(path: str, byte_level: bool) -> WordIds:
    """One for each Python worker and tokenizer file."""
    return WordIds(path, byte_level)
