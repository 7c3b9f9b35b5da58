"""Ids of whole texts by the public word BPE file of the tokenizers library, with memories for parts and words.

The file normalises (NFC, blanks, lower case), cuts a text into letter runs, single digits, contractions and runs of the rest,
and drops blanks. Nothing on one side of an ASCII blank changes the ids of the other, so the ids of a text are those of its
blank-separated parts in a row. The strings of the file's added tokens have their own ids, as the library finds them in the text
before anything else. A text of printable ASCII, ASCII blanks and Latin-1 letters is cut by the same rule here; its
words come back often, so a worker keeps the ids of each as little-endian bytes, and new ones go to the library's BPE model one
by one. In any other text the parts that have other characters, or an added token, go through the whole tokenizer.

Defined cases: an empty text, or one of blanks only, has no ids; memory does not grow with the text but by its ids.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import cache

import numpy as np

#: Words that a worker remembers (about 200 bytes each); the memory is emptied beyond it.
MEMORY = 350_000

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(rf"[\x09-\x0d\x20-\x7e{LETTERS}]*").fullmatch
CUT = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[0-9]|[^\x09-\x0d\x20{LETTERS}0-9]+").findall


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordBPE:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.find, self.mark = re.compile("|".join(map(re.escape, added)) or "(?!)").search, os.path.commonprefix(added)
        self.model = self.tokenizer.model
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        if len(self.words) >= MEMORY:
            self.words.clear()
        got = self.words[word] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return got

    def added(self, text: str) -> bool:
        """Whether the text has an added token."""
        return self.mark in text and self.find(text) is not None

    def ids(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        if PLAIN(text) and not self.added(text):
            get, new = self.words.get, self.word
            return b"".join([get(w) or new(w) for w in CUT(text.lower())])
        out = []
        for part in text.encode().split():
            part = part.decode()
            out.append(self.ids(part) if PLAIN(part) and not self.added(part) else np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes())
        return b"".join(out)


@cache
def word_coder(path: str) -> WordBPE:
    return WordBPE(path)
