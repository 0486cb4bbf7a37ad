"""Token ids of whole texts, word by word through a bounded cache."""

from __future__ import annotations

import string
import sys
from array import array

from matricula.llm.pieces import TwoGenerations

CACHED_WORDS = 1 << 17  # of a generation
MARKS = string.punctuation.encode()
_LOADED: dict[str, WordIds] = {}


def _latin(text: str) -> bool:
    """Whether these are Latin letters, which lower-case one by one and are in composed form."""
    return text.isalpha() and max(text) < "İ"


class WordIds:
    """ids(text) of a tokenizer that drops white space, lower-cases and never merges across it.

    Such a tokenizer gives the ids of a text as those of its words in turn, so each distinct word is
    encoded once and kept as packed 32-bit ids. Plain Latin words go to the model itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words = TwoGenerations(self._encode, CACHED_WORDS)
        # the byte-level alphabet: printable Latin-1 stays, other bytes move above 255
        kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        moved = (256 + i for i in range(256))
        self.shown = "".join(chr(b if b in kept else next(moved)) for b in range(256))

    def _ids(self, word: bytes) -> array:
        if word.isalpha() and word.islower():  # ASCII
            return array("I", [t.id for t in self.model.tokenize(word.decode())])
        text = word.decode("utf-8", "replace")
        if _latin(text):
            text = text.lower().encode().decode("latin-1").translate(self.shown)
            return array("I", [t.id for t in self.model.tokenize(text)])
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _encode(self, word: bytes) -> bytes:
        head = word.rstrip(MARKS)
        if head and len(head) < len(word) and (head.isalpha() or _latin(head.decode("utf-8", "replace"))):  # marks after letters
            return self.words[head] + self.words[word[len(head):]]
        ids = self._ids(word)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __call__(self, text: bytes) -> bytes:
        """The ids as unsigned little-endian 32-bit integers."""
        words = text.split() if b"<|" in text else text.lower().split()  # special tokens keep their case
        return b"".join(map(self.words.__getitem__, words))


def word_ids(path: str) -> WordIds:
    """One tokenizer a worker and path."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]
