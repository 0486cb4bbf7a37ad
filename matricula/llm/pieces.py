"""SentencePiece encoding and decoding of merge-type models, by backtracking.

The library merges neighbouring symbols by the best score until nothing merges. The same ids come without merging:
an Aho-Corasick automaton finds all pieces in a stretch in one pass, and from the left the longest piece is taken
that is compatible with the piece before it. Two neighbours are compatible if merging their joined text again gives
just them; a sequence is the encoding exactly if all its neighbours are compatible. Where no piece goes on, the
position is marked in a bitfield as failed, for only one sequence leads to it, and the piece before is shortened.

A stretch never has to be longer than a word: where two neighbouring characters are together in no piece, no piece
spans them. Such stretches are kept with their ids in a cache of two bounded generations.

Models must be of merge type, leave texts as they are but for spaces (one is put before) and may fall back to
bytes. Others raise ValueError.

Defined results: null and empty texts have no ids and decode to an empty text. Invalid UTF-8 is read as U+FFFD,
U+2581 as a space, as the library does. Repeated rows are encoded row by row, null ids are kept, an empty table gives no rows.
Texts are never cut. Other columns stay; those named ids or decoded are replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matricula.llm.base import bound_batches, register, table

SPACE = "▁"
CACHED, FEW = 1 << 18, 1 << 16  # words of a generation; stretches and pairs of one
LONG = 32  # longer words are cut wherever they can be
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_LOADED: dict[str, PieceModel] = {}


class TwoGenerations(dict):
    """Values made once and kept while in use: a full generation becomes the old one, and the one before goes."""

    def __init__(self, make: Callable, limit: int = CACHED) -> None:
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value


class PieceModel:
    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        probe = f" a  b{SPACE}éﬁ "
        if model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("the model changes texts by more than its spaces")
        ids = range(model.vocab_size())
        special = {i for i in ids if model.is_control(i) or model.is_unknown(i)}
        self.bytes_at = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        plain = [i for i in ids if i not in special and not model.is_byte(i) and not model.is_unused(i)]
        self.unknown = model.unk_id()
        self.id_of = {model.id_to_piece(i): i for i in plain}
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        if any(self.merged(p) != [p] for p in ("th", "er", "in") if p in self.score):
            raise ValueError("the model is not of merge type")
        self.together = {pair for p in self.id_of for pair in zip(p, p[1:])}
        self.splits_words = not any(a != SPACE and b == SPACE for a, b in self.together)
        self.automaton = ahocorasick.Automaton()
        for p in self.id_of:
            self.automaton.add_word(p, (len(p) - 1, p))
        self.automaton.make_automaton()
        # the next piece to try in a piece's place: its longest head that is a piece, at last its first character
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 1, -1) if p[:n] in self.id_of), p[0]) for p in self.id_of if len(p) > 1}
        # what an id stands for: bytes, with U+2581 as a space
        self.raw = [b""] * len(ids)
        for p, i in self.id_of.items():
            self.raw[i] = p.replace(SPACE, " ").encode()
        for b, i in self.bytes_at.items():
            self.raw[i] = bytes([b])
        self.raw[self.unknown] = " ⁇ ".encode()
        self.compatible = TwoGenerations(lambda pair: self.merged(pair[0] + pair[1]) == [p for p in pair if p], 2 * FEW)
        self.stretches = TwoGenerations(self._stretch, FEW)
        self.words = TwoGenerations(self._word)

    def merged(self, text: str) -> list[str]:
        """Merge neighbours by the best score (of equals the leftmost) until none merges: the slow, plain way."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def backtracked(self, text: str) -> list[str]:
        """The pieces (or single unknown characters) of a stretch."""
        longest = list(text)
        for end, (back, piece) in self.automaton.iter(text):
            longest[end - back] = piece  # from each place, matches come ascending in length
        compatible, shorter = self.compatible, self.shorter
        taken, before, at, failed, n = [], "", 0, 0, len(text)
        piece = longest[0] if n else None
        while at < n:
            while piece and (failed >> at + len(piece) & 1 or not compatible[before, piece]):
                piece = shorter.get(piece)
            if piece:
                taken.append(piece)
                at += len(piece)
                before, piece = piece, longest[at] if at < n else None
            else:
                failed |= 1 << at
                piece = taken.pop()
                at -= len(piece)
                before, piece = taken[-1] if taken else "", shorter.get(piece)
        return taken

    def _stretch(self, text: str) -> bytes:
        taken = self.backtracked(text)
        try:
            return array("i", map(self.id_of.__getitem__, taken)).tobytes()
        except KeyError:  # a character that is no piece
            out = array("i")
        for piece in taken:
            known = self.id_of.get(piece)
            if known is not None:
                out.append(known)
            elif self.bytes_at:
                out.extend(self.bytes_at[b] for b in piece.encode())
            else:
                out.append(self.unknown)
        return out.tobytes()

    def _word(self, word: str) -> bytes:
        """A key without U+2581 stands for a word after one space."""
        if len(word) <= LONG:
            if word.isalpha():
                return self._stretch(SPACE + word)
            if word[:-1].isalpha() and (word[-2], word[-1]) not in self.together:  # a mark after a word
                return self.words[word[:-1]] + self.stretches[word[-1]]
        return self.joined(word if SPACE in word else SPACE + word)

    def joined(self, word: str) -> bytes:
        """The ids of a stretch as it stands (spaces as U+2581)."""
        together, last, out = self.together, 0, []
        for i, pair in enumerate(zip(word, word[1:]), 1):
            if pair not in together:
                out.append(self.stretches[word[last:i]])
                last = i
        out.append(self.stretches[word[last:]])
        return b"".join(out)

    def split(self, text: str) -> list[str]:
        """Keys of `words` for a whole text."""
        if not text:
            return []
        if not self.splits_words:
            return [SPACE + text.replace(" ", SPACE)]
        parts = text.split(" ")
        if SPACE in text or "" in parts:
            return _WORDS.findall(SPACE + text.replace(" ", SPACE))
        return parts

    def encode(self, text: str) -> bytes:
        """The ids as 32-bit integers of this machine's byte order."""
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; one space is taken from its start."""
        return b"".join(map(self.raw.__getitem__, ids)).removeprefix(b" ").decode("utf-8", "replace")


def piece_model(path: str) -> PieceModel:
    """One model a worker and path."""
    if path not in _LOADED:
        _LOADED[path] = PieceModel(path)
    return _LOADED[path]


def read(text: bytes | None) -> str:
    return (text or b"").decode("utf-8", "replace")


def with_ids(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Add ids, array<int>: the whole text's encoding."""

    @F.arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        encode = piece_model(model).encode
        out = [encode(read(t)) for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, out)]) // 4
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(out), np.int32)))

    bound_batches(docs.sparkSession, 8 << 20)
    return docs.withColumn("ids", encoded(F.col(text).cast("binary")))


def with_decoded(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """Add decoded: the text of the ids; null ids stand for an empty text."""

    @F.arrow_udf("string")
    def text_of(ids: pa.Array) -> pa.Array:
        decode = piece_model(model).decode
        flat = ids.flatten().to_numpy(zero_copy_only=False).tolist()  # all lists at once: one by one they are slow to read
        ends = np.cumsum(pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False)).tolist()
        return pa.array([decode(flat[i:j]) for i, j in zip([0, *ends], ends)], pa.string())

    bound_batches(encoded.sparkSession, 8 << 20)
    return encoded.withColumn("decoded", text_of(F.col(ids)))


def model_path() -> str:
    from public_tokenizers import path

    return path("piece_bpe_32k.model")


@register("op12_pieces")
def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = with_decoded(with_ids(docs, model_path()).select("doc_id", "ids"), model_path())
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
