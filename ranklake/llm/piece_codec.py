"""SentencePiece BPE encoding by prefix tables, and decoding.

For a vocabulary of merges each prefix of a piece of text has one encoding, and so one last token. The table of last tokens
is filled from left to right: an Aho-Corasick automaton over the vocabulary gives the tokens that end at a position, and the
one whose left neighbour (the last token before it) is compatible with it is the prefix's last token. Two tokens are
compatible if merging their characters gives just these two; that answer is kept in a bounded table. Ids are then read
backwards through the table. Characters outside the vocabulary stand alone and become byte tokens.

No token of such a vocabulary has a word mark after another character, so text is cut before word marks and each piece is
encoded by itself; encodings of short pieces are kept in a bounded table.

Defined results: a null text counts as empty; an empty text has the begin and end ids only and decodes to an empty text;
repeated rows give repeated results; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import sys
from array import array
from collections.abc import Iterator
from functools import cached_property
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ranklake.llm.common import hold, ship, text_or_empty

MARK = "▁"
#: Entries of the tables of pieces and of pairs, and characters of the longest piece that is kept.
PIECES, PAIRS, LONGEST = 400_000, 600_000, 48


class PieceCodec:
    """Encodes as the model's library does, without sampling; ``model`` is the serialised model."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        sp = self.library
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte = {}
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id[piece], self.score[piece] = i, sp.get_score(i)
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise ValueError("ids are packed as this machine's integers, which must be little-endian and of 32 bits")
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a token has a word mark inside: the text can't be cut there")
        self.piece = {i: p for p, i in self.id.items()}
        self._pairs: dict[int, bool] = {}
        self._words: dict[str, bytes] = {}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for piece in self.id:
            if self.merged(piece) == [piece]:  # others are never the result of merging
                a.add_word(piece, (len(piece), self.id[piece]))
        a.make_automaton()
        return a

    def merged(self, text: str) -> list[str]:
        """Merges neighbours, the best score first and the leftmost of equals; for short texts."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether the tokens with these ids stay as they are when they meet."""
        if len(self._pairs) >= PAIRS:
            self._pairs.clear()
        a, b = self.piece[left], self.piece[right]
        known = self._pairs[left << 32 | right] = self.merged(a + b) == [a, b]
        return known

    def ids_of(self, piece: str) -> list[int]:
        """The encoding of one piece through its table of last tokens."""
        n = len(piece)
        last, size = [-1] * (n + 1), [1] * (n + 1)  # a character outside the vocabulary keeps -1 and 1
        pairs = self._pairs
        for end, (long, token) in self.automaton.iter(piece):  # ends ascend; of one end the longest comes first
            end += 1
            if last[end] < 0:
                start = end - long
                left = last[start]  # -1 also at the start of the piece
                if left >= 0:
                    known = pairs.get(left << 32 | token)
                    if not (self.compatible(left, token) if known is None else known):
                        continue
                last[end], size[end] = token, long
        out: list[int] = []
        at = n
        while at:
            if last[at] >= 0:
                out.append(last[at])
            else:
                out.extend(self.byte[b] for b in reversed(piece[at - 1].encode("utf-8")))
            at -= size[at]
        return out[::-1]

    def encode(self, text: str) -> np.ndarray:
        """All ids with begin and end, as little-endian unsigned 32-bit integers."""
        sp, known = self.library, self._words
        normal = sp.normalize(text)
        # A cut before each word mark that follows another character.
        pieces = normal.split(MARK)
        packed = [np.array([sp.bos_id()], "<u4").tobytes()]
        if pieces[0]:
            packed.append(self._packed(pieces[0]))
        marks = 1
        for p in pieces[1:]:
            if not p:
                marks += 1
                continue
            word = MARK * marks + p
            found = known.get(word)
            packed.append(found if found is not None else self._packed(word))
            marks = 1
        if marks > 1:  # marks at the end
            packed.append(self._packed(MARK * (marks - 1)))
        packed.append(np.array([sp.eos_id()], "<u4").tobytes())
        return np.frombuffer(b"".join(packed), "<u4")

    def _packed(self, word: str) -> bytes:
        known = self._words.get(word)
        if known is None:
            known = array("I", self.ids_of(word)).tobytes()
            if len(word) <= LONGEST:
                if len(self._words) >= PIECES:
                    self._words.clear()
                self._words[word] = known
        return known

    def forget(self) -> None:
        """Empties the tables of pieces and pairs, so that the worker's next stage doesn't hold them."""
        self._words.clear()
        self._pairs.clear()

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


_CODECS: dict[str, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """One codec a worker and model."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = PieceCodec(model)
    return _CODECS[key]


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and decoded with the model at a driver's path."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(Path(model_path).read_bytes())  # under 1 MB for 32,000 pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model.value)
        hold("codec", c.forget)
        for b in batches:
            n, ids, decoded = [], [], []
            for t in b.column("text").to_pylist():
                e = c.encode(t)
                n.append(len(e))
                ids.append(hashlib.sha256(e.tobytes()).hexdigest())
                decoded.append(hashlib.sha256(c.decode(e).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, T.StructType([docs.schema["doc_id"], *fields]))
