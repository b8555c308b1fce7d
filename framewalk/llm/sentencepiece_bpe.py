"""SentencePiece BPE encoding and decoding by the last token of each prefix.

For every prefix of a word the last token of its encoding is unique.  An
automaton over all pieces gives the tokens that end at a position; such a token
is the last one if what precedes it is empty, or if it is compatible with the
last token of the prefix before it: the two, encoded together, stay the same two.
The ids are recovered backwards from the whole word's last token.  The work is
linear in the length of the text, however long a word is.

A piece holds "▁" only at its start (or is a run of them), so no merge crosses
the start of a word; words are encoded one by one and remembered, within a bound.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewalk.llm.common import Workspace, table

SPACE = "▁"
#: Words and pairs that a task remembers, and the longest such word.
WORDS, PAIRS, LONGEST = 300_000, 400_000, 48
#: No token: the start of a word, or a character that is no piece.
NONE = (1 << 24) - 1


class Piece:
    """Encodes and decodes with one model file."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix or not kinds <= {1, 2, 3, 6}:
            raise ValueError("only BPE models without normalization rules or user-defined pieces, with a dummy prefix, are supported")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        if any(SPACE in p.lstrip(SPACE) or p.startswith(SPACE * 2) and p.strip(SPACE) for p in self.ids):
            raise ValueError("a piece crosses the start of a word")
        self.score = {p.piece: p.score for p in model.pieces if p.type == 1}
        self.pieces = [p.piece for p in model.pieces]
        self.byte = [None] * 256
        self.of_byte: dict[int, int] = {}
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte[int(p.piece[3:5], 16)] = i
                self.of_byte[i] = int(p.piece[3:5], 16)
        self.fallback = model.trainer_spec.byte_fallback
        self.unk, self.end = model.trainer_spec.unk_id, model.trainer_spec.eos_id
        self.unk_surface = model.trainer_spec.unk_surface
        self.silent = {i for i, p in enumerate(model.pieces) if p.type == 3}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.split = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if not any("\n" in p for p in self.ids) else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.is_byte = np.zeros(len(self.pieces), bool)
        self.is_byte[list(self.of_byte)] = True
        self.surfaces = ["" if i in self.silent else self.unk_surface if i == self.unk else p for i, p in enumerate(self.pieces)]
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The merge rule itself, for texts of at most two pieces: the best pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when encoded together; left may be NONE."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        parts = [self.pieces[right]] if left == NONE else [self.pieces[left], self.pieces[right]]
        known = self.pairs[left << 24 | right] = self.merged("".join(parts)) == parts
        return known

    def encode_word(self, word: str) -> bytes:
        """The ids of a word as int32 bytes; a character that is no piece gives its UTF-8 bytes' ids."""
        last, pairs, done = [NONE] * (len(word) + 1), self.pairs, 0
        for end, (size, token) in self.automaton.iter(word):
            end += 1
            if end == done:
                continue
            before = last[end - size]
            fits = pairs.get(before << 24 | token)
            if self.compatible(before, token) if fits is None else fits:
                last[end] = token
                done = end
        out, at = [], len(word)
        while at:
            token = last[at]
            if token != NONE:
                out.append(token)
                at -= len(self.pieces[token])
            else:
                at -= 1
                out += [self.byte[b] for b in reversed(word[at].encode("utf-8"))] if self.fallback else [self.unk]
        out.reverse()
        return array("i", out).tobytes()

    def encode(self, text: str | None, end: bool = True) -> np.ndarray:
        out: list[bytes] = []
        if text:
            known = self.words
            for word in self.split.findall(SPACE + text.replace(" ", SPACE)):
                ids = known.get(word)
                if ids is None:
                    ids = self.encode_word(word)
                    if len(word) <= LONGEST:
                        if len(known) >= WORDS:
                            known.clear()
                        known[word] = ids
                out.append(ids)
        if end:
            out.append(array("i", [self.end]).tobytes())
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Pieces in a row, bytes as UTF-8 (each byte that fits no character as U+FFFD), one leading space less."""
        ids = np.asarray(ids, np.int32)
        bytes_at = np.flatnonzero(self.is_byte[ids])
        tokens, surface, out, start, k = ids.tolist(), self.surfaces.__getitem__, [], 0, 0
        while k < len(bytes_at):
            at = int(bytes_at[k])
            out += map(surface, tokens[start:at])
            raw = bytearray()
            start = at
            while k < len(bytes_at) and bytes_at[k] == start:
                raw.append(self.of_byte[tokens[start]])
                k, start = k + 1, start + 1
            out.append(_utf8(raw))
        out += map(surface, tokens[start:])
        text = "".join(out)
        if text.startswith(SPACE):
            text = text[1:]
        return text.replace(SPACE, " ")


def _utf8(raw: bytearray) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode("utf-8"))
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_loaded: dict[str, Piece] = {}


def load(path: str) -> Piece:
    """The model, read once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = Piece(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """One row per row of docs: (doc_id, ids array<int>, decoded string).

    A null text counts as empty: the ids are the end id alone, the decoded text is empty.
    `model` is a path that every executor can read (the tokenizer package is installed on each).
    """
    Workspace(docs.sparkSession, "pieces")

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = load(model)
        for batch in batches:
            ids = [piece.encode(t, end) for t in batch["text"].to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = pa.array(np.concatenate([np.empty(0, np.int32), *ids]))
            decoded = pa.array([piece.decode(i) for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(pa.array(ends), flat), decoded], names=["doc_id", "ids", "decoded"])

    return rows.mapInArrow(both, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digests(made: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encode_decode's rows."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))
