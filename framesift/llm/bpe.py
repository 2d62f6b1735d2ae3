"""Byte-level BPE encoding and decoding over Arrow batches.

Each match of the pre-token pattern is encoded by the model of the ``tokenizers`` library, whose
vocabulary writes every byte as one printable character; a worker process remembers the ids of
pieces it has met. Decoding reverses that table: a token's characters
give its bytes, so tokens that hold only a part of a UTF-8 character still decode, and offsets map
such a token to the character that its bytes belong to.

Null texts count as empty; repeated rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from framesift.llm.common import Remembered, arrow_map, cut_points, text_groups

#: Characters of a text that are encoded at a time, and pre-tokens that a task remembers.
RUN_CHARS, CACHE = 1 << 18, 200_000


def byte_table() -> dict[str, int]:
    """Character -> byte. Printable Latin-1 stands for itself; the other bytes follow from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder of one vocabulary file; see ``byte_bpe`` for the one of a worker process."""

    def __init__(self, vocabulary: str, pattern: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(vocabulary)
        self.model = whole.model
        self.pieces = regex.compile(pattern).findall
        reverse = byte_table()
        self.printable = {b: c for c, b in reverse.items()}
        special = {i for i in whole.get_added_tokens_decoder()}
        names = [whole.id_to_token(i) or "" for i in range(whole.get_vocab_size(with_added_tokens=True))]
        self.bytes_of = [t.encode() if i in special else bytes(reverse[c] for c in t) for i, t in enumerate(names)]
        self.decimal = [str(i) for i in range(len(names))]
        self.known = Remembered(self._ids, CACHE)

    def _ids(self, piece: str) -> bytes:
        """What the library's model makes of a piece, byte by byte as printable characters."""
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.printable))
        return array("I", [t.id for t in tokens]).tobytes()

    def encode(self, text: str) -> Iterable[list[int]]:
        """The text's ids, run after run."""
        for run in cut_points(text, RUN_CHARS):
            yield array("I", b"".join(map(self.known.__getitem__, self.pieces(run)))).tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes that the ids stand for; characters split over tokens come together again."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First character and end (exclusive) of each token; a token inside a character covers that character."""
        lengths = np.fromiter((len(self.bytes_of[i]) for i in ids), np.int64, len(ids))
        ends = np.cumsum(lengths)
        raw = np.frombuffer(text.encode(), np.uint8)
        at = np.cumsum((raw & 0xC0) != 0x80) - 1  # each byte's character
        return at[ends - lengths], at[ends - 1] + 1


@functools.lru_cache(maxsize=2)
def byte_bpe(vocabulary: str, pattern: str) -> ByteBpe:
    """One encoder for a worker process, whose tasks share what it remembers."""
    return ByteBpe(vocabulary, pattern)


def encode_ids(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id column, ids, and start and end of every token in characters."""
    schema = f"`{id_col}` {_type(df, id_col)}, ids array<int>, starts array<int>, ends array<int>"

    def make():
        bpe = byte_bpe(vocabulary, pattern)

        def work(batch: pa.RecordBatch):
            for start, texts in text_groups(batch):
                ids = [list(chain.from_iterable(bpe.encode(t))) for t in texts]
                starts, ends = zip(*(bpe.offsets(t, i) if i else ([], []) for t, i in zip(texts, ids)))
                yield {id_col: batch.column("key").slice(start, len(texts)), "ids": ids, "starts": starts, "ends": ends}

        return work

    return arrow_map(df, {"key": id_col, "text": text_col}, schema, make)


def decode_ids(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per document: the id column and its bytes (null ids: empty)."""
    schema = f"`{id_col}` {_type(df, id_col)}, content binary"

    def make():
        bpe = byte_bpe(vocabulary, pattern)

        def work(batch: pa.RecordBatch):
            yield {id_col: batch.column("key"), "content": [bpe.decode(i or []) for i in batch.column("ids").to_pylist()]}

        return work

    return arrow_map(df, {"key": id_col, "ids": ids_col}, schema, make)


def round_trip(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest form of encode and decode: n_tokens, ids_sha256 and decoded_sha256 of each document.

    Texts pass through in runs, so memory is bounded by a run and the text, not by its tokens.
    """
    schema = f"`{id_col}` {_type(df, id_col)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def make():
        bpe = byte_bpe(vocabulary, pattern)

        def digest(text: str) -> tuple[int, str, str]:
            n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
            for ids in bpe.encode(text):
                if ids:
                    ids_hash.update(((" " if n else "") + " ".join(map(bpe.decimal.__getitem__, ids))).encode())
                    text_hash.update(bpe.decode(ids))
                    n += len(ids)
            return n, ids_hash.hexdigest(), text_hash.hexdigest()

        def work(batch: pa.RecordBatch):
            for start, texts in text_groups(batch):
                n, a, b = zip(*map(digest, texts))
                yield {id_col: batch.column("key").slice(start, len(texts)), "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

        return work

    return arrow_map(df, {"key": id_col, "text": text_col}, schema, make)


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()
