"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

The rank file (one ``base64(bytes) rank`` pair a line) becomes a serialised sentencepiece BPE model:
each byte ``b`` is written as the character ``chr(256 + b)``, each token as the string of its bytes'
characters, scored with its negative rank, so that the library's best-score-first merging is the
lowest-rank-first merging of the vocabulary. The normaliser is the identity. Nothing is trained.

Defined results: a null text is the empty text; the empty text has no ids and decodes to no bytes;
an empty table gives no rows; columns beside the id and the text are not read; repeated rows give repeated
results. A text is encoded whole, however long.
"""

from __future__ import annotations

import base64
import struct
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table, text_or_empty

#: First code point of the 256 characters that stand for bytes; none of them is white space.
BYTE_BASE = 256
#: Pre-token results a Python worker remembers before it starts afresh.
REMEMBERED = 200_000
UNKNOWN = "<unk>"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def as_characters(data: bytes) -> str:
    return data.decode("latin-1").translate(_TO_CHARACTERS)


_TO_CHARACTERS = {b: chr(BYTE_BASE + b) for b in range(256)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int) -> bytes:
    """A protobuf field: bytes with their length, or a varint."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised model; piece k is the token of rank k, and the unknown piece comes last."""
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    normal, unknown, bpe = 1, 2, 2
    pieces = [(as_characters(token), -float(rank), normal) for token, rank in by_rank]
    pieces.append((UNKNOWN, 0.0, unknown))
    body = b"".join(
        _field(1, _field(1, p.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _field(3, kind))
        for p, score, kind in pieces
    )
    minus_one = (1 << 64) - 1
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(pieces) - 1)
    trainer += _field(41, minus_one) + _field(42, minus_one) + _field(43, minus_one)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return body + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes one text at a time; remembers what it made of recent chunks of text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.tokens = [token for token, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.chunks = _Memory(self._chunk)
        self.odd_space = regex.compile(r"\s |^ | \s| $").search

    def _chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        for pre_token in self.find(chunk):
            data = pre_token.encode("utf-8", "replace")
            known = self.ranks.get(data)
            if known is not None:
                ids.append(known)
            else:
                ids += self.model.encode(as_characters(data), num_threads=1)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        # A space between two characters that are no white space always opens a pre-token,
        # so the chunks that begin at such spaces can be encoded one by one.
        if self.odd_space(text):
            chunks, pieces = [], text.split(" ")
            for k, piece in enumerate(pieces):
                if k and piece and not piece[0].isspace() and pieces[k - 1] and not pieces[k - 1][-1].isspace():
                    chunks.append(" " + piece)
                elif k:
                    chunks[-1] += " " + piece
                else:
                    chunks.append(piece)
        else:
            first, *rest = text.split(" ")
            chunks = [first, *map(" ".__add__, rest)]
        out = b"".join(map(self.chunks.__getitem__, chunks))
        if len(self.chunks) > REMEMBERED:
            self.chunks.clear()
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


class _Memory(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) < 64:
            self[key] = value
        return value


@cache
def codec(ranks_path: str | None = None, pattern: str | None = None) -> Codec:
    """One codec a Python process; without a path, the public 50k vocabulary and its pattern."""
    import public_tokenizers

    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return Codec(load_ranks(path), pattern or public_tokenizers.PATTERN)


def encode(df: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens for each row of (doc_id, text)."""

    def start():
        one = codec(ranks_path, pattern).encode

        def step(batch):
            ids = [one(text) for text in batch["text"]]
            return {"doc_id": batch["doc_id"], "ids": ids, "n_tokens": [len(x) // 4 for x in ids]}

        return step

    rows = df.select("doc_id", text_or_empty().alias("text"))
    return map_batches(rows, "doc_id long, ids binary, n_tokens long", start)


def decode(df: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The rows of :func:`encode` with their bytes in ``decoded``."""

    def start():
        one = codec(ranks_path, pattern).decode
        return lambda batch: batch | {"decoded": [one(ids) for ids in batch["ids"]]}

    rows = df.select("doc_id", "ids", "n_tokens")
    return map_batches(rows, "doc_id long, ids binary, n_tokens long, decoded binary", start)


def round_trip(df: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """:func:`encode` and then :func:`decode`, in one pass, as two would need two Python workers for each core."""

    def start():
        one = codec(ranks_path, pattern)

        def step(batch):
            ids = [one.encode(text) for text in batch["text"]]
            decoded = [one.decode(x) for x in ids]
            return {"doc_id": batch["doc_id"], "ids": ids, "n_tokens": [len(x) // 4 for x in ids], "decoded": decoded}

        return step

    rows = df.select("doc_id", text_or_empty().alias("text"))
    return map_batches(rows, "doc_id long, ids binary, n_tokens long, decoded binary", start)


def unpack_ids(ids: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


def digest(docs: DataFrame) -> DataFrame:
    return round_trip(docs).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
