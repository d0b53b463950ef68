"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 7)."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how the vocabulary's texts are cut into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept per worker, and the longest word kept: bounds on memory only, words beyond them are encoded anew each time.
CACHE_WORDS, CACHE_BYTES = 300_000, 256


class BytePairEncoder:
    """Ranks of byte strings; merging takes the least rank first, the leftmost of equals."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.words = ranks, {rank: piece for piece, rank in ranks.items()}
        self._split = regex.compile(PATTERN)
        self._cache: dict[str, tuple[int, ...]] = {}

    @classmethod
    def from_file(cls, path: str) -> BytePairEncoder:
        """Read a rank file: per line a base64 byte string and its rank."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())})

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word: a priority queue of merge ranks over a doubly linked list of symbols; entries gone stale are skipped."""
        ranks = self.ranks
        whole = ranks.get(word)
        if whole is not None:
            return (whole,)
        n = len(word)
        symbol: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(rank, i, 2) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, size = heapq.heappop(queue)
            j = right[i] if symbol[i] is not None else -1
            if j < 0 or len(symbol[i]) + len(symbol[j]) != size:
                continue  # one of the two has been merged since
            symbol[i], symbol[j] = symbol[i] + symbol[j], None
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                pair = symbol[i] + symbol[k]
                if (rank := ranks.get(pair)) is not None:
                    heapq.heappush(queue, (rank, i, len(pair)))
            h = left[i]
            if h >= 0:
                pair = symbol[h] + symbol[i]
                if (rank := ranks.get(pair)) is not None:
                    heapq.heappush(queue, (rank, h, len(pair)))
        return tuple(ranks[s] for s in symbol if s is not None)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for an empty or a null one. Strings of special tokens are ordinary text."""
        ids: list[int] = []
        if not text:
            return ids
        known = self._cache
        for word in self._split.findall(text):
            got = known.get(word)
            if got is None:
                got = self.merge(word.encode("utf-8"))
                if len(known) < CACHE_WORDS and len(word) <= CACHE_BYTES:
                    known[word] = got
            ids += got
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text again: the strings of the vocabulary, one after another."""
        return b"".join(self.words[i] for i in ids).decode("utf-8")


@cache
def encoder(path: str) -> BytePairEncoder:
    """The encoder of a rank file, read once per worker."""
    return BytePairEncoder.from_file(path)


def default_ranks() -> str:
    """Place of the vocabulary ``byte_bpe_50k`` of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode_column(docs: DataFrame, *, doc_id: str, text: str, ranks_path: str | None = None) -> DataFrame:
    """``(doc_id, ids array<int>)`` for every row, whole texts, without a shuffle. ``ranks_path`` has to exist on each executor."""
    path = ranks_path or default_ranks()
    kind = docs.schema[doc_id].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            ids = pa.array([bpe.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(encode, f"doc_id {kind}, ids array<int>")


def decode_column(encoded: DataFrame, *, doc_id: str, ids: str, ranks_path: str | None = None) -> DataFrame:
    """``(doc_id, text)``: the texts of id lists; null for null, empty for an empty list."""
    path = ranks_path or default_ranks()
    kind = encoded.schema[doc_id].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            texts = pa.array([None if x is None else bpe.decode(x) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    return encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(decode, f"doc_id {kind}, text string")
