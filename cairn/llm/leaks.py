"""Evaluation texts leaking into training text (problem 8): greedy string tiling over running Karp-Rabin hashes.

Every window of ``least`` words has a running hash. The hashes of the items' windows are the seeds: a table, and a bit field of
bounded size that goes to all workers. One pass over the documents keeps those with a window in the bit field, with the hashes
of such windows; these are joined to the seeds, each hash once per document and item, however often its words repeat. A
document and an item that share a seed are then tiled: the longest common stretches of unmarked words are marked, without
overlap, until none of ``least`` words is left. The marked share of the item is its coverage, however its passages are ordered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cairn.common import materialize

_WORD = re.compile(r"[^\W_]+")
#: Base of the running hash, modulo 2**64, and its inverse.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
#: Bits per seed, and the most bits that the field may have (64 MiB); beyond that more windows pass it, and the join sorts them out.
BITS_PER_SEED, MOST_BITS = 32, 1 << 29
#: Bits of one row that Spark aggregates a bit field in (fixed value).
_CHUNK = 32_768
#: Bytes of text that are turned into numbers at once (a bound on a worker's memory only; one text is never cut).
PART_BYTES = 1 << 23
#: Spellings kept per worker with their code (a bound on memory only).
CACHE_WORDS = 500_000
_known: dict[str, int] = {}


def words(text: str | None) -> list[str]:
    """The longest runs of letters and digits, in lower case."""
    return [w.lower() for w in _WORD.findall(text or "")]


def _code(word: str) -> int:
    """Code of a spelling: a hash of the word in lower case."""
    code = xxhash.xxh3_64_intdigest(word.lower())
    if len(_known) < CACHE_WORDS:
        _known[word] = code
    return code


def codes_of(text: str | None) -> list[int]:
    """Codes of the words of a text."""
    get = _known.get
    return [c if (c := get(w)) is not None else _code(w) for w in _WORD.findall(text or "")]


def running_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hash of every window of ``n`` codes: differences of running sums, moved to one power of the base, modulo 2**64."""
    size = len(codes)
    if size < n:
        return np.empty(0, np.uint64)
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _INVERSE)]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * down, dtype=np.uint64)])
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - n, _BASE)]), dtype=np.uint64)
    return (sums[n:] - sums[:-n]) * up


def _windows(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of all windows of the texts of a batch."""
    codes: list[int] = []
    ends = []
    for t in texts:
        if t:
            codes += codes_of(t)
        ends.append(len(codes))
    hashes = running_hashes(np.array(codes, dtype=np.uint64), n)
    first = np.searchsorted(np.array(ends), np.arange(len(hashes)), side="right")
    last = np.searchsorted(np.array(ends), np.arange(n - 1, n - 1 + len(hashes)), side="right")
    own = first == last
    return first[own], hashes[own]


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about :data:`PART_BYTES` of text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PART_BYTES, side="right")))
        yield batch.slice(at, end - at)
        at = end


# --- tiling ---------------------------------------------------------------------------------------------------------
def _common(doc: np.ndarray, item: np.ndarray, n: int, free_doc: np.ndarray, free_item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the wholly unmarked windows of ``n`` codes that both sides have."""
    sides = []
    for codes, free in ((doc, free_doc), (item, free_item)):
        if len(codes) < n:
            return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
        upto = np.concatenate([[0], np.cumsum(free)])
        whole = np.flatnonzero(upto[n:] - upto[:-n] == n)
        sides.append((whole, running_hashes(codes, n)[whole]))
    (a, x), (b, y) = sides
    keep = np.isin(x, y)
    a, x = a[keep], x[keep]
    keep = np.isin(y, x)
    return a, b[keep], x, y[keep]


def _simple(doc: np.ndarray, item: np.ndarray, least: int, a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]] | None:
    """The tiles where every shared window stands once on each side and the stretches do not overlap; None otherwise."""
    order = np.argsort(y)
    if len(x) != len(y) or (np.diff(np.sort(x)) == 0).any() or (np.diff(y[order]) == 0).any():
        return None
    place = b[order][np.searchsorted(y[order], x)]
    starts = np.flatnonzero(np.r_[True, (np.diff(a) != 1) | (np.diff(place) != 1)])
    length = np.diff(np.r_[starts, len(a)]) + least - 1
    tiles = list(zip(a[starts].tolist(), place[starts].tolist(), length.tolist(), strict=True))
    for side in (0, 1):
        spans = sorted((t[side], t[side] + t[2]) for t in tiles)
        if any(p[1] > q[0] for p, q in zip(spans, spans[1:], strict=False)):
            return None
    return tiles if all((doc[i : i + n] == item[j : j + n]).all() for i, j, n in tiles) else None


def tile(doc: np.ndarray | list[int], item: np.ndarray | list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: tiles ``(place in document, place in item, length)``, the longest unmarked match first, ties by place.

    The greatest length that both sides have is found by doubling and halving; all its matches are marked in order, each place at most once,
    so words that repeat cost no more than others.
    """
    doc, item = np.asarray(doc, dtype=np.uint64), np.asarray(item, dtype=np.uint64)
    free_doc, free_item = np.ones(len(doc), np.int64), np.ones(len(item), np.int64)
    some = _common(doc, item, least, free_doc, free_item)
    if not len(some[0]):
        return []
    tiles = _simple(doc, item, least, *some)
    if tiles is not None:
        return sorted(tiles)
    tiles, most = [], min(len(doc), len(item))
    while len(some[0]):
        # The greatest length of a common unmarked stretch: low has a match, high has none.
        low, found, high = least, some, most + 1
        step = least
        while low + step < high:
            got = _common(doc, item, low + step, free_doc, free_item)
            if len(got[0]):
                low, found, step = low + step, got, 2 * step
            else:
                high = low + step
        while high - low > 1:
            middle = (low + high) // 2
            got = _common(doc, item, middle, free_doc, free_item)
            if len(got[0]):
                low, found = middle, got
            else:
                high = middle
        most = low
        a, b, x, y = found
        order = np.argsort(y, kind="stable")
        places, keys = b[order].tolist(), y[order]
        firsts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        at = {h: [s, e] for h, s, e in zip(keys[firsts].tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(keys)], strict=True)}
        until, marked = -1, len(tiles)
        for i, h in zip(a.tolist(), x.tolist(), strict=True):
            if i < until:
                continue
            span = at[h]
            while span[0] < span[1]:
                j = places[span[0]]
                if free_item[j] and free_item[j + low - 1] and (doc[i : i + low] == item[j : j + low]).all():  # a hash is no proof
                    tiles.append((i, j, low))
                    free_doc[i : i + low] = free_item[j : j + low] = 0
                    until = i + low
                    break
                span[0] += 1
        if len(tiles) == marked:
            most -= 1  # nothing but equal hashes of unequal words
            if most < least:
                break
        some = _common(doc, item, least, free_doc, free_item)
    return sorted(tiles)


# --- search ---------------------------------------------------------------------------------------------------------
def _seeds(items: DataFrame, least: int) -> DataFrame:
    """``(item_id, seed)``: the distinct window hashes of each item."""
    kind = items.schema["item_id"].dataType.simpleString()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in _parts(b, 1)):
            at, h = _windows(batch.column(1).to_pylist(), least)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(h.view(np.int64))], ["item_id", "seed"])

    return items.mapInArrow(hashes, f"item_id {kind}, seed bigint").distinct()


def _slot(seed: np.ndarray, bits: int) -> np.ndarray:
    return (seed * _SPREAD) >> np.uint64(64 - (bits - 1).bit_length())


def _bit_field(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """Packed bits of the seeds' slots, at most :data:`MOST_BITS`, and their number. Spark gathers the bits in rows of 4 KiB each."""
    n = seeds.count()
    bits = 1 << max(15, min(MOST_BITS.bit_length() - 1, (BITS_PER_SEED * n).bit_length()))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_slot(batch.column(0).to_numpy().view(np.uint64), bits).astype(np.int64))], ["slot"])

    rows = seeds.select("seed").mapInArrow(slots, "slot bigint").distinct()
    per = rows.groupBy((F.col("slot") / _CHUNK).cast("int").alias("chunk")).agg(F.bitmap_construct_agg(F.col("slot") % _CHUNK).alias("bits")).collect()  # at most MOST_BITS
    field = np.zeros(bits // 8, np.uint8)
    for r in per:
        field[r["chunk"] * (_CHUNK // 8) : (r["chunk"] + 1) * (_CHUNK // 8)] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return field, bits


def leaked_passages(docs: DataFrame, items: DataFrame, *, doc_id: str, item_id: str, text: str = "text", least: int = 13) -> DataFrame:
    """``(doc_id, item_id, n_tiles, longest, covered, item_words)`` of every document and item with ``least`` consecutive words in common.

    Whole texts on both sides; null, empty and short texts share nothing; items with the same text are each reported. A repeated row of
    ``docs`` or ``items`` (same id and text) counts once. Documents are read once whatever the number of items; only those with a seed are kept,
    in the shared folder, and only what workers hold of the items is broadcast: the bit field.
    """
    spark = docs.sparkSession
    doc_kind, item_kind = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    own = items.where(F.col(text).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("item_text"))
    seeds = materialize(_seeds(own, least), "seeds")
    held = spark.sparkContext.broadcast(_bit_field(seeds))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, bits = held.value
        for batch in (p for b in batches for p in _parts(b, 1)):
            texts = batch.column(1).to_pylist()
            at, h = _windows(texts, least)
            slot = _slot(h, bits)
            hit = (field[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
            at, h = at[hit], h[hit]
            rows, sizes = np.unique(at, return_counts=True)
            ids = batch.column(0).take(pa.array(rows))
            keys = [xxhash.xxh3_128_hexdigest(f"{d}\0{texts[i]}".encode("utf-8", "surrogatepass")) for d, i in zip(ids.to_pylist(), rows.tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), ids, batch.column(1).take(pa.array(rows)), lists], ["row", "doc_id", "text", "seeds"])

    left = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kept = materialize(left.mapInArrow(hits, f"row string, doc_id {doc_kind}, text string, seeds array<bigint>"), "leaks")
    pairs = kept.select("row", F.explode(F.array_distinct("seeds")).alias("seed")).join(seeds, "seed").select("row", "item_id").distinct()
    both = pairs.join(kept.select("row", "doc_id", "text").dropDuplicates(["row"]), "row").join(own.distinct(), "item_id").select("doc_id", "item_id", "text", "item_text")
    names = ["n_tiles", "longest", "covered", "item_words"]

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = lambda t: np.array(codes_of(t), dtype=np.uint64)
        for batch in batches:
            at, found = [], []
            for i, (d, t) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                item = code(t)
                if got := tile(code(d), item, least):
                    at.append(i)
                    found.append((len(got), max(x[2] for x in got), sum(x[2] for x in got), len(item)))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *[pa.array([f[k] for f in found], pa.int32()) for k in range(4)]], ["doc_id", "item_id", *names])

    return both.mapInArrow(tiles, f"doc_id {doc_kind}, item_id {item_kind}, " + ", ".join(f"{n} int" for n in names))


def contaminated(passages: DataFrame, coverage: float = 0.5) -> DataFrame:
    """Documents that hold at least ``coverage`` of an item, its passages in whatever order; only passages of the minimum length of the search count."""
    return passages.where(F.col("covered") >= F.lit(coverage) * F.col("item_words"))
