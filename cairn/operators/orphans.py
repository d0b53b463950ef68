"""References to records that do not exist (problem 4).

Keys are split into ranges by hash, as many as their number asks for; within a range they are dictionary-encoded as integers,
the references and the parents of each period become compressed bitmaps over those integers, and the surviving bits of
``reference AND NOT parent`` are decoded to keys. From one period to the next only those containers of the parents' bitmap are
made anew in which a parent comes or goes. Only distinct keys reach that step, so hot keys cost nothing; the rows that hold an
orphan key are found by a join in which every frequent key is salted by its count.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.common import materialize

#: Distinct references of one key range: what one task holds in Python, with the parents of their keys.
RANGE_KEYS = 200_000
#: A key with more than this part of all references is salted; there can be no more such keys than that.
HOT_PARTS = 512


class PackedBits:
    """Compressed bitmap in containers of 2**13 bits: sparse ones as sorted offsets, dense ones as deflated words."""

    SHIFT = 13
    SPARSE = 512

    def __init__(self, parts: dict[int, tuple[bool, bytes]] | None = None):
        self.parts = parts or {}

    @classmethod
    def of(cls, codes: np.ndarray) -> PackedBits:
        codes = np.unique(np.asarray(codes, dtype=np.int64))
        high = codes >> cls.SHIFT
        parts = {}
        for part in np.split(codes, np.flatnonzero(high[1:] != high[:-1]) + 1) if len(codes) else []:
            parts[int(part[0] >> cls.SHIFT)] = cls._pack((part & ((1 << cls.SHIFT) - 1)).astype(np.uint16))
        return cls(parts)

    @classmethod
    def _pack(cls, low: np.ndarray) -> tuple[bool, bytes]:
        if len(low) <= cls.SPARSE:
            return False, low.tobytes()
        bits = np.zeros(1 << cls.SHIFT, dtype=np.uint8)
        bits[low] = 1
        return True, zlib.compress(np.packbits(bits).tobytes(), 1)

    @classmethod
    def _bits(cls, part: tuple[bool, bytes]) -> np.ndarray:
        if part[0]:
            return np.unpackbits(np.frombuffer(zlib.decompress(part[1]), dtype=np.uint8))
        bits = np.zeros(1 << cls.SHIFT, dtype=np.uint8)
        bits[np.frombuffer(part[1], dtype=np.uint16)] = 1
        return bits

    def and_not(self, other: PackedBits) -> PackedBits:
        out = {}
        for high, part in self.parts.items():
            if high not in other.parts:
                out[high] = part
                continue
            left = np.flatnonzero(self._bits(part) & ~self._bits(other.parts[high]) & 1)
            if len(left):
                out[high] = self._pack(left.astype(np.uint16))
        return PackedBits(out)

    def union(self, other: PackedBits) -> PackedBits:
        out = dict(other.parts)
        for high, part in self.parts.items():
            out[high] = self._pack(np.flatnonzero(self._bits(part) | self._bits(other.parts[high])).astype(np.uint16)) if high in other.parts else part
        return PackedBits(out)

    def codes(self) -> np.ndarray:
        found = [np.flatnonzero(self._bits(p)).astype(np.int64) + (h << self.SHIFT) for h, p in sorted(self.parts.items())]
        return np.concatenate(found) if found else np.empty(0, dtype=np.int64)


class Alive:
    """Bitmap of the parents that exist at a period, moved forward through the periods in order."""

    def __init__(self, codes: np.ndarray, since: np.ndarray, until: np.ndarray, size: int):
        at = np.concatenate([since, until])
        order = np.argsort(at, kind="stable")
        self.at, self.code, self.step = at[order], np.concatenate([codes, codes])[order], np.repeat([1, -1], len(codes))[order]
        self.count = np.zeros(size, dtype=np.int32)  # parents that hold each code now
        self.done, self.bits = 0, PackedBits()

    def move(self, period: int) -> PackedBits:
        """What exists at ``period``, which is not less than that of the call before."""
        end = int(np.searchsorted(self.at, period, side="right"))
        if end > self.done:
            codes = self.code[self.done : end]
            np.add.at(self.count, codes, self.step[self.done : end])
            for high in np.unique(codes >> PackedBits.SHIFT):
                low = np.flatnonzero(self.count[high << PackedBits.SHIFT : (high + 1) << PackedBits.SHIFT] > 0)
                if len(low):
                    self.bits.parts[int(high)] = PackedBits._pack(low.astype(np.uint16))
                else:
                    self.bits.parts.pop(int(high), None)
            self.done = end
        return self.bits


def orphans_of_range(refs: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
    """Orphan ``(field, key, period, n)`` of one key range. refs: field, key, period, n (rows that refer so); parents: field, key, since, until (exclusive)."""
    found = []
    for field, own in refs.groupby("field"):
        above = parents[parents["field"] == field]
        above = above[above["since"] < above["until"]]
        words = pd.Index(pd.unique(np.concatenate([own["key"].to_numpy(object), above["key"].to_numpy(object)])))  # the dictionary
        alive = Alive(words.get_indexer(above["key"]), above["since"].to_numpy(np.int64), above["until"].to_numpy(np.int64), len(words))
        own = own.assign(code=words.get_indexer(own["key"])).sort_values(["period", "code"])
        period, code = own["period"].to_numpy(np.int64), own["code"].to_numpy(np.int64)
        starts = np.flatnonzero(np.r_[True, period[1:] != period[:-1]]) if len(period) else []
        for a, b in zip(starts, [*starts[1:], len(period)], strict=True):
            lost = PackedBits.of(code[a:b]).and_not(alive.move(int(period[a]))).codes()
            if len(lost):
                rows = own.iloc[a:b]
                found.append(rows[np.isin(code[a:b], lost)][["field", "key", "period", "n"]])
    return pd.concat(found) if found else pd.DataFrame({"field": pd.Series(dtype=object), "key": pd.Series(dtype=object), "period": pd.Series(dtype=np.int64), "n": pd.Series(dtype=np.int64)})


def orphan_keys(refs: DataFrame, parents: DataFrame, ranges: int) -> DataFrame:
    """Distinct orphan ``(field, key, period, n)``, ``n`` being the rows that refer so.

    refs: ``field string, key string, period bigint``; parents: ``field, key, since bigint, until bigint``. Null keys and
    periods refer to nothing; a parent with a null key or ``since`` never exists, a null ``until`` never ends. Repeated rows
    are reduced first.
    """
    forever = F.lit(2**62)
    r = refs.where(F.col("key").isNotNull() & F.col("period").isNotNull()).groupBy("field", "key", F.col("period").cast("bigint").alias("period")).agg(F.count("*").alias("n"))
    p = parents.where(F.col("key").isNotNull() & F.col("since").isNotNull()).select("field", "key", F.col("since").cast("bigint"), F.coalesce(F.col("until").cast("bigint"), forever).alias("until")).distinct()
    rng = F.pmod(F.xxhash64("key"), F.lit(ranges)).cast("int").alias("range")

    def and_not(_key: tuple, own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        return orphans_of_range(own, above)

    left, right = r.select(rng, "*").groupBy("range"), p.select(rng, "*").groupBy("range")
    return left.cogroup(right).applyInPandas(and_not, "field string, key string, period bigint, n bigint")


def find_orphans(rows: DataFrame, parents: DataFrame, *, row_id: str, period: str, fields: dict[str, str], ranges: int | None = None, hot_parts: int = HOT_PARTS) -> DataFrame:
    """``(field, period, row_id)`` of every row that holds an orphan reference, one per row id, field and period.

    fields: name of the field -> SQL expression of its key in ``rows``. ``ranges``: by default as many as the distinct references and
    parents need at :data:`RANGE_KEYS` each. A missing key may be that of a third of all rows: keys with more than one ``hot_parts``-th of all
    references, of which there are fewer than ``hot_parts``, are known to every task and cut into pieces of that size in the join back to the rows.
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.expr(e).alias("key")) for n, e in fields.items()]))
    refs = rows.select(F.col(row_id).alias("row_id"), F.col(period).cast("bigint").alias("period"), each.alias("x")).select("row_id", "period", "x.field", "x.key").where(F.col("key").isNotNull() & F.col("period").isNotNull() & F.col("row_id").isNotNull())
    keys = refs.agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("field", "key", "period")).alias("d")).first()
    if ranges is None:
        above = parents.agg(F.approx_count_distinct(F.xxhash64("field", "key", "since", "until"))).first()[0]
        ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(keys["d"] + above) // RANGE_KEYS))
    piece = max(1, -(-keys["n"] // hot_parts))
    lost = materialize(orphan_keys(refs, parents, ranges).withColumn("salts", F.ceil(F.col("n") / F.lit(piece)).cast("int")).drop("n"), "orphans")
    hot = F.broadcast(lost.where("salts > 1"))  # fewer than hot_parts rows
    salt = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("row_id"), F.col("salts")).cast("int")).otherwise(0)
    salted = refs.join(hot, ["field", "key", "period"], "left").withColumn("salt", salt).drop("salts")
    pieces = lost.select("field", "key", "period", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return salted.join(pieces, ["field", "key", "period", "salt"], "left_semi").select("field", "period", "row_id").distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Number of orphan references per field and period."""
    return orphans.groupBy("field", "period").agg(F.count("*").alias("n_orphans"))
