"""Versioned sets of rows: active revisions, staged changes, overlays, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def active_facts(facts: DataFrame, active: DataFrame, keys: list[str]) -> DataFrame:
    """Facts of the active revisions: inner join with the pointer rows, each once. Null keys are never active."""
    return facts.join(active.select(*keys).distinct(), keys, "left_semi")


def effective(active: DataFrame, pending: DataFrame, key: str, tombstone: str) -> DataFrame:
    """What will hold once the pending changes are in: active rows without a pending one, and the pending rows that are no tombstones."""
    return active.join(pending.select(key).distinct(), key, "left_anti").unionByName(pending.where(~F.coalesce(F.col(tombstone), F.lit(False))).drop(tombstone))


def overlaid(base: DataFrame, overlay: DataFrame, path: str) -> DataFrame:
    """Base rows of paths without an overlay, and the overlay's rows."""
    return base.join(overlay.select(path).distinct(), path, "left_anti").unionByName(overlay)


def obsolete(revisions: DataFrame, active: DataFrame, pending: DataFrame, leased: DataFrame, key: str) -> DataFrame:
    """Revisions that are neither active nor staged nor read by anybody."""
    out = revisions
    for kept in (active, pending, leased):
        out = out.join(kept.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return out


def unchanged(candidates: DataFrame, stored: DataFrame, keys: list[str], mtime: str) -> DataFrame:
    """Candidates that need no new parse: all keys equal those stored, with a modification time that is known."""
    return candidates.join(stored.where(F.col(mtime) != 0).select(*keys).distinct(), keys, "left_semi")


def to_parse(candidates: DataFrame, stored: DataFrame, keys: list[str], mtime: str) -> DataFrame:
    """The other candidates."""
    return candidates.join(stored.where(F.col(mtime) != 0).select(*keys).distinct(), keys, "left_anti")


def missing(stored: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Stored keys that were not seen again: the tombstones to stage."""
    return stored.select(key).distinct().join(seen.select(key).distinct(), key, "left_anti")


def unreferenced(dictionary: DataFrame, key: str, *columns: DataFrame) -> DataFrame:
    """Dictionary rows that no referring column holds. columns: frames of one column each."""
    used = None
    for c in columns:
        part = c.toDF(key)
        used = part if used is None else used.unionByName(part)
    return dictionary.join(used.where(F.col(key).isNotNull()).distinct(), key, "left_anti")
