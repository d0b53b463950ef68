"""Subject area of each document (problem 9): seeded non-negative factorisation of the document-term matrix.

The matrix (hashed words and word pairs of whole texts) is written once and factored by alternating multiplicative
updates under the Kullback-Leibler divergence, under which a document's weight in a component is the number of its
terms that the component accounts for. One component is anchored to each subject: it starts from the labelled documents
and from the subject's description, and may only use terms that the labelled documents of the subject have more often
than others. Free components take up what belongs to no subject. The weights thus are subject mixtures at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.common import materialize

#: Odd multipliers of the hashes of pairs and of terms.
_PAIR, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Letters(dict):
    """Translation that leaves letters and makes a space of everything else."""

    def __missing__(self, code: int) -> int:
        self[code] = out = code if chr(code).isalpha() else 32
        return out


_LETTERS = _Letters()
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(frozen=True)
class Settings:
    """Sizes that bound what is gathered on the driver (dimensions x components numbers), and the thresholds of the decision."""

    dimensions: int = 1 << 18  # a power of two
    free: int = 4  # components without a subject
    rounds: int = 5
    inner: int = 4  # updates of the weights in each round
    labelled: int = 20_000  # documents with labels that are used as seeds, at most
    least_df: int = 3
    most_df: float = 0.25  # of all documents; does not hold for a term of one subject
    purity: float = 0.3  # share of a term's labelled documents that has to be its subject's for the term to be anchored to it
    strong: float = 0.5  # share from which on free components may not use the term
    doubt: float = 2.0  # documents at the base rates that are added before those shares are taken
    mass: float = 7.0  # terms that a subject must account for: more than one mention of one of its terms makes
    share: float = 0.1  # of all terms that subjects account for in the document


#: Spellings kept per worker with their number (a bound on memory only).
CACHE_WORDS = 200_000
_known: dict[str, int] = {}


def _number(word: str) -> int:
    """Number of a word without letter case and plural s; nought for a single letter."""
    w = word.lower()
    if len(w) > 3 and w[-1] == "s" and w[-2] != "s":
        w = w[:-1]
    n = crc32(w.encode()) + 1 if len(w) > 1 else 0
    if len(_known) < CACHE_WORDS:
        _known[word] = n
    return n


def hashed(texts: list[str | None], dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed counts of the words of texts and of their pairs of words with one character between, identifiers split into words: offsets of the texts, terms, counts. A null or blank text has none."""
    get = _known.get
    numbers: list[int] = []
    ends = [0]
    for text in texts:
        if text:
            # Two separators in a row leave an empty word between, which pairs with nothing.
            numbers += [n if (n := get(w)) is not None else _number(w) for w in _HUMP.sub(" ", text).translate(_LETTERS).split(" ")]
        numbers.append(0)
        ends.append(len(numbers))
    words = np.array(numbers, dtype=np.uint64)
    of = np.repeat(np.arange(len(texts)), np.diff(ends))
    both = (words[:-1] != 0) & (words[1:] != 0)
    pairs = (words[:-1][both] * _PAIR) ^ words[1:][both]
    shift = np.uint64(64 - (dimensions - 1).bit_length())
    some = words != 0
    term = np.concatenate([words[some], pairs]) * _SPREAD >> shift
    key, count = np.unique(np.concatenate([of[some], of[:-1][both]]).astype(np.int64) * dimensions + term.astype(np.int64), return_counts=True)
    return np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.int64) * dimensions), key % dimensions, count


def term_matrix(docs: DataFrame, *, doc_id: str, text: str, settings: Settings) -> DataFrame:
    """``(doc_id, idx array<int>, cnt array<float>)`` of every row, written to the shared folder."""
    kind, size = docs.schema[doc_id].dataType.simpleString(), settings.dimensions

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, term, count = hashed(batch.column(1).to_pylist(), size)
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(values)) for values in (term.astype(np.int32), count.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", "idx", "cnt"])

    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(vectors, f"doc_id {kind}, idx array<int>, cnt array<float>")
    return materialize(found, "terms")


def seed_labels(labels: DataFrame, areas: list[str], *, doc_id: str, subject: str, limit: int) -> dict:
    """Votes per labelled document as ``{doc_id: vector}``, of at most ``limit`` documents (the least by hash). Spelling variants of a subject are one; unknown and null subjects are no votes."""
    place = {plain(a): i for i, a in enumerate(areas)}
    name = F.regexp_replace(F.lower(F.trim(F.col(subject))), r"[\s\-_]+", "_")
    votes = labels.where(F.col(doc_id).isNotNull() & name.isin(list(place))).groupBy(F.col(doc_id).alias("doc_id")).agg(F.collect_set(name).alias("names"), F.count("*").alias("n"))
    kept = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    out = {}
    for r in kept.collect():  # at most ``limit`` rows of a few names
        v = np.zeros(len(areas), dtype=np.float32)
        v[[place[n] for n in r["names"]]] = 1 / len(r["names"])
        out[r["doc_id"]] = v
    return out


def plain(subject: str) -> str:
    """The spelling under which subjects are compared."""
    return re.sub(r"[\s\-_]+", "_", subject.strip().lower())


@dataclass(frozen=True)
class Factor:
    """A factor by term: the components that have it, and with what value."""

    components: int
    sizes: np.ndarray
    starts: np.ndarray
    comp: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, h: np.ndarray) -> Factor:
        """From components x terms."""
        term, comp = np.nonzero(h.T)
        sizes = np.bincount(term, minlength=h.shape[1])
        return cls(h.shape[0], sizes, np.cumsum(sizes) - sizes, comp, h[comp, term])


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, term and count of each entry of a batch."""
    lists = batch.column(1)
    sizes = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(sizes)), sizes), lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy().astype(np.float32)


def _weights(row: np.ndarray, idx: np.ndarray, cnt: np.ndarray, n: int, factor: Factor, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weights of ``n`` documents (n x components), and what each entry gives to each component that its term has: term, component and amount.

    Entries are spread over the components of their term only; those whose term belongs to one component are its from the start.
    """
    k = factor.components
    size = factor.sizes[idx]
    first = np.cumsum(size) - size
    at = np.repeat(factor.starts[idx] - first, size) + np.arange(size.sum())  # places in the factor's list
    comp, value = factor.comp[at], factor.value[at]
    cell = np.repeat(row, size) * k + comp
    alone = np.repeat(size == 1, size)
    amount = np.repeat(cnt, size)
    sure = np.bincount(cell[alone], weights=amount[alone], minlength=n * k)
    shared = np.flatnonzero(~alone)
    cells, values, counts = cell[shared], value[shared], cnt[size > 1]
    group = size[size > 1]
    begins = np.cumsum(group) - group
    w = np.ones(n * k)
    p = values
    for _ in range(steps if len(shared) else 0):
        p = values * w[cells]
        p *= np.repeat(counts / np.maximum(np.add.reduceat(p, begins), 1e-30), group)
        w = sure + np.bincount(cells, weights=p, minlength=n * k)
    if len(shared):
        amount[shared] = p
    else:
        w = sure
    return w.reshape(n, k), np.repeat(idx, size), comp, amount


def _summed(matrix: DataFrame, partial, width: int, size: int) -> np.ndarray:
    """Sum over the corpus of what ``partial`` adds per term: each task sums its rows, Spark the tasks. Gives ``width x size``."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, width), dtype=np.float64)
        for batch in batches:
            if len(batch):
                partial(batch, total)
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[pa.array(total[at, i]) for i in range(width)]], ["t", *[f"v{i}" for i in range(width)]])

    cols = [f"v{i}" for i in range(width)]
    rows = matrix.mapInArrow(tasks, "t int, " + ", ".join(f"{c} double" for c in cols))
    got = rows.groupBy("t").agg(*[F.sum(c).alias(c) for c in cols]).toPandas()  # at most ``size`` rows
    out = np.zeros((width, size))
    out[:, got["t"].to_numpy(np.int64)] = got[cols].to_numpy().T
    return out


def _add(total: np.ndarray, idx: np.ndarray, column: int, weights: np.ndarray) -> None:
    total[:, column] += np.bincount(idx, weights=weights, minlength=len(total))


def factor(spark: SparkSession, matrix: DataFrame, votes: dict, areas: DataFrame, names: list[str], settings: Settings) -> np.ndarray:
    """Components x dimensions; the first ones are the subjects in the order of ``names``."""
    k, size = len(names), settings.dimensions
    shared = spark.sparkContext.broadcast(votes)  # bounded by settings.labelled

    def seeds(batch: pa.RecordBatch, total: np.ndarray) -> None:
        row, idx, cnt = _flat(batch)
        _add(total, idx, 2 * k, cnt)
        _add(total, idx, 2 * k + 1, np.ones(len(idx)))
        votes_of = [(i, v) for i, d in enumerate(batch.column(0).to_pylist()) if (v := shared.value.get(d)) is not None]
        if votes_of:
            y = np.zeros((len(batch), k), np.float32)
            y[[i for i, _ in votes_of]] = np.stack([v for _, v in votes_of])
            labelled = y.any(axis=1)[row]
            row, idx, cnt = row[labelled], idx[labelled], cnt[labelled]
            for i in range(k):
                own = y[row, i]
                some = own > 0
                _add(total, idx[some], i, cnt[some] * own[some])
                _add(total, idx[some], k + i, own[some])

    sums = _summed(matrix, seeds, 2 * k + 2, size)
    n_docs = max(1, matrix.count())
    under, docs_under, total, df = sums[:k], sums[k : 2 * k], sums[2 * k], sums[2 * k + 1]
    for i, name in enumerate(names):  # the description counts as a few documents of its subject
        _, idx, cnt = hashed([f"{name.replace('_', ' ')} {areas.get(name) or ''}"], size)
        under[i, idx] += 3 * cnt
        docs_under[i, idx] += 3
    usable = (df >= settings.least_df) & (df <= max(settings.most_df * n_docs, settings.least_df))
    rate = total / max(1.0, total.sum())
    own = under / np.maximum(under.sum(axis=1, keepdims=True), 1.0)
    base = sum(votes.values(), np.full(k, 1e-3, np.float32))
    base = (base / base.sum())[:, None]
    pure = (docs_under + settings.doubt * base) / (docs_under.sum(axis=0) + settings.doubt)
    seen = docs_under > 0
    # However many documents use it, a term belongs to a subject of which its labelled documents are that much more often than all are.
    own_term = (df >= settings.least_df) & seen & (pure >= base + settings.strong * (1 - base))
    anchored = np.where(seen, pure >= settings.purity, docs_under.sum(axis=0) == 0) & usable | own_term
    taken = (seen & (pure >= settings.strong)).any(axis=0)
    rng = np.random.default_rng(7)
    h = np.zeros((k + settings.free, size))
    h[:k] = np.where(anchored & seen, np.maximum(own - rate, 0), 0) + anchored * 1e-9
    h[k:] = (usable & ~taken) * rate * rng.uniform(0.8, 1.2, (settings.free, size))
    h = _rows_to_one(h)
    for _ in range(settings.rounds):
        now = spark.sparkContext.broadcast(Factor.of(h))

        def update(batch: pa.RecordBatch, total: np.ndarray, now=now) -> None:
            row, idx, cnt = _flat(batch)
            keep = now.value.sizes[idx] > 0
            if keep.any():
                _, term, comp, amount = _weights(row[keep], idx[keep], cnt[keep], len(batch), now.value, settings.inner)
                total += np.bincount(term.astype(np.int64) * total.shape[1] + comp, weights=amount, minlength=total.size).reshape(total.shape)

        h = _rows_to_one(_summed(matrix, update, k + settings.free, size))
        now.unpersist()
    return h


def _rows_to_one(h: np.ndarray) -> np.ndarray:
    return h / np.maximum(h.sum(axis=1, keepdims=True), 1e-300)


def subject_masses(docs: DataFrame, labels: DataFrame, areas: DataFrame, *, doc_id: str = "doc_id", text: str = "text", subject: str = "subject", description: str = "description", settings: Settings | None = None) -> DataFrame:
    """``(doc_id, subject, mass, share)``: the terms of the document that each subject accounts for, and their share of all such terms.

    One row per document and subject with a mass above one half. Null, empty and blank texts have none; without subjects the result is empty. Repeated
    rows give repeated results. Subjects are few: their list and the factor (dimensions x components) are gathered.
    """
    settings = settings or Settings()
    spark = docs.sparkSession
    about = {r[0]: r[1] for r in areas.where(F.col(subject).isNotNull()).select(subject, description).distinct().collect()}
    names = sorted(about)
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, subject string, mass double, share double"
    if not names:
        return spark.createDataFrame([], schema)
    matrix = term_matrix(docs, doc_id=doc_id, text=text, settings=settings)
    votes = seed_labels(labels, names, doc_id=doc_id, subject=subject, limit=settings.labelled)
    h = spark.sparkContext.broadcast(Factor.of(factor(spark, matrix, votes, about, names, settings)))
    k = len(names)

    def mixtures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, idx, cnt = _flat(batch)
            keep = h.value.sizes[idx] > 0
            w = _weights(row[keep], idx[keep], cnt[keep], len(batch), h.value, 3 * settings.inner)[0][:, :k]
            share = w / np.maximum(w.sum(axis=1, keepdims=True), 1e-12)
            at, which = np.nonzero(w > 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([names[i] for i in which], pa.string()), pa.array(w[at, which]), pa.array(share[at, which])], ["doc_id", "subject", "mass", "share"])

    return matrix.mapInArrow(mixtures, schema)


def assigned(masses: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The subjects that a document is about: of enough mass for more than a passing remark."""
    settings = settings or Settings()
    return masses.where((F.col("mass") >= settings.mass) & (F.col("share") >= settings.share))
