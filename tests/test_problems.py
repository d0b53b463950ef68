"""Problems 1 to 4 against brute force, with the edge cases their docstrings name."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from cairn.operators import incremental, keychunks, orphans, snapshots

COLS = {"period": "g", "key": "f", "ref": "r", "delivered": "d", "content_id": "id", "content_hash": "h"}
SNAP, CONT = "g int, f bigint, r bigint, d bigint, clash string, h string", "id bigint, h string, f string"


def brute_changes(rows, contents):
    last, hashes = {}, {}
    for g, f, r, d, *_ in rows:
        if g is None or f is None:
            continue
        rank = (d is not None, d or 0, r is not None, r or 0)
        if (g, f) not in last or rank > last[g, f][0]:
            last[g, f] = (rank, r)
    for i, h, *_ in contents:
        if i is not None:
            hashes[i] = max(filter(None, [hashes.get(i), h and h.lower()]), default=None)
    gens = sorted({g for g, f, *_ in rows if g is not None and f is not None})
    state = [{f: hashes.get(r) for (g2, f), (_, r) in last.items() if g2 == g and r is not None} for g in gens]
    out = set()
    for g, old, new in zip(gens[1:], state, state[1:], strict=False):
        out |= {(g, f, "added") for f in new.keys() - old.keys()} | {(g, f, "removed") for f in old.keys() - new.keys()}
        out |= {(g, f, "changed") for f in new.keys() & old.keys() if new[f] != old[f]}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_snapshot_changes(spark, seed):
    rnd = random.Random(seed)
    contents = [(i, rnd.choice(["ab", "AB", "cd", None]), "x") for i in range(12)] + [(3, "ab", "dup"), (None, "zz", "n")]
    rows = [(rnd.choice([1, 2, 4, 7, None]), rnd.choice([1, 2, 3, 4, 5, None]), rnd.choice([*range(14), None]), rnd.choice([1, 2, 3, None]), "c", "own") for _ in range(90)]
    rows += rows[:20]
    got = snapshots.snapshot_changes(spark.createDataFrame(rows, SNAP), spark.createDataFrame(contents, CONT), **COLS).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute_changes(rows, contents)


def test_snapshot_changes_of_nothing(spark):
    assert snapshots.snapshot_changes(spark.createDataFrame([], SNAP), spark.createDataFrame([], CONT), **COLS).count() == 0


ENTRY = "id bigint, t bigint, n int, h string, s bigint, key string"


def brute_state(rows, upto):
    best = {}
    for i, t, n, h, s, *_ in rows:
        if i is None or t is None or n is None or n > upto:
            continue
        rank = (t, n, h is not None, h or "", s is not None, s or 0)
        if i not in best or rank > best[i][0]:
            best[i] = (rank, (h, s))
    return {i: v for i, (_, v) in best.items()}


def entries(seed, n=120):
    rnd = random.Random(seed)
    return [(rnd.choice([*range(15), 7, 7, 7, None]), rnd.choice([*range(30), None]), rnd.choice([1, 2, 3, 4, 5, 6, None]), rnd.choice(["a", "b", None]), rnd.choice([1, 2, None]), "clash") for _ in range(n)]


def feed_of(spark, folder):
    return incremental.ChangeFeed(spark, str(folder), key="id", newest="t", delivery="n", watched=["h", "s"], buckets=4)


def brute_runs(rows, runs):
    out, before = set(), {}
    for run, upto in runs:
        now = brute_state(rows, upto)
        out |= {(run, i) for i in now if i not in before or before[i] != now[i]}
        before = now
    return out


@pytest.mark.parametrize("seed", range(2))
def test_incremental_runs(spark, tmp_path, seed):
    rows = entries(seed)
    df = spark.createDataFrame(rows, ENTRY)
    runs = [(1, 1), (3, 3), (4, 3), (9, 6)]
    feed = feed_of(spark, tmp_path / "feed")
    for run, upto in runs:
        feed.run(run, df, upto)
    feed.run(9, df, 6)  # a run that is repeated does nothing
    got = [tuple(r) for r in feed.changes().collect()]
    assert len(got) == len(set(got)) and set(got) == brute_runs(rows, runs)


@pytest.mark.parametrize("dies_at", ["state", "changes", "prints"])
def test_incremental_run_that_dies(spark, tmp_path, dies_at):
    """A run that ends after any of its writes is made good by the next one, under another id."""
    rows = entries(5)
    df = spark.createDataFrame(rows, ENTRY)
    feed = feed_of(spark, tmp_path / "feed")
    feed.run(1, df, 2)
    whole = feed._replace

    def dying(out, part, by):
        if part != dies_at or dies_at != "prints":
            whole(out, part, by)
        if part == dies_at:
            raise RuntimeError("lost")

    feed._replace = dying
    with pytest.raises(RuntimeError):
        feed.run(2, df, 4)
    feed = feed_of(spark, tmp_path / "feed")
    feed.run(3, df, 6)
    assert {tuple(r) for r in feed.changes().collect()} == brute_runs(rows, [(1, 2), (3, 6)])


def test_incremental_state_that_lost_a_bucket(spark, tmp_path):
    """A run that dies after the old partition is removed and before the new one is in place."""
    rows = entries(6)
    df = spark.createDataFrame(rows, ENTRY)
    feed = feed_of(spark, tmp_path / "feed")
    feed.run(1, df, 3)
    shutil.rmtree(next((tmp_path / "feed/state").glob("bucket=*")))
    feed.run(2, df, 5)
    assert {tuple(r) for r in feed.changes().collect()} == brute_runs(rows, [(1, 3), (2, 5)])


def test_incremental_rewind_and_empty(spark, tmp_path):
    rows = entries(8)
    df = spark.createDataFrame(rows, ENTRY)
    feed = feed_of(spark, tmp_path / "feed")
    feed.run(1, df, 5)
    feed.run(2, df, 3)
    now, before = brute_state(rows, 3), brute_state(rows, 5)
    assert {r[1] for r in feed.changes().collect() if r[0] == 2} == {i for i in now if i not in before or before[i] != now[i]}
    empty = feed_of(spark, tmp_path / "none")
    assert empty.changes().count() == 0
    empty.run(1, df.limit(0), 1)
    assert empty.changes().count() == 0 and empty.committed()[0] == 1


def test_key_chunks(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot"] * 6 + ["a", "b", "", None]), rnd.choice([1, 2, None]), i, "x") for i in range(3000)]
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame(rows, "name string, v int, i int, k string").repartition(3).write.parquet(path)
    df = spark.read.parquet(path)
    counts = {}
    for n, *_ in rows:
        counts[n] = counts.get(n, 0) + 1
    got = keychunks.key_counts(df, "name", chunk_rows=100).collect()
    assert {r["k"]: r["n_rows"] for r in got} == counts
    assert {r["k"]: r["n_chunks"] for r in got} == {k: -(-n // 100) for k, n in counts.items()}
    pos = keychunks.numbered(df, "name", ["i"]).collect()
    for k, n in counts.items():
        assert sorted(r["pos"] for r in pos if r["k"] == k) == list(range(n))
    # Ordered states, against a walk in the order of the numbers.
    order = {r["i"]: r["pos"] for r in pos}
    for r in keychunks.runs_per_key(df, "name", "v", chunk_rows=70).collect():
        own = [v for _, v in sorted((order[i], v) for n, v, i, _ in [(a, (b, ), c, d) for a, b, c, d in rows] if n == r["key_value"])]
        assert r["n_rows"] == len(own) and r["n_runs"] == sum(1 for i, v in enumerate(own) if i == 0 or own[i - 1] != v)
        assert (r["first_value"],) == own[0] and (r["last_value"],) == own[-1]
    heavy = {r["key_value"] for r in keychunks.heavy_keys(df, "name", 0.12).collect()}
    assert heavy == {k for k, n in counts.items() if k is not None and n >= 0.12 * len(rows)}
    spark.createDataFrame([], "name string, v int").write.parquet(str(tmp_path / "e.parquet"))
    assert keychunks.heavy_keys(spark.read.parquet(str(tmp_path / "e.parquet")), "name").count() == 0


def test_packed_bits():
    rnd = random.Random(1)
    for size, most in ((0, 10), (50, 100_000), (9000, 20_000)):
        a, b = ({rnd.randrange(most) for _ in range(size)} for _ in range(2))
        x, y = orphans.PackedBits.of(list(a)), orphans.PackedBits.of(list(b))
        assert x.and_not(y).codes().tolist() == sorted(a - b) and x.union(y).codes().tolist() == sorted(a | b)


def test_orphans(spark):
    rnd = random.Random(4)
    keys = ["k1", "K1", "k2", "k3", "", None, "hot"]
    sites = [(rnd.choice([*range(300), None]), rnd.choice([1, 2, 5, None]), rnd.choice(keys), rnd.choice(keys + ["hot"] * 5), "x") for _ in range(500)]
    sites += sites[:40]
    parents = [(rnd.choice(["a", "b"]), rnd.choice(keys), rnd.choice([1, 2, 3, None]), rnd.choice([2, 5, None])) for _ in range(9)]
    want = set()
    for i, g, a, b, _ in sites:
        for f, k in (("a", a and a.lower()), ("b", b)):
            if i is not None and g is not None and k is not None and not any(pf == f and pk == k and s is not None and s <= g and (u is None or u > g) for pf, pk, s, u in parents):
                want.add((f, g, i))
    df = spark.createDataFrame(sites, "id bigint, g int, a string, b string, field string")
    pf = spark.createDataFrame(parents, "field string, key string, since int, until int")
    got = orphans.find_orphans(df, pf, row_id="id", period="g", fields={"a": "lower(a)", "b": "b"}, ranges=3).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == want
    assert orphans.find_orphans(df.limit(0), pf, row_id="id", period="g", fields={"b": "b"}).count() == 0
    everything = orphans.find_orphans(df, pf.limit(0), row_id="id", period="g", fields={"b": "b"})
    assert everything.count() == len({(i, g) for i, g, _, b, _ in sites if None not in (i, g, b)})
    assert {r["period"] for r in orphans.orphan_report(everything).select(F.col("period")).collect()} <= {1, 2, 5}


def test_incremental_finds_what_changed_below_the_mark(spark, tmp_path):
    """An old row is altered and a late one arrives under an old number: both are found by the fingerprints, and only their buckets are rewritten."""
    rows = [(i, 10 * n + i % 3, n, "a", n, "clash") for n in (1, 2, 3) for i in range(200) if (i + n) % 3]
    folder = str(tmp_path / "source")
    spark.createDataFrame(rows, ENTRY).repartition(3).write.parquet(folder)
    feed = incremental.ChangeFeed(spark, str(tmp_path / "feed"), key="id", newest="t", delivery="n", watched=["h", "s"], buckets=8)
    feed.run(1, spark.read.parquet(folder), 3)
    stamp = lambda: {p.parent.name: p.stat().st_mtime_ns for p in (tmp_path / "feed/state").glob("bucket=*/*.parquet")}
    before = stamp()
    touched = next(i for i, *_, in rows if i > 20)
    newer = [(touched, 99, 1, "late", 5, "clash")]
    spark.createDataFrame(newer, ENTRY).write.mode("append").parquet(folder)
    feed.run(2, spark.read.parquet(folder), 3)
    after = stamp()
    assert {tuple(r) for r in feed.changes().where("run_id = 2").collect()} == {(2, touched)}
    assert sum(after[b] != before[b] for b in before) < len(before)
    # The altered row goes back: the state is taken anew from the deliveries, also by another writer.
    altered = [(i, t, n, "b" if (i, n) == (7, 1) else h, s, k) for i, t, n, h, s, k in rows]
    spark.createDataFrame(altered, ENTRY).repartition(2).write.mode("overwrite").parquet(folder)
    feed = incremental.ChangeFeed(spark, str(tmp_path / "feed"), key="id", newest="t", delivery="n", watched=["h", "s"], buckets=8)
    feed.run(3, spark.read.parquet(folder), 3)
    was, now = brute_state(rows + newer, 3), brute_state(altered, 3)
    assert {tuple(r) for r in feed.changes().where("run_id = 3").collect()} == {(3, i) for i in now if now[i] != was[i]}


def test_incremental_buckets_follow_the_data(spark, tmp_path):
    rows = [(i, 1, n, "a", n, "clash") for n in (1, 2, 3) for i in range(40 * n * n)]
    feed = incremental.ChangeFeed(spark, str(tmp_path / "feed"), key="id", newest="t", delivery="n", watched=["h", "s"], bucket_rows=50)
    df = spark.createDataFrame(rows, ENTRY)
    for n in (1, 2, 3):
        feed.run(n, df, n)
    assert feed.committed().buckets >= 4
    assert {tuple(r) for r in feed.changes().collect()} == brute_runs(rows, [(1, 1), (2, 2), (3, 3)])


def test_incremental_dead_run_that_went_further(spark, tmp_path):
    """A run that died had seen deliveries that the next one must not see."""
    rows = entries(9)
    df = spark.createDataFrame(rows, ENTRY)
    feed = feed_of(spark, tmp_path / "feed")
    feed.run(1, df, 2)
    whole = feed._replace

    def dying(out, part, by):
        whole(out, part, by)
        if part == "state":
            raise RuntimeError("lost")

    feed._replace = dying
    with pytest.raises(RuntimeError):
        feed.run(2, df, 6)
    feed = feed_of(spark, tmp_path / "feed")
    feed.run(3, df, 4)
    assert {tuple(r) for r in feed.changes().collect()} == brute_runs(rows, [(1, 2), (3, 4)])
