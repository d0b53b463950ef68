"""Bounded reachability over edge lists: over files by walks in arrays, over packages by iterated frontier joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.common import cut, fresh_folder, qualified, read_written

MAX_DEPTH, MAX_NODES = 32, 4096


def _arrays(folder: str, nodes: int) -> tuple:
    """The numbered graph as arrays, read once per worker: for each node the begin of its edges, the edges in visiting order (twice the target, one more if weak), the number of the reason why it is open (0: it is not), and the reasons."""
    if folder not in _loaded:
        e = read_written(f"{folder}/edges", ["src", "edge", "place"])
        src = e["src"].to_numpy()
        begin = np.zeros(nodes + 1, np.int64)
        np.cumsum(np.bincount(src, minlength=nodes), out=begin[1:])
        edges = e["edge"].to_numpy()[np.lexsort((e["place"].to_numpy(), src))]
        o = read_written(f"{folder}/open", ["node", "reason"])
        reasons = ["", *sorted(set(o["reason"].to_pylist())), "node_limit", "depth_limit"]
        opened = np.zeros(nodes, np.int16)
        opened[o["node"].to_numpy()] = [reasons.index(x, 1) for x in o["reason"].to_pylist()]
        _loaded.clear()
        _loaded[folder] = begin, edges, opened, reasons
    return _loaded[folder]


_loaded: dict[str, tuple] = {}


def _firsts(keys: np.ndarray, at: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """Those of the ascending places ``at`` where a key stands for the first time."""
    scratch[keys[::-1]] = at[::-1]
    return at[scratch[keys] == at]


def _walk(start: int, begin: np.ndarray, edges: np.ndarray, opened: np.ndarray, state: np.ndarray, scratch: np.ndarray, depth: int, max_nodes: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Files in the order of their arrival, their depths, and the cause of an open scope (0: closed; -2: limit of files, -1: of depth); ``state`` of the files afterwards: 1 heuristic, 2 proven."""
    state[start] = 2
    front, weak = np.array([start], np.int64), np.zeros(1, bool)
    files, cause, there = [front], int(opened[start]), 1
    for _ in range(depth):
        first, count = begin[front], begin[front + 1] - begin[front]
        total = int(count.sum())
        parent = np.repeat(np.arange(len(front)), count)
        edge = edges[np.arange(total) + np.repeat(first - np.cumsum(count) + count, count)]
        node, step_weak = (edge >> 1).astype(np.int64), weak[parent] | (edge & 1).astype(bool)
        was = state[node]
        unknown = np.flatnonzero(was == 0)
        new = _firsts(node[unknown], unknown, scratch)
        new, beyond = new[: max_nodes - there], new[max_nodes - there :]
        able, stops = ~step_weak & (was != 2), beyond[:0]
        if len(beyond):
            # What is beyond the limit is refused, and so is the rest of that file's edges.
            state[node[beyond]] = 3
            refused = state[node] == 3
            state[node[beyond]] = 0
            at = np.flatnonzero(refused)
            by, i = np.unique(parent[at], return_index=True)
            stops, stop = at[i], np.full(len(front), total)
            stop[by] = stops
            able &= ~refused & (np.arange(total) <= stop[parent])
        able = np.flatnonzero(able)
        strong = _firsts(node[able], able, scratch)
        taken = np.union1d(new, strong)
        state[node[new]] = 1
        state[node[strong]] = 2
        there += len(new)
        files.append(node[new])
        front, weak = node[taken], step_weak[taken]
        if not cause:
            own = taken[opened[front] > 0]
            if len(own) and not (len(stops) and stops[0] < own[0]):
                cause = int(opened[node[own[0]]])
            elif len(stops):
                cause = -2
        if not len(front):
            break
    if len(front) and not cause:
        cause = -1
    return np.concatenate(files), np.repeat(np.arange(len(files)), [len(f) for f in files]), cause


def _searches(folder: str, nodes: int, depth: int, max_nodes: int, asked: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Searches from batches of origins: a row for each file, or for each asked file that is reached, and one without a file for the scope."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, edges, opened, reasons = _arrays(folder, nodes)
        state, scratch = np.zeros(nodes, np.int8), np.zeros(nodes, np.int64)
        names = ["origin", "node", "is_heuristic", "depth", "reason"]
        kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.string()]
        parts: list[tuple] = []
        size = 0

        def rows() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate(c), k) for c, k in zip(list(zip(*parts, strict=True))[:4], kinds[:4], strict=True)]
            why = pa.array([x for *_, n, r in parts for x in [None] * (n - 1) + [r]], pa.string())
            return pa.RecordBatch.from_arrays([*columns, why], names=names)

        for batch in batches:
            wanted = batch.column("wanted") if asked else None
            for i, origin in enumerate(batch.column("origin").to_pylist()):
                files, depths, cause = _walk(origin, begin, edges, opened, state, scratch, depth, max_nodes)
                scratch[files] = depths
                shown = files
                if asked:
                    shown = wanted[i].values.to_numpy(zero_copy_only=False).astype(np.int64) if wanted[i].is_valid else files[:0]
                    shown = shown[state[shown] > 0]
                n = len(shown) + 1
                parts.append((np.full(n, origin), np.append(shown, -1), np.append(state[shown] == 1, False), np.append(scratch[shown], 0), n, reasons[cause] or None))
                state[files] = 0
                size += n
                if size >= 65536:
                    yield rows()
                    parts, size = [], 0
        if parts:
            yield rows()

    return run


def reach(origins: DataFrame, edges: DataFrame, open_nodes: DataFrame, *, weak: str = "suffix_match", depth: int = MAX_DEPTH, max_nodes: int = MAX_NODES, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Reach of each origin: ``(origin, path, is_heuristic, depth)`` and ``(origin, open, reason)``.

    origins: ``origin``; edges: ``src, dst, resolution``; open_nodes: ``src, reason``. What strong edges reach is proven, what only a path
    with a weak edge reaches is heuristic; the origin itself is proven. Files are visited breadth first, the edges of each in the order of
    :func:`normalized_edges`. Once ``max_nodes`` files are known no further one is taken: a file's edges are left at the first that leads to
    one, and those before still make known files proven. A scope is open, for the cause met first on the way: a reached file that leaves includes
    open, the limit of files, a file at the greatest depth. ``depth`` of a file is that of its first arrival. Null origins and edge ends reach nothing.
    wanted: ``origin, path``; the search is the same, but only those of the files are returned.

    Files are numbered and the graph is written in numbers; each worker reads it whole (about 12 bytes an edge while reading, 4 after, 19 a file) and walks
    from its share of the origins, level by level. A lost task walks again from its origins.
    """
    spark, base = edges.sparkSession, fresh_folder(edges.sparkSession, "reach")
    per = edges.where("src is not null and dst is not null").repartition("src").groupBy("src", "dst").agg(F.min((F.col("resolution") != "external_exact").cast("int")).alias("later"), F.min(F.col("resolution") == weak).alias("weak"))
    order = Window.partitionBy("src").orderBy("later", "dst")
    e = cut(per.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max_nodes + 1).select("src", "dst", "weak", "place"))
    start = cut(origins.where("origin is not null").select("origin").distinct())
    names = e.select(F.col("src").alias("path")).unionByName(e.select(F.col("dst").alias("path"))).unionByName(start.select(F.col("origin").alias("path"))).distinct()
    # Numbers without gaps: the place within a partition as it was written, after all files of the partitions before.
    placed = cut(names.select("path", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = cut(sizes.select("part", "n", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")))
    ids = placed.withColumn("part", part).join(F.broadcast(before), "part").select("path", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).cast("int").alias("id"))
    nodes = before.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    number = lambda name, to: ids.select(F.col("path").alias(name), F.col("id").alias(to))
    # Twice the target and one more: the target has to stay below 2^30.
    coded = e.join(number("src", "s"), "src").join(number("dst", "d"), "dst").select(F.col("s").alias("src"), (F.col("d") * 2 + F.col("weak").cast("int")).alias("edge"), "place")
    coded.write.parquet(f"{base}/edges")
    open_nodes.where("reason is not null").groupBy("src").agg(F.min("reason").alias("reason")).join(number("src", "node"), "src").select("node", "reason").write.parquet(f"{base}/open")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = start.join(number("origin", "id"), "origin").select(F.col("id").alias("origin"))
    if wanted is not None:
        lists = wanted.join(number("origin", "o"), "origin").join(number("path", "p"), "path").groupBy(F.col("o").alias("origin")).agg(F.collect_set("p").alias("wanted"))
        asked = asked.join(lists, "origin", "left")
    walked = asked.repartition(tasks).mapInArrow(_searches(qualified(spark, base), nodes, depth, max_nodes, wanted is not None), "origin int, node int, is_heuristic boolean, depth int, reason string")
    walked = cut(walked).withColumnRenamed("origin", "o").join(number("origin", "o"), "o")
    files = walked.where("node >= 0").join(number("path", "node"), "node").select("origin", "path", "is_heuristic", "depth")
    return files, walked.where("node < 0").select("origin", F.col("reason").isNotNull().alias("open"), "reason")


def provable(pairs: DataFrame, edges: DataFrame, *, weak: str = "suffix_match") -> DataFrame:
    """Rows ``(origin, path)`` for which :func:`reach` can find the file proven: it is the origin itself, or a strong edge leaves the origin and one arrives at the file. All others are unproven whatever lies between."""
    strong = edges.where((F.col("resolution") != weak) & F.col("src").isNotNull() & F.col("dst").isNotNull())
    other = pairs.where("origin <> path").join(strong.select(F.col("dst").alias("path")), "path", "left_semi").join(strong.select(F.col("src").alias("origin")), "origin", "left_semi")
    return pairs.where("origin = path").select("origin", "path").unionByName(other.select("origin", "path"))


def package_reach(origins: DataFrame, edges: DataFrame, members: DataFrame, *, depth: int = MAX_DEPTH) -> DataFrame:
    """``(origin, path, is_heuristic)`` over packages: the first arrival at a package decides whether it is heuristic, a later stronger path does not promote it.

    origins: ``origin`` (a package); edges: ``src, dst, resolution`` (exact or heuristic) of packages; members: ``package, path``.
    """
    e = edges.where("src is not null and dst is not null").select("src", "dst", (F.col("resolution") != "exact").alias("weak")).groupBy("src", "dst").agg(F.min("weak").alias("weak"))
    e = cut(e)
    known = cut(origins.where("origin is not null").select("origin", F.col("origin").alias("node"), F.lit(False).alias("is_heuristic")).distinct())
    layers, frontier = [known], known
    for _ in range(depth):
        step = frontier.join(e, frontier["node"] == e["src"]).groupBy("origin", "dst").agg(F.min(F.col("is_heuristic") | F.col("weak")).alias("is_heuristic")).withColumnRenamed("dst", "node")
        seen = reduce(DataFrame.unionByName, layers).select("origin", "node")
        frontier = cut(step.join(seen, ["origin", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        layers.append(frontier)
    packages = reduce(DataFrame.unionByName, layers)
    return packages.join(members, packages["node"] == members["package"]).groupBy("origin", "path").agg(F.min("is_heuristic").alias("is_heuristic"))


def normalized_edges(edges: DataFrame) -> DataFrame:
    """Per source the distinct edges in visiting order: direct external ones first, then by target, then by resolution."""
    w = Window.partitionBy("src").orderBy((F.col("resolution") != "external_exact").cast("int"), "dst", "resolution")
    return edges.select("src", "dst", "resolution").distinct().withColumn("position", F.row_number().over(w) - 1)


def direct_external(edges: DataFrame) -> DataFrame:
    """``(src, dst)`` of first-layer external targets: exact, and absolute paths."""
    return edges.where("resolution = 'external_exact' and startswith(dst, '/')").select("src", "dst").distinct()


def replaced_sources(base: DataFrame, fresh: DataFrame, sources: DataFrame) -> DataFrame:
    """A new edge list in which the sources' edges are the fresh ones; a source without fresh edges has none."""
    s = sources.select("src").distinct()
    return base.join(s, "src", "left_anti").unionByName(fresh.join(s, "src", "left_semi"))
