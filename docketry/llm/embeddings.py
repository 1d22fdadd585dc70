"""Near-duplicate embeddings by an inverted multi-index over two halves of the vector."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.llm.graph import components
from docketry.store import materialise

SAMPLE_VECTORS = 20_000
BLOCK_VECTORS = 1024
VISITORS_PER_STEP = 512
PROBERS_PER_STEP = 64
MARGIN = 1e-9

GROUP = ["label", "dim", "cell"]
BLOCK = ["label", "dim", "core", "block"]


@dataclass
class Grid:
    """Codebooks of both halves of vectors of one dimension; a cell is a pair of codewords."""

    first: np.ndarray
    second: np.ndarray

    def cells(self, at: np.ndarray) -> np.ndarray:
        """The middle of the cells of that number, as unit vectors."""
        i, j = np.divmod(at, len(self.second))
        middle = np.concatenate([self.first[i], self.second[j]], axis=1)
        length = np.linalg.norm(middle, axis=1, keepdims=True)
        return np.divide(middle, length, out=np.zeros_like(middle), where=length > 0)

    def bounds(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest cell of each vector and, for each codeword of a half, a squared lower bound.

        What lies nearest to codeword k is beyond the planes between k and all other codewords,
        so at least as far away as the farthest of them.
        """
        half = self.first.shape[1]
        parts = []
        for book, own in ((self.first, unit[:, :half]), (self.second, unit[:, half:])):
            far = np.maximum((own * own).sum(1)[:, None] - 2 * own @ book.T + (book * book).sum(1)[None, :], 0)
            apart = np.linalg.norm(book[:, None, :] - book[None, :, :], axis=2)
            apart[apart == 0] = np.inf
            plane = ((far[:, :, None] - far[:, None, :]) / (2 * apart)).max(2)
            parts.append((far.argmin(1), np.maximum(plane, 0) ** 2))
        (i, a), (j, b) = parts
        return i * len(self.second) + j, a, b


def multi_sequence(a: np.ndarray, b: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) by rising a[i] + b[j], until it passes the limit: the multi-sequence traversal."""
    by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, met = [(a[by_a[0]] + b[by_b[0]], 0, 0)], {(0, 0)}
    while heap and heap[0][0] <= limit:
        _, s, t = heapq.heappop(heap)
        yield int(by_a[s]), int(by_b[t])
        for u, v in ((s + 1, t), (s, t + 1)):
            if u < len(by_a) and v < len(by_b) and (u, v) not in met:
                met.add((u, v))
                heapq.heappush(heap, (a[by_a[u]] + b[by_b[v]], u, v))


def kmeans(points: np.ndarray, k: int, turns: int = 12, seed: int = 5) -> np.ndarray:
    """Up to k codewords for the points; deterministic."""
    distinct = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    book = distinct[rng.permutation(len(distinct))[: min(k, len(distinct))]].copy()
    for _ in range(turns):
        far = (book * book).sum(1)[None, :] - 2 * points @ book.T
        own = far.argmin(1)
        n = np.bincount(own, minlength=len(book))
        sums = np.zeros_like(book)
        np.add.at(sums, own, points)
        book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
    return book


def _unit(values: np.ndarray) -> np.ndarray | None:
    """The vector at length 1, or None if it is empty, zero or not finite."""
    values = values.astype(np.float64)
    if not len(values) or not np.isfinite(values).all() or not values.any():
        return None
    values = values / np.abs(values).max()
    return values / np.sqrt(values @ values)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        taken, units, dims = [], [], []
        for i, x in enumerate(batch.column("embedding")):
            if x.is_valid and not x.values.null_count:
                unit = _unit(x.values.to_numpy(zero_copy_only=False))
                if unit is not None:
                    taken.append(i)
                    dims.append(len(unit))
                    units.append(unit.tobytes())
        rows = batch.select(["vec_id", "label"]).take(pa.array(taken, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*rows.columns, pa.array(dims, pa.int32()), pa.array(units, pa.binary())], ["vec_id", "label", "dim", "unit"]
        )


def _matrix(units: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(u.as_py() for u in units), np.float64).reshape(-1, dim)


def _probe(shared, radius: float):
    """Own cell, angle to its middle, and one row for each cell that may hold a link of the vector."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids: dict[int, Grid] = shared.value
        for whole in batches:
            dims = whole.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                batch = whole.take(pa.array(np.flatnonzero(dims == dim)))
                unit = _matrix(batch.column("unit"), dim)
                half = (dim + 1) // 2
                grid = grids.get(dim) or Grid(np.zeros((1, half)), np.zeros((1, dim - half)))
                for low in range(0, len(unit), PROBERS_PER_STEP):
                    some = unit[low : low + PROBERS_PER_STEP]
                    own, a, b = grid.bounds(some)
                    met = [
                        np.array([i * len(grid.second) + j for i, j in multi_sequence(x, y, radius * radius + MARGIN)])
                        for x, y in zip(a, b)
                    ]
                    rows = np.repeat(np.arange(len(some)), [len(x) for x in met])
                    cells = np.concatenate(met)
                    cosine = np.einsum("ij,ij->i", some[rows], grid.cells(cells))
                    angle = np.where(cosine == 0, np.pi, np.arccos(np.clip(cosine, -1, 1)))
                    taken = batch.select(["uid", "vec_id", "label", "dim"]).take(pa.array(low + rows))
                    yield pa.RecordBatch.from_arrays(
                        [*taken.columns, pa.array(cells), pa.array(own[rows] == cells), pa.array(angle)],
                        [*taken.schema.names, "cell", "own", "angle"],
                    )

    return work


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a block of links between rows and columns, the root column of each row's and column's component."""
    n = linked.shape[1]
    columns = np.arange(n)
    while True:
        rows = np.where(linked, columns[None, :], n).min(1)
        again = np.minimum(np.where(linked, rows[:, None], n).min(0), columns)
        if (again == columns).all():
            return rows, columns
        columns = again


def _verify(least: float):
    """Rows come sorted by block, its stored vectors before the vectors that visit it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, cells, units = None, np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in (*BLOCK, "visitor"))))
            starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for low, high in zip(starts, starts[1:]):
                if low == high:
                    continue
                *key, visitor = keys[low]
                rows = batch.slice(low, high - low)
                own_ids, own = rows.column("vec_id").to_numpy(), _matrix(rows.column("unit"), key[1])
                if not visitor:
                    own_cells = rows.column("cell").to_numpy()
                    if group == key:
                        ids, cells, units = np.r_[ids, own_ids], np.r_[cells, own_cells], np.concatenate([units, own])
                    else:
                        group, ids, cells, units = key, own_ids, own_cells, own
                elif group == key:
                    counted = rows.column("counted")
                    for at in range(0, len(own), VISITORS_PER_STEP):
                        some = own_ids[at : at + VISITORS_PER_STEP]
                        linked = (own[at : at + VISITORS_PER_STEP] @ units.T >= least) & (some[:, None] != ids[None, :])
                        for r in range(len(some)):
                            if len(already := counted[at + r].values):
                                linked[r] &= ~np.isin(cells, np.asarray(already))
                        n = linked.sum(1)
                        hit = np.flatnonzero(n)
                        if len(hit):
                            to, columns = _forest(linked[hit])
                            out.append((some[hit], n[hit], ids[to]))
                            held = np.flatnonzero(linked.any(0) & (columns != np.arange(len(ids))))
                            out.append((ids[held], np.zeros(len(held), np.int64), ids[columns[held]]))
            a, n, b = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (zip(*out) if out else ((), (), ())))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n), pa.array(b)], ["a", "n", "b"])

    return work


def _fit(units: DataFrame, codewords: int) -> dict[int, Grid]:
    """Codebooks per dimension, on a bounded sample of all vectors."""
    sample = units.orderBy("uid").limit(SAMPLE_VECTORS).select("dim", "unit").toArrow()
    dims, grids = sample.column("dim").to_numpy(), {}
    for dim in np.unique(dims).tolist():
        points = _matrix(sample.column("unit").take(pa.array(np.flatnonzero(dims == dim))), dim)
        half = (dim + 1) // 2
        grids[dim] = Grid(kmeans(points[:, :half], codewords), kmeans(points[:, half:], codewords))
    return grids


def _directory(stored: DataFrame) -> DataFrame:
    """For each cell its core and other vectors: how many, and the blocks they are kept in.

    Cells fill blocks in the order of their numbers; a label has at most as many cells as the grid.
    """
    cells = stored.groupBy(*GROUP).agg(
        F.count_if(F.col("core")).alias("core_n"),
        F.count_if(~F.col("core")).alias("other_n"),
        F.min(F.when(F.col("core"), F.col("vec_id"))).alias("core_id"),
        F.max(F.when(F.col("core"), F.col("angle"))).alias("core_angle"),
    )
    before = W.partitionBy("label", "dim").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    for kind in ("core", "other"):
        filled = F.coalesce(F.sum(f"{kind}_n").over(before), F.lit(0))
        cells = cells.withColumn(f"{kind}_filled", filled)
    return cells.withColumns(
        {f"{kind}_block": F.expr(f"{kind}_filled div {BLOCK_VECTORS}") for kind in ("core", "other")}
        | {f"{kind}_parts": F.expr(f"{kind}_n div {BLOCK_VECTORS} + 1") for kind in ("core", "other")}
    ).drop("core_filled", "other_filled")


def link_vectors(vectors: DataFrame, least: float = 0.98, codewords: int = 32) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of `vectors` (vec_id, embedding, label).

    Vectors of one label and dimension link if their cosine, in double precision, is `least` or
    more.

    1. Codebooks of both halves are fitted on at most `SAMPLE_VECTORS` vectors; their product is
       the grid. Every vector is stored in its nearest cell.
    2. Every vector visits cells in the order of the multi-sequence traversal, by lower bounds of
       the distance to what a cell can hold, and stops where the bound passes the distance that
       the cosine allows. So the target recall is 1: no link is missed on any codebook.
    3. Vectors near the middle of their cell (half the allowed angle at most) are its core. They
       all link with each other, so they are counted, not compared; a visitor whose angle to the
       middle leaves no doubt about all of a core is counted with it at once.
    4. The stored vectors of neighbouring cells share a block of about `BLOCK_VECTORS`; a large
       cell is many blocks, so no task holds a cell. A vector is sent once to each block that
       holds a cell it visits and is verified against the block by a matrix product. A block
       adds the number of links of each visitor and a spanning forest of them, not the links.

    Vectors that are null, empty, zero, or hold null or non-finite components, and those without
    label, link with nothing. Rows that share a vec_id do not link with each other and get the
    sum of their links each; rows that are alike in all are one vector. A null vec_id links with
    nothing and is kept. An empty table gives no rows; other columns are left alone, whatever their
    names.
    """
    if not 0 < least < 1:
        raise ValueError("least must be between 0 and 1")
    spark = vectors.sparkSession
    radius, widest = float(np.sqrt(2 - 2 * least)), float(np.arccos(least))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    units = rows.dropna(subset=["vec_id", "label"]).mapInArrow(_units, "vec_id bigint, label string, dim int, unit binary")
    uid = F.xxhash64("vec_id", "label", "unit")
    units = materialise(units.withColumn("uid", uid).dropDuplicates(["uid", "vec_id"]), "units")
    grids = _fit(units, codewords)
    probes = units.mapInArrow(
        _probe(spark.sparkContext.broadcast(grids), radius),
        "uid bigint, vec_id bigint, label string, dim int, cell bigint, own boolean, angle double",
    )
    is_core = F.col("own") & (F.col("angle") <= widest / 2 - MARGIN)
    probes = materialise(probes.withColumn("core", is_core), "probes")
    cells = materialise(_directory(probes.filter("own")), "cells")
    visits = probes.join(cells, GROUP)
    sure = F.col("core") | F.coalesce(F.col("angle") + F.col("core_angle") <= widest - MARGIN, F.lit(False))
    never = F.col("angle") - F.col("core_angle") > widest + MARGIN
    counted = visits.filter((F.col("core_n") > 0) & sure).select(
        F.col("vec_id").alias("a"), (F.col("core_n") - F.col("core").cast("int")).alias("n"), F.col("core_id").alias("b")
    )
    part = F.pmod(F.xxhash64("uid"), F.when(F.col("core"), F.col("core_parts")).otherwise(F.col("other_parts")))
    block = F.when(F.col("core"), F.col("core_block")).otherwise(F.col("other_block")) + part
    no_cells = F.array().cast("array<bigint>")
    stored = (
        visits.filter("own")
        .select("uid", "vec_id", "label", "dim", "core", block.alias("block"), "cell", F.lit(False).alias("visitor"), no_cells.alias("counted"))
    )
    to_core = visits.filter((F.col("core_n") > 0) & (sure | ~never)).select(
        "uid", "vec_id", "label", "dim", F.lit(True).alias("core"),
        F.explode(F.sequence(F.col("core_block"), F.col("core_block") + F.col("core_parts") - 1)).alias("block"),
        sure.alias("sure"), "cell",
    )
    to_other = visits.filter("other_n > 0").select(
        "uid", "vec_id", "label", "dim", F.lit(False).alias("core"),
        F.explode(F.sequence(F.col("other_block"), F.col("other_block") + F.col("other_parts") - 1)).alias("block"),
        F.lit(False).alias("sure"), "cell",
    )
    asked = (
        to_core.unionByName(to_other)
        .groupBy("uid", "vec_id", *BLOCK)
        .agg(F.collect_set(F.when(F.col("sure"), F.col("cell"))).alias("counted"), F.min("sure").alias("all_sure"))
        .filter("not all_sure")
        .select("uid", "vec_id", *BLOCK, F.lit(0).cast("bigint").alias("cell"), F.lit(True).alias("visitor"), "counted")
    )
    together = stored.unionByName(asked).join(units.select("uid", "vec_id", "unit"), ["uid", "vec_id"])
    verified = together.repartition(*BLOCK).sortWithinPartitions(*BLOCK, "visitor").mapInArrow(_verify(least), "a bigint, n bigint, b bigint")
    found = materialise(counted.unionByName(verified), "found")
    labels = components(found.select("a", "b"))
    degrees = found.groupBy("a").agg(F.sum("n").alias("n"))
    joined = rows.select("vec_id").join(degrees, F.col("vec_id") == F.col("a"), "left").join(labels, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
