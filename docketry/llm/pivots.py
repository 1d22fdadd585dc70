"""Exact top-k search by inner product, with a table of distances to pivots for elimination."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docketry.store import materialise

PIVOTS = 32
SAMPLE_VECTORS = 4096
CANDIDATES_PER_GROUP = 8192
QUERIES_PER_GROUP = 2048
FIRST_STEP = 32
MARGIN = 1e-9

VECTOR = "row bigint, id bigint, asks boolean, dim int, v array<bigint>"
TABLE = f"{VECTOR}, far array<double>, cell int"


@dataclass
class Pivots:
    """Pivots of one dimension, and what one task needs to know of the vectors.

    An inner product is turned into a distance: a candidate c gets one more coordinate,
    sqrt(longest^2 - |c|^2), a query q gets 0. Then |q - c|^2 = |q|^2 + longest^2 - 2 <q, c>, so
    the nearest candidates are those with the highest products.
    """

    points: np.ndarray  # with the further coordinate
    longest2: float
    sample_rows: np.ndarray
    sample: np.ndarray

    def distances(self, vectors: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of each vector, with its further coordinate, to each pivot."""
        squares = (vectors * vectors).sum(1) + last * last
        cross = vectors @ self.points[:, :-1].T + last[:, None] * self.points[None, :, -1]
        return np.sqrt(np.maximum(squares[:, None] - 2 * cross + (self.points**2).sum(1)[None, :], 0))

    def last(self, vectors: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.longest2 - (vectors * vectors).sum(1), 0))

    def slack(self, squares: np.ndarray) -> np.ndarray:
        """More than the rounding errors of a bound can be."""
        return MARGIN * (squares + self.longest2) + MARGIN

    def bound(self, squares: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """No candidate at least `apart` away has a higher product than this."""
        return (squares + self.longest2 - apart * apart) / 2 + self.slack(squares)


def choose_pivots(sample: np.ndarray, longest2: float, rows: np.ndarray, most: int) -> Pivots:
    """Pivots far from each other: the longest vector first, then always the farthest from those chosen."""
    vectors = sample.astype(float)
    points = np.column_stack([vectors, np.sqrt(np.maximum(longest2 - (vectors * vectors).sum(1), 0))])
    at = [int((vectors * vectors).sum(1).argmax())]
    nearest = ((points - points[at[0]]) ** 2).sum(1)
    while len(at) < most and nearest.max() > 0:
        at.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((points - points[at[-1]]) ** 2).sum(1))
    return Pivots(points[at], longest2, rows, sample)


def _matrix(column: pa.Array, dim: int, dtype) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, dim)


def _measure(pivots: dict[int, Pivots]):
    """The pivot table: the distances of each candidate, and its nearest pivot as its cell."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                vectors = _matrix(own.column("v"), dim, float)
                far = pivots[dim].distances(vectors, pivots[dim].last(vectors))
                columns = [pa.array(list(far), pa.list_(pa.float64())), pa.array(far.argmin(1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*own.columns, *columns], [*own.schema.names, "far", "cell"])

    return work


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, ties by smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _floor(pivots: Pivots, row: int, query: np.ndarray, k: int) -> int | None:
    """A score that at least k candidates reach: the k-th of the sample, without the query itself."""
    scores = (pivots.sample @ query)[pivots.sample_rows != row]
    return int(np.partition(scores, -k)[-k]) if len(scores) >= k else None


def _visits(pivots: dict[int, Pivots], cells: dict[tuple[int, int], tuple], k: int):
    """Which cells each query has to see: those in which a candidate may reach its floor."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, rows = batch.column("dim").to_numpy(), batch.column("row").to_numpy()
            take, cell, far, floors = [], [], [], []
            for dim in np.unique(dims).tolist():
                own, p = np.flatnonzero(dims == dim), pivots[dim]
                exact = _matrix(batch.column("v").take(pa.array(own)), dim, np.int64)
                vectors = exact.astype(float)
                squares = (vectors * vectors).sum(1)
                apart = p.distances(vectors, np.zeros(len(own)))
                lower = [_floor(p, int(rows[i]), exact[n], k) for n, i in enumerate(own.tolist())]
                least = np.array([-np.inf if x is None else x for x in lower], float)
                for (d, c), (low, high) in cells.items():
                    if d == dim:
                        gap = np.maximum(np.maximum(apart - high, low - apart), 0).max(1)
                        seen = np.flatnonzero(p.bound(squares, gap) >= least)
                        take.append(own[seen])
                        cell.append(np.full(len(seen), c))
                        far += list(apart[seen])
                        floors += [lower[n] for n in seen.tolist()]
            rows_at = pa.array(np.concatenate([*take, np.zeros(0, np.int64)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    *(c.take(rows_at) for c in batch.columns),
                    pa.array(far, pa.list_(pa.float64())),
                    pa.array(np.concatenate([*cell, np.zeros(0, np.int64)]).astype(np.int32)),
                    pa.array(floors, pa.int64()),
                ],
                [*batch.schema.names, "far", "cell", "floor"],
            )

    return work


def _search(pivots: dict[int, Pivots], k: int):
    """The k best candidates of one group for each of its queries, in the order of their bounds.

    A candidate is at least as far from a query as their distances to any pivot differ. Products
    are taken in steps, highest bound first, until the next bound is below the k-th product found,
    or below the floor; candidates that tie with it are still seen.
    """

    def work(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out = {"query": [], "query_id": [], "id": [], "score": []}
        if len(queries) and len(candidates):
            dim = queries.column("dim")[0].as_py()
            p = pivots[dim]
            vectors, asked = (_matrix(t.column("v"), dim, np.int64) for t in (candidates, queries))
            far, apart = (_matrix(t.column("far"), len(p.points), float) for t in (candidates, queries))
            rows, ids = (candidates.column(c).to_numpy() for c in ("row", "id"))
            squares = (asked.astype(float) ** 2).sum(1)
            floors = queries.column("floor").to_pylist()
            q_rows, q_ids = queries.column("row").to_pylist(), queries.column("id").to_pylist()
            for n, query in enumerate(asked):
                gap = np.abs(far[:, 0] - apart[n, 0])
                for j in range(1, far.shape[1]):
                    np.maximum(gap, np.abs(far[:, j] - apart[n, j]), out=gap)
                bounds = p.bound(squares[n], gap)
                left = np.flatnonzero((bounds >= (-np.inf if floors[n] is None else floors[n])) & (rows != q_rows[n]))
                left = left[np.argsort(-bounds[left], kind="stable")]
                kept, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
                done, step = 0, FIRST_STEP
                while done < len(left) and (len(kept) < k or bounds[left[done]] >= scores[-1]):
                    step_rows = left[done : done + step]
                    both = np.concatenate([kept, step_rows])
                    values = np.concatenate([scores, vectors[step_rows] @ query])
                    order = _best(values, ids[both], k)
                    kept, scores = both[order], values[order]
                    done, step = done + len(step_rows), 2 * step
                out["query"] += [q_rows[n]] * len(kept)
                out["query_id"] += [q_ids[n]] * len(kept)
                out["id"] += ids[kept].tolist()
                out["score"] += scores.tolist()
        return pa.table({name: pa.array(values, pa.int64()) for name, values in out.items()})

    return work


def _parts(rows: DataFrame, keys: list[str], size: int, name: str) -> DataFrame:
    """How many parts of about `size` rows each group is dealt into."""
    return rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))


def top_products(
    vectors: DataFrame, id_column: str, v_column: str, asks: Column, k: int = 5, pivots: int = PIVOTS
) -> DataFrame:
    """query_id, rank (from 1), id and score: for each row that `asks`, the k other rows with the highest inner product.

    `v_column` is an array of whole numbers; products are exact in 64 bits. Ties go to the smaller
    id. Fewer than k rows come back only where fewer other rows exist.

    1. Pivots, for each dimension: vectors of a sample of about `SAMPLE_VECTORS` rows, far from
       each other. The sample also gives each query a first floor, the k-th best score in it.
    2. The pivot table, written: every candidate with its distances to all pivots. Its nearest
       pivot is its cell; a cell keeps the least and greatest of these distances.
    3. A query goes to the cells whose bound reaches its floor, in groups of bounded size: large
       cells are dealt into parts by row, and so are the queries of a cell.
    4. In a group, candidates are evaluated in the order of their bounds until the next bound is
       below the k-th score. The groups' best are ranked together.

    Groups hold `CANDIDATES_PER_GROUP` and `QUERIES_PER_GROUP` rows on average however many equal
    vectors there are. Sample, pivots and cell limits have fixed sizes for a dimension; they alone
    leave Spark. What is eliminated is certain, so the result is that of a full comparison.

    Rows take no part if the id is null or the vector is null or has a null component; only rows
    of equal dimension are compared. Rows with the same id are different rows, and each that asks
    is answered. An empty table gives no rows, as does k = 0. Other columns are left alone,
    whatever their names.
    """
    whole = f"`{v_column}`"
    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{id_column}`").cast("bigint").alias("id"),
        F.coalesce(asks, F.lit(False)).alias("asks"),
        F.size(whole).alias("dim"),
        F.col(whole).cast("array<bigint>").alias("v"),
    ).filter("id is not null and v is not null and dim > 0 and not exists(v, x -> x is null)")
    rows = materialise(rows, "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("longest2")).collect()
    spark = vectors.sparkSession
    best = "query bigint, query_id bigint, id bigint, score bigint"
    if not sizes or k < 1:
        return spark.createDataFrame(pa.table({"query_id": pa.array([], pa.int64()), "rank": pa.array([], pa.int32()), id_column: pa.array([], pa.int64()), "score": pa.array([], pa.int64())}))
    books = {}
    for size in sizes:
        own = rows.filter(F.col("dim") == size.dim).select("row", "v")
        share = max(size.n // SAMPLE_VECTORS, 1)
        drawn = own.filter(F.pmod(F.xxhash64("row"), F.lit(share)) == 0).limit(2 * SAMPLE_VECTORS).toArrow()
        if not len(drawn):
            drawn = own.limit(SAMPLE_VECTORS).toArrow()
        books[size.dim] = choose_pivots(
            _matrix(drawn.column("v"), size.dim, np.int64), size.longest2, drawn.column("row").to_numpy(), pivots
        )
    table = materialise(rows.mapInArrow(_measure(books), TABLE), "pivot_table")
    cell = ["dim", "cell"]
    limits = (
        table.select(*cell, F.posexplode("far").alias("at", "d"))
        .groupBy(*cell, "at")
        .agg(F.min("d").alias("low"), F.max("d").alias("high"))
        .groupBy(*cell)
        .agg(F.sort_array(F.collect_list(F.struct("at", "low", "high"))).alias("limits"))
    )
    cells = {
        (r.dim, r.cell): (np.array([x.low for x in r.limits]), np.array([x.high for x in r.limits])) for r in limits.collect()
    }
    visits = materialise(
        rows.filter("asks").mapInArrow(_visits(books, cells, k), f"{TABLE}, floor bigint"), "visits"
    )
    parts = _parts(table, cell, CANDIDATES_PER_GROUP, "parts")
    teams = _parts(visits, cell, QUERIES_PER_GROUP, "teams")
    deal = lambda n: F.pmod(F.xxhash64("row"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asked = visits.join(parts, cell).join(teams, cell)
    asked = asked.select("*", deal(F.col("teams")).alias("team"), every(F.col("parts")).alias("part"))
    offered = table.join(parts, cell).join(teams, cell)
    offered = offered.select("*", deal(F.col("parts")).alias("part"), every(F.col("teams")).alias("team"))
    group = [*cell, "part", "team"]
    found = (
        asked.select(*group, "row", "id", "v", "far", "floor").groupBy(*group)
        .cogroup(offered.select(*group, "row", "id", "v", "far").groupBy(*group))
        .applyInArrow(_search(books, k), best)
    )
    order = W.partitionBy("query").orderBy(F.desc("score"), "id")
    ranked = found.select("*", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_column), "score")


def scaled_down(v: Column, factor: int) -> Column:
    """floor(factor * x) of every component in double precision; null if a component is null or not finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * factor))
    return F.when(~bad, whole)
