"""Dense search by cells: the same hits as a search of all vectors, from fewer of them.

Vectors lie in cells around centres, each with the largest distance from its centre. A query's product with any vector
of a cell is at most its product with the centre and its own length times that distance. The cells with the best bounds
give each query a threshold; cells whose bound does not reach it are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import materialize
from . import dense, ranking

#: Vectors that the centres are fitted on, rounds of fitting, and vectors of a cell in the mean.
SAMPLE, ROUNDS, VECTORS = 20_000, 4, 256
#: Most centres, which bounds what a task holds of them, and cells of a query that are read first.
MOST_CENTRES, FIRST = 4096, 4
_SLACK = 2e-6


def _numbers(column) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cell = ((centres**2).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)
    return cell, np.sqrt(((x - centres[cell]) ** 2).sum(axis=1))


def fit_centres(vectors: DataFrame, n: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """n centres or fewer, by rounds of means over a sample of bounded size. They only decide how much can be skipped."""
    drawn = vectors.orderBy(F.xxhash64("chunk_id")).limit(sample).select("vector").toArrow().column("vector").combine_chunks()
    if not len(drawn):
        return np.zeros((0, 0))
    x = _numbers(drawn)
    centres = np.unique(x, axis=0)
    centres = centres[np.random.default_rng(3).permutation(len(centres))[:n]]
    for _ in range(rounds):
        cell, _ = _nearest(x, centres)
        size = np.bincount(cell, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, cell, x)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


@dataclass
class CellIndex:
    """vectors (cell, chunk_id, vector), in files by cell, and cells (cell, centre, radius, n)."""

    vectors: DataFrame
    cells: DataFrame

    @classmethod
    def build(cls, vectors: DataFrame, per_cell: int = VECTORS, sample: int = SAMPLE) -> CellIndex:
        """vectors (chunk_id, vector). Vectors that are null, hold a null or have another length than the longest are
        passed over."""
        about = vectors.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
        vectors = vectors.select("chunk_id", "vector").filter(dense.whole(about.d or 0))
        centres = fit_centres(vectors, int(min(MOST_CENTRES, max(1, about.n // per_cell))), sample)
        shared = vectors.sparkSession.sparkContext.broadcast(centres)

        def place(batches):
            for batch in batches:
                if batch.num_rows:
                    cell, far = _nearest(_numbers(batch.column("vector")), shared.value)
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(far), batch.column("chunk_id"), batch.column("vector")], ["cell", "far", "chunk_id", "vector"])

        kind, numbers = dict(vectors.dtypes)["chunk_id"], dict(vectors.dtypes)["vector"]
        placed = materialize(vectors.mapInArrow(place, f"cell int, far double, chunk_id {kind}, vector {numbers}").repartitionByRange("cell", "chunk_id").sortWithinPartitions("cell"), "dense-cells")
        radius = placed.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"))
        told = vectors.sparkSession.createDataFrame([(i, c) for i, c in enumerate(centres.tolist())], "cell int, centre array<double>")
        return cls(placed.drop("far"), materialize(told.join(radius, "cell"), "dense-centres"))

    def save(self, path: str, mode: str = "errorifexists") -> None:
        self.vectors.repartitionByRange("cell", "chunk_id").sortWithinPartitions("cell").write.mode(mode).parquet(f"{path}/vectors")
        self.cells.write.mode(mode).parquet(f"{path}/cells")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CellIndex:
        return cls(spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/cells"))

    def _bounds(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells, and the bound of every query's products in each; cells are MOST_CENTRES at most."""
        rows = self.cells.orderBy("cell").collect()
        centres = np.array([r.centre for r in rows], np.float64).reshape(len(rows), matrix.shape[1])
        lengths = np.sqrt((matrix**2).sum(axis=1))
        reach = lengths[:, None] * np.array([r.radius for r in rows], np.float64)
        return np.array([r.cell for r in rows], np.int64), matrix @ centres.T + reach + 1e-9 * (lengths[:, None] * np.sqrt((centres**2).sum(axis=1)) + reach)

    def _read(self, ids: pa.Array, matrix: np.ndarray, cells: np.ndarray, wanted: np.ndarray, k: int, digits: int, kinds: tuple[str, str]) -> DataFrame:
        """Of each query the k best candidates of every batch of the cells that are wanted for it (queries x cells)."""
        asked = {int(c): np.flatnonzero(wanted[:, j]) for j, c in enumerate(cells) if wanted[:, j].any()}
        shared = self.vectors.sparkSession.sparkContext.broadcast((ids, matrix, asked))

        def run(batches):
            ids, matrix, asked = shared.value
            for batch in batches:
                cell = batch.column("cell").to_numpy()
                cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else []
                for a, b in zip(cuts, [*cuts[1:], len(cell)], strict=True):
                    mine = asked.get(int(cell[a]))
                    if mine is None:
                        continue
                    part = batch.slice(int(a), int(b - a)).sort_by("chunk_id")
                    dot = np.round(_numbers(part.column("vector")) @ matrix[mine].T, digits)
                    best = np.argsort(-dot, axis=0, kind="stable")[:k]
                    which = np.tile(np.arange(len(mine)), (best.shape[0], 1))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(mine[which.ravel()])), part.column("chunk_id").take(pa.array(best.ravel())), pa.array(dot[best.ravel(), which.ravel()])], ["query_id", "chunk_id", "score"])

        kept = self.vectors.filter(F.col("cell").isin(list(asked))) if len(asked) < len(cells) else self.vectors
        return kept.mapInArrow(run, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")

    def search(self, queries: DataFrame, k: int, digits: int = 6, first: int = FIRST) -> tuple[DataFrame, float]:
        """queries (query_id, vector), a stated set -> the hits that dense.search gives over all vectors, and which share of
        queries x vectors was multiplied. Queries are taken in blocks of dense.BLOCK_BYTES."""
        kinds = dict(queries.dtypes)["query_id"], dict(self.vectors.dtypes)["chunk_id"]
        sizes = {r.cell: r.n for r in self.cells.select("cell", "n").collect()}
        out, done, all_ = None, 0, 0
        for ids, matrix in dense.query_blocks(queries, (self.cells.select(F.size("centre")).first() or [0])[0]):
            cells, bound = self._bounds(matrix)
            n = np.array([sizes[int(c)] for c in cells])
            wanted = np.zeros(bound.shape, bool)
            if len(cells) and len(ids):
                np.put_along_axis(wanted, np.argsort(-bound, axis=1, kind="stable")[:, :first], True, axis=1)
                seen = materialize(ranking.top_k(self._read(ids, matrix, cells, wanted, k, digits, kinds), k, digits), "dense-first")
                least = {r.query_id: r.score for r in seen.filter(F.col("rank") == k).collect()}  # one a query of the block
                wanted |= bound >= np.array([least.get(i, -np.inf) for i in ids.to_pylist()])[:, None] - _SLACK
                found = self._read(ids, matrix, cells, wanted, k, digits, kinds)
                out = found if out is None else out.unionByName(found)
            done, all_ = done + float((wanted * n).sum()), all_ + float(len(ids) * n.sum())
        if out is None:
            out = queries.sparkSession.createDataFrame([], f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")
        return ranking.top_k(out, k, digits), done / all_ if all_ else 0.0
