"""Whitening of embeddings: exact integer means, a covariance in two passes, projection on its components.

Entries become integers (``floor(64 c) + 1000000``), and each distinct integer vector counts once
in the fit. The first pass adds integers, so the mean is exact; the second adds outer products of
centred vectors, a block of rows at a time by matrix product. Each part's sums are one row, which
``treeAggregate`` merges, so the driver sees one square matrix. Its eigenvectors come from LAPACK
and go out to every task, where rows are centred exactly, projected and scaled.

Rows with a null vector, or with a null or non-finite entry, are dropped; so are vectors of another
length than the commonest one (of equally common ones the longer). Repeated rows each get their
result. Components without variance (at most 1e-12 of the total) have no whitened value and are
left out, so a table of one distinct vector gives no rows, like an empty one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import stored

#: Steps in a unit of an entry, and what is added so that usual values are positive.
STEPS, SHIFT = 64, 1_000_000
#: Rows of a matrix product.
BLOCK = 4096
#: Share of all variance under which a component counts as empty.
EMPTY = 1e-12


@dataclass(frozen=True)
class Model:
    """n distinct vectors, their sums by dimension, components as columns by falling eigenvalue, eigenvalues, trace and the largest deviation from the identity."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def integer_rows(df: DataFrame, vector_col: str = "embedding", keep: dict[str, str] | None = None) -> DataFrame:
    """The columns ``keep`` (new name to old) and the integer vector ``_x`` of every row whose vector is whole."""
    vector = F.col(f"`{vector_col}`")
    entry = lambda c: F.floor(F.lit(STEPS) * c.cast("double")).cast("bigint") + F.lit(SHIFT)
    whole = vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = df.where(whole & (F.size(vector) > 0)).select(*[F.col(f"`{old}`").alias(new) for new, old in (keep or {}).items()], F.transform(vector, entry).alias("_x"))
    sizes = rows.groupBy(F.size("_x").alias("size")).agg(F.count("*").alias("n"))
    # one row: the commonest length
    best = sizes.agg(F.max_by("size", F.struct("n", "size")).alias("_size"))
    return rows.join(F.broadcast(best), F.size("_x") == F.col("_size")).drop("_size")


def _matrix(batch: pa.RecordBatch, name: str = "_x") -> np.ndarray:
    """The vectors of a batch as rows of one array."""
    lists = batch.column(name)
    flat = np.asarray(lists.flatten())
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else flat.reshape(0, 0)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            yield _matrix(batch.slice(start, BLOCK))


def _merged(rows: DataFrame, part) -> object:
    """The sum over all parts of what ``part`` makes of a part's blocks (None: nothing), by treeAggregate."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = part(_blocks(batches))
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["sums"])

    def add(a, b):
        return b if a is None else a if b is None else tuple(x + y for x, y in zip(a, b))

    parts = rows.select("_x").mapInArrow(run, "sums binary").rdd.map(lambda r: pickle.loads(bytes(r.sums)))
    return parts.treeAggregate(None, add, add)


def _integer_sums(blocks: Iterator[np.ndarray]):
    """Number of rows and their sums by dimension; Python's integers can't overflow."""
    n, sums = 0, None
    for x in blocks:
        n += len(x)
        sums = x.sum(axis=0).astype(object) + (0 if sums is None else sums)
    return None if sums is None else (n, sums)


def _offsets(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact: in 64 bits where that has room, else in Python's integers."""
    largest = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max((abs(s) for s in sums), default=0)
    return x * n - sums.astype(np.int64) if largest < 2**62 else x.astype(object) * n - sums


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (_offsets(x, n, sums) / n).astype(np.float64)


def fit(rows: DataFrame, components: int = 16) -> Model | None:
    """Learn from the distinct vectors ``_x`` of ``integer_rows``; None where there is nothing to learn from.

    Equal vectors meet by a partial aggregation, so hot ones don't gather. The distinct vectors
    are written once in the shared folder; each of the three passes over them (sums, outer
    products, the check of the whitened covariance) reads them there.
    """
    distinct = stored(rows.groupBy("_x").agg(F.lit(1).alias("one")).select("_x"))
    total = _merged(distinct, _integer_sums)
    if total is None:
        return None
    n, sums = total

    def outer(blocks: Iterator[np.ndarray]):
        found = None
        for x in blocks:
            c = _centred(x, n, sums)
            found = c.T @ c + (0 if found is None else found)
        return None if found is None else (found,)

    covariance = _merged(distinct, outer)[0] / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    trace = float(np.trace(covariance))
    order = [i for i in np.argsort(-values, kind="stable")[:components] if values[i] > EMPTY * trace > 0]
    picked, e = vectors[:, order], values[order]

    def whitened(blocks: Iterator[np.ndarray]):
        found = None
        for x in blocks:
            w = _centred(x, n, sums) @ (picked / np.sqrt(e))
            found = w.T @ w + (0 if found is None else found)
        return None if found is None else (found,)

    error = float(np.abs(_merged(distinct, whitened)[0] / n - np.eye(len(e))).max()) if len(e) else 0.0
    return Model(n, sums, picked, e, trace, error)


def project(rows: DataFrame, model: Model, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """For each row and component: ``keep``, component (from 1), n, deviation (null where it exceeds 64 bits), whitened, explained, identity_error."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kinds}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.values)
        scaled, explained = m.components / np.sqrt(m.values), m.values / m.trace if k else m.values
        for batch in batches:
            for start in range(0, batch.num_rows if k else 0, BLOCK):
                piece = batch.slice(start, BLOCK)
                offsets = _offsets(_matrix(piece), m.n, m.sums)
                room = float(np.abs(offsets).max(initial=0)) ** 2 * offsets.shape[1] < 2**62
                squares = (offsets * offsets).sum(axis=1) if room else [v if (v := sum(int(y) ** 2 for y in row)) < 2**63 else None for row in offsets]
                white = (offsets / m.n).astype(np.float64) @ scaled
                again = pa.array(np.repeat(np.arange(piece.num_rows), k))
                size = len(again)
                columns = [piece.column(c).take(again) for c in keep]
                columns += [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), piece.num_rows)), pa.array(np.full(size, m.n, np.int64)), pa.array(squares, pa.int64()).take(again)]
                columns += [pa.array(white.ravel()), pa.array(np.tile(explained, piece.num_rows)), pa.array(np.full(size, m.identity_error))]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(*[F.col(f"`{c}`") for c in keep], "_x").mapInArrow(run, schema)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16) -> DataFrame:
    """Fit on the distinct vectors of a table and project all its rows; see ``project`` for the columns (the id is named ``vec_id``)."""
    rows = integer_rows(df, vector_col, {"vec_id": id_col})
    model = fit(rows, components)
    if model is None:
        none = np.zeros((0, 0))
        model = Model(0, none, none, np.zeros(0), 0.0, 0.0)
    return project(rows, model)
