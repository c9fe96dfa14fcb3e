"""Whitening of vectors: the leading components of their covariance, found without ever forming it.

Vectors become integers once; each distinct one is fitted once. Block Lanczos asks for products of
the covariance with a few vectors, each a pass over the fitted rows; the driver holds only matrices
of dimensions by columns.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, scratch, small_batches

COMPONENTS = 4
#: Columns of a block; where the largest residual against the largest eigenvalue ends the passes; the least eigenvalue, against it, that is whitened.
BLOCK, TOLERANCE, LEAST = 8, 5e-14, 1e-12
#: States merged by one task.
FAN = 64
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as doubles) by length; rows whose vector is null or holds a null or an entry that isn't finite are in none."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    for size in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero(lengths == size)
        values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), size)
        good = np.isfinite(values).all(axis=1)
        yield rows[good], values[good]


def quantized(values: np.ndarray) -> np.ndarray:
    """floor(256 * c) as long; what no long can hold becomes the nearest that one can."""
    with np.errstate(over="ignore"):
        x = np.floor(256 * values)
    inside = (x >= -(2.0**63)) & (x < 2.0**63)
    out = np.where(inside, x, 0).astype(np.int64)
    out[x >= 2.0**63] = HIGH
    out[x < -(2.0**63)] = LOW
    return out


def packed(x: np.ndarray) -> Iterator[bytes]:
    """Each row in as few bytes for an entry as its largest needs, after their number; equal rows are equal bytes."""
    low, high = (x.min(axis=1), x.max(axis=1)) if x.shape[1] else (np.zeros(len(x), np.int64),) * 2
    width = np.select([(low >= -(1 << (8 * w - 1))) & (high < 1 << (8 * w - 1)) for w in (1, 2, 4)], [1, 2, 4], 8)
    return (bytes([w]) + row.astype(f"<i{w}").tobytes() for w, row in zip(width.tolist(), x, strict=True))


def unpacked(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of longs; shorter vectors end in zeros."""
    out = np.zeros((len(column), dims), np.int64)
    for i, raw in enumerate(column.to_pylist()):
        own = np.frombuffer(raw, f"<i{raw[0]}", offset=1)
        out[i, : len(own)] = own
    return out


def reduced(rows: DataFrame, add: Callable, merge: Callable):
    """The states that `add(state or None, Arrow column)` makes of each partition's batches, merged in order; None without rows.

    At most FAN states meet in a task, level by level, and at most FAN * FAN reach the driver.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                state = add(state, batch.column(0))
        if state is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([part // FAN], pa.int64()), pa.array([pickle.dumps(state)], pa.binary())], names=["part", "slot", "state"])

    def several(group: pa.Table) -> pa.Table:
        state = functools.reduce(merge, map(pickle.loads, group.sort_by("part").column("state").to_pylist()))
        slot = group.column("slot")[0].as_py()
        return pa.table([pa.array([slot], pa.int64()), pa.array([slot // FAN], pa.int64()), pa.array([pickle.dumps(state)], pa.binary())], names=["part", "slot", "state"])

    parts = rows.rdd.getNumPartitions()
    schema = "part long, slot long, state binary"
    states = rows.mapInArrow(each, schema)
    while parts > FAN * FAN:
        states, parts = states.groupBy("slot").applyInArrow(several, schema), -(-parts // FAN)
    return functools.reduce(merge, (pickle.loads(r["state"]) for r in states.orderBy("part").collect()), None) if parts else None


def merging(fn: Callable) -> Callable:
    """fn for two states, of which the first may be missing."""
    return lambda a, b: b if a is None else fn(a, b)


def totals(fit: DataFrame) -> tuple[int, list[int], int]:
    """(n, sums per dimension, largest absolute entry) of the fitted rows, exact at any size."""

    def padded(a: list[int], b: list[int]) -> list[int]:
        size = max(len(a), len(b))
        return [x + y for x, y in zip(a + [0] * (size - len(a)), b + [0] * (size - len(b)), strict=True)]

    def add(state, column):
        raw = column.to_pylist()
        x = unpacked(column, max((len(r) - 1) // r[0] for r in raw))
        most = max(int(x.max()), -int(x.min())) if x.size else 0
        sums = (x if most < 1 << 40 else x.astype(object)).sum(axis=0).tolist()
        own = (len(raw), [int(s) for s in sums], most)
        return own if state is None else both(state, own)

    def both(a, b):
        return a[0] + b[0], padded(a[1], b[1]), max(a[2], b[2])

    return reduced(fit, add, merging(both)) or (0, [], 0)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return x.astype(np.float64) - np.array([s / n for s in sums])


def deviations(x: np.ndarray, n: int, sums: list[int], most: int) -> np.ndarray:
    """Sums over dimensions of (n * x - S)^2, exact: as long where it is sure to fit, else as Python's integers."""
    bound = 2 * n * most
    if len(sums) * bound * bound < HIGH:
        y = n * x - np.array(sums, np.int64)
        return (y * y).sum(axis=1)
    y = n * x.astype(object) - np.array(sums, object)
    return (y * y).sum(axis=1) if len(sums) else np.zeros(len(x), np.int64)


def covariance_times(fit: DataFrame, n: int, sums: list[int], q: np.ndarray) -> np.ndarray:
    """V q in one pass: each batch adds Z'(Z q) for its centred rows Z."""

    def add(state, column):
        z = centred(unpacked(column, len(sums)), n, sums)
        own = z.T @ (z @ q)
        return own if state is None else state + own

    return reduced(fit, add, merging(lambda a, b: a + b)) / n


def extended(basis: np.ndarray, block: np.ndarray, floor: float, rng: np.random.Generator) -> np.ndarray:
    """basis with the directions that block adds; one that adds none (a breakdown) is restarted at random."""
    for v in block.T:
        if basis.shape[1] == len(basis):
            break
        least = floor
        while True:
            for _ in range(2):
                v = v - basis @ (basis.T @ v)
            size = float(np.linalg.norm(v))
            if size > least:
                break
            v, least = rng.standard_normal(len(basis)), 0.0
        v = v / size
        for _ in range(2):
            v = v - basis @ (basis.T @ v)
        basis = np.column_stack([basis, v / np.linalg.norm(v)])
    return basis


def block_lanczos(times: Callable[[np.ndarray], np.ndarray], dims: int, want: int, block: int = BLOCK, tolerance: float = TOLERANCE, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns), the `want` largest of a symmetric non-negative matrix known by its products.

    Each pass multiplies one block, whose image, orthogonal to all before, is the next. Ends when the
    residuals of the wanted pairs are small against the largest eigenvalue, or the basis is whole.
    """
    rng, block = np.random.default_rng(seed), max(block, want)
    basis, image = np.zeros((dims, 0)), np.zeros((dims, 0))
    new, floor = rng.standard_normal((dims, min(block, dims))), 0.0
    while True:
        held = basis.shape[1]
        basis = extended(basis, new, floor, rng)
        image = np.column_stack([image, times(basis[:, held:])])
        small = basis.T @ image
        values, turned = np.linalg.eigh((small + small.T) / 2)
        values, turned = values[::-1][:want], turned[:, ::-1][:, :want]
        vectors = basis @ turned
        residual = np.linalg.norm(image @ turned - vectors * values, axis=0)
        if basis.shape[1] == dims or (residual <= tolerance * max(values[0], 0)).all():
            return np.maximum(values, 0), vectors / np.linalg.norm(vectors, axis=0)
        new, floor = image[:, held:], LEAST * max(values[0], 0)


def moments(fit: DataFrame, n: int, sums: list[int], most: int, axes: np.ndarray) -> tuple[int, np.ndarray]:
    """(sum of deviations, covariance of the rows projected on axes); means are merged as well, so products are of centred values."""

    def add(state, column):
        x = unpacked(column, len(sums))
        w = centred(x, n, sums) @ axes
        mean = w.mean(axis=0)
        own = (sum(deviations(x, n, sums, most).tolist()), len(w), mean, (w - mean).T @ (w - mean))
        return own if state is None else both(state, own)

    def both(a, b):
        count, step = a[1] + b[1], b[2] - a[2]
        return a[0] + b[0], count, a[2] + step * (b[1] / count), a[3] + b[3] + np.outer(step, step) * (a[1] * b[1] / count)

    deviation, _, _, products = reduced(fit, add, merging(both))
    return deviation, products / n


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Each row's place on the leading components of the covariance, in units of their standard deviations.

    Rows whose vector is null or holds a null or a non-finite entry are left out. Shorter vectors end in
    zeros. Repeated rows and rows of one vector each get their rows, but a vector is fitted once. Components
    whose eigenvalue is under LEAST of the largest are none: vectors that are all one, one row, an empty
    table give an empty result. Among equal eigenvalues any basis of their space is right; rows agree on it.
    A deviation that no long can hold is null in `deviation`; deviation_text has all digits. Other columns,
    whatever their names, take no part. Result: id_col, component, n, deviation, whitened, explained,
    identity_error, deviation_text.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("i"), F.col(vector_col).cast("array<double>").alias("v"))

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [p for _, m in matrices(batch.column(0)) for p in packed(quantized(m))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["x"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")], T.StructField("deviation_text", T.StringType())])
    with scratch():
        fit = materialize(rows.select("v").mapInArrow(shrink, "x binary").distinct(), "whiten-fit")
        n, sums, most = totals(fit)
        if not n or not sums:
            return df.sparkSession.createDataFrame([], schema)
        values, vectors = block_lanczos(lambda q: covariance_times(fit, n, sums, q), len(sums), min(components, len(sums)))
        kept = values > LEAST * values[0]
        values, vectors = values[kept], vectors[:, kept]
        if not len(values):
            return df.sparkSession.createDataFrame([], schema)
        axes = vectors / np.sqrt(values)
        deviation, products = moments(fit, n, sums, most, axes)
    error = float(np.abs(products - np.eye(len(values))).max())
    shares = [float(e) * n**3 / deviation for e in values]
    out, k = to_arrow_schema(schema), len(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, m in matrices(batch.column(1)):
                x = np.zeros((len(at), len(sums)), np.int64)
                x[:, : m.shape[1]] = quantized(m)
                w = centred(x, n, sums) @ axes
                far = deviations(x, n, sums, most).tolist()
                twice = np.repeat(np.arange(len(at)), k)
                ids = batch.column(0).take(pa.array(at[twice])).cast(out.field(0).type)
                longs = [d if d <= HIGH else None for d in far]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array([n] * len(twice), pa.int64()), pa.array([longs[i] for i in twice.tolist()], pa.int64()), pa.array(w.reshape(-1)), pa.array(shares * len(at), pa.float64()), pa.array([error] * len(twice), pa.float64()), pa.array([str(far[i]) for i in twice.tolist()], pa.string())], schema=out
                )

    return rows.mapInArrow(project, schema)
