"""Whitening of embeddings by incremental eigendecomposition.

1. Each partition holds the spectrum of what it has seen: count, mean, eigenvalues and eigenvectors of the centred scatter.
   A block of rows is centred and folded by an orthogonal factorisation into at most as many rows as the vectors have
   dimensions (their scatter is the block's); each of these, and the shift between the two means, is a rank-one update: the
   new eigenvalues are the roots of a secular equation between the old ones, the new vectors follow from Löwner's formula.
   Directions the update does not touch, and equal eigenvalues (turned so that one carries the update), are deflated.
2. Spectra are combined by the same updates, one for each eigenpair and one for the means, in a tree of ``FAN`` at a time.
   A spectrum keeps ``width`` directions at most; it is whole where vectors have no more dimensions than that.
3. Rayleigh-Ritz: the covariance is applied to the vectors found, centred before multiplying, in one pass over all rows, and
   the small problem is solved. Where ``width`` cut directions off, the products become the next basis until the residual
   of the wanted components is at the level of rounding or no longer shrinks.
4. The whitened vectors' own covariance is measured in one more pass.

Entries become the integers floor(1024 c) + 100000; counts, sums and deviations are exact integers. Rows whose vector is null
or empty, holds null or non-finite entries or entries beyond ``LARGEST`` are dropped; where vectors differ in length, those
of the most frequent length (the shorter one in a tie) remain. Rows repeat as they do in the input, a null vec_id is carried
on, other columns are not read. A component without variance has ``whitened`` null and counts in no error; a deviation that
needs more than 63 bits is null. Without remaining rows the result is empty.

No row depends on the driver's memory: what reaches it are ``length`` x ``width`` sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.base import stage

SCALE, SHIFT, LARGEST = 1024, 100_000, 2.0**40
COMPONENTS, WIDTH, BLOCK, FAN = 8, 64, 1024, 16
_EPS = np.finfo(np.float64).eps


# --- one spectrum and its rank-one update -------------------------------------------------------------------------------


def _secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(weights / (poles - x)), one behind each pole; poles ascend strictly, weights are positive.

    Returns the nearest pole's index and the distance to it of each root, which keeps the digits that a sum would lose.
    """
    k = len(poles)
    own = np.arange(k)
    gaps = poles - poles[:, None]  # of every pole, as seen from the one before the root
    width = np.append(np.diff(poles), weights.sum())
    # The sign at the middle of an interval tells which end the root is nearer to.
    at_middle = 1 + (weights / (gaps - width[:, None] / 2)).sum(axis=1)
    origin = np.where((at_middle < 0) & (own < k - 1), own + 1, own)
    gaps = gaps - (poles[origin] - poles)[:, None]
    right_end = at_middle < 0
    low = np.where(right_end, np.where(origin > own, -width / 2, width / 2), 0.0)
    high = np.where(right_end, np.where(origin > own, 0.0, width), width / 2)
    left = np.where(own == k - 1, max(k - 2, 0), own)
    right = np.minimum(left + 1, k - 1)
    behind = own <= left[:, None]
    d_left, d_right = gaps[own, left], gaps[own, right]
    x = (low + high) / 2
    active = own
    for _ in range(100):
        at = x[active]
        apart = gaps[active] - at[:, None]
        ratio = weights / apart
        slope = ratio / apart
        value = 1 + ratio.sum(axis=1)
        slope_all, slope_left = slope.sum(axis=1), (slope * behind[active]).sum(axis=1)
        noise = _EPS * (2 + 8 * np.abs(ratio).sum(axis=1) + np.abs(at) * slope_all)
        low[active], high[active] = np.where(value < 0, at, low[active]), np.where(value < 0, high[active], at)
        bottom, top = low[active], high[active]
        going = (np.abs(value) > noise) & (top - bottom > 2 * _EPS * np.maximum(np.abs(bottom), np.abs(top)))
        if not going.any():
            break
        # The two poles next to the root are kept as they are, the others count as a constant.
        a, b = d_left[active] - at, d_right[active] - at
        c = value - a * slope_left - b * (slope_all - slope_left)
        p, q = (a + b) * value - a * b * slope_all, a * b * value
        # The last root lies behind both poles, the others between them: the other solution of the quadratic equation.
        root = np.where(active == k - 1, -1.0, 1.0) * np.sqrt(np.abs(p * p - 4 * q * c))
        guess = at + np.where(p * root <= 0, (p - root) / (2 * c), 2 * q / (p + root))
        inside = (guess > bottom) & (guess < top)
        x[active[going]] = np.where(inside, guess, (bottom + top) / 2)[going]
        active = active[going]
    return origin, x


def rank_one(values: np.ndarray, vectors: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of diag(values) + z z', times ``vectors``; ``values`` ascend."""
    scale = max(float(np.abs(values).max(initial=0)), float(z @ z))
    if scale == 0:
        return values, vectors
    tiny = 8 * _EPS * scale
    size = float(np.sqrt(z @ z))
    z, vectors = z.copy(), vectors.copy()
    for i in np.flatnonzero(np.diff(values) <= tiny):  # equal eigenvalues: turned until the later one carries both parts
        length = np.hypot(z[i], z[i + 1])
        if length:
            c, s = z[i + 1] / length, z[i] / length
            vectors[:, i], vectors[:, i + 1] = c * vectors[:, i] - s * vectors[:, i + 1], s * vectors[:, i] + c * vectors[:, i + 1]
            z[i], z[i + 1] = 0.0, length
    moved = np.flatnonzero(np.abs(z) * size > tiny)
    if not len(moved):
        return values, vectors
    poles, weights = values[moved], z[moved] ** 2
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        origin, x = _secular_roots(poles, weights)
    k = len(poles)
    apart = (poles[:, None] - poles[origin]) - x  # pole minus root
    # Weights for which the computed roots are exact; the vectors then are orthogonal whatever the roots' rounding.
    between = poles[:, None] - poles
    np.fill_diagonal(between, 1.0)
    ratio = apart / between
    exact = -np.prod(np.where(np.eye(k, dtype=bool), 1.0, ratio), axis=1) * np.diag(apart)
    part = np.sqrt(np.maximum(exact, 0.0)) * np.where(z[moved] < 0, -1.0, 1.0)
    new = part[:, None] / np.where(apart == 0, _EPS * scale, apart)
    new /= np.sqrt((new * new).sum(axis=0))
    values, roots = values.copy(), poles[origin] + x
    vectors[:, moved] = vectors[:, moved] @ new
    values[moved] = np.maximum(roots, poles)
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Count, mean and the eigenpairs (values ascend) of the centred scatter of the rows seen."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    width: int

    @classmethod
    def empty(cls, length: int, width: int) -> Spectrum:
        return cls(0, np.zeros(length), np.zeros(0), np.zeros((length, 0)), width)

    def update(self, v: np.ndarray) -> None:
        """Add v v' to the scatter; a part of v outside the known directions becomes a direction."""
        size = np.sqrt(v @ v)
        if size == 0:
            return
        inside = self.vectors.T @ v
        rest = v - self.vectors @ inside
        again = self.vectors.T @ rest
        rest -= self.vectors @ again
        inside += again
        outside = np.sqrt(rest @ rest)
        values, vectors, z = self.values, self.vectors, inside
        if outside > 64 * _EPS * size and vectors.shape[1] < len(v):
            values, vectors = np.insert(values, 0, 0.0), np.column_stack([rest / outside, vectors])
            z = np.insert(z, 0, outside)
        values, vectors = rank_one(values, vectors, z)
        self.values, self.vectors = values[-self.width :], vectors[:, -self.width :]

    def add_rows(self, rows: np.ndarray, fold: bool = True) -> None:
        """A block of rows: its centred scatter, then the shift of the mean."""
        n, mean = len(rows), rows.mean(axis=0)
        centred = rows - mean
        folded = np.linalg.qr(centred, mode="r") if fold and n > rows.shape[1] else centred
        self._merge(n, mean, folded)

    def add(self, other: Spectrum) -> None:
        self._merge(other.n, other.mean, (other.vectors * np.sqrt(np.maximum(other.values, 0.0))).T)

    def _merge(self, n: int, mean: np.ndarray, scatter_rows: np.ndarray) -> None:
        if self.n:
            self.update((mean - self.mean) * np.sqrt(self.n * n / (self.n + n)))
        for row in scatter_rows:
            self.update(row)
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
        self.n += n


# --- passes over the table ----------------------------------------------------------------------------------------------


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, x): rows that remain, their entries as the integers the fit works on."""
    wide = table.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    sound = F.col("e").isNotNull() & (F.size("e") > 0)
    sound &= F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= LARGEST))
    x = F.transform("e", lambda v: F.floor(v * SCALE) + SHIFT)
    return wide.where(sound).select("vec_id", x.alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _spectra(rows: DataFrame, length: int, width: int, block: int, fold: bool) -> DataFrame:
    """One spectrum a partition, with the exact sum of its rows."""
    schema = "part long, n long, sums array<decimal(38,0)>, mean array<double>, eigenvalues array<double>, eigenvectors array<double>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum, total = Spectrum.empty(length, width), np.zeros(length, dtype=object)
        held: list[np.ndarray] = []

        def take() -> None:
            nonlocal total
            joined = np.concatenate(held)
            held.clear()
            total = total + exact_sum(joined)
            spectrum.add_rows(joined.astype(np.float64), fold)

        for _, x in _blocks(batches, length):
            held.append(x)
            if sum(map(len, held)) >= block:
                take()
        if held:
            take()
        if spectrum.n:
            numbers = pa.list_(pa.float64())
            columns = [
                pa.array([TaskContext.get().partitionId()], pa.int64()),
                pa.array([spectrum.n], pa.int64()),
                pa.array([[Decimal(int(t)) for t in total]], pa.list_(pa.decimal128(38, 0))),
                pa.array([spectrum.mean], numbers),
                pa.array([spectrum.values], numbers),
                pa.array([spectrum.vectors.ravel()], numbers),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["part", "n", "sums", "mean", "eigenvalues", "eigenvectors"])

    return rows.select("x").mapInArrow(scan, schema)


def exact_sum(x: np.ndarray) -> np.ndarray:
    """Column sums as Python integers: 64 bits hold the sums of the upper and of the lower halves of the entries."""
    high, low = x >> 32, x & 0xFFFFFFFF
    return high.sum(axis=0).astype(object) * (1 << 32) + low.sum(axis=0).astype(object)


def _combined(spectra: DataFrame, length: int, width: int) -> Spectrum:
    """The spectrum of all rows: ``FAN`` at a time, in rounds, until one is left."""
    schema = "part long, n long, mean array<double>, eigenvalues array<double>, eigenvectors array<double>"

    def read(row) -> Spectrum:
        values = np.asarray(row.eigenvalues, dtype=float)
        return Spectrum(int(row.n), np.asarray(row.mean, dtype=float), values, np.asarray(row.eigenvectors).reshape(length, len(values)), width)

    def combine(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        first, *others = [read(r) for r in group.sort_values("part").itertuples()]
        for other in others:
            first.add(other)
        row = (key[0], first.n, first.mean, first.values, first.vectors.ravel())
        return pd.DataFrame([row], columns=["part", "n", "mean", "eigenvalues", "eigenvectors"])

    now = spectra.select("part", "n", "mean", "eigenvalues", "eigenvectors")
    left = now.count()
    while left > 1:
        now = stage(now.groupBy(F.floor(F.col("part") / FAN).alias("part")).applyInPandas(combine, schema))
        left = now.count()
    return read(now.first())


@dataclass
class Whitening:
    """What the fit found: exact count and sums, components (columns, by falling eigenvalue) and the measured error."""

    length: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int
    error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x minus the mean: the whole part of the mean is taken off in integers."""
        whole, rest = self._whole()
        return (x - whole).astype(np.float64) - np.array([r / self.n for r in rest])

    def _whole(self) -> tuple[np.ndarray, list[int]]:
        parts = [divmod(s, self.n) for s in self.sums]
        return np.array([q for q, _ in parts], dtype=np.int64), [r for _, r in parts]

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - sum)^2, exact."""
        whole, rest = self._whole()
        y, n = x - whole, self.n
        small = int(np.abs(y).max(initial=0)) + 1
        if self.length * (small * n + n) ** 2 < 1 << 63:
            return (((y * n - np.array(rest, dtype=np.int64)) ** 2).sum(axis=1)).tolist()
        gaps = y.astype(object) * n - np.array(rest, dtype=object)
        return [d if d < 1 << 63 else None for d in (gaps * gaps).sum(axis=1).tolist()]

    def scales(self) -> np.ndarray:
        """The deviation of each component, 0 where it has no variance beyond rounding."""
        top = self.values.max(initial=0.0)
        flat = self.values <= 16 * _EPS * self.length * top
        return np.where(flat, 0.0, np.sqrt(np.maximum(self.values, 0.0)))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        scales = self.scales()
        return (self.centred(x) @ self.vectors) / np.where(scales > 0, scales, np.inf)


def _summed(rows: DataFrame, length: int, make) -> np.ndarray:
    """The sum over all rows of what ``make`` gives for a block of rows; tasks add up their own first."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, length):
            one = make(x)
            total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "v"])

    sums = rows.select("x").mapInArrow(scan, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    return sums.sort_values("at")["v"].to_numpy()


def _refined(rows: DataFrame, model: Whitening, basis: np.ndarray, count: int) -> None:
    """Rayleigh-Ritz steps, one pass each, until the first ``count`` vectors are those of the covariance to rounding."""
    best, stalled = np.inf, 0
    while True:
        width = basis.shape[1]

        def products(x: np.ndarray, basis: np.ndarray = basis) -> np.ndarray:
            y = model.centred(x)
            return np.append((y.T @ (y @ basis)).ravel(), (y * y).sum())

        sums = _summed(rows, model.length, products) / model.n
        product, model.trace = sums[:-1].reshape(model.length, width), float(sums[-1])
        small = basis.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, images = basis @ turn, product @ turn
        model.passes += 1
        model.values, model.vectors = values[:count], vectors[:, :count]
        off = np.sqrt(((images - vectors * values) ** 2).sum(axis=0))[:count].max()
        stalled = 0 if off < 0.98 * best else stalled + 1
        best = min(best, off)
        if width >= model.length or off <= 16 * _EPS * model.length * max(values[0], 0.0) or stalled >= 8:
            return
        basis = np.linalg.qr(images)[0]


def fit(
    table: DataFrame, components: int = COMPONENTS, width: int = WIDTH, block: int = BLOCK, fold: bool = True
) -> tuple[Whitening | None, DataFrame]:
    """The whitening of a table (vec_id, embedding), and its usable rows (vec_id, x). None where no row is left."""
    rows = usable(table)
    lengths = rows.groupBy(F.size("x").alias("length")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), "length").first()
    if most is None:
        return None, rows
    length = most["length"]
    rows = rows.where(F.size("x") == length)
    count = min(components, length)
    width = max(width, count)
    spectra = stage(_spectra(rows, length, width, block, fold))
    sums = spectra.select("n", F.posexplode("sums").alias("at", "s")).groupBy("at")
    sums = sums.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("at").collect()
    model = Whitening(length, sums[0]["n"], [int(r["s"]) for r in sums], np.zeros(0), np.zeros((length, 0)), 0.0, 0)
    start = _combined(spectra, length, width).vectors
    if start.shape[1] < min(width, length):  # directions without variance: any that are orthogonal to the rest
        filled = np.column_stack([start[:, ::-1], np.random.default_rng(0).normal(size=(length, min(width, length) - start.shape[1]))])
        start = np.linalg.qr(filled)[0]
    _refined(rows, model, start, count)
    used = model.scales() > 0

    def moments(x: np.ndarray) -> np.ndarray:
        w = model.whitened(x)
        return np.append(w.sum(axis=0), (w.T @ w).ravel())

    sums = _summed(rows, length, moments) / model.n
    mean, squares = sums[:count], sums[count:].reshape(count, count)
    off = np.abs(squares - np.outer(mean, mean) - np.eye(count))[np.ix_(used, used)]
    model.error = float(off.max(initial=0.0))
    return model, rows


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """A row for each row and component: ``SCHEMA``, vec_id in its own type."""
    id_type = rows.schema["vec_id"].dataType.simpleString()
    count = model.vectors.shape[1]
    used = model.scales() > 0
    explained = model.values / model.trace if model.trace > 0 else np.zeros(count)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, model.length):
            n = len(x)
            empty = np.broadcast_to(~used, (n, count)).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(n), count))),
                    pa.array(np.tile(np.arange(1, count + 1), n), pa.int32()),
                    pa.array(np.full(n * count, model.n), pa.int64()),
                    pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(n), count))),
                    pa.array(model.whitened(x).ravel(), pa.float64(), mask=empty),
                    pa.array(np.tile(explained, n), pa.float64()),
                    pa.array(np.full(n * count, model.error), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(scan, SCHEMA.replace("vec_id long", f"vec_id {id_type}"))


def whiten(table: DataFrame, **options) -> DataFrame:
    """Fit on a table and transform it."""
    model, rows = fit(table, **options)
    if model is None:
        return table.sparkSession.createDataFrame([], SCHEMA)
    return transform(rows, model)
