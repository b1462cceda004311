"""Fits over stored counts of terms: sums of matrices over all rows, principal axes, and logistic models of all folds at once.

A row holds its counts as one byte for each bucket in counts; 255 stands for a number that over has, as pairs of bucket and count.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ledgerlake.session import kept

#: Numbers in a matrix of rows by buckets that is worked on at a time, and bytes of counts that a task of a pass reads where all cores have two tasks.
CELLS, READ = 1 << 20, 1 << 28
#: What a count weighs: nothing, or 1 + log(count).
_TF = np.append(0.0, 1 + np.log(np.arange(1, 256)))


def packed(table: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The columns counts and over of the rows of a table of counts."""
    many = np.nonzero(table >= 255)
    ends = np.append(0, np.cumsum(np.bincount(many[0], minlength=len(table)) * 16))
    pairs = np.stack([many[1], table[many]], axis=1).astype(np.int64)
    return _binary(np.arange(len(table) + 1) * table.shape[1], np.minimum(table, 255).astype(np.uint8)), _binary(ends, pairs)


def _binary(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, and where its values end in them, with a first 0."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def frequencies(batch: pa.RecordBatch, features: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Parts of a batch and their weights of counts, rows by buckets. The next part takes the place of the last."""
    step = max(1, min(batch.num_rows, CELLS // features))
    room = np.empty((step, features))
    for at in range(0, batch.num_rows, step):
        counts = _bytes(batch.column("counts").slice(at, step))[0].reshape(-1, features)
        tf = np.take(_TF, counts, out=room[: len(counts)], mode="clip")
        more, ends = _bytes(batch.column("over").slice(at, step))
        if len(more):
            pairs = np.frombuffer(more.tobytes(), np.int64).reshape(-1, 2)
            tf[np.repeat(np.arange(len(counts)), np.diff(ends) // 16), pairs[:, 0]] = 1 + np.log(pairs[:, 1])
        yield slice(at, at + len(counts)), tf


def few_tasks(held: DataFrame, rows: int, features: int) -> DataFrame:
    """held in two tasks for each core, or in so many that none reads more than READ: each task of a pass sends one sum."""
    return held.coalesce(max(2 * held.sparkSession.sparkContext.defaultParallelism, -(-rows * features // READ)))


def total(held: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, int], dealt: bool = False) -> np.ndarray:
    """The sum of part(batch), a matrix, over all batches. dealt: tasks add the matrices up, dealt by their rows, so that one comes to the driver."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added = None
        for batch in batches:
            if batch.num_rows:
                added = part(batch) if added is None else np.add(added, part(batch), out=added)
        if added is not None:
            yield sent(np.arange(len(added)), added)

    def sent(at: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), _binary(np.arange(len(m) + 1) * 8 * shape[1], m)], ["i", "sums"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column("i").to_pylist(), np.frombuffer(_bytes(batch.column("sums"))[0].tobytes()).reshape(-1, shape[1]), strict=True):
                found[i] = found[i] + row if i in found else row
        if found:
            yield sent(np.array(list(found)), np.stack(list(found.values())))

    sums = held.mapInArrow(own, "i int, sums binary")
    if dealt:
        sums = sums.repartition(held.sparkSession.sparkContext.defaultParallelism, "i").mapInArrow(together, "i int, sums binary")
    out = np.zeros(shape)
    for r in sums.collect():
        out[r.i] += np.frombuffer(bytes(r.sums))
    return out


def _idf(rows: np.ndarray, held_by: np.ndarray) -> np.ndarray:
    return np.log((rows + 1.0) / (held_by + 1.0))


def _unit(m: np.ndarray) -> np.ndarray:
    """m with its rows brought to length 1 in place; rows of zeros stay."""
    norms = np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
    return np.divide(m, np.where(norms > 0, norms, 1), out=m)


def principal_axes(held: DataFrame, features: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(idf, axes): the weights of buckets, and the axes along which tf-idf vectors of unit length vary most, as columns."""

    def held_by(batch: pa.RecordBatch) -> np.ndarray:
        return sum(np.append((tf > 0).sum(0), len(tf)) for _, tf in frequencies(batch, features))[None, :].astype(float)

    seen = total(held, held_by, (1, features + 1))[0]
    rows = int(seen[-1])
    idf = _idf(rows, seen[:-1])

    def squares(batch: pa.RecordBatch) -> np.ndarray:
        added = np.zeros((features + 1, features))
        for _, tf in frequencies(batch, features):
            x = _unit(np.multiply(tf, idf, out=tf))
            added[:-1] += x.T @ x
            added[-1] += x.sum(0)
        return added

    sums = total(few_tasks(held, rows, features), squares, (features + 1, features), dealt=True)
    mean = sums[-1] / max(rows, 1)
    spread = (sums[:-1] - rows * np.outer(mean, mean)) / max(rows - 1, 1)
    try:
        axes = np.linalg.svd(spread)[0]
    except np.linalg.LinAlgError:  # of few rows; the same axes, which may point the other way
        axes = np.linalg.eigh(spread)[1][:, ::-1]
    return idf, axes[:, :components]


def placed(held: DataFrame, idf: np.ndarray, axes: np.ndarray) -> DataFrame:
    """held with vector in place of its counts: along the axes, of unit length, zero without terms."""
    own = [f for f in held.schema.fields if f.name not in ("counts", "over")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, tf in frequencies(batch, len(idf)):
                v = _unit(_unit(np.multiply(tf, idf, out=tf)) @ axes)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))
                rows = batch.slice(part.start, len(v))
                yield pa.RecordBatch.from_arrays([*[rows.column(f.name) for f in own], lists], [*[f.name for f in own], "vector"])

    return held.mapInArrow(place, StructType([*own, StructField("vector", ArrayType(DoubleType()))]))


def fold_guesses(counted: DataFrame, features: int, k: int = 5, iterations: int = 50, penalty: float = 0.01) -> DataFrame:
    """(fold, label, prediction) of each row of counted(fold, label, counts, over): told by a logistic model of tf-idf that learned from all other folds.

    What MLlib fits fold by fold (weights of buckets, deviations, a penalty on standardized coefficients) is fitted for all k folds in the same passes:
    a pass gives the loss and slope of every fold. The driver holds a few vectors of features for each fold, which do not grow with the rows.
    """
    held = kept(counted, "counts", compression="zstd")

    def told(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return batch.column("fold").to_numpy(), batch.column("label").to_numpy()

    def seen(batch: pa.RecordBatch) -> np.ndarray:
        (fold, label), out = told(batch), np.zeros((k, features + 3))
        for part, tf in frequencies(batch, features):
            for f in range(k):
                out[f, :features] += np.count_nonzero(tf[fold[part] == f], axis=0)
        out[:, features:] = np.stack([np.bincount(fold, w, k) for w in (np.ones(len(fold)), label == 1, (label != 0) & (label != 1))], axis=1)
        return out

    sums = total(held, seen, (k, features + 3))
    if sums[:, -1].any():
        raise ValueError("labels are 0 or 1")
    own, (rows, ones) = sums[:, features], (sums[:, c].sum() - sums[:, c] for c in (features, features + 1))
    if (alone := np.flatnonzero((own > 0) & (rows == 0))).size:
        raise ValueError(f"no rows outside fold {alone[0]} to learn from")
    idf = _idf(rows[:, None], sums[:, :features].sum(0) - sums[:, :features])
    active = np.flatnonzero((own > 0) & (ones > 0) & (ones < rows))
    measured = kept(_with_lengths(held, idf), "terms", compression="zstd")
    passes = few_tasks(measured, int(own.sum()), features)

    def shares(batch: pa.RecordBatch, of: np.ndarray) -> np.ndarray:
        """What a row's weights are divided by, turned over; 0 where the row isn't learned from."""
        return _lists(batch.column("turned"), k)[:, of] * (told(batch)[0][:, None] != of)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        by, out = shares(batch, active), np.zeros((2 * len(active), features))
        for part, tf in frequencies(batch, features):
            out[: len(active)] += by[part].T @ tf
            out[len(active) :] += np.square(by[part]).T @ np.square(tf, out=tf)
        return out

    n, weights = rows[active, None], idf[active]
    first, second = np.split(total(passes, moments, (2 * len(active), features)), 2) if len(active) else (weights, weights)
    mean = first * weights / n
    spread = (second * weights**2 - n * mean**2) / np.maximum(n - 1, 1)
    # what rounding leaves of a bucket that is the same in all rows is no deviation
    deviation = np.sqrt(np.where(spread > 1e-11 * mean**2, spread, np.inf))
    scale, centre = weights / deviation, mean / deviation

    def margins(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.ascontiguousarray((points[:, :-1] * scale[at]).T), points[:, -1] - np.einsum("ij,ij->i", points[:, :-1], centre[at])

    def losses(points: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
        at = np.array(list(points))
        x = np.stack(list(points.values()))
        slopes, offsets = margins(x, at)

        def losses_of(batch: pa.RecordBatch) -> np.ndarray:
            (fold, label), out = told(batch), np.zeros((len(at), features + 2))
            by, learned, y = shares(batch, active[at]), fold[:, None] != active[at], label[:, None]
            for part, tf in frequencies(batch, features):
                m = tf @ slopes * by[part] + offsets
                missed = (0.5 + 0.5 * np.tanh(m / 2) - y[part]) * learned[part]
                out[:, :features] += (missed * by[part]).T @ tf
                out[:, features] += missed.sum(0)
                out[:, -1] += ((np.logaddexp(0, m) - y[part] * m) * learned[part]).sum(0)
            return out

        sums = total(passes, losses_of, (len(at), features + 2)) / n[at]
        slope = sums[:, :features] * scale[at] - sums[:, features, None] * centre[at] + penalty * x[:, :-1]
        value = sums[:, -1] + penalty / 2 * np.square(x[:, :-1]).sum(1)
        return {f: (value[i], np.append(slope[i], sums[i, features])) for i, f in enumerate(points)}

    starts = [np.append(np.zeros(features), np.log(ones[f] / (rows[f] - ones[f]))) for f in active]
    found = minima(starts, losses, iterations)
    slopes, offsets = np.zeros((features, k)), np.where(ones > 0, np.inf, -np.inf)
    if found:
        slopes[:, active], offsets[active] = margins(np.stack(found), np.arange(len(active)))

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (fold, _), by = told(batch), _lists(batch.column("turned"), k)
            for part, tf in frequencies(batch, features):
                m = np.take_along_axis(tf @ slopes * by[part] + offsets, fold[part, None], 1)[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(part.start, len(m)) for c in ("fold", "label")] + [pa.array((m > 0).astype(float))], ["fold", "label", "prediction"])

    return measured.select("fold", "label", "counts", "over", "turned").mapInArrow(guess, "fold long, label double, prediction double")


def _with_lengths(held: DataFrame, idf: np.ndarray) -> DataFrame:
    """held with turned: for each row of idf one over the length of the tf-idf vector, 0 without terms."""
    names = held.columns

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, tf in frequencies(batch, idf.shape[1]):
                length = np.sqrt(np.square(tf, out=tf) @ np.square(idf).T)
                turned = np.divide(1, length, out=np.zeros_like(length), where=length > 0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(turned) + 1, dtype=np.int32) * len(idf)), pa.array(turned.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(part.start, len(turned)) for c in names], lists], [*names, "turned"])

    return held.mapInArrow(measure, StructType([*held.schema.fields, StructField("turned", ArrayType(DoubleType()))]))


def _lists(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, k)


Losses = Callable[[dict[int, np.ndarray]], dict[int, tuple[float, np.ndarray]]]


def minima(starts: list[np.ndarray], losses: Losses, iterations: int) -> list[np.ndarray]:
    """Where L-BFGS from each start ends. All searches go on together: losses gets a point of each that has not ended, and gives its values and slopes."""
    searches = [_search(x, iterations) for x in starts]
    asked, found = {i: next(s) for i, s in enumerate(searches)}, {}
    while asked:
        for i, told in losses(asked).items():
            try:
                asked[i] = searches[i].send(told)
            except StopIteration as end:
                found[i] = end.value
                del asked[i]
    return [found[i] for i in range(len(starts))]


def _search(x: np.ndarray, iterations: int, memory: int = 10, tolerance: float = 1e-6, past: int = 20) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Asks for the value and slope at points and returns the best; ends as MLlib does, by the slope or by what the last values gained."""
    value, slope = yield x
    values, steps = [value], []
    for _ in range(iterations):
        if np.linalg.norm(slope) <= max(tolerance * abs(value), 1e-8) or (len(values) > past and max(values[-past - 1 :]) - value <= tolerance * abs(values[0])):
            break
        way, kept_back = -slope, []
        for s, y in reversed(steps):
            kept_back.append(s @ way / (s @ y))
            way = way - kept_back[-1] * y
        if steps:
            s, y = steps[-1]
            way = way * (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(kept_back), strict=True):
            way = way + (a - y @ way / (s @ y)) * s
        # the step is halved between one that is too long and one that is too short, and doubled while there is none too long
        down, short, long, step = slope @ way, 0.0, None, 1.0 if steps else 1 / np.linalg.norm(way)
        for _ in range(20):
            there, its = yield x + step * way
            if not there <= value + 1e-4 * step * down or its @ way > -0.9 * down:
                long = step
            elif its @ way < 0.9 * down:
                short = step
            else:
                break
            step = 2 * short if long is None else (short + long) / 2
        if not there < value:
            break
        steps = [*steps, (step * way, its - slope)][-memory:]
        x, value, slope = x + step * way, there, its
        values.append(value)
    return x
