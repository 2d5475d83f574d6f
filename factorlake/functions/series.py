"""Series windows of a panel in one pass over tickers: Spark deals and sorts rows by (ticker, date), numpy computes blocks of tickers.

A block of whole tickers is a matrix of tickers by dates. Windows are put together from windows of 1, 2, 4, ... dates, so a value costs the logarithm
of the window; what is joined are summaries (count, sum, mean, sum of squares about the mean, co-moments, extremes), nothing is ever subtracted,
so no value outside a window, an infinity or a large sum, reaches its result. Nulls are kept apart from NaN by masks. A pass keeps the
order of its rows, so the passes of a family follow each other in one stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

SERIES = "PARTITION BY ticker ORDER BY date"
POSITION = "__pos"
#: (kind, arguments as SQL expressions, numbers), for instance ("avg", ("volume",), (60, 30)): 60 dates, at least 30 values.
Op = tuple[str, tuple[str, ...], tuple]
#: Values that windows laid side by side may hold at once.
ROOM = 4_000_000


def add(df: DataFrame, ops: dict[str, Op], drop: tuple[str, ...] = (), ordered: bool = False) -> DataFrame:
    """df without the columns of ``drop``, with a column of doubles for each operation; ordered: df comes from such a pass, with its column of places."""
    args = list(dict.fromkeys(a for _, xs, _ in ops.values() for a in xs))
    at = {a: f"__a{i}" for i, a in enumerate(args)}
    place = [] if ordered else [F.expr(f"row_number() OVER ({SERIES})").alias(POSITION)]
    rows = df.select("*", *place).select("*", *[F.expr(a).cast("double").alias(c) for a, c in at.items()]).drop(*drop)  # before they are sent, and so that nothing below makes them
    kept = [f for f in rows.schema.fields if f.name not in at.values()]
    named = {name: (kind, tuple(at[x] for x in xs), numbers) for name, (kind, xs, numbers) in ops.items()}
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tickers(batches):
            columns = [one_array(table.column(n)) for n in names]
            made = computed(table, named)
            yield pa.RecordBatch.from_arrays([*columns, *made.values()], names=[*names, *made])

    return rows.mapInArrow(run, StructType([*kept, *[StructField(name, DoubleType()) for name in ops]]))


def digested(df: DataFrame, names: list[str], held: str, keep: list[str], digest: str) -> DataFrame:
    """The columns of ``keep`` (without them: one row a ticker) and, in a ticker's last row, ``digest``: for each name the count, least, largest and mean of its values where ``held``.

    df comes from a pass, with its column of places.
    """
    rows = df.select(*(keep or ["ticker"]), POSITION, F.expr(held).alias("__held"), *[F.col(n).cast("double").alias(f"__v{i}") for i, n in enumerate(names)])
    kept = [rows.schema[c] for c in (keep or ["ticker"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tickers(batches):
            starts = np.flatnonzero(table.column(POSITION).to_numpy() == 1)
            ends = np.append(starts[1:], table.num_rows) - 1
            mine = one_array(table.column("__held")).fill_null(False).to_numpy(zero_copy_only=False)
            made = np.zeros((len(starts), len(names), 4))
            for i in range(len(names)):
                column = one_array(table.column(f"__v{i}"))
                valid = mine & column.is_valid().to_numpy(zero_copy_only=False)
                values = column.fill_null(0.0).to_numpy(zero_copy_only=False)
                count = np.add.reduceat(valid.astype(float), starts)
                made[:, i, 0], made[:, i, 1] = count, np.fmin.reduceat(np.where(valid, values, np.nan), starts)
                with np.errstate(all="ignore"):
                    made[:, i, 2], made[:, i, 3] = np.maximum.reduceat(np.where(valid, values, -np.inf), starts), np.add.reduceat(np.where(valid, values, 0.0), starts) / count
            lists = pa.FixedSizeListArray.from_arrays(pa.array(made.reshape(-1)), 4 * len(names)).cast(pa.list_(pa.float64()))
            if keep:
                place = np.full(table.num_rows, -1)
                place[ends] = np.arange(len(ends))
                lists, columns = lists.take(pa.array(place, mask=place < 0)), [one_array(table.column(f.name)) for f in kept]
            else:
                columns = [one_array(table.column(f.name)).take(pa.array(ends)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, lists], names=[*[f.name for f in kept], digest])

    return rows.mapInArrow(run, StructType([*kept, StructField(digest, ArrayType(DoubleType()))]))


def whole_tickers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a partition, cut where a ticker begins."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch.column(batch.schema.get_field_index(POSITION)).to_numpy() == 1)
        if len(starts):
            before = [*held, batch.slice(0, starts[-1])]
            if sum(b.num_rows for b in before):
                yield pa.Table.from_batches(before)
            held, batch = [], batch.slice(starts[-1])
        held.append(batch)
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def one_array(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def computed(table: pa.Table, ops: dict[str, Op]) -> dict[str, pa.Array]:
    """A column for each operation over a table of whole tickers in order; tickers of like length are one matrix."""
    place = table.column(POSITION).to_numpy() - 1
    ticker = np.cumsum(place == 0) - 1
    lengths = np.bincount(ticker)
    size = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    flat = {}
    for a in dict.fromkeys(x for _, xs, _ in ops.values() for x in xs):
        column = one_array(table.column(a))
        flat[a] = column.fill_null(0.0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == lengths[0]).all():  # a dense panel: columns are matrices as they lie
        shape = (len(lengths), int(lengths[0]))
        block = Block({a: (v.reshape(shape), m.reshape(shape)) for a, (v, m) in flat.items()}, shape, [*ops.values()])
        with np.errstate(all="ignore"):
            results = {name: block.result(op) for name, op in ops.items()}
        return {name: pa.array(np.ravel(values).astype(float, copy=False), mask=~np.ravel(valid)) for name, (values, valid) in results.items()}
    out = {name: (np.zeros(len(place)), np.zeros(len(place), dtype=bool)) for name in ops}
    for one in np.unique(size):
        tickers = size == one
        number = np.cumsum(tickers) - 1
        rows = np.flatnonzero(tickers[ticker])
        cells = number[ticker[rows]], place[rows]
        shape = (int(tickers.sum()), int(lengths[tickers].max()))
        block = Block({a: (laid(v[rows], cells, shape), laid(m[rows], cells, shape)) for a, (v, m) in flat.items()}, shape, [*ops.values()])
        with np.errstate(all="ignore"):
            for name, op in ops.items():
                values, valid = block.result(op)
                out[name][0][rows], out[name][1][rows] = values[cells], valid[cells]
    return {name: pa.array(values, mask=~valid) for name, (values, valid) in out.items()}


def laid(values: np.ndarray, cells: tuple[np.ndarray, np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape, dtype=values.dtype)
    out[cells] = values
    return out


def back(x: np.ndarray, n: int, fill=0) -> np.ndarray:
    """Values n dates before (after, if n is negative)."""
    out = np.full_like(x, fill)
    if n == 0:
        return x
    if 0 < n < x.shape[1]:
        out[:, n:] = x[:, :-n]
    elif -x.shape[1] < n < 0:
        out[:, :n] = x[:, -n:]
    return out


def joined(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Moments (count, mean, squares) or (count, means of x and y, squares of both, products) of two windows side by side."""
    na, nb = a[0], b[0]
    both, share = (na > 0) & (nb > 0), np.where(nb > 0, nb / np.maximum(na + nb, 1), 0.0)
    many = len(a) // 2 if len(a) == 6 else 2
    gaps = [np.where(both, b[i] - a[i], 0.0) for i in range(1, many)]
    means = [np.where(na > 0, a[i] + gaps[i - 1] * share, b[i]) for i in range(1, many)]
    pairs = [(0, 0)] if many == 2 else [(0, 0), (1, 1), (0, 1)]
    products = [a[many + k] + b[many + k] + np.where(both, gaps[i] * gaps[j] * (na * share), 0.0) for k, (i, j) in enumerate(pairs)]
    return na + nb, *means, *products


class Block:
    """Windows over tickers by dates; columns: (values, 0 where there is none; whether there is one)."""

    def __init__(self, columns: dict[str, tuple[np.ndarray, np.ndarray]], shape: tuple[int, int], ops: list[Op]) -> None:
        self.columns, self.shape = columns, shape
        self.spans = [(xs[0], numbers[0]) for kind, xs, numbers in ops if kind == "ewm"]
        self.levels: dict[tuple, tuple[np.ndarray, ...]] = {}

    def result(self, op: Op) -> tuple[np.ndarray, np.ndarray]:
        kind, xs, numbers = op
        return getattr(self, f"of_{kind}")(*xs, *numbers)

    # windows from windows of 1, 2, 4, ... dates

    def level(self, part: str, xs: tuple[str, ...], k: int) -> tuple[np.ndarray, ...]:
        """Summary of the last 2 ** k dates."""
        if (part, xs, k) not in self.levels:
            if k:
                half = self.level(part, xs, k - 1)
                made = self.merged(part, half, self.before(part, half, 2 ** (k - 1)))
            else:
                x, held = self.columns[xs[0]]
                if part == "moments" and len(xs) == 2:
                    both = held & self.columns[xs[1]][1]
                    x, y = np.where(both, x, 0.0), np.where(both, self.columns[xs[1]][0], 0.0)
                    made = both.astype(float), x, y, x - x, y - y, (x - x) + (y - y)  # an infinity has no squares
                elif part == "moments":
                    made = held.astype(float), x, x - x
                elif part == "sum":
                    made = held.astype(float), x
                else:
                    made = held.astype(float), np.where(held, x, -np.inf if part == "max" else np.nan)
            self.levels[part, xs, k] = made
        return self.levels[part, xs, k]

    @staticmethod
    def before(part: str, summary: tuple[np.ndarray, ...], n: int) -> tuple[np.ndarray, ...]:
        fill = {"max": -np.inf, "min": np.nan}.get(part, 0.0)
        return back(summary[0], n), *[back(s, n, fill) for s in summary[1:]]

    @staticmethod
    def merged(part: str, late: tuple[np.ndarray, ...], early: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        if part == "moments":
            return joined(late, early)
        join = {"sum": np.add, "max": np.maximum, "min": np.fmin}[part]
        return late[0] + early[0], join(early[1], late[1])

    def summary(self, part: str, xs: tuple[str, ...], n: int) -> tuple[np.ndarray, ...]:
        """Summary of the last n dates."""
        if (part, xs, -n) not in self.levels:
            made, done = None, 0
            for k in reversed(range(n.bit_length())):
                if n >> k & 1:
                    piece = self.before(part, self.level(part, xs, k), done)
                    made, done = piece if made is None else self.merged(part, made, piece), done + 2**k
            self.levels[part, xs, -n] = made
        return self.levels[part, xs, -n]

    def moments_of_values(self, x: str, n: int) -> tuple[np.ndarray, ...]:
        """Moments of the last n dates, put together from their values alone: dates that hold the same values have the same result to the last bit, wherever nulls lie between them."""
        values, held = self.columns[x]
        if held.all():
            return self.summary("moments", (x,), n)
        if ("values", (x,), n) not in self.levels:
            if ("packed", (x,), 0) not in self.levels:
                number = np.cumsum(held, axis=1)
                packed = np.take_along_axis(values, np.argsort(~held, axis=1, kind="stable"), axis=1)
                self.levels["packed", (x,), 0] = number, Block({x: (packed, np.arange(self.shape[1]) < number[:, -1:])}, self.shape, [])
            number, packed = self.levels["packed", (x,), 0]
            count = number - back(number, n)
            made, done = tuple(np.zeros(self.shape) for _ in range(3)), np.zeros(self.shape, dtype=count.dtype)
            for k in reversed(range(n.bit_length())):
                has = count >> k & 1 > 0
                if has.any():
                    at = np.maximum(number - 1 - done, 0)
                    piece = [np.where(has, np.take_along_axis(s, at, axis=1), 0.0) for s in packed.level("moments", (x,), k)]
                    made, done = joined(made, tuple(piece)), done + np.where(has, 2**k, 0)
            self.levels["values", (x,), n] = made
        return self.levels["values", (x,), n]

    def of_sum(self, x: str, n: int, least: int):
        count, total = self.summary("sum", (x,), n)
        return total, count >= max(least, 1)

    def of_avg(self, x: str, n: int, least: int):
        count, total = self.summary("sum", (x,), n)
        return total / count, count >= max(least, 1)

    def of_max(self, x: str, n: int, least: int):
        count, high = self.summary("max", (x,), n)
        return high, count >= max(least, 1)

    def of_min(self, x: str, n: int, least: int):
        count, low = self.summary("min", (x,), n)
        return low, count >= max(least, 1)

    def of_var_samp(self, x: str, n: int, least: int):
        count, _, squares = self.moments_of_values(x, n)
        return squares / (count - 1), count >= max(least, 2)

    def of_stddev_samp(self, x: str, n: int, least: int):
        values, valid = self.of_var_samp(x, n, least)
        return np.sqrt(values), valid

    def of_covar_samp(self, y: str, x: str, n: int, least: int):
        count, *_, products = self.summary("moments", (x, y), n)
        return products / (count - 1), count >= max(least, 2)

    def of_regr_slope(self, y: str, x: str, n: int, least: int):
        count, _, _, squares, _, products = self.summary("moments", (x, y), n)
        return products / squares, (count >= max(least, 2)) & (squares > 0)

    def of_corr(self, y: str, x: str, n: int, least: int):
        """Null if either side doesn't vary."""
        count, _, _, xx, yy, xy = self.summary("moments", (x, y), n)
        spread = np.sqrt(xx / (count - 1)) * np.sqrt(yy / (count - 1))
        return xy / (count - 1) / spread, (count >= max(least, 2)) & (spread != 0)

    # windows laid side by side

    def laid_out(self, x: np.ndarray, n: int, fill) -> Iterator[tuple[slice, np.ndarray]]:
        """(tickers, their windows of n dates), a few tickers at a time."""
        step = max(ROOM // (self.shape[1] * n), 1)
        for start in range(0, self.shape[0], step):
            some = slice(start, start + step)
            ahead = np.full((len(x[some]), n - 1), fill, dtype=x.dtype)
            yield some, np.lib.stride_tricks.sliding_window_view(np.concatenate([ahead, x[some]], axis=1), n, axis=1)

    def of_quantile(self, x: str, p: float, n: int, least: int):
        """Linear interpolation; between equal values it is that value."""
        values, held = self.columns[x]
        count = self.summary("sum", (x,), n)[0]
        out = np.zeros(self.shape)
        place = p * (np.maximum(count, 1) - 1)
        low, high = np.floor(place), np.ceil(place)
        for some, windows in self.laid_out(np.where(held, values, np.nan), n, np.nan):
            ordered = np.sort(windows, axis=2)
            a, b = (np.take_along_axis(ordered, at[some][:, :, None].astype(int), axis=2)[:, :, 0] for at in (low, high))
            out[some] = np.where(a == b, a, a * (high - place)[some] + b * (place - low)[some])
            out[some] = np.where((low == high)[some], a, out[some])
        return out, count >= max(least, 1)

    def central(self, x: str, n: int) -> tuple[np.ndarray, ...]:
        """(count, sums of the second, third and fourth powers about the mean)."""
        if ("central", (x,), n) not in self.levels:
            values, held = self.columns[x]
            count, mean, _ = self.summary("moments", (x,), n)
            sums = [np.zeros(self.shape) for _ in range(3)]
            masks = (m for _, m in self.laid_out(held, n, False))
            for (some, windows), mask in zip(self.laid_out(values, n, 0.0), masks):
                away = np.where(mask, windows - mean[some][:, :, None], 0.0)
                square = away * away
                sums[0][some], sums[1][some], sums[2][some] = square.sum(axis=2), (square * away).sum(axis=2), (square * square).sum(axis=2)
            self.levels["central", (x,), n] = count, *sums
        return self.levels["central", (x,), n]

    def of_skew(self, x: str, n: int, least: int):
        """Bias-corrected sample skewness; needs three values."""
        k, m2, m3, _ = self.central(x, n)
        return np.sqrt(k * (k - 1)) / (k - 2) * (np.sqrt(k) * m3 / np.sqrt(m2 * m2 * m2)), (k >= max(least, 3)) & (m2 != 0)

    def of_kurt(self, x: str, n: int, least: int):
        """Bias-corrected sample excess kurtosis; needs four values."""
        k, m2, _, m4 = self.central(x, n)
        return (k - 1) / ((k - 2) * (k - 3)) * ((k + 1) * (k * m4 / (m2 * m2) - 3) + 6), (k >= max(least, 4)) & (m2 != 0)

    def of_mean_deviation(self, x: str, mean: str, n: int, least: int):
        """Mean absolute deviation of the window from the row's ``mean``."""
        values, held = self.columns[x]
        middle, known = self.columns[mean]
        count, out = self.summary("sum", (x,), n)[0], np.zeros(self.shape)
        masks = (m for _, m in self.laid_out(held, n, False))
        for (some, windows), mask in zip(self.laid_out(values, n, 0.0), masks):
            out[some] = np.where(mask, np.abs(windows - middle[some][:, :, None]), 0.0).sum(axis=2)
        return out / count, known & (count >= max(least, 1))

    def of_first_high(self, x: str, idx: str, n: int):
        """idx of the first largest x of a full window."""
        values, held = self.columns[x]
        count, out = self.summary("sum", (x,), n)[0], np.zeros(self.shape)
        for (some, windows), (_, places) in zip(self.laid_out(values, n, 0.0), self.laid_out(self.columns[idx][0], n, 0.0)):
            out[some] = np.take_along_axis(places, windows.argmax(axis=2)[:, :, None], axis=2)[:, :, 0]
        return out, count == n

    # other series

    def of_lag(self, x: str, n: int):
        values, held = self.columns[x]
        return back(values, n), back(held, n, False)

    def of_position(self):
        return np.broadcast_to(np.arange(1.0, self.shape[1] + 1), self.shape), np.ones(self.shape, dtype=bool)

    def of_running_sum(self, x: str):
        values, held = self.columns[x]
        return np.cumsum(values, axis=1), np.logical_or.accumulate(held, axis=1)

    def of_fill_forward(self, x: str, limit: int | None):
        values, held = self.columns[x]
        days = np.arange(self.shape[1])
        last = np.maximum.accumulate(np.where(held, days, -1), axis=1)
        near = last >= (0 if limit is None else np.maximum(days - limit, 0))
        return np.take_along_axis(values, np.maximum(last, 0), axis=1), near

    def of_own_rank(self, x: str):
        """Average-tie rank in the ticker's whole history over the number of its values."""
        values, held = self.columns[x]
        out = np.zeros(self.shape)
        for row, mine, target in zip(values, held, out):
            own = row[mine]
            ordered = np.sort(own)
            first, last = np.searchsorted(ordered, own, "left"), np.searchsorted(ordered, own, "right")
            target[mine] = (first + 1 + (last - first - 1) / 2) / max(len(own), 1)
        return out, held

    def of_ewm(self, x: str, span: int):
        """Exponential mean: y = ((1 - a)^gap y + a x) / ((1 - a)^gap + a), gap: dates since the last value; a NaN is none."""
        if ("ewm", x, span) not in self.levels:
            spans = [s for xs, s in self.spans if xs == x]
            values, held = self.columns[x]
            held = held & ~np.isnan(values)
            a = 2.0 / (np.array(spans)[:, None] + 1)
            y, weight, known = np.zeros((len(spans), self.shape[0])), np.ones((len(spans), self.shape[0])), np.zeros(self.shape[0], dtype=bool)
            out, begun = np.zeros((len(spans), *self.shape)), np.logical_or.accumulate(held, axis=1)
            for day in range(self.shape[1]):
                value, here = values[:, day], held[:, day]
                weight = np.where(known, weight * (1 - a), weight)
                mixed = np.where(known & (y != value), (weight * y + a * value) / (weight + a), value)
                y, weight, known = np.where(here, mixed, y), np.where(here, 1.0, weight), known | here
                out[:, :, day] = y
            self.levels |= {("ewm", x, s): (made, begun) for s, made in zip(spans, out)}
        return self.levels["ewm", x, span]
