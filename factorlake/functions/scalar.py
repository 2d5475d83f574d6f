"""Scalar functions that Spark SQL lacks, as Column expressions; for tables of many columns as Arrow passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, IntegerType, StructField, StructType

#: Exact as doubles, so an integer of six digits times or over one of them is rounded once, as a number read from text is.
POWERS = np.array([float(f"1e{k}") for k in range(23)])


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function by a rational approximation of erf with an error below 1.5e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    # fixed values: coefficients of the approximation (Abramowitz and Stegun, 7.1.26)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1.0 - poly * F.exp(-x * x)
    return F.when(z >= 0, 0.5 * (1.0 + erf)).otherwise(0.5 * (1.0 - erf))


def two_sided_p(z: Column) -> Column:
    return 2.0 * (1.0 - normal_cdf(F.abs(z)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if one vector has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def six_digits(x: Column) -> Column:
    """x to six significant digits, so engines that sum in another order agree; the factor keeps exact halves from being ties, and what is below 1e-12 is 0."""
    return F.when(F.abs(x) < 1e-12, F.lit(0.0)).when(x.isNotNull(), F.format_string("%.5e", x.cast("double") * F.lit(1.0000000001) + F.lit(0.0)).cast("double"))


def six_digits_of(x: np.ndarray) -> np.ndarray:
    """``six_digits`` of an array: only what is close to a tie, or of an unusual size, is written out and read again."""
    with np.errstate(all="ignore"):
        y = x * 1.0000000001 + 0.0
        size = np.abs(y)
        places = 5 - np.floor(np.log10(size))
        usual = np.abs(places) < len(POWERS)
        places = np.where(usual, places, 0).astype(np.int64)
        power = POWERS[np.abs(places)]
        digits = np.where(places >= 0, size * power, size / power)
        whole = np.floor(digits + 0.5)
        out = np.copysign(np.where(places >= 0, whole / power, whole * power), y)
        tiny = np.abs(x) < 1e-12
        sure = tiny | (usual & (digits >= 1e5) & (whole < 1e6) & (np.abs(digits - np.floor(digits) - 0.5) > 1e-6))
    out[tiny] = 0.0
    for i in np.flatnonzero(~sure):
        out[i] = float(f"{y[i]:.5e}")
    return out


def six_digit_codes(x: np.ndarray) -> np.ndarray:
    """``six_digits`` of an array as 32-bit integers in the same order, equal where they are equal: the place of a number of six digits among all such; a NaN is the largest."""
    y = six_digits_of(x)
    usual = np.isfinite(y) & (y != 0)
    size = np.where(usual, np.abs(y), 1.0)
    power = np.floor(np.log10(size))
    for _ in range(2):  # log10 may be rounded to the other side of a power of ten
        whole = np.rint(size * np.power(10.0, 5 - power))
        power = power + (whole >= 1e6) - (whole < 1e5)
    whole = np.rint(size * np.power(10.0, 5 - power))
    place = np.copysign((power + 12) * 900_000 + whole - 99_999, y)
    unusual = np.where(np.isnan(y), 2.0**31 - 1, np.where(np.isinf(y), np.copysign(2.0**31 - 2, y), 0.0))
    return np.where(usual, place, unusual).astype(np.int32)


def of_six_digit_codes(codes: np.ndarray) -> np.ndarray:
    """The numbers that ``six_digit_codes`` stand for, to the last bit."""
    size = np.abs(codes).astype(np.int64)
    power, whole = (size - 1) // 900_000 - 17, (size - 1) % 900_000 + 100_000.0
    near = np.abs(power) < len(POWERS)
    factor = POWERS[np.where(near, np.abs(power), 0)]
    out = np.copysign(np.where(power >= 0, whole * factor, whole / factor), codes)
    out[size == 0], out[size == 2**31 - 2], out[size == 2**31 - 1] = 0.0, np.copysign(np.inf, codes[size == 2**31 - 2]), np.nan
    for i in np.flatnonzero(~near & (size < 2**31 - 2)):
        out[i] = np.copysign(float(f"{int(whole[i])}e{power[i]}"), codes[i])
    return out


def made_of(df: DataFrame, names: list[str], function: Callable[[np.ndarray], np.ndarray], kind: DataType) -> DataFrame:
    """df with a function of the named columns, of arrays of doubles without nulls; nulls stay: one pass over batches of rows."""
    rows = df.select(*[F.col(c).cast("double").alias(c) if c in names else F.col(c) for c in df.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for name, column in zip(batch.schema.names, batch.columns):
                if name in names:
                    held = column.is_valid().to_numpy(zero_copy_only=False)
                    column = pa.array(function(column.fill_null(0.0).to_numpy(zero_copy_only=False)), mask=~held)
                made.append(column)
            yield pa.RecordBatch.from_arrays(made, names=batch.schema.names)

    return rows.mapInArrow(run, StructType([StructField(f.name, kind) if f.name in names else f for f in rows.schema.fields]))


def with_six_digits(df: DataFrame, names: list[str]) -> DataFrame:
    """df with ``six_digits`` of the named columns, as doubles: one pass over batches of rows instead of a text for every value."""
    return made_of(df, names, six_digits_of, DoubleType())


def with_six_digit_codes(df: DataFrame, names: list[str]) -> DataFrame:
    """df with ``six_digit_codes`` of the named columns, for ranks."""
    return made_of(df, names, six_digit_codes, IntegerType())


def from_six_digit_codes(df: DataFrame, names: list[str]) -> DataFrame:
    """df with the numbers that ``six_digit_codes`` in the named columns stand for."""
    return made_of(df, names, of_six_digit_codes, DoubleType())


def parse_time(value: Column) -> Column:
    """Epoch seconds, as number or text, or an ISO time (a final Z is UTC); null if neither."""
    text = value.cast("string")
    seconds = F.timestamp_seconds(text.try_cast("double"))
    return F.coalesce(seconds, F.try_to_timestamp(text))
