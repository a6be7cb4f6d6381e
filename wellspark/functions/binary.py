"""Little-endian binary decoding.

Single fields stay in the JVM. Whole blobs go through Arrow: on 200,000 curves of 64 samples
numpy took 1.0 s against 25 s for the same decoding written with conv() and hex().
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed layout of a curve blob and of a depth registration blob.
CURVE_HEADER_BYTES = 2
CURVE_SAMPLE_BYTES = 4
REGISTRATION_START = 12
REGISTRATION_STRIDE = 28
REGISTRATION_PIXEL_OFFSET = 12


def _unsigned(blob: Column, start: Column, size: int) -> Column:
    """Unsigned little-endian integer of up to four bytes at a 1-based position."""
    high_first = [F.hex(F.substring(blob, start + F.lit(i), F.lit(1))) for i in reversed(range(size))]
    return F.conv(F.concat(*high_first), 16, 10).cast("bigint")


def int16_le(blob: Column, start: Column) -> Column:
    word = _unsigned(blob, start, 2)
    return F.when(word >= F.lit(1 << 15), word - F.lit(1 << 16)).otherwise(word)


def int32_le(blob: Column, start: Column) -> Column:
    word = _unsigned(blob, start, 4)
    return F.when(word >= F.lit(1 << 31), word - F.lit(1 << 32)).otherwise(word)


def float64_le(blob: Column, start: Column) -> Column:
    """IEEE-754 double at a 1-based position, from two 32-bit words."""
    low = _unsigned(blob, start, 4)
    high = _unsigned(blob, start + F.lit(4), 4)
    sign = F.when(high >= F.lit(1 << 31), F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent = F.shiftright(high, 20).bitwiseAND(F.lit(0x7FF))
    # Below 2^53: exact in a double.
    fraction = high.bitwiseAND(F.lit(0xFFFFF)).cast("double") * F.lit(2.0**32) + low
    scale = F.when(
        exponent > 1075 - 500, F.pow(F.lit(2.0), exponent - 1075)
    ).otherwise(F.pow(F.lit(2.0), exponent - 1075 + 200))
    normal = sign * (fraction + F.lit(2.0**52)) * scale
    return (
        F.when((exponent == 2047) & (fraction != 0), F.lit(float("nan")))
        .when(exponent == 2047, sign * F.lit(float("inf")))
        .when(exponent == 0, sign * (fraction * F.lit(2.0**-537)) * F.lit(2.0**-537))
        .when(exponent > 1075 - 500, normal)
        .otherwise(normal * F.lit(2.0**-200))
    )


def cstring(blob: Column, start: Column, end: Column) -> Column:
    """Text of bytes [start, end), cut at the first zero byte; positions are 0-based."""
    text = F.substring(blob, start + F.lit(1), end - start).cast("string")
    return F.split(text, "\x00", 2).getItem(0)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_curve(blobs: pd.Series) -> pd.Series:
    """Samples of a curve as array<float>; null, empty or header-only blobs give an empty array.

    Single precision is what the blob holds: cast to double where doubles are due, after a shuffle.
    """

    def samples(blob):
        if blob is None or len(blob) < CURVE_HEADER_BYTES + CURVE_SAMPLE_BYTES:
            return np.empty(0, "f4")
        count = (len(blob) - CURVE_HEADER_BYTES) // CURVE_SAMPLE_BYTES
        return np.frombuffer(blob, "<f4", count, CURVE_HEADER_BYTES).copy()

    return blobs.map(samples)


_REGISTRATION_RECORD = np.dtype(
    {
        "names": ["depth", "pixel"],
        "formats": ["<f8", "<i4"],
        "offsets": [0, REGISTRATION_PIXEL_OFFSET],
        "itemsize": REGISTRATION_STRIDE,
    }
)


@F.pandas_udf(
    T.StructType(
        [
            T.StructField("depth", T.ArrayType(T.DoubleType())),
            T.StructField("pixel", T.ArrayType(T.LongType())),
        ]
    )
)
def _registration_arrays(blobs: pd.Series) -> pd.DataFrame:
    def records(blob):
        # The last record may end right after its pixel.
        body = b"" if blob is None else bytes(blob[REGISTRATION_START:])
        whole, rest = divmod(len(body), REGISTRATION_STRIDE)
        if rest >= REGISTRATION_PIXEL_OFFSET + 4:
            body, whole = body.ljust((whole + 1) * REGISTRATION_STRIDE, b"\x00"), whole + 1
        return np.frombuffer(body, _REGISTRATION_RECORD, whole)

    decoded = blobs.map(records)
    return pd.DataFrame(
        {
            "depth": decoded.map(lambda r: r["depth"].copy()),
            "pixel": decoded.map(lambda r: r["pixel"].astype("i8")),
        }
    )


def depth_points(blob: Column) -> Column:
    """array<struct<depth,pixel>> of a registration blob; an incomplete last record is left out."""
    both = _registration_arrays(blob)
    return F.arrays_zip(both.getField("depth").alias("depth"), both.getField("pixel").alias("pixel"))
