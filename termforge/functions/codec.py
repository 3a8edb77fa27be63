"""Variable-byte integers. Parquet's encodings take their place in storage; this is for exchange."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ty


def encode(numbers: Iterable[int]) -> bytes:
    """7 bits a byte, lowest first; the high bit says that more follow."""
    out = bytearray()
    for n in numbers:
        if n < 0:
            raise ValueError("only non-negative integers can be encoded")
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        out.append(n)
    return bytes(out)


def decode(data: bytes) -> list[int]:
    out, n, shift = [], 0, 0
    for byte in data:
        n |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            out.append(n)
            n = shift = 0
    if shift:
        raise ValueError("the data ends within a number")
    return out


@F.pandas_udf(ty.BinaryType())
def vbyte_encode(numbers: pd.Series) -> pd.Series:
    return numbers.map(lambda x: encode(int(n) for n in x), na_action="ignore")


@F.pandas_udf(ty.ArrayType(ty.LongType()))
def vbyte_decode(data: pd.Series) -> pd.Series:
    return data.map(decode, na_action="ignore")


@F.pandas_udf(ty.ArrayType(ty.LongType()))
def sums(gaps: pd.Series) -> pd.Series:
    """What ``gaps`` were taken of: running sums, in one pass."""
    return gaps.map(lambda x: list(accumulate(int(n) for n in x)), na_action="ignore")


def vbyte_size(n: Column) -> Column:
    """Bytes that ``n`` takes, natively."""
    size = F.when(n < 0, F.lit(None).cast("int"))
    for k in range(1, 9):
        size = size.when(n < (1 << 7 * k), F.lit(k))
    return size.otherwise(F.lit(9))


def gaps(numbers: Column) -> Column:
    """Differences between neighbours of an ascending array, the first one from 0."""
    before = F.concat(F.array(F.lit(0).cast("bigint")), numbers.cast("array<bigint>"))
    return F.zip_with(numbers.cast("array<bigint>"), F.slice(before, F.lit(1), F.size(numbers)), lambda a, b: a - b)
