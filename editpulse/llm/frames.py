"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_of(documents: DataFrame, columns: Iterable[str] | None = None) -> Column:
    """The given columns (all by default) as one struct ``row``, so that new columns clash with none."""
    return F.struct(*(F.col(f"`{c}`") for c in columns or documents.columns)).alias("row")


def kind_of(frame: DataFrame, column: str) -> str:
    """A column's type as DDL."""
    return frame.schema[column].dataType.simpleString()


def row_key(id_column: str = "doc_id", text: str = "text") -> Column:
    """64-bit key that equals for equal ids, or for equal texts where the id is missing."""
    return F.when(F.col(id_column).isNotNull(), F.xxhash64(id_column)).otherwise(F.xxhash64(text))


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions start, start + 1, … of consecutive runs of the given sizes."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def long_lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


SALTS = 16


def salted_join(many: DataFrame, few: DataFrame, on: str, spread: str, how: str = "inner") -> DataFrame:
    """Joins ``few``, a small share of the distinct keys of ``many``, on a column that may have hot values.

    Rows of one key are spread over ``SALTS`` tasks by a hash of the column ``spread``; the rows of
    ``few`` are repeated that often.
    """
    left = many.withColumn("join_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    right = few.withColumn("join_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [on, "join_salt"], how).drop("join_salt")
