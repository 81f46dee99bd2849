"""Packed payloads: scalars and vocabularies beside base64 of gzipped typed arrays.

Arrays of one line are packed in Arrow batches on the executors; a payload joins the packed lines in order.
"""

from __future__ import annotations

import base64
import gzip
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed_deltas(steps: Column) -> Column:
    """binary: the first point as two int32, then differences as int16 (steps must have been halved before)."""

    @F.pandas_udf("binary")
    def run(lines: pd.Series) -> pd.Series:
        def one(line) -> bytes:
            xy = np.array([(p["x"], p["y"]) for p in line], np.int64).reshape(-1, 2)
            return xy[:1].astype("<i4").tobytes() + xy[1:].astype("<i2").tobytes()

        return lines.map(one, na_action="ignore")

    return run(steps)


def unpacked_deltas(data: Column) -> Column:
    """array<struct<x, y>> of long from packed_deltas()."""

    @F.pandas_udf("array<struct<x:bigint,y:bigint>>")
    def run(values: pd.Series) -> pd.Series:
        def one(raw: bytes) -> list[dict]:
            first = np.frombuffer(raw[:8], "<i4").astype(np.int64).reshape(-1, 2)
            rest = np.frombuffer(raw[8:], "<i2").astype(np.int64).reshape(-1, 2)
            return [{"x": int(x), "y": int(y)} for x, y in np.concatenate([first, rest])]

        return values.map(one, na_action="ignore")

    return run(data)


def gzipped(data: Column) -> Column:
    """base64 of the gzipped bytes; Spark has no function for gzip."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda raw: base64.b64encode(gzip.compress(raw, mtime=0)).decode(), na_action="ignore")

    return run(data)


def typed_array(values: Column, kind: str) -> Column:
    """binary: an array column as little-endian numbers of a numpy kind such as "u1", "i2" or "f4"."""

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda row: np.asarray(row).astype("<" + kind).tobytes(), na_action="ignore")

    return run(values)


def payload(scalars: dict, vocabularies: dict[str, list[str]], table: DataFrame, columns: dict[str, str], order: list[str], most: int = 1_000_000) -> str:
    """JSON of a table for a browser: each column as base64(gzip(typed array)), rows in order.

    A payload is a single document for one reader, so its rows, at most `most`, come to the driver.
    """
    rows = table.orderBy(*order).limit(most + 1).select(*columns).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; choose with budgeted() first")
    arrays = {c: base64.b64encode(gzip.compress(rows[c].to_numpy().astype("<" + kind).tobytes(), mtime=0)).decode() for c, kind in columns.items()}
    return json.dumps(scalars | {"vocabularies": vocabularies, "n": len(rows), "arrays": arrays}, ensure_ascii=False)


def decoded(text: str, columns: dict[str, str]) -> dict[str, np.ndarray]:
    """The arrays of a payload."""
    arrays = json.loads(text)["arrays"]
    return {c: np.frombuffer(gzip.decompress(base64.b64decode(arrays[c])), "<" + kind) for c, kind in columns.items()}
