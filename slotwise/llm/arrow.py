"""Arrow-batch helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from slotwise.session import ship_package


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df less its columns of these names, upper and lower case alike: an operator's own columns win over clashing ones."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def unused(df: DataFrame, name: str) -> str:
    """name with as many underscores in front as make it differ from all of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def add_columns(df: DataFrame, fn: Callable[[pa.RecordBatch], list], fields: list[T.StructField], keep: list[str] | None = None, reads: list[str] | None = None) -> DataFrame:
    """df, or its columns in `keep`, with the columns that fn makes of each Arrow batch. fn sees the columns in `reads` as well."""
    ship_package(df.sparkSession)
    names = [f.name for f in fields]
    base = without(df, names)
    kept = [c for c in (keep or base.columns) if c.lower() not in {n.lower() for n in names}]
    seen = kept + [c for c in (reads or []) if c not in kept]
    source = df.select(*[F.col(f"`{c}`") for c in seen])
    schema = T.StructType([source.schema[i] for i in range(len(kept))] + fields)
    arrow = to_arrow_schema(schema)
    new = [arrow.field(i).type for i in range(len(kept), len(arrow))]
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pa.array(x, t) if not isinstance(x, pa.Array) else x.cast(t) for x, t in zip(fn(batch), new, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], names=[*batch.schema.names[:n], *names])

    return source.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.names.index(name))
