"""Geometry operators on streams: scalar ones are stateless projections, boxes of all rows or of groups are aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from .. import types as G
from ..operators import kernels


def running_box(stream: DataFrame, column: str, t: G.GeometryType, by: list[str] | None = None) -> DataFrame:
    """Box of everything seen so far, of each group: state is four doubles for each."""
    boxed = stream.withColumn("_box", kernels.box(column, t))
    return boxed.groupBy(*(by or [])).agg(kernels.native.box_agg("_box").alias("box"))


def to_memory(df: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    return df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
