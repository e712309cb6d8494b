"""Batch sampling over a stream: each point meets static layers by a stateless join, so no watermark or state is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tesserax.operators.spatial import sample_grid


def sample_stream(points: DataFrame, layers: dict[str, DataFrame], **grid) -> DataFrame:
    """A streaming (or plain) points frame with a column for each layer; null outside and without data."""
    for name, cells in layers.items():
        points = sample_grid(points, cells, name, **grid)
    return points
