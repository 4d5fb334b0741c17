"""User models over packed windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def score_windows(packed: DataFrame, model: Callable[[np.ndarray], list[float]]) -> DataFrame:
    """stream, win, n, scores: the model's output for the feature matrix of each window. Windows are rows already, so
    they are scored in Arrow batches where they lie, without a shuffle; a matrix is a view into the batch's values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = batch.column("matrix")
            rows, lines = matrix.offsets.to_numpy(), matrix.values.offsets.to_numpy()
            values = matrix.values.values.to_numpy(zero_copy_only=False)
            scores = [[float(x) for x in model(values[lines[a] : lines[b]].reshape(b - a, -1) if b > a else np.zeros((0, 4)))] for a, b in zip(rows[:-1], rows[1:], strict=True)]
            yield pa.record_batch([batch.column("stream"), batch.column("win"), batch.column("n"), pa.array(scores, pa.list_(pa.float64()))], ["stream", "win", "n", "scores"])

    return packed.select("stream", "win", "n", "matrix").mapInArrow(run, "stream long, win long, n long, scores array<double>")
