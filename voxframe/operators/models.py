"""Model calls as Arrow-batched operators. A model is a function that loads it and gives another, which is called with
arrays; it is loaded once a task. Without weights, tests and queries use deterministic stand-ins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.functions.vectors import softmax_rows, unit
from voxframe.operators.intervals import KEY
from voxframe.operators.packing import inferred
from voxframe.operators.requests import prediction_frames
from voxframe.operators.timeline import powerset
from voxframe.params import Packing
from voxframe.shared import publish, scratch

Model = Callable[[], Callable]


def scored(chunks: DataFrame, model: Model) -> DataFrame:
    """chunks with what the model says of them in place of their samples: rows (a matrix of class scores), or error, the name of
    what it raised. Written to the shared folder, so the model is called once for frames and failures. What isn't about a
    chunk, such as a model that can't be loaded, ends the job.

    chunks: recording_id, read_start, read_end, core_start, core_end, samples.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = model()
        for frame in frames:
            out, errors = [], []
            for samples in frame["samples"]:
                found = error = None
                try:
                    found = np.atleast_2d(np.asarray(call(np.asarray(samples)), float)).tolist()
                except Exception as e:  # noqa: BLE001  the chunk's own failure, which is reported
                    error = type(e).__name__
                out.append(found)
                errors.append(error)
            yield frame.drop(columns="samples").assign(rows=out, error=errors)

    kinds = ", ".join(f"`{c}` {t}" for c, t in chunks.dtypes if c != "samples")
    return publish(chunks.mapInPandas(run, f"{kinds}, rows array<array<double>>, error string"), scratch(chunks.sparkSession, "scored"))


def failures(scores: DataFrame) -> DataFrame:
    """Chunks that scored() has no scores for: recording_id, read_start, read_end, error."""
    return scores.filter("error is not null").select(KEY, "read_start", "read_end", "error")


def segmentation(chunks: DataFrame, model: Model) -> DataFrame:
    """Activity frames of chunks of samples, by the model; chunks that fail give none."""
    return activity(scored(chunks, model))


def activity(scores: DataFrame) -> DataFrame:
    """Activity frames of the recordings that scored() chunks belong to: recording_id, start_ms, end_ms, active, dom, confidence.

    Scores that aren't shares yet become so by softmax, chunk by chunk; frames count where their centre lies in the
    chunk's core.
    """
    rows = prediction_frames(scores.filter("error is null").drop("error"), F.col("read_end") - F.col("read_start"))
    rows = softmax_rows(rows, "row", (KEY, "read_start", "core_start"))
    active, dom, confidence = powerset(F.col("row"))
    rows = rows.withColumns({"start_ms": F.col("start_ms") + F.col("read_start"), "end_ms": F.col("end_ms") + F.col("read_start"), "active": active, "dom": dom, "confidence": confidence})
    centre = F.expr("(start_ms + end_ms) div 2")
    return rows.filter((centre >= F.col("core_start")) & (centre < F.col("core_end"))).select(KEY, "start_ms", "end_ms", "active", "dom", "confidence")


def embeddings(requests: DataFrame, model: Model, now_ms: int, least: int = 400 * 16, p: Packing = Packing()) -> DataFrame:
    """Requests as packing.inferred() takes them, to vectors of length 1: recording_id, request, status, embedding.

    Samples are filled with zeros to `least`; a vector without length is inference_failed.
    """

    def padded() -> Callable[[list], list]:
        call = model()
        return lambda batch: call([np.pad(x, (0, max(0, least - len(x)))) for x in batch])

    rows = inferred(requests, padded, now_ms, p).withColumn("embedding", unit(F.col("result")))
    failed = (F.col("status") == "success") & F.col("embedding").isNull()
    return rows.select(KEY, "request", F.when(failed, "inference_failed").otherwise(F.col("status")).alias("status"), "embedding")
