"""Where a user's own batch code joins in: frame scorers and wake detectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from voxloom import schemas

Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def _per_batch(fn: Scorer):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return run


def score_frames(audio: DataFrame, scorer: Scorer) -> DataFrame:
    """Rows of audio to frame-logit rows by a user-supplied model, batch by batch.

    The scorer runs where the rows are; the result feeds ``frame_metrics``.
    """
    return audio.mapInPandas(_per_batch(scorer), schemas.FRAMES)


def detect_wake(prefixes: DataFrame, detector: Scorer) -> DataFrame:
    """Submitted phrase prefixes to wake decisions by a user-supplied detector."""
    return prefixes.mapInPandas(_per_batch(detector), schemas.WAKE_DECISIONS)
