"""Frames that tasks get from Spark, in pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

#: Rows of a piece: what a task makes of so many texts it holds at once.
PIECE_ROWS = 128


def pieces(frames: Iterator[pd.DataFrame], rows: int = PIECE_ROWS) -> Iterator[pd.DataFrame]:
    """The frames cut into pieces of so many rows, so that results are given back before more are made."""
    for frame in frames:
        for at in range(0, len(frame), rows):
            yield frame.iloc[at : at + rows]
