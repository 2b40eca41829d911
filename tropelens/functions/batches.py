"""Arrow batches cut by the size of their texts: Spark cuts them by rows, and rows of long texts make them large."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

#: Characters that are worked on at a time, unless one row alone has more.
MOST_CHARS = 1 << 20


def pieces(batch: pd.DataFrame, columns: list[str], most: int = MOST_CHARS) -> Iterator[pd.DataFrame]:
    """The batch's rows in order, in pieces whose texts have at most so many characters, or a single row; null texts have none."""
    sizes = sum((batch[c].str.len().fillna(0).astype("int64") for c in columns), pd.Series(0, index=batch.index)).to_numpy()
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield batch.iloc[start:i]
            start, total = i, 0
        total += size
    if start < len(batch):
        yield batch.iloc[start:]
