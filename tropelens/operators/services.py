"""Table boundary of external services: a scorer is a function from rows to rows; this library opens no connections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def scored(items: DataFrame, key: str, inputs: list[str], scorer: Scorer, schema: str, done: DataFrame | None = None, retries: int = 2) -> DataFrame:
    """Scores of the items that `done` doesn't have. Only key and inputs reach the scorer. A batch that fails is tried again
    row by row; a row that keeps failing gets its error as text, and the others go on. schema: key and outputs."""
    if done is not None:
        items = items.join(done.select(key), key, "left_anti")
    names = [x.split()[0].strip("`") for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                yield scorer(batch).assign(error=None)[[*names, "error"]]
                continue
            except Exception:  # noqa: BLE001  a service may fail in any way
                pass
            for k in range(len(batch)):
                row, error = batch.iloc[[k]], ""
                for _ in range(retries):
                    try:
                        yield scorer(row).assign(error=None)[[*names, "error"]]
                        break
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                else:
                    yield pd.DataFrame([{key: row[key].iloc[0], "error": error}], columns=[*names, "error"])

    return items.select(key, *inputs).mapInPandas(run, f"{schema}, error string")


def cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (model, input_tokens, output_tokens) with cost by price per million; unknown models cost nothing."""
    rows = usage.join(prices, "model", "left")
    total = F.col("input_tokens") * F.coalesce("input_price", F.lit(0.0)) + F.col("output_tokens") * F.coalesce("output_price", F.lit(0.0))
    return rows.withColumn("cost", total / 1e6).drop("input_price", "output_price")
