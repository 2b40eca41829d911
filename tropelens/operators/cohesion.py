"""Mean similarity within and between classes of unit vectors, leaving out pairs of one paper, and its permutation test.

No pair is ever made: the sum over all pairs of two classes is the product of their vector sums, and the pairs within a paper,
which include each vector with itself, are taken off as the products of the classes' sums in that paper.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tropelens.operators.order import numbered
from tropelens.operators.ranking import sized_join
from tropelens.operators.replicates import chosen
from tropelens.operators.repositories import settled

#: Rows of one paper that a task adds up at a time; larger papers are split over tasks.
PAPER_ROWS = 20_000


def component_sums(rows: DataFrame, by: list[str], vector: str) -> DataFrame:
    """(by, at, x): sums by component; a row of at = -1 counts the vectors."""
    parts = F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.lit(1.0).alias("x"))), F.transform(F.col(vector), lambda x, i: F.struct(i.alias("at"), x.cast("double").alias("x"))))
    return rows.select(*by, F.explode(parts).alias("c")).groupBy(*by, "c.at").agg(F.sum("c.x").alias("x"))


def masked_cohesion(rows: DataFrame, label: str, paper: str, vector: str = "embedding") -> DataFrame:
    """(label_a, label_b, pairs, mean_cosine) for label_a <= label_b that have pairs of different papers. Pairs count in both
    orders within a class. Rows without label, paper or vector are left out.

    Classes meet per component and, for what is taken off, per paper and component: the work follows the labels of a paper.
    """
    rows = rows.where(F.col(label).isNotNull() & F.col(paper).isNotNull() & F.col(vector).isNotNull()).select(F.col(label).alias("l"), F.col(paper).alias("p"), F.col(vector).alias("v"))
    fine = settled(component_sums(rows, ["l", "p"], "v"))
    whole = settled(fine.groupBy("l", "at").agg(F.sum("x").alias("x")))

    def products(sums: DataFrame, on: list[str]) -> DataFrame:
        a, b = sums.withColumnsRenamed({"l": "label_a", "x": "xa"}), sums.withColumnsRenamed({"l": "label_b", "x": "xb"})
        both = a.join(b, on).where("label_a <= label_b")
        is_count = F.col("at") == -1
        x = F.col("xa") * F.col("xb")
        return both.groupBy("label_a", "label_b").agg(F.sum(F.when(is_count, x)).alias("n"), F.sum(F.when(~is_count, x)).alias("s"))

    out = products(whole, ["at"]).join(products(fine, ["p", "at"]).withColumnsRenamed({"n": "n0", "s": "s0"}), ["label_a", "label_b"], "left")
    n, s = F.col("n") - F.coalesce("n0", F.lit(0.0)), F.col("s") - F.coalesce("s0", F.lit(0.0))
    return out.select("label_a", "label_b", F.round(n).cast("long").alias("pairs"), (s / n).alias("mean_cosine")).where("pairs > 0")


def subset_sums(rows: DataFrame, n: int, k: int, replicates: int, seed: int) -> np.ndarray:
    """[replicate, 2]: (sum of cosines, number of pairs) over ordered pairs of different papers within each replicate's subset of
    k of the n rows. rows: place (from 0), paper, share (of the paper's rows, by number), shares, v.

    Tasks go through their papers in order, a chunk of rows at a time, and hold one paper's sums of all replicates. A paper
    dealt in several shares sends those sums instead of its square; they are added up before they are squared.
    """
    width = len(rows.select("v").first()["v"])
    schema = "what int, paper string, rep long, s array<double>"

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, off = np.zeros((replicates, width + 1)), np.zeros((replicates, 2))
        now, held, split = None, None, False

        def closed() -> pd.DataFrame | None:
            if now is None:
                return None
            if split:
                return pd.DataFrame({"what": 1, "paper": now[0], "rep": np.arange(replicates), "s": list(held)})
            off[:, 0] += (held[:, :-1] ** 2).sum(1)
            off[:, 1] += held[:, -1] ** 2
            return None

        for batch in batches:
            for (paper, share), part in batch.groupby(["paper", "share"], sort=False):
                if (paper, share) != now:
                    done = closed()
                    if done is not None:
                        yield done
                    now, held, split = (paper, share), np.zeros((replicates, width + 1)), part["shares"].iloc[0] > 1
                x = np.column_stack([np.stack(part["v"].to_numpy()), np.ones(len(part))])
                sums = chosen(part["place"].to_numpy(dtype=np.int64), n, k, replicates, seed) @ x
                held += sums
                total += sums
        done = closed()
        if done is not None:
            yield done
        yield pd.DataFrame({"what": 0, "paper": "", "rep": np.arange(replicates), "s": list(np.column_stack([total, off]))})

    dealt = rows.repartition("paper", "share").sortWithinPartitions("paper", "share")
    parts = settled(dealt.mapInPandas(add, schema))

    def added(what: int, by: list[str]) -> DataFrame:
        each = parts.where(F.col("what") == what).select(*by, F.posexplode("s").alias("at", "x")).groupBy(*by, "at").agg(F.sum("x").alias("x"))
        return each

    square = F.col("x") * F.col("x")
    main = added(0, ["rep"]).groupBy("rep").agg(
        F.sum(F.when(F.col("at") < width, square)).alias("s"), F.sum(F.when(F.col("at") == width, square)).alias("n"),
        F.sum(F.when(F.col("at") == width + 1, F.col("x"))).alias("s0"), F.sum(F.when(F.col("at") == width + 2, F.col("x"))).alias("n0"),
    )
    large = added(1, ["paper", "rep"]).groupBy("rep").agg(F.sum(F.when(F.col("at") < width, square)).alias("s1"), F.sum(F.when(F.col("at") == width, square)).alias("n1"))
    out = main.join(large, "rep", "left").select("rep", (F.col("s") - F.col("s0") - F.coalesce("s1", F.lit(0.0))).alias("s"), (F.col("n") - F.col("n0") - F.coalesce("n1", F.lit(0.0))).alias("n"))
    return np.array([(r["s"], r["n"]) for r in out.orderBy("rep").collect()]).reshape(-1, 2)


def cohesion_test(rows: DataFrame, key: str, flag: str, paper: str, vector: str = "embedding", replicates: int = 1000, seed: int = 1, paper_rows: int = PAPER_ROWS) -> DataFrame:
    """One row: flagged items, observed mean cosine of flagged pairs of different papers, mean over random subsets of as many
    items, and the add-one share of subsets that reach the observed one. Keys tell all rows apart; rows with a null in any of
    the columns are left out. Nulls where there is no pair."""
    rows = rows.select(F.col(key).alias("key"), F.col(flag).cast("boolean").alias("flag"), F.col(paper).cast("string").alias("paper"), F.col(vector).cast("array<double>").alias("v")).dropna()
    rows = settled(numbered(rows, [], ["key"], "place").withColumn("place", F.col("place") - 1))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("flag").cast("long")).alias("k")).first()
    n, k = counts["n"], counts["k"] or 0
    seen = masked_cohesion(rows.where("flag"), "flag", "paper", "v").first() if k else None
    if seen is None:
        return rows.sparkSession.createDataFrame([(k, None, None, None)], "flagged long, observed double, expected double, p double")
    sizes = settled(rows.groupBy("paper").agg(F.ceil(F.count(F.lit(1)) / paper_rows).alias("shares")))
    shared = sized_join(rows, sizes, ["paper"]).withColumn("share", F.pmod(F.xxhash64("key"), F.col("shares")))
    got = subset_sums(shared, n, k, replicates, seed)
    means = got[got[:, 1] > 0.5]
    means = means[:, 0] / means[:, 1]
    p = (1 + int((means >= seen["mean_cosine"] - 1e-12).sum())) / (1 + len(means))
    return rows.sparkSession.createDataFrame([(k, seen["mean_cosine"], float(means.mean()) if len(means) else None, p)], "flagged long, observed double, expected double, p double")
