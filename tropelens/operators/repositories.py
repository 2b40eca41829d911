"""Code links in papers, and bundles of repository files."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tropelens.operators.corpus import sentence_rows

URL = r"(?i)github\.com/[A-Za-z0-9_.\-]+(?:/[A-Za-z0-9_.\-]+)?"

# Cues beside a link. Strong ones speak of the authors' own code; weak ones count without a citation verb.
STRONG_CUE = (
    r"(?i)\b(?:our code|our implementation|our (?:source )?repository|our github|official implementation|code for (?:this|our) (?:paper|work)|"
    r"we (?:release|open-?source|publicly release|make (?:our|the) (?:code|data and code|code and data) (?:publicly )?available|provide (?:our )?code))\b"
)
WEAK_CUE = (
    r"(?i)\b(?:code (?:is |will be |are |is publicly |is now )*(?:available|released|public)|code and data (?:are|is) available|"
    r"source code (?:is )?(?:available|released)|implementation (?:is )?(?:available|released|public)|code (?:can be found|is hosted|repository)|"
    r"publicly available (?:code|implementation)|data and code (?:are|is) available)\b"
)
CITATION = (
    r"(?i)\b(?:we use[ds]?|using the|we utiliz(?:e[ds]?)|we employ(?:ed)?|we adopt(?:ed)?|built on|based on the|adapted from|fine-?tuned using|"
    r"pre-?trained|released by|provided by|published by|developed by|made available by|open-?sourced by)\b"
)


def clean_url(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"(?i)(?<=.)https?:.*$", ""), r"[./]+$", "")


def owner_repo(url: Column) -> Column:
    """owner__repo of a link, or null."""
    parts = F.split(F.regexp_extract(clean_url(url), r"(?i)github\.com/(.+)", 1), "/")
    return F.when(F.size(parts) >= 2, F.concat_ws("__", parts[0], F.regexp_replace(parts[1], r"\.git$", "")))


def link_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, url, window): every link with its sentence and the neighbours."""
    rows = sentence_rows(docs.where(F.col(text).rlike(URL)), key, text)
    w = Window.partitionBy(key).orderBy("pos")
    window = F.concat_ws(" ", F.lag("sentence").over(w), F.col("sentence"), F.lead("sentence").over(w))
    return rows.withColumn("window", window).select(key, "pos", F.posexplode(F.regexp_extract_all("sentence", F.lit(f"({URL})"), F.lit(1))).alias("at", "url"), "window").withColumn("url", clean_url(F.col("url")))


def own_code(links: DataFrame, strong: str = STRONG_CUE, weak: str = WEAK_CUE, citation: str = CITATION, key: str = "doc_id") -> DataFrame:
    """(key, url): the first link with a strong cue beside it, else the last with a weak cue and no citation verb. Cues are
    regular expressions."""
    w = F.col("window")
    kind = F.when(w.rlike(strong), 2).when(w.rlike(weak) & ~w.rlike(citation), 1)
    place = F.struct("pos", "at")
    ranked = links.withColumn("__kind", kind).where("__kind is not null")
    best = ranked.groupBy(key).agg(F.min_by("url", F.when(F.col("__kind") == 2, place)).alias("strong"), F.max_by("url", F.when(F.col("__kind") == 1, place)).alias("weak"), F.max("__kind").alias("kind"))
    return best.select(key, F.when(F.col("kind") == 2, F.col("strong")).otherwise(F.col("weak")).alias("url"))


def file_kind(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return (
        F.when(name.rlike(r"^readme"), "readme")
        .when(name.rlike(r"(?:^|[_.])tests?[_.]|^test") | F.lower(path).rlike(r"/tests?/"), "test")
        .when(name.rlike(r"\.(?:ya?ml|toml|ini|cfg|json)$"), "config")
        .when(name.rlike(r"\.ipynb$"), "notebook")
        .when(name.rlike(r"\.(?:py|jl|r|m|java|scala|c|cc|cpp|h|hpp|cu|js|ts|go|rs|sh|pl|lua)$"), "code")
        .otherwise("other")
    )


def packed(files: DataFrame, budget: int, shares: dict[str, float], repo: str = "repo") -> DataFrame:
    """Files taken into a bundle of `budget` characters per repository, in order of `rank`: a file that doesn't fit in its
    kind's share or in what is left is skipped, and later ones are still tried. A repository's file list (without contents)
    passes through one task in order, batch by batch: only what is left of the budget is held."""
    rows = files.select(repo, "path", "kind", "rank", "size").where(F.col("size").isNotNull())

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, left, of = object(), 0.0, {}
        for batch in batches:
            keep = []
            for name, kind, size in zip(batch[repo], batch["kind"], batch["size"], strict=True):
                name = None if pd.isna(name) else name
                if name != now:
                    now, left, of = name, budget, {k: budget * s for k, s in shares.items()}
                fits = size <= min(left, of.get(kind, left))
                if fits:
                    left -= size
                    if kind in of:
                        of[kind] -= size
                keep.append(fits)
            yield batch[keep]

    taken = rows.repartition(F.col(repo)).sortWithinPartitions(repo, "rank", "path").mapInPandas(take, rows.schema)
    return files.join(taken.select(repo, "path").distinct(), [repo, "path"], "left_semi")


def settled(df: DataFrame) -> DataFrame:
    """df computed once and checkpointed: later plans start from its rows. The folder is spark.checkpoint.dir; only a session
    on one machine (tests) may go without, on a cluster that is an error."""
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not folder and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            folder = tempfile.mkdtemp(prefix="tropelens-")
        if not folder:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def reachable(edges: DataFrame, starts: DataFrame, most_steps: int | None = None) -> DataFrame:
    """(node, depth) by breadth-first search along imports (a -> b): each round joins only the newest nodes, until there
    are no new ones. With most_steps, a search that isn't done after so many rounds raises an error."""
    seen = new = settled(starts.select("node", F.lit(0).alias("depth")).distinct())
    step = 0
    while not new.isEmpty():
        step += 1
        nxt = new.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        known = seen.select(F.col("node").alias("__seen"))
        new = settled(nxt.join(known, F.col("node").eqNullSafe(F.col("__seen")), "left_anti").select("node", F.lit(step).alias("depth")))
        if most_steps is not None and step > most_steps and not new.isEmpty():
            raise RuntimeError(f"nodes are still being found after {most_steps} rounds")
        seen = seen.union(new)
        if step % 10 == 0:  # else the plan grows with every level
            seen = settled(seen.repartition("node"))
    return seen


def dataset(papers: DataFrame, files: DataFrame, budget: int, key: str = "repo") -> DataFrame:
    """Papers with their repository's files as an array, in path order, while the total before a file is under the budget."""
    w = Window.partitionBy(key).orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    kept = files.withColumn("__before", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)))
    sums = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("__before") < budget, F.struct("path", "text")))).alias("files"), F.max(F.col("__before") >= budget).alias("truncated"))
    return papers.join(sums, key, "left")


def outline(source: str) -> list[str]:
    """Classes and functions of Python source, by name and line; text that doesn't parse has none."""
    import ast

    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    found = [(n.lineno, f"{type(n).__name__.replace('Def', '').lower()} {n.name}") for n in ast.walk(tree) if isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef)]
    return [f"{line}: {name}" for line, name in sorted(found)]


def outlines(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([outline(t or "") for t in batch])

    return files.withColumn("outline", F.pandas_udf(run, "array<string>", F.PandasUDFType.SCALAR_ITER)("text"))
