"""Stand-in tables: the supplied prose has none of the phrases, so the demo corpus puts them there by literal replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPLACEMENTS = [
    (" by ", " rather than "),
    (" that ", ", not "),
    (" with ", " it is not "),
    (" as ", " it is "),
    (" for ", " not "),
    (" was ", " but "),
    (" to ", " not only "),
    (" on ", " instead of "),
    (" or ", " in contrast "),
    (" an ", " as opposed to "),
    (" are ", " this is not to say "),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, v1 (raw text) and text (with the phrases)."""
    text = F.col("text")
    for old, new in REPLACEMENTS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("text").alias("v1"), text.alias("text"))


def demo_sql() -> str:
    text = "text"
    for old, new in REPLACEMENTS:
        text = f"replace({text}, '{old}', '{new}')"
    return f"demo AS (SELECT doc_id, lang, source, text AS v1, {text} AS text FROM documents)"


#: The same patterns without look-ahead, for engines that have none: (id, text expression, expression).
MASKED = r"regexp_replace({t}, '\b(n)o(t\s+(?:only|just|merely)\b)', '\1_\2', 'gi')"


def count_sql(pattern_id: str, t: str = "text") -> str:
    def n(rx: str, text: str = t) -> str:
        return f"len(regexp_extract_all({text}, '{rx}', 0, 'i'))"

    plain = {
        "rather_than": r"\brather than\b",
        "instead_of": r"\binstead of\b",
        "as_opposed_to": r"\bas opposed to\b",
        "in_contrast": r"\bin contrast\b",
        "cleft_pivot": r"\bit''?s\s+not\b[^.!?]{0,60}?\bit''?s\b|\bit\s+is\s+not\b[^.!?]{0,60}?\bit\s+is\b",
        "not_only_just_merely_but": r"\bnot\s+(?:only|just|merely)\b[^.!?]{0,60}?\bbut\b",
        "not_to_say": r"\bthis is not to say\b",
    }
    if pattern_id == "not_but":
        return n(r"\bnot\b[^.!?]{0,60}?\bbut\b", MASKED.replace("{t}", t))
    if pattern_id == "x_not_y":
        return f"({n(r',\s*not\b')} - {n(r',\s*not\s+(?:only|just|merely)\b')})"
    return n(plain[pattern_id])


def words_sql(t: str = "text") -> str:
    return rf"len(regexp_extract_all({t}, '[\p{{L}}\p{{N}}_]+'))"
