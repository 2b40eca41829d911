"""Fill-in-middle transformation: Spark SQL functions only, one pass without a shuffle.

regexp_extract_all makes a text's array of units, conv and substring of a sha2 give the two cuts and the form, slice and
array_join arrange the parts, and split at the sentinels restores the text from what was put out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A word with the white space before it, or white space that no word follows.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
SENTINEL = "<[PSM]>"


def draws(key: Column, seed: int) -> Column:
    """array of four numbers below 2^32 from the seed and a key (null: as an empty one)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """One row per document: id, n (units), form, prefix_chars, middle_chars and output.

    Of 100 documents about `rate` are cut into prefix, middle and suffix, and of 100 of these about spm_rate are put out as
    suffix, prefix, middle, the others as prefix, suffix, middle. Texts that are empty or hold a sentinel stay plain. The
    draws depend on seed and id only: rows with the same id and text are the same. Null text: as empty; null id: drawn as
    an empty one. Texts of any length are cut whole. Extra columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("__id"), text.alias("__text"), draws(F.col(id_col), seed).alias("__h"))
    rows = rows.withColumn("__plain", (F.col("__text") == "") | F.col("__text").rlike(SENTINEL) | (F.col("__h")[2] % 100 >= rate))
    rows = rows.withColumn("__units", F.regexp_extract_all("__text", F.lit(UNIT), F.lit(0))).withColumn("n", F.size("__units").cast("long"))
    one, two = F.col("__h")[0] % (F.col("n") + 1), F.col("__h")[1] % (F.col("n") + 1)
    rows = rows.withColumn("__lo", F.least(one, two).cast("int")).withColumn("__hi", F.greatest(one, two).cast("int"))

    def joined(start: Column, length: Column) -> Column:
        return F.when(~F.col("__plain"), F.array_join(F.slice("__units", start, length), ""))

    lo, hi, n = F.col("__lo"), F.col("__hi"), F.col("n").cast("int")
    rows = rows.withColumns({"__p": joined(F.lit(1), lo), "__m": joined(lo + 1, hi - lo), "__s": joined(hi + 1, n - hi)})
    spm = F.col("__h")[3] % 100 < spm_rate
    form = F.when(F.col("__plain"), "plain").when(spm, "spm").otherwise("psm")
    output = (
        F.when(F.col("__plain"), F.col("__text"))
        .when(spm, F.concat(F.lit(SUFFIX), "__s", F.lit(PREFIX), "__p", F.lit(MIDDLE), "__m"))
        .otherwise(F.concat(F.lit(PREFIX), "__p", F.lit(SUFFIX), "__s", F.lit(MIDDLE), "__m"))
    )
    return rows.select(F.col("__id").alias(id_col), "n", form.alias("form"), F.length("__p").cast("long").alias("prefix_chars"), F.length("__m").cast("long").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Outputs that aren't plain have exactly three sentinels: a text with one of its
    own stays plain, and none can arise at a border, as each begins with < and ends with >."""
    parts = F.split(output, SENTINEL, -1)  # before the first sentinel stands nothing
    return F.when(form == "plain", output).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(F.concat(parts[1], parts[3], parts[2]))


def query(spark, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sha = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return cut.withColumn("restored", restored(F.col("output"), F.col("form"))).select("doc_id", "n", "form", "prefix_chars", "middle_chars", *sha)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
  ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(units)::BIGINT AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS lo, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS hi,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:lo], '') AS pre, array_to_string(units[lo + 1:hi], '') AS mid, array_to_string(units[hi + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
