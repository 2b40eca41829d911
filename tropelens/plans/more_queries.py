"""Queries of sections, replicates, partners, preferences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tropelens.functions import text as tx
from tropelens.operators import preferences, replicates, sections
from tropelens.plans.base import query, rounded
from tropelens.plans.demo import count_sql, demo, demo_sql, table

#: Headings go in where the demo text has line ends, so that the section operators have something to find.
HEADED = "concat('Title\n\n', replace(text, '\n', '\n\nMethods\n\n'))"


@query(
    "section_counts",
    r"WITH x AS (SELECT doc_id, len(string_split(text, chr(10))) - 1 AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, n::BIGINT AS sections FROM x WHERE n > 0",
)
def section_counts(spark, d):
    """Method sections per document."""
    rows = table(spark, d, "documents").select("doc_id", F.expr(HEADED).alias("text"))
    return sections.section_rows(rows).where("category = 'method'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections"))


BACKED = "concat(text, '\n\nConclusion\n\nWe end here.\n\nReferences\n\n[1] A book.\n\nMethods\n\nmore')"


@query(
    "back_matter",
    r"SELECT doc_id, length(text)::BIGINT + 53 AS kept, md5(text || replace('||Conclusion||We end here.||References||[1] A book.||', '|', chr(10))) AS body_md5, true AS truncated FROM documents WHERE text IS NOT NULL",
)
def back_matter(spark, d):
    """Texts with a conclusion, references and methods put behind them: cut after the references, the last section of the back matter."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.expr(BACKED).alias("text"))
    out = sections.without_back_matter(sections.section_rows(rows))
    return rounded(out.select("doc_id", F.length("body").alias("kept"), F.md5(F.col("body").cast("binary")).alias("body_md5"), "truncated"))


@query(
    "stripped_references",
    "SELECT doc_id, length(text)::BIGINT + 9 AS kept, md5(text || chr(10) || 'Finally' || chr(10)) AS body_md5, true AS cut FROM documents WHERE text IS NOT NULL",
)
def stripped_references(spark, d):
    """Texts with two headings of references behind them, cut before the last one."""
    t = F.concat("text", F.lit("\nFinally\nReferences.\n[1] A book, with References inside a line.\n"))
    kept, cut = tx.strip_references(t)
    return rounded(table(spark, d, "documents").where("text is not null").select("doc_id", F.length(kept).alias("kept"), F.md5(kept.cast("binary")).alias("body_md5"), cut.alias("cut")))


@query("section_rates")
def section_rates(spark, d):
    rows = demo(spark, d).select("doc_id", F.expr(HEADED).alias("text"))
    return rounded(sections.rates_by_section(sections.section_rows(rows)))


@query(
    "shift_partner",
    "WITH r AS (SELECT doc_id, source, coalesce(lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id), first_value(doc_id) OVER (PARTITION BY source ORDER BY doc_id)) AS partner FROM documents) SELECT doc_id, partner FROM r",
)
def shift_partner(spark, d):
    """Each document with the next of its corpus, the last with the first."""
    w = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.lead("doc_id").over(w), F.first("doc_id").over(w)).alias("partner"))


@query("bootstrap_interval")
def bootstrap_interval(spark, d):
    return rounded(replicates.bootstrap_mean(table(spark, d, "labels"), "toxic", "doc_id", 500))


@query("permutation_test")
def permutation_test(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("bad", F.col("toxic") == 1)
    return rounded(replicates.permutation_difference(rows, "n_chars", "bad", "doc_id", 300))


@query(
    "pattern_discordance",
    f"""WITH {demo_sql()}, x AS (SELECT text AS c, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS r FROM demo), y AS (SELECT * FROM x WHERE r IS NOT NULL AND c <> r AND c <> '' AND r <> ''),
    z AS (SELECT {", ".join(f"{count_sql(i, 'c')} > 0 AS c_{i}, {count_sql(i, 'r')} > 0 AS r_{i}" for i in ("rather_than", "not_but"))} FROM y)
    """
    + " UNION ALL ".join(f"SELECT '{i}' AS pattern_id, sum((c_{i} AND NOT r_{i})::INT)::BIGINT AS only_chosen, sum((r_{i} AND NOT c_{i})::INT)::BIGINT AS only_rejected FROM z" for i in ("rather_than", "not_but")),
)
def pattern_discordance(spark, d):
    w = Window.partitionBy("source").orderBy("doc_id")
    pairs = demo(spark, d).select(F.col("text").alias("chosen"), F.lead("text").over(w).alias("rejected"))
    from tropelens.functions.patterns import PATTERNS

    return preferences.discordance(pairs, [p for p in PATTERNS if p.pattern_id in ("rather_than", "not_but")])


@query("conversation_messages", "SELECT conv_id, count(*)::BIGINT AS n, string_agg(role, ',' ORDER BY turn) AS roles, arg_max(text, turn) AS last_text FROM conversations GROUP BY conv_id")
def conversation_messages(spark, d):
    """Messages of a conversation as one array, in order."""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return rows.select("conv_id", F.size("m").cast("long").alias("n"), F.array_join(F.transform("m", lambda x: x["role"]), ",").alias("roles"), F.element_at("m", -1)["text"].alias("last_text"))
