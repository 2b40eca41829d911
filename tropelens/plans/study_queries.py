"""Queries of revisions, verbatim overlap, cohesion under a mask and replicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tropelens.functions import text as tx
from tropelens.functions.patterns import PATTERNS
from tropelens.operators import agreement, cohesion, corpus, location, replicates, revisions, tells, vectors, verbatim
from tropelens.plans.base import query, rounded
from tropelens.plans.demo import count_sql, demo, demo_sql, table, words_sql

RANKED = "rank() OVER (PARTITION BY pattern_id ORDER BY {c}) + (count(*) OVER (PARTITION BY pattern_id, {c}) - 1) / 2.0::DOUBLE"


@query(
    "pat_rate_changes",
    f"""WITH {demo_sql()}, r AS (SELECT doc_id, greatest({words_sql('v1')}, 1) AS n1, greatest({words_sql('text')}, 1) AS n2, {', '.join(f"{count_sql(p.pattern_id, 'v1')} AS a{k}, {count_sql(p.pattern_id, 'text')} AS b{k}" for k, p in enumerate(PATTERNS))} FROM demo WHERE text IS NOT NULL),
    l AS ({' UNION ALL '.join(f"SELECT doc_id, '{p.pattern_id}' AS pattern_id, 1000.0::DOUBLE * a{k} / n1 AS a, 1000.0::DOUBLE * b{k} / n2 AS b, round(1000.0::DOUBLE * b0 / n2 - 1000.0::DOUBLE * a0 / n1, 9) AS anchor FROM r" for k, p in enumerate(PATTERNS))}),
    d AS (SELECT *, round(b - a, 9) AS d FROM l), k AS (SELECT pattern_id, {RANKED.format(c='anchor')} AS x, {RANKED.format(c='d')} AS y FROM d)
    SELECT pattern_id, count(*)::BIGINT AS docs, round(avg(a), 6) AS old_rate, round(avg(b), 6) AS new_rate, round(avg(d), 6) AS change, count(*) FILTER (d <> 0)::BIGINT AS changed,
      any_value(CASE WHEN pattern_id <> 'rather_than' THEN round(rho, 6) END) AS rho FROM d JOIN (SELECT pattern_id, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS rho FROM k GROUP BY ALL) USING (pattern_id) GROUP BY pattern_id""",
)
def pat_rate_changes(spark, d):
    """All nine patterns' rates in two versions, and how their changes go with the first one's."""
    return rounded(revisions.rate_changes(demo(spark, d).select("v1", "text"), "v1", "text").drop("p"))


@query("substituted_sentences")
def substituted_sentences(spark, d):
    """What became of the sentences with the phrase: a third of the documents has another phrase there, a third the words
    that stood there before, a third is unchanged."""
    new = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit(" rather than "), F.lit(" instead of "))).when(F.col("doc_id") % 3 == 1, F.col("v1")).otherwise(F.col("text"))
    return revisions.substitutions(demo(spark, d).select("doc_id", F.col("text").alias("old"), new.alias("new")), "doc_id", "old", "new")


TOKENS = r"regexp_extract_all(lower(coalesce({t}, '')), '[\p{{L}}\p{{N}}_]+')"


def _grams(n: int) -> str:
    return f"""g{n} AS (SELECT doc_id, i - 1 AS place, array_to_string(t[i:i + {n - 1}], ' ') AS g FROM (SELECT doc_id, t, unnest(range(1, len(t) - {n - 2})) AS i FROM x WHERE len(t) >= {n})),
    s{n} AS (SELECT DISTINCT source, array_to_string(t[i:i + {n - 1}], ' ') AS g FROM (SELECT doc_id AS source, s AS t, unnest(range(1, len(s) - {n - 2})) AS i FROM x WHERE len(s) >= {n})),
    c{n} AS (SELECT DISTINCT source, array_to_string(t[i:i + {n - 1}], ' ') AS g FROM (SELECT doc_id AS source, a AS t, unnest(range(1, len(a) - {n - 2})) AS i FROM x WHERE len(a) >= {n})),
    h{n} AS (SELECT p.doc_id, kind, place, g FROM p JOIN g{n} USING (doc_id) JOIN s{n} USING (source, g) ANTI JOIN c{n} USING (source, g)),
    k{n} AS (SELECT doc_id, kind, count(DISTINCT g) AS own FROM h{n} GROUP BY ALL), n{n} AS (SELECT doc_id, count(DISTINCT g) AS n FROM g{n} GROUP BY doc_id)"""


@query(
    "verbatim_overlap",
    f"""WITH {demo_sql()}, x AS (SELECT doc_id, source AS corpus, {TOKENS.format(t='text')} AS t, {TOKENS.format(t='v1')} AS s, {TOKENS.format(t='v1')}[1:60] AS a FROM demo),
    p AS (SELECT doc_id, 'own' AS kind, doc_id AS source FROM x UNION ALL SELECT doc_id, 'other', coalesce(lead(doc_id) OVER w, first(doc_id) OVER (PARTITION BY corpus ORDER BY doc_id)) FROM x WINDOW w AS (PARTITION BY corpus ORDER BY doc_id)),
    {_grams(8)}, {_grams(13)},
    i AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id, kind ORDER BY place) AS run FROM h8), r AS (SELECT doc_id, kind, min(place) AS start, count(*) AS m FROM i GROUP BY doc_id, kind, run),
    b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, kind ORDER BY m DESC, start) = 1)
    SELECT p.doc_id, p.kind, round(CASE WHEN n8.n > 0 THEN 100.0::DOUBLE * coalesce(k8.own, 0) / n8.n END, 6) AS share8, round(CASE WHEN n13.n > 0 THEN 100.0::DOUBLE * coalesce(k13.own, 0) / n13.n END, 6) AS share13,
      coalesce(m + 7, 0)::BIGINT AS words, array_to_string(x.t[start + 1 : start + m + 7], ' ') AS run
    FROM p JOIN x USING (doc_id) LEFT JOIN n8 USING (doc_id) LEFT JOIN n13 USING (doc_id) LEFT JOIN k8 ON k8.doc_id = p.doc_id AND k8.kind = p.kind LEFT JOIN k13 ON k13.doc_id = p.doc_id AND k13.kind = p.kind LEFT JOIN b ON b.doc_id = p.doc_id AND b.kind = p.kind""",
)
def verbatim_overlap(spark, d):
    """The demo texts against their own originals and, for chance, the next document's of their corpus; the first 60 words of an
    original are its abstract."""
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    docs = demo(spark, d).select("doc_id", F.col("source").alias("corpus"), "v1", "text")
    texts = docs.select(F.col("doc_id").alias("key"), words("text").alias("tokens"))
    sources = docs.select(F.col("doc_id").alias("source"), words("v1").alias("tokens"), F.slice(words("v1"), 1, 60).alias("abstract"))
    out = verbatim.overlap(texts, sources, verbatim.partners(docs.select("corpus", F.col("doc_id").alias("key"))))
    return rounded(out.withColumnRenamed("key", "doc_id"))


UNIT = "u AS (SELECT vec_id, label, vec_id % 40 AS paper, embedding::DOUBLE[] AS e FROM embeddings)"


@query(
    "masked_cohesion",
    f"WITH {UNIT} SELECT a.label AS label_a, b.label AS label_b, count(*)::BIGINT AS pairs, round(avg(list_cosine_similarity(a.e, b.e)), 6) AS mean_cosine FROM u AS a JOIN u AS b ON a.label <= b.label AND a.paper <> b.paper GROUP BY ALL",
)
def masked_cohesion(spark, d):
    """Mean cosine within and between labels over pairs of different papers."""
    rows = vectors.unit_vectors(table(spark, d, "embeddings").select("vec_id", "label", (F.col("vec_id") % 40).alias("paper"), "embedding"))
    return rounded(cohesion.masked_cohesion(rows, "label", "paper"))


@query("cohesion_permutation")
def cohesion_permutation(spark, d):
    """Whether the vectors of one label are closer to each other than random ones, over pairs of different papers."""
    rows = vectors.unit_vectors(table(spark, d, "embeddings").select("vec_id", (F.col("label") == 3).alias("flag"), (F.col("vec_id") % 40).alias("paper"), "embedding"))
    return rounded(cohesion.cohesion_test(rows, "vec_id", "flag", "paper"))


@query("bootstrap_coefficients")
def bootstrap_coefficients(spark, d):
    """Within-order regressions of two outcomes, with intervals from drawing whole orders."""
    return rounded(replicates.bootstrap_within(table(spark, d, "lineitem"), "l_orderkey", ["l_quantity", "l_discount"], ["l_extendedprice", "l_tax"]))


LISTED = ["ba", "de", "la", "the", "of", "and", "et", "le", "und", "der", "en"]
SAID = ["rather than", "in contrast", "as opposed to"]
STYLED = "replace(replace({t}, '. ', CASE WHEN doc_id % 3 = 0 THEN '. Notably, ' ELSE '. ' END), ' in ', ' — ')"


def styled(spark, d):
    t = F.replace("text", F.lit(". "), F.when(F.col("doc_id") % 3 == 0, ". Notably, ").otherwise(". "))
    return demo(spark, d).select("doc_id", "source", F.replace(t, F.lit(" in "), F.lit(" — ")).alias("text"))


@query(
    "tells_measures",
    rf"""WITH {demo_sql()}, s AS (SELECT doc_id, coalesce({STYLED.format(t='text')}, '') AS t FROM demo), w AS (SELECT *, regexp_extract_all(lower(t), '[a-z]+(?:''[a-z]+)?') AS w FROM s)
    SELECT doc_id, round(100.0::DOUBLE * len(list_filter(w, lambda x: x IN ({', '.join(f"'{x}'" for x in LISTED)}))) / greatest(len(w), 1), 6) AS listed, len(regexp_extract_all(t, '\b(?:{'|'.join(x.replace(' ', r'\s+') for x in SAID)})\b', 0, 'i'))::BIGINT AS phrases,
      regexp_matches(t, '(?i)(?:\A|[.!?]\s+)(?:notably|moreover),') AS initial, len(regexp_extract_all(t, '—|---'))::BIGINT AS dashes, greatest(len(w), 1)::BIGINT AS length FROM w""",
)
def tells_measures(spark, d):
    """Style measures of the demo texts, with words and phrases that occur in them."""
    rows = styled(spark, d).select("doc_id", tells.measures(F.col("text"), LISTED, SAID, ["notably", "moreover"]).alias("m"))
    return rounded(rows.select("doc_id", "m.*"))


@query("tells_model")
def tells_model(spark, d):
    """How the measures go with a document's label, by source."""
    rows = styled(spark, d).join(table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("y")), "doc_id")
    return rounded(tells.label_model(rows.select("source", "y", tells.measures(F.col("text"), LISTED, SAID, ["notably", "moreover"]).alias("m")), "y", "source"))


RATED = "r AS (SELECT event_id // 2 AS item, event_id % 2 AS rater, event_type AS label, user_id % 5 AS batch FROM events)"


@query(
    "label_agreement",
    f"""WITH {RATED}, p AS (SELECT a.batch, a.label AS a, b.label AS b FROM r AS a JOIN r AS b USING (item) WHERE a.rater = 0 AND b.rater = 1),
    q AS (SELECT item, a, b FROM (SELECT a.item, a.label AS a, b.label AS b FROM r AS a JOIN r AS b USING (item) WHERE a.rater = 0 AND b.rater = 1) WHERE a <> 'error' AND b <> 'error'),
    k AS (SELECT item % 3 AS part, a, b FROM q), m AS (SELECT part, c, sum(x)::DOUBLE AS x, sum(y)::DOUBLE AS y FROM (SELECT part, a AS c, 1 AS x, 0 AS y FROM k UNION ALL SELECT part, b, 0, 1 FROM k) GROUP BY ALL),
    n AS (SELECT part, count(*) AS n, avg((a = b)::INT) AS po FROM k GROUP BY part),
    e AS (SELECT part, count(*) AS classes, sum(x * y) / (sum(x) * sum(x)) AS pe, sum((x + y) / 2 / t * (1 - (x + y) / 2 / t)) / (count(*) - 1) AS pg FROM m JOIN (SELECT part, sum(x) AS t FROM m GROUP BY part) USING (part) GROUP BY part)
    SELECT part, n::BIGINT AS n, classes::BIGINT AS classes, round(po, 6) AS observed, round((po - pe) / (1 - pe), 6) AS kappa, round((po - pg) / (1 - pg), 6) AS ac1 FROM n JOIN e USING (part)""",
)
def label_agreement(spark, d):
    """Agreement of two raters over several classes: rows of one item are two raters' labels."""
    rows = table(spark, d, "events").select(F.expr("event_id div 2").alias("item"), (F.col("event_id") % 2).cast("string").alias("rater"), F.col("event_type").alias("label"))
    pairs = agreement.label_pairs(rows, "rater", "item", "label", "0", "1", ("error",))
    return rounded(agreement.agreement(pairs.withColumn("part", F.col("item") % 3), ["part"]))


SENTENCES = r"sent AS (SELECT doc_id, unnest(parts) AS sentence, unnest(range(len(parts))) AS pos FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts FROM demo))"


@query(
    "shown_density",
    f"""WITH {demo_sql()}, {SENTENCES}, w AS (SELECT doc_id, sentence, coalesce(lag(sentence) OVER v, '') || ' ' || sentence || ' ' || coalesce(lead(sentence) OVER v, '') AS shown FROM sent WINDOW v AS (PARTITION BY doc_id ORDER BY pos))
    SELECT source, count(*)::BIGINT AS items, sum(({count_sql('rather_than', 'shown')} > 1)::INT)::BIGINT AS again, sum(({' + '.join(count_sql(p.pattern_id, 'shown') for p in PATTERNS if p.pattern_id not in ('rather_than', 'in_contrast'))} > 0)::INT)::BIGINT AS other
    FROM w JOIN demo USING (doc_id) WHERE contains(lower(sentence), 'rather than') GROUP BY source""",
)
def shown_density(spark, d):
    """Items, of which what is shown has the phrase again, and of which it has another pattern, by source."""
    rows = corpus.sentences_with(demo(spark, d).select("doc_id", "text"), "rather than")
    rows = location.shown_density(rows).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("items"), F.sum(F.col("again").cast("long")).alias("again"), F.sum(F.col("other").cast("long")).alias("other"))


PAPER = "concat('# Title rather than name\\nskipped\\n## 1 Introduction\\n', {t}, '\\n## Odd thing\\n', v1, '\\n### 2.1 Related work\\n', {t}, '\\n#### Deep\\n', {t}, '\\n## 5. Conclusions\\n', {t}, '\\n# References\\n', {t}, '\\n## Limitations\\n', v1, '\\n### more\\n', {t})"


@query(
    "section_location",
    f"""WITH {demo_sql()}, w AS (SELECT source, stage, {count_sql('rather_than', 'x')} AS u, {words_sql('x')} AS n, {count_sql('rather_than', 'v1')} AS u1, {words_sql('v1')} AS n1 FROM
      (SELECT source, v1, 'old' AS stage, v1 AS x FROM demo WHERE text IS NOT NULL UNION ALL SELECT source, v1, 'new', text FROM demo WHERE text IS NOT NULL)),
    g AS (SELECT source, stage, unnest(['introduction', 'body', 'related', 'body', 'conclusion', 'limitations', 'limitations']) AS grp, unnest([u, u1, u, u, u, u1, u]) AS uses, unnest([n, n1, n, n, n, n1, n]) AS words FROM w),
    a AS (SELECT * FROM g UNION ALL SELECT source, stage, 'all', uses, words FROM g UNION ALL SELECT source, stage, 'scoping', uses, words FROM g WHERE grp IN ('abstract', 'conclusion', 'limitations')),
    t AS (SELECT source, stage, sum(uses) AS tu, sum(words) AS tw FROM g GROUP BY ALL)
    SELECT a.source, a.stage, grp, sum(uses)::BIGINT AS uses, sum(words)::BIGINT AS words, round(CASE WHEN sum(words) > 0 THEN 1000.0::DOUBLE * sum(uses) / sum(words) END, 6) AS rate, round(CASE WHEN any_value(tu) > 0 THEN 100.0::DOUBLE * sum(uses) / any_value(tu) END, 6) AS share,
      round(CASE WHEN any_value(tw) > 0 THEN 100.0::DOUBLE * sum(words) / any_value(tw) END, 6) AS word_share FROM a JOIN t ON a.source IS NOT DISTINCT FROM t.source AND a.stage = t.stage GROUP BY a.source, a.stage, grp""",
)
def section_location(spark, d):
    """Rates and shares by section group of papers in two stages, by source."""
    stages = F.array(*(F.struct(F.lit(s).alias("stage"), F.expr(PAPER.format(t=t)).alias("md")) for s, t in (("old", "v1"), ("new", "text"))))
    rows = demo(spark, d).where("text is not null").select("source", F.explode(stages).alias("x")).select("source", "x.stage", F.explode(location.markdown_groups(F.col("x.md"))).alias("g")).select("source", "stage", "g.*")
    return rounded(location.location_table(location.group_counts(rows, ["source", "stage"]), ["source", "stage"]))


@query(
    "cut_rates",
    f"""WITH {demo_sql()}, w AS (SELECT doc_id % 2 = 0 AS cut, {words_sql()} AS n, {count_sql('rather_than')} AS u FROM demo WHERE text IS NOT NULL),
    k AS (SELECT CASE WHEN cut THEN 'cut' ELSE 'whole' END AS kind, n + CASE WHEN cut THEN 11 ELSE 0 END AS fn, u + CASE WHEN cut THEN 1 ELSE 0 END AS fu, n + CASE WHEN cut THEN 0 ELSE 0 END AS bn, u AS bu FROM w)
    SELECT coalesce(kind, 'all') AS kind, count(*)::BIGINT AS docs, round(avg(fn), 6) AS full_words, round(avg(CASE WHEN fn > 0 THEN 1000.0::DOUBLE * fu / fn END), 6) AS full_rate, round(avg(bn), 6) AS body_words, round(avg(CASE WHEN bn > 0 THEN 1000.0::DOUBLE * bu / bn END), 6) AS body_rate
    FROM k GROUP BY ROLLUP (kind)""",
)
def cut_rates(spark, d):
    """Lengths and rates with and without references; every second document has some."""
    tail = "\nReferences\n[1] A book, rather than a paper: of all things.\n"
    rows = demo(spark, d).where("text is not null").select(F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(tail))).otherwise(F.col("text")).alias("full"))
    kept, cut = tx.strip_references(F.col("full"))
    return rounded(location.cut_rates(rows.select("full", kept.alias("body"), cut.alias("cut")), "full", "body", "cut"))


@query(
    "dropped_documents",
    f"""WITH {demo_sql()}, a AS (SELECT doc_id, v1, replace(text, 'rather', CASE WHEN doc_id % 5 = 0 THEN 'xxrather' ELSE 'rather' END) AS t FROM demo WHERE doc_id % 7 <> 0),
    r AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'excluded list' WHEN length(v1) < 300 THEN 'original: short' WHEN contains(v1, 'xxrather') THEN 'original: odd' WHEN length(t) < 300 THEN 'revised: short' WHEN contains(t, 'xxrather') THEN 'revised: odd' END AS reason FROM a)
    SELECT coalesce(reason, 'kept') AS reason, count(*)::BIGINT AS n FROM r GROUP BY ALL""",
)
def dropped_documents(spark, d):
    """Documents that both versions have, by why they aren't used."""
    docs = demo(spark, d)
    revised = docs.where(F.col("doc_id") % 7 != 0).select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.replace("text", F.lit("rather"), F.lit("xxrather"))).otherwise(F.col("text")).alias("text"))
    assess = lambda t: F.when(F.length(t) < 300, "short").when(t.contains("xxrather"), "odd")
    out = location.dropped_documents({"original": docs.select("doc_id", F.col("v1").alias("text")), "revised": revised}, assess, table(spark, d, "labels").where("quality = 0"))
    return out.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
