"""Queries over texts: words, sentences, n-grams, sections, licences, messages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tropelens.functions import text as tx
from tropelens.functions.patterns import space_word_count, word_count
from tropelens.operators import corpus, ngrams, preferences, ranking
from tropelens.operators.compare import classify_change
from tropelens.plans.base import query, rounded
from tropelens.plans.demo import demo, demo_sql, table, words_sql


@query("word_counts", rf"SELECT doc_id, {words_sql()}::BIGINT AS words, len(regexp_extract_all(text, '\S+'))::BIGINT AS space_words, len(regexp_extract_all(text, '\p{{L}}{{2,}}'))::BIGINT AS letter_words FROM documents")
def word_counts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", word_count(t).alias("words"), space_word_count(t).alias("space_words"), F.regexp_count(t, F.lit(r"\p{L}{2,}")).cast("long").alias("letter_words"))


@query("word_bands", f"WITH w AS (SELECT lang, {words_sql()} AS n FROM documents) SELECT lang, sum((n BETWEEN 500 AND 3500)::INT)::BIGINT AS short, sum((n > 3500)::INT)::BIGINT AS long FROM w GROUP BY lang")
def word_bands(spark, d):
    rows = table(spark, d, "documents").select("lang", word_count(F.col("text")).alias("n"))
    return rows.groupBy("lang").agg(F.sum(F.col("n").between(500, 3500).cast("long")).alias("short"), F.sum((F.col("n") > 3500).cast("long")).alias("long"))


@query("length_mean_median", f"WITH w AS (SELECT source, {words_sql()} AS n FROM documents) SELECT source, count(*)::BIGINT AS docs, round(avg(n), 6) AS mean, round(median(n), 6) AS median FROM w GROUP BY source")
def length_mean_median(spark, d):
    rows = table(spark, d, "documents").select("source", word_count(F.col("text")).alias("n"))
    return rounded(rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), F.median("n").alias("median")))


SENT = r"sent AS (SELECT doc_id, unnest(parts) AS sentence, unnest(range(len(parts))) AS pos FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts FROM demo))"


@query("sentence_counts", f"WITH {demo_sql()}, {SENT} SELECT doc_id, count(*)::BIGINT AS sentences, max(length(sentence))::BIGINT AS longest FROM sent GROUP BY doc_id")
def sentence_counts(spark, d):
    s = tx.sentences(F.col("text"))
    return demo(spark, d).select("doc_id", F.size(s).cast("long").alias("sentences"), F.array_max(F.transform(s, lambda x: F.length(x))).cast("long").alias("longest"))


@query("sentence_context", f"WITH {demo_sql()}, {SENT}, n AS (SELECT doc_id, pos, sentence, lag(sentence) OVER q AS before, lead(sentence) OVER q AS after FROM sent WINDOW q AS (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, pos::BIGINT AS pos, length(coalesce(before, ''))::BIGINT AS before, length(coalesce(after, ''))::BIGINT AS after FROM n WHERE contains(lower(sentence), 'rather than')")
def sentence_context(spark, d):
    """Lengths of the neighbours of sentences with the phrase."""
    rows = corpus.sentences_with(demo(spark, d).select("doc_id", "text"), "rather than")
    return rounded(rows.select("doc_id", "pos", F.length("before").alias("before"), F.length("after").alias("after")))


@query("excluded_antijoin", r"WITH x AS (SELECT doc_id FROM documents WHERE lang <> 'en' OR len(regexp_extract_all(text, '\p{L}{2,}')) < 200) SELECT source, count(*)::BIGINT AS docs FROM documents d WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = d.doc_id) GROUP BY source")
def excluded_antijoin(spark, d):
    docs = table(spark, d, "documents")
    return corpus.without(docs.select("doc_id", "source"), corpus.excluded(docs), ["doc_id"]).groupBy("source").agg(F.count(F.lit(1)).alias("docs"))


@query("included_semijoin", "SELECT source, count(*)::BIGINT AS docs FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY source")
def included_semijoin(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("docs"))


@query("excluded_reasons", r"WITH w AS (SELECT lang, len(regexp_extract_all(text, '\p{L}{2,}')) AS n FROM documents) SELECT CASE WHEN n < 200 THEN 'no_text' WHEN lang <> 'en' THEN 'non_english' END AS reason, count(*)::BIGINT AS n FROM w WHERE n < 200 OR lang <> 'en' GROUP BY 1")
def excluded_reasons(spark, d):
    return corpus.excluded(table(spark, d, "documents")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


LICENSE_SQL = "CASE WHEN text IS NULL THEN 'NO_LICENSE_FILE' " + " ".join(f"WHEN regexp_matches(text, '{rx.replace('(?s)', '')}', '{'is' if '(?s)' in rx else 'i'}') THEN '{name}'" for name, rx in tx.LICENSES) + " ELSE 'unrecognized_license_text' END"


@query("licence_classes", f"SELECT {LICENSE_SQL} AS licence, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def licence_classes(spark, d):
    return table(spark, d, "documents").groupBy(tx.license_of(F.col("text")).alias("licence")).agg(F.count(F.lit(1)).alias("n"))


@query("last_assistant", "SELECT conv_id, arg_max(text, turn) AS text, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def last_assistant(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"), F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("turn"))
    return rows.where("turn is not null").select("conv_id", tx.last_of_role(F.col("m"), "assistant").alias("text"), "turn")


@query("preference_pairs", "WITH t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations WHERE role = 'assistant'), s AS (SELECT *, length(nxt) - length(text) AS s FROM t WHERE nxt IS NOT NULL) SELECT conv_id, turn, length(CASE WHEN s < 0 THEN text ELSE nxt END)::BIGINT AS chosen, length(CASE WHEN s < 0 THEN nxt ELSE text END)::BIGINT AS rejected, abs(s)::BIGINT AS strength FROM s WHERE s <> 0")
def preference_pairs(spark, d):
    """Consecutive answers of a conversation, the longer one chosen; ties left out."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").where("role = 'assistant'").withColumn("nxt", F.lead("text").over(w)).where("nxt is not null")
    rows = t.select("conv_id", "turn", F.col("text").alias("response1"), F.col("nxt").alias("response2"), (F.length("nxt") - F.length("text")).alias("strength"))
    return rounded(preferences.oriented(rows).select("conv_id", "turn", F.length("chosen").alias("chosen"), F.length("rejected").alias("rejected"), "strength"))


@query("messages_by_role", "SELECT role, count(*)::BIGINT AS n, count(DISTINCT conv_id)::BIGINT AS conversations, round(avg(length(text)), 6) AS mean_length FROM conversations GROUP BY role")
def messages_by_role(spark, d):
    return rounded(table(spark, d, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("conv_id").alias("conversations"), F.avg(F.length("text")).alias("mean_length")))


@query("normalised_texts", r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS digest FROM documents")
def normalised_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.squeezed(F.col("text")).cast("binary")).alias("digest"))


@query("cut_sensitivity", r"WITH c AS (SELECT doc_id, text, contains(text, chr(10)) AS cut, CASE WHEN contains(text, chr(10)) THEN regexp_extract(text, '(?s)^(.*)\n', 1) ELSE text END AS body FROM documents) SELECT coalesce(cut::VARCHAR, 'all') AS cut, count(*)::BIGINT AS n, sum(length(body))::BIGINT AS kept, sum(length(text))::BIGINT AS total FROM c GROUP BY ROLLUP (cut)")
def cut_sensitivity(spark, d):
    """Lengths with the last line cut off, for documents that have several lines, the others, and all."""
    t = F.col("text")
    rows = table(spark, d, "documents").select(F.contains(t, F.lit("\n")).alias("cut"), F.length(F.when(F.contains(t, F.lit("\n")), F.regexp_extract(t, r"(?s)^(.*)\n", 1)).otherwise(t)).alias("kept"), F.length(t).alias("total"))
    out = rows.rollup("cut").agg(F.count(F.lit(1)).alias("n"), F.sum("kept").alias("kept"), F.sum("total").alias("total"))
    return rounded(out.withColumn("cut", F.coalesce(F.col("cut").cast("string"), F.lit("all"))))


@query("html_sections", r"SELECT page_id, len(regexp_extract_all(html, '<h1>'))::BIGINT AS headings, len(regexp_extract_all(html, '<p>'))::BIGINT AS paragraphs, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages")
def html_sections(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.regexp_count(h, F.lit("<h1>")).cast("long").alias("headings"), F.regexp_count(h, F.lit("<p>")).cast("long").alias("paragraphs"), F.regexp_extract(h, "<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


TOKENS = r"regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?')"


@query("tells_rates", f"WITH t AS (SELECT doc_id, {TOKENS} AS tok FROM documents) SELECT doc_id, len(tok)::BIGINT AS tokens, len(list_filter(tok, lambda x: x IN ('the', 'of', 'and')))::BIGINT AS listed FROM t")
def tells_rates(spark, d):
    """How often listed words occur, repeats counted."""
    tok = tx.az_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(tok).cast("long").alias("tokens"), F.size(F.filter(tok, lambda x: x.isin("the", "of", "and"))).cast("long").alias("listed"))


GRAMS = f"tok AS (SELECT doc_id, (toxic = 1)::INT AS y, {TOKENS} AS t FROM documents JOIN labels USING (doc_id)), g AS (SELECT DISTINCT doc_id, y, unnest(t) AS term FROM tok)"


@query(
    "lexical_logodds",
    f"""WITH {GRAMS}, n AS (SELECT sum(y)::DOUBLE AS n1, (count(*) - sum(y))::DOUBLE AS n0 FROM (SELECT DISTINCT doc_id, y FROM tok)),
    c AS (SELECT term, sum(y)::DOUBLE AS k1, (count(*) - sum(y))::DOUBLE AS k0 FROM g GROUP BY term HAVING count(*) >= 20),
    q AS (SELECT term, k1, k0, n1, n0, 10 * least((k1 + k0) / (n1 + n0), 0.999::DOUBLE) AS a FROM c, n),
    z AS (SELECT term, k1, k0, ln((k1 + a) / (n1 + 10 - k1 - a)) - ln((k0 + a) / (n0 + 10 - k0 - a)) AS delta, 1 / (k1 + a) + 1 / (k0 + a) AS v FROM q)
    SELECT term, k1::BIGINT AS k1, k0::BIGINT AS k0, round(delta, 6) AS delta, round(delta / sqrt(v), 6) AS z FROM z""",
)
def lexical_logodds(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", (F.col("toxic") == 1).alias("y"), tx.az_tokens(F.col("text")).alias("tokens"))
    return rounded(ngrams.log_odds(rows, "doc_id", "y", "tokens", least_items=20))


@query(
    "ngram_overlap",
    rf"""WITH b AS (SELECT item_id, {TOKENS} AS t FROM benchmark), d AS (SELECT doc_id, {TOKENS} AS t FROM documents),
    bg AS (SELECT DISTINCT item_id, array_to_string(t[i:i + 7], ' ') AS g FROM (SELECT item_id, t, unnest(range(1, len(t) - 6)) AS i FROM b WHERE len(t) >= 8)),
    dg AS (SELECT DISTINCT doc_id, array_to_string(t[i:i + 7], ' ') AS g FROM (SELECT doc_id, t, unnest(range(1, len(t) - 6)) AS i FROM d WHERE len(t) >= 8))
    SELECT item_id, doc_id, count(*)::BIGINT AS shared FROM bg JOIN dg USING (g) GROUP BY ALL""",
)
def ngram_overlap(spark, d):
    """8-grams that benchmark items and documents share."""
    items = table(spark, d, "benchmark").select("item_id", tx.az_tokens(F.col("text")).alias("tokens"))
    docs = table(spark, d, "documents").select("doc_id", tx.az_tokens(F.col("text")).alias("tokens"))
    return ngrams.shared(items, docs, "item_id", "doc_id", 8)


@query(
    "longest_copy_run",
    rf"""WITH b AS (SELECT {TOKENS} AS t FROM benchmark), d AS (SELECT doc_id, {TOKENS} AS t FROM documents),
    bg AS (SELECT DISTINCT array_to_string(t[i:i + 7], ' ') AS g FROM (SELECT t, unnest(range(1, len(t) - 6)) AS i FROM b WHERE len(t) >= 8)),
    dg AS (SELECT doc_id, i, array_to_string(t[i:i + 7], ' ') AS g FROM (SELECT doc_id, t, unnest(range(1, len(t) - 6)) AS i FROM d WHERE len(t) >= 8)),
    h AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM dg SEMI JOIN bg USING (g)),
    r AS (SELECT doc_id, grp, count(*) AS n FROM h GROUP BY ALL) SELECT doc_id, (max(n) + 7)::BIGINT AS words FROM r GROUP BY doc_id""",
)
def longest_copy_run(spark, d):
    items = table(spark, d, "benchmark").select(tx.az_tokens(F.col("text")).alias("tokens"))
    docs = table(spark, d, "documents").select("doc_id", tx.az_tokens(F.col("text")).alias("tokens"))
    hits = ngrams.hashed(docs, ["doc_id"], 8).join(ngrams.small_side(ngrams.hashed(items, [], 8).select("h", "g").distinct()), ["h", "g"], "left_semi")
    return ranking.longest_runs(hits, ["doc_id"], "at").select("doc_id", (F.col("longest") + 7).alias("words"))


@query("redacted_gaps", r"SELECT doc_id, regexp_replace(replace(text, ' | ', '   '), '(\S)[ \t]{2,}(\S)', '\1 [redacted] \2', 'g') AS text FROM documents WHERE contains(text, ' | ') AND NOT regexp_matches(replace(text, ' | ', '   '), '\s{2,}\S\s{2,}')")
def redacted_gaps(spark, d):
    """Column gaps of table-like lines; texts with one-character columns aren't compared (the other engine has no look-behind)."""
    wide = F.replace(F.col("text"), F.lit(" | "), F.lit("   "))
    rows = table(spark, d, "documents").where(F.contains("text", F.lit(" | "))).select("doc_id", wide.alias("wide")).where(~F.col("wide").rlike(r"\s{2,}\S\s{2,}"))
    return rows.select("doc_id", tx.redact_gaps(F.col("wide")).alias("text"))


@query("change_sets", f"WITH {demo_sql()}, o AS (SELECT DISTINCT doc_id, unnest(string_split(v1, chr(10))) AS line FROM demo), n AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM demo) SELECT doc_id, sum(gone)::BIGINT AS removed, sum(new)::BIGINT AS added FROM (SELECT doc_id, 1 AS gone, 0 AS new FROM o ANTI JOIN n USING (doc_id, line) UNION ALL SELECT doc_id, 0, 1 FROM n ANTI JOIN o USING (doc_id, line)) GROUP BY doc_id")
def change_sets(spark, d):
    """Lines that one version has and the other hasn't: inside each row, no shuffle."""
    old, new = F.split("v1", "\n"), F.split("text", "\n")
    rows = demo(spark, d).select("doc_id", F.size(F.array_except(old, new)).cast("long").alias("removed"), F.size(F.array_except(new, old)).cast("long").alias("added"))
    return rows.where("removed + added > 0")


CHANGE_SQL = r"""c AS (SELECT doc_id, lang, v1, text, regexp_matches(text, '\brather than\b', 'i') AS was, regexp_matches(v1, '\brather than\b', 'i') AS is_now FROM demo),
w AS (SELECT *, list_filter(regexp_split_to_array(CASE WHEN was THEN regexp_extract(text, '^(.*?)\brather than\b', 1, 'is') ELSE '' END, '\s+'), lambda x: x <> '') AS ws FROM c),
k AS (SELECT *, ws[greatest(len(ws) - 14, 1):len(ws)] AS tl FROM w), r AS (SELECT *, least(5, len(tl)) AS n FROM k),
s AS (SELECT *, len(tl) > 0 AND len(list_filter(range(1, greatest(len(tl) - n + 1, 1) + 1), lambda i: trim(array_to_string(tl[i:i + n - 1], ' '), ',.;:()') <> '' AND contains(lower(v1), lower(trim(array_to_string(tl[i:i + n - 1], ' '), ',.;:()'))))) > 0 AS surgical FROM r)"""


@query("change_classes", f"WITH {demo_sql()}, {CHANGE_SQL} SELECT lang, CASE WHEN was AND NOT is_now THEN CASE WHEN surgical THEN 'removed_surgical' ELSE 'removed' END WHEN is_now AND NOT was THEN 'added' WHEN was AND is_now AND v1 <> text THEN 'reworded' ELSE 'none' END AS kind, count(*)::BIGINT AS n FROM s GROUP BY ALL")
def change_classes(spark, d):
    """From the text with the phrases to the raw one."""
    return demo(spark, d).groupBy("lang", classify_change(F.col("text"), F.col("v1")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("text_diff")
def text_diff(spark, d):
    """Line opcodes between two versions with two lines of context, per document."""
    from tropelens.operators.compare import diff_hunks

    return diff_hunks(demo(spark, d).select("doc_id", "v1", "text"), "doc_id", "v1", "text")
