"""Queries of tokens, passages, reviews, samples of sentences, file names, bundles and parses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tropelens.functions import names
from tropelens.functions import text as tx
from tropelens.operators import corpus, passages, preferences, repositories, reviews, sampling, syntax, vectors
from tropelens.plans.base import long, query, r6, rounded
from tropelens.plans.demo import demo, demo_sql, table, words_sql
from tropelens.plans.label_queries import ORDER
from tropelens.plans.text_queries import SENT

S = "[ \\t\\n\\x0B\\f\\r]"


@query(
    "letter_words",
    r"WITH w AS (SELECT doc_id, regexp_extract_all(text, '\p{L}{2,}') AS w FROM documents) SELECT doc_id, len(w)::BIGINT AS letter_words, len(list_filter(w, lambda x: regexp_full_match(x, '[A-Za-z]+')))::BIGINT AS latin_words FROM w",
)
def letter_words(spark, d):
    w = names.letter_words(F.col("text"))
    return table(spark, d, "documents").select("doc_id", long(F.size(w)).alias("letter_words"), long(F.size(F.filter(w, lambda x: x.rlike("^[A-Za-z]+$")))).alias("latin_words"))


@query(
    "token_kinds",
    r"SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+(?:[-''][a-z0-9]+)*|[^\sa-z0-9]'))::BIGINT AS lex, len(regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?'))::BIGINT AS az FROM documents",
)
def token_kinds(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", long(F.size(tx.lex_tokens(t))).alias("lex"), long(F.size(tx.az_tokens(t))).alias("az"))


@query(
    "ngram_sets",
    r"WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?') AS t FROM documents) SELECT doc_id, "
    + ", ".join(f"len(list_distinct(list_transform(range(1, len(t) - {n - 2}), lambda i: array_to_string(list_slice(t, i, i + {n - 1}), ' '))))::BIGINT AS grams_{n}" for n in (1, 2, 3))
    + " FROM t",
)
def ngram_sets(spark, d):
    """Distinct word n-grams of each document."""
    rows = table(spark, d, "documents").select("doc_id", tx.az_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", *(long(F.size(F.array_distinct(tx.ngrams(F.col("t"), n)))).alias(f"grams_{n}") for n in (1, 2, 3)))


@query(
    "displayed_texts",
    rf"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(text, '“”‘’', '\"\"'''''), '\({S}*\)', '', 'g'), '{S}+([,.;:)])', '\1', 'g'), '\({S}+', '(', 'g'), '{S}+', ' ', 'g')) AS text FROM documents".replace('\\"', '"'),
)
def displayed_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", names.displayed(F.col("text")).alias("text"))


@query("safe_stems", "SELECT page_id, url_encode(url) AS stem FROM pages")
def safe_stems(spark, d):
    """File names for urls."""
    return table(spark, d, "pages").select("page_id", names.safe_stem(F.col("url")).alias("stem"))


@query(
    "paper_ids",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '2020.main-' || (o_custkey % 20) || '.' || (o_orderkey % 100)
      WHEN o_orderkey % 3 = 1 OR o_custkey % 20 >= 10 THEN (CASE WHEN o_orderkey % 3 = 1 THEN 'W19-' ELSE 'P19-' END) || lpad((o_custkey % 20)::VARCHAR, 2, '0') || lpad((o_orderkey % 100)::VARCHAR, 2, '0')
      ELSE 'P19-' || (o_custkey % 20) || lpad((o_orderkey % 100)::VARCHAR, 3, '0') END AS paper_id, (1 + o_custkey % 20)::BIGINT AS pages FROM orders""",
)
def paper_ids(spark, d):
    o, v = F.col("o_orderkey"), (F.col("o_custkey") % 20).cast("string")
    collection = F.when(o % 3 == 0, "2020.main").when(o % 3 == 1, "W19").otherwise("P19")
    pages = F.concat_ws("--", o.cast("string"), (o + F.col("o_custkey") % 20).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", names.paper_id(collection, v, (o % 100).cast("string")).alias("paper_id"), names.page_count(pages).alias("pages"))


@query(
    "dropped_headings",
    rf"""WITH l AS (SELECT doc_id, unnest(ls) AS x, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
    n AS (SELECT *, lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM l WHERE trim(x) <> ''),
    h AS (SELECT doc_id, i FROM n WHERE len(regexp_split_to_array(trim(x), '{S}+')) <= 8 AND NOT regexp_matches(x, '[.!?:;,]{S}*$') AND regexp_matches(trim(nx), '^\p{{Lu}}'))
    SELECT l.doc_id, count(*)::BIGINT AS lines, count(h.i)::BIGINT AS dropped FROM l LEFT JOIN h ON h.doc_id = l.doc_id AND h.i = l.i GROUP BY l.doc_id""",
)
def dropped_headings(spark, d):
    n = lambda t: F.size(F.split(t, "\n"))
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", "text", passages.without_headings(F.col("text")).alias("kept"))
    return rows.select("doc_id", long(n("text")).alias("lines"), long(n("text") - F.when((F.col("kept") == "") & ~F.col("text").rlike(r"(?s)^\s*$"), 0).otherwise(n("kept"))).alias("dropped"))


@query(
    "usable_passages",
    rf"""WITH {demo_sql()}, {SENT}, p AS (SELECT doc_id, pos, string_agg(sentence, ' ') OVER w AS p, count(*) OVER w AS n FROM sent WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
    SELECT doc_id, pos::BIGINT AS pos FROM p WHERE n = 3 AND len(regexp_extract_all(p, '[^ \t\n\x0B\f\r]+')) BETWEEN 40 AND 160
    AND length(regexp_replace(p, '[^\p{{L}}]', '', 'g')) > 0.7 * length(regexp_replace(p, '{S}', '', 'g'))
    AND length(p) - length(replace(p, '[redacted]', '')) <= 40 AND NOT regexp_matches(p, '\({S}*\)|{S}[,.;:]|^[^\p{{L}}\p{{N}}_]|\({S}*[,;]')""",
)
def usable_passages(spark, d):
    """Starts of three sentences that make a usable passage."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(0, 2)
    rows = corpus.sentence_rows(demo(spark, d)).withColumn("p", F.collect_list("sentence").over(w)).where(F.size("p") == 3)
    return rows.where(passages.usable(F.array_join("p", " "))).select("doc_id", long("pos").alias("pos"))


@query(
    "filler_sentences",
    f"""WITH {demo_sql()}, {SENT}, f AS (SELECT *, max(contains(lower(sentence), 'rather than')::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM sent)
    SELECT doc_id, pos::BIGINT AS pos FROM f WHERE near = 0""",
)
def filler_sentences(spark, d):
    rows = corpus.sentence_rows(demo(spark, d))
    return passages.fillers(rows, F.contains(F.lower("sentence"), F.lit("rather than"))).select("doc_id", long("pos").alias("pos"))


@query("vicinity_windows")
def vicinity_windows(spark, d):
    """For each sentence with the phrase, the first usable window near it."""
    said = lambda c: F.contains(F.lower(c), F.lit("rather than"))
    docs = demo(spark, d).select("doc_id", "text").where(said("text"))  # other documents have no item
    return rounded(sampling.vicinity_in_lists(corpus.sentence_lists(docs), "sentences", said, 3, passages.usable))


@query(
    "review_effects",
    rf"""WITH {demo_sql()}, r AS (SELECT doc_id, v1, text, replace(text, ' not ', ' lack of evidence ') AS c FROM demo WHERE text IS NOT NULL),
    x AS (SELECT doc_id, {words_sql("c")}::BIGINT AS critique_words, len(regexp_extract_all(c, 'lack(?:s|ing)? (?:of )?(?:[\p{{L}}\p{{N}}_]+ )?(?:evidence|results|validation|experiments|support)|overstat|overclaim|over-claim|unsupported|not (?:well[- ])?supported|unsubstantiated|speculative|insufficient (?:[\p{{L}}\p{{N}}_]+ )?(?:evidence|support|detail)|no (?:quantitative|empirical|experimental) |does not (?:report|provide|establish|demonstrate|support|justify|show)|(?:claims?|conclusions?) (?:are|is|seem|appear) (?:not|too|overly)', 0, 'i'))::BIGINT AS cues,
    len(regexp_extract_all(text, '\brather than\b', 0, 'i')) AS a, len(regexp_extract_all(v1, '\brather than\b', 0, 'i')) AS b, greatest(1, {words_sql("text")}) AS wa, greatest(1, {words_sql("v1")}) AS wb FROM r)
    SELECT doc_id, critique_words, cues, (a - b)::BIGINT AS added, round(1000.0::DOUBLE * a / wa - 1000.0::DOUBLE * b / wb, 6) AS rate_change, round(ln(wa / wb), 6) AS length_change FROM x""",
)
def review_effects(spark, d):
    """Cues in the critique of a review against what the revision added."""
    rows = demo(spark, d).where("text is not null").withColumn("c", F.replace("text", F.lit(" not "), F.lit(" lack of evidence ")))
    review = F.concat(F.lit("Summary\nfine\n**Weaknesses**\n"), "c", F.lit("\n# Overall Assessment:\nno empirical part"))
    return rounded(reviews.revision_effects(rows.select("doc_id", F.col("v1").alias("generated"), F.col("text").alias("revised"), review.alias("review"))))


LINKED = [(" not ", " see github.com/lab/kit-1. "), (" it is ", " our code is at https://github.com/own/Tool. "), (" but ", " we use github.com/other/lib here ")]


@query(
    "own_code_links",
    rf"""WITH {demo_sql()}, t AS (SELECT doc_id, {"replace(" * 3}text, {", ".join(f"'{a}', '{b}')" for a, b in LINKED)} AS text FROM demo),
    {SENT.replace("FROM demo", "FROM t")}, w AS (SELECT doc_id, pos, sentence, concat_ws(' ', lag(sentence) OVER q, sentence, lead(sentence) OVER q) AS win FROM sent WINDOW q AS (PARTITION BY doc_id ORDER BY pos)),
    u AS (SELECT doc_id, pos, win, unnest(l) AS url, unnest(range(len(l))) AS nth FROM (SELECT *, regexp_extract_all(sentence, 'github\.com/[A-Za-z0-9_.\-]+(?:/[A-Za-z0-9_.\-]+)?', 0, 'i') AS l FROM w)),
    k AS (SELECT doc_id, regexp_replace(url, '[./]+$', '') AS url, pos * 1000000 + nth AS place FROM u WHERE regexp_matches(win, '\bour code\b', 'i'))
    SELECT doc_id, arg_min(url, place) AS url FROM k GROUP BY doc_id""",
)
def own_code_links(spark, d):
    t = F.col("text")
    for old, new in LINKED:
        t = F.replace(t, F.lit(old), F.lit(new))
    return repositories.own_code(repositories.link_rows(demo(spark, d).select("doc_id", t.alias("text")))).where("url is not null")


@query(
    "file_kinds",
    r"""WITH p AS (SELECT page_id, lower(url) AS p, lower(string_split(url, '/')[-1]) AS n FROM pages)
    SELECT page_id, CASE WHEN regexp_matches(n, '^readme') THEN 'readme' WHEN regexp_matches(n, '(?:^|[_.])tests?[_.]|^test') OR regexp_matches(p, '/tests?/') THEN 'test'
    WHEN regexp_matches(n, '\.(?:ya?ml|toml|ini|cfg|json)$') THEN 'config' WHEN regexp_matches(n, '\.ipynb$') THEN 'notebook'
    WHEN regexp_matches(n, '\.(?:py|jl|r|m|java|scala|c|cc|cpp|h|hpp|cu|js|ts|go|rs|sh|pl|lua)$') THEN 'code' ELSE 'other' END AS kind FROM p""",
)
def file_kinds(spark, d):
    return table(spark, d, "pages").select("page_id", repositories.file_kind(F.col("url")).alias("kind"))


@query("bundle_packing")
def bundle_packing(spark, d):
    """Documents packed by source as if they were a repository's files: 200,000 characters, 40 % of them English at most."""
    files = table(spark, d, "documents").select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"), F.col("lang").alias("kind"), F.length("lang").alias("rank"), F.length("text").alias("size"))
    return rounded(repositories.packed(files, 200_000, {"en": 0.4}))


@query(
    "bundle_truncation",
    """WITH f AS (SELECT source AS repo, doc_id, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id::VARCHAR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents WHERE source IS NOT NULL)
    SELECT repo, count(*) FILTER (b < 300000)::BIGINT AS files, bool_or(b >= 300000) AS truncated FROM f GROUP BY repo""",
)
def bundle_truncation(spark, d):
    files = table(spark, d, "documents").where("source is not null").select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"), "text")
    return repositories.dataset(files.select("repo").distinct(), files, 300_000).select("repo", long(F.size("files")).alias("files"), "truncated")


@query(
    "import_reach",
    """WITH RECURSIVE e AS (SELECT doc_id AS a, doc_id // 2 AS b FROM documents), r AS (SELECT doc_id AS node, 0 AS depth FROM labels WHERE toxic = 1 UNION SELECT e.b, depth + 1 FROM r JOIN e ON e.a = r.node WHERE e.a <> e.b)
    SELECT node, min(depth)::BIGINT AS depth FROM r GROUP BY node""",
)
def import_reach(spark, d):
    """Breadth-first search along links from one document to another."""
    edges = table(spark, d, "documents").select(F.col("doc_id").alias("a"), F.expr("doc_id div 2").alias("b"))
    return rounded(repositories.reachable(edges, table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("node"))))


@query(
    "minimal_pairs",
    """SELECT lang AS model, count(*)::BIGINT AS n, round(avg(n_chars - length(source)), 6) AS original_deleted, round(avg(n_chars - quality), 6) AS original_control, round(avg(quality - length(source)), 6) AS control_deleted
    FROM documents JOIN labels USING (doc_id) GROUP BY lang""",
)
def minimal_pairs(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    x = rows.select(F.col("lang").alias("model"), F.col("doc_id").alias("item_id"), F.col("n_chars").alias("original"), F.length("source").alias("deleted"), F.col("quality").alias("control"))
    return rounded(preferences.contrasts(x))


@query(
    "sample_few_shot",
    f"SELECT doc_id, toxic::BIGINT AS toxic FROM (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {ORDER.format(k='doc_id')}, doc_id) AS r FROM labels) WHERE r > 5",
)
def sample_few_shot(spark, d):
    """What is left to judge once five examples of each label are out."""
    return rounded(sampling.few_shot(table(spark, d, "labels").select("doc_id", "toxic"), "toxic", ["doc_id"], 5)[1])


@query(
    "sample_balanced",
    f"""WITH r AS (SELECT doc_id, source, toxic = 1 AS gone, row_number() OVER (PARTITION BY source, toxic = 1 ORDER BY {ORDER.format(k='doc_id')}, doc_id) AS n FROM documents JOIN labels USING (doc_id)),
    g AS (SELECT source, count(*) AS most FROM r WHERE gone GROUP BY source) SELECT doc_id, r.source, gone FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source WHERE gone OR n <= most""",
)
def sample_balanced(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "source", (F.col("toxic") == 1).alias("gone"))
    return sampling.balanced(rows, "source", "gone", ["doc_id"])


@query(
    "annotator_places",
    "SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY md5('13:' || user_id || ':' || event_id), event_id) - 1)::BIGINT AS place FROM events",
)
def annotator_places(spark, d):
    return sampling.annotator_order(table(spark, d, "events").select("user_id", "event_id"), "event_id", "user_id")


@query(
    "unseen_texts",
    rf"WITH t AS (SELECT trim(regexp_replace(text, '{S}+', ' ', 'g')) AS t, doc_id FROM documents WHERE text IS NOT NULL) SELECT DISTINCT sha1(t) AS text_key, length(t)::BIGINT AS chars FROM t WHERE t NOT IN (SELECT t FROM t WHERE doc_id % 7 = 0)",
)
def unseen_texts(spark, d):
    """Texts that a cache filled with every seventh document doesn't have."""
    docs = table(spark, d, "documents")
    cache = vectors.unseen_texts(docs.where("doc_id % 7 = 0"), None)
    return vectors.unseen_texts(docs, cache).select("text_key", long(F.length("text")).alias("chars"))


@query(
    "context_similarity",
    """WITH n AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), a AS (SELECT label, arg_min(e, vec_id) AS e FROM n GROUP BY label),
    s AS (SELECT label AS item_id, list_cosine_similarity(a.e, n.e) AS s FROM n JOIN a USING (label)) SELECT item_id, count(*)::BIGINT AS n, round(max(s), 6) AS nearest, round(avg(s), 6) AS mean FROM s GROUP BY item_id""",
)
def context_similarity(spark, d):
    """The first vector of each label against all of the label."""
    rows = table(spark, d, "embeddings").select(F.col("label").alias("item_id"), "vec_id", "embedding")
    firsts = rows.groupBy("item_id").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return rounded(vectors.context_similarity(firsts, rows))


#: A stand-in for a parser: tags by length, each token governed by the one before it.
PARSE = "transform({t}, (x, i) -> struct(cast(0 as int) as at, x as text, concat('T', least(length(x), 9)) as tag, if(i = 0, 'VERB', 'NOUN') as pos, if(i = 1, 'nsubj', if(i = 0, 'ROOT', 'dep')) as dep, cast(greatest(i - 1, 0) as int) as head))"


@query(
    "parse_patterns",
    rf"""WITH {demo_sql()}, {SENT}, w AS (SELECT row_number() OVER () AS rid, contains(lower(sentence), 'rather than') AS f, regexp_extract_all(sentence, '[a-z]+') AS w FROM sent),
    k AS (SELECT rid, f, i, 'T' || least(length(x), 9) AS tag, w FROM (SELECT rid, f, w, unnest(w) AS x, unnest(range(len(w))) AS i FROM w WHERE len(w) > 0)),
    g AS (SELECT rid, f, i, tag, lag(tag) OVER (PARTITION BY rid ORDER BY i) AS h, CASE WHEN i = 1 THEN 'nsubj' ELSE 'dep' END AS dep, w FROM k),
    p AS (SELECT rid, f, 'tag:' || tag AS pattern FROM g UNION SELECT rid, f, 'dep:' || dep FROM g WHERE i > 0 UNION SELECT rid, f, 'arc:' || h || '-' || dep || '->' || tag FROM g WHERE i > 0
      UNION SELECT rid, f, 'root:' || tag FROM g WHERE i = 0 UNION SELECT rid, f, 'subj:' || CASE WHEN len(w) < 2 THEN 'none' WHEN w[2] = 'we' THEN 'we' ELSE 'NP' END FROM g WHERE i = 0 UNION SELECT rid, f, '' FROM g)
    SELECT pattern, sum(f::INT)::BIGINT AS flagged, sum((NOT f)::INT)::BIGINT AS others FROM p GROUP BY pattern""",
)
def parse_patterns(spark, d):
    """Shares of tag, dependency and arc patterns in sentences with the phrase and without."""
    rows = corpus.sentence_rows(demo(spark, d).select("doc_id", "text"))
    words = rows.select(F.contains(F.lower("sentence"), F.lit("rather than")).alias("f"), F.regexp_extract_all("sentence", F.lit("[a-z]+"), F.lit(0)).alias("w")).where(F.size("w") > 0)
    return syntax.pattern_shares(words.select("f", F.expr(PARSE.format(t="w")).alias("tokens")), "f")


#: A stand-in for a parser on `s`, a sentence with single spaces: words hang towards the middle one, by their lengths.
TREE = """transform(split(s, ' '), (x, i) -> named_struct('at', int(length(array_join(slice(split(s, ' '), 1, i), ' ')) + int(i > 0)), 'text', x,
    'tag', case when length(x) = 3 then 'MD' when endswith(x, 'g') then 'VBG' else concat('T', least(length(x), 9)) end,
    'pos', element_at(array('NOUN', 'VERB', 'ADJ', 'ADP', 'PRON'), int(length(x) % 5 + 1)),
    'dep', element_at(array('nsubj', 'conj', 'cc', 'pobj', 'nsubjpass', 'auxpass', 'neg', 'dep', 'poss'), int((length(x) + i) % 9 + 1)),
    'head', int(case when i < size(split(s, ' ')) div 2 then least(size(split(s, ' ')) div 2, i + 1 + length(x) % 3) when i > size(split(s, ' ')) div 2 then greatest(size(split(s, ' ')) div 2, i - 1 - length(x) % 3) else i end)))"""

#: The same trees as rows, closed by recursion, and X and Y: CTEs up to span(rid, side, i) and heads(rid, side, i).
TREE_SQL = rf"""{demo_sql()}, {SENT}, q AS (SELECT row_number() OVER () AS rid, doc_id % 2 = 0 AS f, trim(regexp_replace(regexp_replace(sentence, '([,.;:])', ' \1 ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS s FROM sent WHERE contains(lower(sentence), 'rather than')),
    b AS (SELECT rid, f, s, string_split(s, ' ') AS w, strpos(lower(s), 'rather than') - 1 AS start FROM q),
    k AS (SELECT rid, f, start, w[i + 1] AS x, lower(w[i + 1]) AS low, i, len(w) AS n, length(array_to_string(w[1:i], ' ')) + (i > 0)::INT AS place, len(w) // 2 AS mid, length(w[i + 1]) AS l FROM (SELECT *, unnest(range(len(w))) AS i FROM b)),
    t AS (SELECT *, CASE WHEN l = 3 THEN 'MD' WHEN x LIKE '%g' THEN 'VBG' ELSE 'T' || least(l, 9) END AS tag, ['NOUN', 'VERB', 'ADJ', 'ADP', 'PRON'][l % 5 + 1] AS pos,
      ['nsubj', 'conj', 'cc', 'pobj', 'nsubjpass', 'auxpass', 'neg', 'dep', 'poss'][(l + i) % 9 + 1] AS dep, CASE WHEN i < mid THEN least(mid, i + 1 + l % 3) WHEN i > mid THEN greatest(mid, i - 1 - l % 3) ELSE i END AS head, regexp_full_match(x, '\p{{P}}+') AS mark FROM k),
    anc AS (SELECT rid, i, i AS a FROM t UNION ALL SELECT anc.rid, anc.i, t.head FROM anc JOIN t ON t.rid = anc.rid AND t.i = anc.a WHERE t.head <> t.i),
    deep AS (SELECT rid, i, count(*) - 1 AS depth FROM anc GROUP BY ALL),
    th AS (SELECT rid, min(i) AS than FROM t WHERE low = 'than' AND place >= start GROUP BY rid),
    th2 AS (SELECT rid, than, nullif(head, than) AS x0 FROM th JOIN t USING (rid) WHERE i = than),
    c AS (SELECT rid, than, x0, min(i) FILTER (head = than AND i <> than AND low <> 'rather' AND NOT mark) AS y1, min(i) FILTER (head = x0 AND i <> x0 AND i > than AND dep = 'conj') AS y2,
      coalesce(min(i) FILTER (i > than AND (x IN (';', '.', ':') OR (dep = 'cc' AND i > than + 1))), any_value(n)) AS stop FROM th2 JOIN t USING (rid) GROUP BY ALL),
    h AS (SELECT rid, min(depth * 100000 + i) % 100000 AS y3 FROM c JOIN t USING (rid) JOIN deep USING (rid, i) WHERE i > than AND i < stop AND NOT mark GROUP BY rid),
    xy AS (SELECT rid, than, coalesce(x0, CASE WHEN y1 IS NULL AND y2 IS NULL THEN than END) AS x, coalesce(y1, y2, y3) AS y FROM c LEFT JOIN h USING (rid) WHERE coalesce(y1, y2, y3) IS NOT NULL AND coalesce(x0, CASE WHEN y1 IS NULL AND y2 IS NULL THEN than END) IS NOT NULL),
    ys AS (SELECT rid, i FROM xy JOIN anc USING (rid) WHERE a = y), ts AS (SELECT rid, i FROM xy JOIN anc USING (rid) WHERE a = than),
    span AS (SELECT rid, 'y' AS side, i FROM ys UNION ALL SELECT xy.rid, 'x', anc.i FROM xy JOIN anc ON anc.rid = xy.rid AND a = x JOIN t ON t.rid = anc.rid AND t.i = anc.i
      WHERE NOT (dep = 'conj' AND t.i > than) AND (xy.rid, anc.i) NOT IN (SELECT (rid, i) FROM ys) AND (xy.rid, anc.i) NOT IN (SELECT (rid, i) FROM ts)),
    heads AS (SELECT span.rid, span.side, min(span.i) AS i FROM span JOIN t ON t.rid = span.rid AND t.i = span.i LEFT JOIN span AS o ON o.rid = span.rid AND o.side = span.side AND o.i = t.head WHERE o.i IS NULL OR t.head = t.i GROUP BY ALL),
    roots AS (SELECT DISTINCT rid, f, mid AS root FROM t), sj AS (SELECT t.rid, min(i) AS s FROM t JOIN roots USING (rid) WHERE head = root AND i <> root AND dep IN ('nsubj', 'nsubjpass') GROUP BY ALL),
    subj AS (SELECT roots.rid, CASE WHEN s IS NULL THEN 'none' WHEN any_value(m.low) = 'we' THEN 'we' WHEN count(o.i) > 0 THEN 'our-NP' WHEN any_value(m.pos) = 'PRON' THEN 'other pronoun' ELSE 'NP' END AS subj
      FROM roots LEFT JOIN sj USING (rid) LEFT JOIN t AS m ON m.rid = roots.rid AND m.i = s LEFT JOIN t AS o ON o.rid = roots.rid AND o.head = s AND o.low = 'our' AND o.dep = 'poss' GROUP BY roots.rid, s)"""
KIND = "CASE WHEN pos IN ('NOUN', 'PRON') THEN 'NP' WHEN pos = 'VERB' AND tag = 'VBG' THEN 'VP-ing' WHEN pos = 'VERB' THEN 'VP' WHEN pos = 'ADJ' THEN 'AdjP' ELSE 'PP' END"


def contrasts(spark, d):
    """(f, s, tokens, start, lead) of all demo sentences with the phrase."""
    spaced = tx.squeezed(F.regexp_replace("sentence", "([,.;:])", " $1 "))
    rows = corpus.sentences_with(demo(spark, d).select("doc_id", "text"), "rather than").select((F.col("doc_id") % 2 == 0).alias("f"), spaced.alias("s"))
    rows = rows.withColumn("start", F.locate("rather than", F.lower("s")) - 1)
    return rows.select("f", "s", F.expr(TREE).alias("tokens"), "start", F.expr("substring(s, 1, start)").alias("lead"))


@query(
    "contrast_features",
    f"""WITH RECURSIVE {TREE_SQL}, cats AS (SELECT rid, max({KIND}) FILTER (side = 'x') AS cx, max({KIND}) FILTER (side = 'y') AS cy FROM heads JOIN t USING (rid, i) GROUP BY rid),
    lens AS (SELECT rid, count(*) FILTER (side = 'x') AS lx, count(*) FILTER (side = 'y') AS ly FROM span GROUP BY rid),
    own AS (SELECT t.rid, bool_and(NOT regexp_matches(substr(b.s, 1, b.start), '[A-Za-z0-9]')) AS initial, bool_or(head = mid AND i <> mid AND dep IN ('nsubjpass', 'auxpass')) AS passive, bool_or(tag = 'MD') AS modal, bool_or(dep = 'neg') AS negation, count(*) FILTER (NOT mark) AS sent_len, max(depth) AS depth
      FROM t JOIN deep USING (rid, i) JOIN b ON b.rid = t.rid GROUP BY t.rid)
    SELECT initial, coalesce(cx, 'other') AS cat_x, coalesce(cy, 'other') AS cat_y, coalesce(cx, 'other') = coalesce(cy, 'other') AS parallel, subj, passive, modal, negation, count(*)::BIGINT AS n, sum(coalesce(lx, 0))::BIGINT AS len_x, sum(coalesce(ly, 0))::BIGINT AS len_y, sum(sent_len)::BIGINT AS words, sum(depth)::BIGINT AS depth
    FROM own JOIN subj USING (rid) LEFT JOIN cats USING (rid) LEFT JOIN lens USING (rid) GROUP BY ALL""",
)
def contrast_features(spark, d):
    """Sentences with the phrase by their syntactic features, with total lengths and depths."""
    rows = contrasts(spark, d).select(syntax.contrast_features(F.col("tokens"), F.col("start"), F.col("lead")).alias("x")).select("x.*")
    keys = ["initial", "cat_x", "cat_y", "parallel", "subj", "passive", "modal", "negation"]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("len_x").alias("len_x"), F.sum("len_y").alias("len_y"), F.sum("sent_len").alias("words"), F.sum("depth").alias("depth"))


@query(
    "contrast_frames",
    f"""WITH RECURSIVE {TREE_SQL}, ra AS (SELECT rid, min(i) AS rather FROM t WHERE low = 'rather' AND place >= start - 1 GROUP BY rid),
    hx AS (SELECT rid, side, i, tag, dep FROM heads JOIN t USING (rid, i)), g AS (SELECT t.*, o.tag AS htag FROM t JOIN t AS o ON o.rid = t.rid AND o.i = t.head),
    p AS (SELECT rid, f, 'pos:initial' AS pattern FROM b WHERE NOT regexp_matches(substr(s, 1, start), '[A-Za-z0-9]')
      UNION SELECT rid, f, 'frame:than=' || dep || '<-' || htag FROM g JOIN th USING (rid) WHERE i = than UNION SELECT rid, f, 'frame:rather=' || dep || '<-' || htag FROM g JOIN ra USING (rid) WHERE i = rather
      UNION SELECT rid, f, upper(side) || ':tag=' || tag FROM hx JOIN roots USING (rid) UNION SELECT rid, f, upper(side) || ':dep=' || dep FROM hx JOIN roots USING (rid)
      UNION SELECT rid, f, 'XY:' || a.tag || '/' || c.tag FROM hx AS a JOIN hx AS c USING (rid) JOIN roots USING (rid) WHERE a.side = 'x' AND c.side = 'y'
      UNION SELECT t.rid, t.f, 'root:' || tag FROM t JOIN roots ON roots.rid = t.rid AND root = i UNION SELECT rid, f, 'subj:' || subj FROM subj JOIN roots USING (rid)
      UNION SELECT rid, f, 'tag:' || tag FROM t UNION SELECT rid, f, 'dep:' || dep FROM t WHERE head <> i UNION SELECT rid, f, 'arc:' || htag || '-' || dep || '->' || tag FROM g WHERE head <> i UNION SELECT rid, f, '' FROM b)
    SELECT pattern, sum(f::INT)::BIGINT AS flagged, sum((NOT f)::INT)::BIGINT AS others FROM p GROUP BY pattern""",
)
def contrast_frames(spark, d):
    """Shares of frame, X, Y, root, subject, tag, dependency and arc patterns in sentences with the phrase."""
    rows = contrasts(spark, d)
    return syntax.pattern_shares(rows, "f", patterns=syntax.contrast_patterns(F.col("tokens"), F.col("start"), F.col("lead")))


@query(
    "deleted_clauses",
    rf"""WITH {demo_sql()}, {SENT}, q AS (SELECT doc_id, pos, sentence AS s, strpos(lower(sentence), 'rather than') - 1 AS a FROM sent WHERE contains(lower(sentence), 'rather than')),
    y AS (SELECT *, regexp_extract(substr(s, a + 12), '^{S}*([^ \t\n\x0B\f\r]+)', 1) AS y, length(regexp_extract(substr(s, a + 12), '^{S}*', 0)) AS gap FROM q),
    k AS (SELECT *, substr(s, 1, a) AS l, substr(s, a + 12 + gap + length(y)) AS r FROM y),
    c AS (SELECT *, regexp_replace(r, '^{S}*(?:,{S}*)?', '') AS o, regexp_matches(l, ', *$') AND starts_with(r, ',') AS paired FROM k),
    h AS (SELECT *, CASE WHEN paired THEN regexp_replace(l, ', *$', '') || r[2:] ELSE rtrim(l, ' ') || r END AS j FROM c)
    SELECT doc_id, pos::BIGINT AS pos, CASE WHEN regexp_matches(l, '[A-Za-z0-9]') THEN regexp_replace(regexp_replace(j, '{S}+([.,;:!?)])', '\1', 'g'), '{S}{{2,}}', ' ', 'g') WHEN o <> '' THEN l || upper(o[1]) || o[2:] END AS deleted FROM h""",
)
def deleted_clauses(spark, d):
    """Sentences with the phrase, without it and the word after it."""
    rows = corpus.sentences_with(demo(spark, d).select("doc_id", "text"), "rather than")
    at = F.locate("rather than", F.lower("sentence")) - 1
    rows = rows.select("doc_id", long("pos").alias("pos"), "sentence", at.alias("local_start"), (at + 11).alias("local_end"))
    rows = rows.withColumn("y", F.regexp_extract(F.expr("substring(sentence, local_end + 1)"), rf"^{S}*([^ \t\n\x0B\f\r]+)", 1))
    return passages.deleted(rows).select("doc_id", "pos", "deleted")
