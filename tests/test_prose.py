"""Names, parses, reviews, samples near items, embedding caches."""

from pyspark.sql import functions as F

from tropelens.functions import names
from tropelens.operators import corpus, passages, repositories, reviews, sampling, syntax, vectors


def one(spark, f, *values):
    cols = [f"c{k}" for k in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in cols)).select(f(*map(F.col, cols)).alias("x")).first()["x"]


def test_stems(spark):
    cases = {"P19-1176": "P19-1176", "a b*~+": "a%20b%2A~%2B", ".hid": "%2Ehid", "end.": "end%2E", "con.txt": "%63on.txt", "é/x": "%C3%A9%2Fx", "..": "%2E%2E"}
    for raw, stem in cases.items():
        assert one(spark, names.safe_stem, raw) == stem
        assert one(spark, names.decoded_stem, stem) == raw
    assert one(spark, names.safe_stem, "é" * 50) is None and one(spark, names.safe_stem, None) is None


def test_ids_and_pages(spark):
    got = [one(spark, names.paper_id, *x) for x in (("P19", "1", "7"), ("W19", "3", "12"), ("D19", "10", "4"), ("2020.main", "1", "7"))]
    assert got == ["P19-1007", "W19-0312", "D19-1004", "2020.main-1.7"]
    assert [one(spark, names.page_count, x) for x in ("101--110", "5", "iv", None)] == [10, None, None, None]


def test_display_and_location(spark):
    assert one(spark, names.displayed, "“So” it ( ) is ( here ) , ‘now’ .\n\nYes") == "\"So\" it is (here), 'now'. Yes"
    assert tuple(one(spark, names.located, "we go  rather\nthan (stay) home", "rather than (stay)")) == (7, 25)
    assert one(spark, names.located, "nothing", "rather than") is None and one(spark, names.located, "x", "") is None


WORDS = [
    # at, text, tag, pos, dep, head
    (0, "Our", "PRP$", "PRON", "poss", 1),
    (4, "rules", "NNS", "NOUN", "nsubjpass", 3),
    (10, "were", "VBD", "AUX", "auxpass", 3),
    (15, "counted", "VBN", "VERB", "ROOT", 3),
    (23, "rather", "RB", "ADV", "advmod", 5),
    (30, "than", "IN", "ADP", "cc", 3),
    (35, "assumed", "VBN", "VERB", "conj", 3),
]


def test_parses(spark):
    rows = spark.createDataFrame([(1, WORDS), (2, []), (3, None)], f"id long, tokens {syntax.TOKENS}")
    t = F.col("tokens")
    got = {r["id"]: r for r in rows.select("id", syntax.participle_contrast(t, F.lit(0)).alias("xy"), syntax.subject_type(t).alias("s"), syntax.sentence_patterns(t).alias("p"), syntax.phrase_type(t, F.lit(0), F.lit(9)).alias("k"), syntax.participle_contrast(t, F.lit(24)).alias("late")).collect()}
    assert tuple(got[1]["xy"]) == ("counted", "assumed") and got[1]["late"] is None
    assert got[1]["s"] == "our-NP" and got[1]["k"] == "NP" and got[2]["xy"] is None and got[2]["p"] == ["subj:none"] and got[3]["xy"] is None
    assert {"tag:VBN", "root:VBN", "subj:our-NP", "dep:conj", "arc:VBN-conj->VBN"} <= set(got[1]["p"]) and len(got[1]["p"]) == len(set(got[1]["p"]))
    shares = {r["pattern"]: (r["flagged"], r["others"]) for r in syntax.pattern_shares(rows.where("id < 3").withColumn("f", F.col("id") == 1), "f").collect()}
    assert shares[""] == (1, 1) and shares["dep:conj"] == (1, 0) and shares["subj:none"] == (0, 1)


def test_first_token_has_nothing_before(spark):
    rows = spark.createDataFrame([([(0, "Rather", "RB", "ADV", "advmod", 1), (7, "than", "IN", "ADP", "ROOT", 1), (12, "lost", "VBN", "VERB", "pcomp", 1)],)], f"tokens {syntax.TOKENS}")
    assert rows.select(syntax.participle_contrast(F.col("tokens"), F.lit(0)).alias("x")).first()["x"] is None


def test_reviews(spark):
    text = "Summary\nfine\n## Weaknesses:\nNo empirical study.\nLacks evidence.\n**Suggestions for Improvement**\nmore\nStrengths\nunsupported"
    assert one(spark, lambda c: reviews.section(c, ["Weaknesses", "Suggestions for Improvement"]), text) == "No empirical study.\nLacks evidence.\nmore"
    rows = spark.createDataFrame([(1, "a b", text, "a rather than b"), (2, None, None, None)], "doc_id long, generated string, review string, revised string")
    got = {r["doc_id"]: r for r in reviews.revision_effects(rows).collect()}
    assert (got[1]["cues"], got[1]["critique_words"], got[1]["added"], got[1]["rate_change"]) == (2, 6, 1, 250.0)
    assert (got[2]["cues"], got[2]["critique_words"], got[2]["added"]) == (0, 0, 0)


def test_samples(spark):
    rows = spark.createDataFrame([(k, "g" if k < 8 else None, k in (0, 1, 9)) for k in range(12)], "id long, g string, gone boolean")
    kept = sampling.balanced(rows, "g", "gone", ["id"]).collect()
    assert sum(r["gone"] for r in kept) == 3 and sum(not r["gone"] and r["g"] == "g" for r in kept) == 2 and sum(not r["gone"] and r["g"] is None for r in kept) == 1
    examples, rest = sampling.few_shot(rows, "gone", ["id"], 1)
    assert examples.count() == 2 and rest.count() == 10
    places = sampling.annotator_order(spark.createDataFrame([(w, k) for w in "ab" for k in range(9)], "who string, id long"), "id", "who").collect()
    orders = [[r["id"] for r in sorted((r for r in places if r["who"] == w), key=lambda r: r["place"])] for w in "ab"]
    assert sorted(orders[0]) == list(range(9)) and orders[0] != orders[1]


def test_vicinity(spark):
    rows = spark.createDataFrame([(1, k, f"s{k}") for k in range(12)] + [(2, 0, "alone")], "doc_id long, pos int, sentence string")
    items = spark.createDataFrame([(1, 5), (2, 0)], "doc_id long, item_pos int")
    got = sampling.vicinity(rows, items, 2, lambda p: ~F.contains(p, F.lit("s1"))).collect()
    # windows after the item: s7 s8, s8 s9; before it: s1 s2 and earlier hold s1
    assert [(r["doc_id"], r["side"], r["start"], r["passage"]) for r in got] == [(1, "after", 7, "s7 s8")]


def test_vicinity_against_a_loop_moves_no_windows(spark):
    import hashlib
    import random

    rnd = random.Random(8)
    docs = {d: [rnd.choice(["good", "bad", "item", "item good", None]) for _ in range(rnd.choice([0, 1, 6, 30]))] for d in range(40)}

    def want(numbered):
        for d, rows in numbered.items():
            places = {p: i for i, (p, _) in enumerate(rows)}
            for p, s in rows:
                first = "before" if hashlib.md5(f"13:{d}:{p}".encode()).hexdigest()[0] < "8" else "after"
                for k in range(8 if s and "item" in s else 0):
                    side = first if k % 2 == 0 else {"before": "after", "after": "before"}[first]
                    start = p - 4 - k // 2 if side == "before" else p + 2 + k // 2
                    parts = [x for _, x in rows[places[start] :][:2]] if start in places else []
                    if len(parts) == 2 and None not in parts and "bad" not in " ".join(parts):
                        yield d, p, side, start, " ".join(parts)
                        break

    good, said = (lambda c: ~F.contains(c, F.lit("bad"))), (lambda c: F.contains(c, F.lit("item")))
    lists = spark.createDataFrame([*docs.items(), (99, None)], "doc_id long, sentences array<string>").repartition(3)
    out = sampling.vicinity_in_lists(lists.localCheckpoint(), "sentences", said, 2, good)
    wanted = set(want({d: [*enumerate(t)] for d, t in docs.items()}))
    assert {tuple(r) for r in out.collect()} == wanted and {w[2] for w in wanted} == {"before", "after"}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    gaps = {d: [(i + i // 7, s) for i, s in enumerate(t)] for d, t in docs.items()}  # numbers with gaps
    rows = [(d, p, s) for d, t in gaps.items() for p, s in t]
    rnd.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, pos int, sentence string")
    out = sampling.vicinity(frame, frame.where(said(F.col("sentence"))).select("doc_id", F.col("pos").cast("long").alias("item_pos")), 2, good)
    assert {tuple(r) for r in out.collect()} == set(want(gaps))
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_sentence_lists_are_the_sentence_rows(spark):
    docs = spark.createDataFrame([(1, "A b.\u00a0C d! 3 e? f. G"), (2, ""), (3, None), (4, "One.  Two.\n\nThree. ")], "doc_id long, text string")
    rows = {}
    for r in corpus.sentence_rows(docs).orderBy("doc_id", "pos").collect():
        rows.setdefault(r["doc_id"], []).append(r["sentence"])
    assert {r["doc_id"]: r["sentences"] for r in corpus.sentence_lists(docs).collect()} == rows and len(rows) == 3


def test_cache(spark):
    rows = spark.createDataFrame([(1, "a  b"), (2, "a b "), (3, "c"), (4, None)], "id long, text string")
    fresh = vectors.unseen_texts(rows, None)
    assert sorted(r["text"] for r in fresh.collect()) == ["a b", "c"]
    cache = fresh.where("text = 'c'").select("text_key", F.array(F.lit(1.0)).alias("embedding"))
    assert [r["text"] for r in vectors.unseen_texts(rows, cache).collect()] == ["a b"]
    assert {r["id"]: r["embedding"] for r in vectors.with_embeddings(rows, cache).collect()} == {1: None, 2: None, 3: [1.0], 4: None}


def test_packing_against_a_loop(spark):
    import random

    rnd = random.Random(3)
    files = [(rnd.choice(["r", "s", None]), f"p{k:03}", rnd.choice(["code", "readme"]), rnd.randrange(3), rnd.randrange(1, 50)) for k in range(200)]
    want = set()
    for repo in ("r", "s"):
        left, code = 300, 150.0
        for f in sorted((f for f in files if f[0] == repo), key=lambda f: (f[3], f[1])):
            if f[4] <= left and (f[2] != "code" or f[4] <= code):
                want.add((repo, f[1]))
                left, code = left - f[4], code - f[4] * (f[2] == "code")
    rows = spark.createDataFrame(files, "repo string, path string, kind string, rank int, size int")
    assert {(r["repo"], r["path"]) for r in repositories.packed(rows, 300, {"code": 0.5}).collect()} == want


def test_headings_across_blank_lines(spark):
    assert one(spark, passages.without_headings, "\nHead\n\n \nText goes on,\nend\nlast") == "\n\n \nText goes on,\nend\nlast"
    assert one(spark, passages.without_headings, "") == "" and one(spark, passages.without_headings, None) is None
