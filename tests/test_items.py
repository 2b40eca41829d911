"""Items, regressions by sums, rank statistics at scale, query sets in blocks."""

import math
import random

import numpy as np
import plain_stats
import pytest
from pyspark.sql import functions as F

from tropelens.functions import stats
from tropelens.functions import text as tx
from tropelens.operators import compare, items, models, ranking, repositories, sampling, sections, vectors
from tropelens.sources import writers


def test_millions_of_ties(spark):
    """5,000,000 equal values: the tie term doesn't fit 64 bits when cubed as a whole number."""
    rows = spark.range(5_000_010).select(F.greatest(F.col("id") - 5_000_000, F.lit(0)).alias("v"), (F.col("id") % 2 == 0).alias("y"))
    got = ranking.mann_whitney(rows, "v", "y").first()
    assert got["n1"] + got["n0"] == 5_000_010 and abs(got["auc"] - 0.5) < 1e-5 and got["ties"] > 1e20
    assert abs(got["p"] - plain_stats.mann_whitney_p(got["u"], got["n1"], got["n0"], got["ties"])) < 1e-6


def test_rank_statistics_against_plain_ranks(spark):
    rng = random.Random(3)
    rows = [(rng.randint(-30, 30) / 2, rng.randint(0, 40), k % 3 == 0) for k in range(900)]
    table = spark.createDataFrame(rows, "d double, x long, y boolean")

    def ranks(values):
        order = sorted(values)
        first, n = {}, {}
        for k, v in enumerate(order, 1):
            first.setdefault(v, k)
            n[v] = n.get(v, 0) + 1
        return [first[v] + (n[v] - 1) / 2 for v in values], sum(c**3 - c for c in n.values())

    r, ties = ranks([x for _, x, _ in rows])
    n1 = sum(y for *_, y in rows)
    n0 = len(rows) - n1
    u = sum(a for a, (*_, y) in zip(r, rows, strict=True) if y) - n1 * (n1 + 1) / 2
    got = ranking.mann_whitney(table, "x", "y").first()
    assert got["u"] == u and got["ties"] == ties and abs(got["p"] - plain_stats.mann_whitney_p(u, n1, n0, ties)) < 1e-6
    spread = math.sqrt(n1 * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1))))
    assert abs(got["p_greater"] - stats.normal_sf((u - n1 * n0 / 2 - 0.5) / spread)) < 1e-6
    assert abs(got["p_less"] - stats.normal_sf((n1 * n0 / 2 - u - 0.5) / spread)) < 1e-6
    d = [x for x, *_ in rows if x]
    r, ties = ranks([abs(x) for x in d])
    plus = sum(a for a, x in zip(r, d, strict=True) if x > 0)
    got = ranking.signed_ranks(table, "d").first()
    assert got["n"] == len(d) and got["w_plus"] == plus and abs(got["p"] - plain_stats.wilcoxon_p(plus, len(d), ties)) < 1e-6
    a, b = ranks([x for x, *_ in rows])[0], ranks([x for _, x, _ in rows])[0]
    assert abs(ranking.spearman(table, "d", "x").first()["rho"] - np.corrcoef(a, b)[0, 1]) < 1e-9
    assert ranking.signed_ranks(table.limit(0), "d").first()["n"] == 0


def test_regressions_against_driver_fits(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(0.3 + x @ [1.0, -0.5])))).astype(float)
    g = np.arange(300) % 11
    table = spark.createDataFrame([(float(a), float(b), float(c), int(k)) for (a, b), c, k in zip(x, y, g, strict=True)], "a double, b double, y double, g long").repartition(3)
    full = np.column_stack([np.ones(300), x])
    for cluster in (None, "g"):
        want = plain_stats.logistic(full, y, g if cluster else None)
        got = models.logistic(table, "y", ["a", "b"], cluster)
        assert all(np.allclose(p, q, atol=1e-6) for p, q in zip(got, want, strict=True))
    got, want = models.conditional_logit(table, ["a", "b"]), plain_stats.conditional_logit(x)
    assert np.allclose(got[0], want[0], atol=1e-5) and np.allclose(got[1], want[1], rtol=1e-4)
    assert not models.logistic(table.limit(0), "y", ["a"])[0].any()


def test_seeds_and_queries_in_blocks(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[7] = v[3]
    rows = spark.createDataFrame([(k, list(map(float, x))) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    seeds = rows.where("vec_id < 20")
    whole, parts = ({r["vec_id"]: (r["seed"], round(r["similarity"], 9)) for r in vectors.seed_similarity(rows, seeds, block=b).collect()} for b in (100, 6))
    assert whole == parts and whole[7][0] == 3 and len(whole) == 60
    near = [sorted((r["query"], r["vec_id"], r["rank"]) for r in vectors.nearest(rows, seeds, 3, block=b).collect()) for b in (100, 7)]
    assert near[0] == near[1] and len(near[0]) == 60
    assert vectors.seed_similarity(rows, seeds.limit(0)).count() == 0 and vectors.nearest(rows, seeds.limit(0), 3).count() == 0


def test_long_hunks_and_references(spark):
    body = "-" + "x" * 1_000_100 + "\n" + "+y\n" * 3
    row = spark.createDataFrame([("@@ -1 +1 @@\n" + body, "a\nReferences.\nb")], "d string, t string")
    got = row.select(compare.git_hunks(F.col("d")).alias("h"), tx.strip_references(F.col("t"))[0].alias("kept")).first()
    assert got["h"][0]["old_text"] == "x" * 1_000_100 and got["h"][0]["new_text"] == "y\ny\ny" and got["kept"] == "a\n"


def test_reach_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    got = {r["node"]: r["depth"] for r in repositories.reachable(edges, spark.createDataFrame([(0,)], "node long")).collect()}
    assert got == {k: k for k in range(41)}


def test_item_filters(spark):
    pairs = spark.createDataFrame([("x", "y"), ("garbled", "y"), ("x", None)], "a string, b string")
    assert items.both_usable(pairs, "a", "b", "garbled").count() == 1
    rows = spark.createDataFrame([(1, "g"), (2, "g"), (3, "g"), (4, "h")], "k long, g string")
    assert {r["k"]: r["position"] for r in items.relative_position(rows, ["g"], ["k"]).collect()} == {1: 0.0, 2: 0.5, 3: 1.0, 4: None}
    assert items.used_columns(spark.createDataFrame([(1, 0), (0, 0)], "p int, q int"), ["p", "q"]) == ["p"]
    with pytest.raises(ValueError):
        items.prompts(rows, "{nothing}")
    shuffled = items.permuted(rows, "g", "k", 5)
    assert {r["rep"]: r["n"] for r in shuffled.groupBy("rep").agg(F.sum((F.col("g") == "g").cast("int")).alias("n")).collect()} == {k: 3 for k in range(1, 6)}


def test_revision_sets(spark):
    s = ["We use trees rather than lists in all of these cases.", "They go on rather than stop at the end of the day.", "It stays rather than goes away in the whole text."]
    found = spark.createDataFrame([(1, k * 60, x) for k, x in enumerate(s)], "doc_id long, char_start long, sentence string")
    hunks = spark.createDataFrame([(1, "We use  trees rather than\nlists in all of these cases. And")], "doc_id long, old_text string")
    latest = spark.createDataFrame([(1, " ".join(s[1:]))], "doc_id long, text string")
    got = {(r["char_start"], r["fate"]) for r in items.revision_sets(found, hunks, latest).collect()}
    assert len(got) == 2 and (0, "removed") in got and {f for _, f in got} == {"removed", "kept"}


def test_revision_sets_make_their_rows_once(spark):
    """Against a plain loop; rows of instances are computed once, however many sets they end in."""
    import hashlib
    import random

    rnd = random.Random(5)
    names = [f"Sentence {a} of {b} goes {c} rather than  elsewhere" for a in "abcd" for b in "xyz" for c in ("up", "on")] + ["Short rather than"]
    found, hunks, latest, want = [], [], [], set()
    for doc in range(30):
        mine = [(k * 50, s) for k, s in enumerate(rnd.sample(names, 12))]
        old = [" \n".join(rnd.sample([s for _, s in mine], 5)) for _ in range(rnd.choice([0, 1, 3]))]
        last = "\t".join(s for _, s in mine if rnd.random() < 0.6) if doc else None
        found += [(doc, *x) for x in mine] + [(doc, *mine[0])] * (doc % 2)
        hunks += [(doc, t) for t in (*old, None)]
        latest += [(doc, last)]
        flat = lambda t: " ".join(t.split())
        gone = {k for k, s in mine if last is not None and flat(s) not in flat(last) and any(flat(s) in flat(t) for t in old)}
        kept = [k for d, k, s in found if d == doc and last is not None and flat(s) in flat(last) and len(flat(s)) > 30]
        kept.sort(key=lambda k: (hashlib.md5(f"13:{doc}:{k}".encode()).hexdigest(), k))
        want |= {(doc, k, "removed") for k in gone} | {(doc, k, "kept") for k in kept[: len(gone)]}
    frames = [spark.createDataFrame(found, "doc_id long, char_start long, sentence string"), spark.createDataFrame(hunks, "doc_id long, old_text string"), spark.createDataFrame(latest, "doc_id long, text string")]
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(len(b))
            yield b

    out = items.revision_sets(frames[0].mapInPandas(seen, frames[0].schema), *frames[1:]).collect()
    assert {(r["doc_id"], r["char_start"], r["fate"]) for r in out} == want and len({f for *_, f in want}) == 2
    assert sum(r["fate"] == "removed" for r in out) == sum(f == "removed" for *_, f in want)
    assert made.value == len(found)


def test_precision_sample_drops_stale_offsets(spark):
    found = spark.createDataFrame([(1, "p", 3, 6, "abc", "en"), (1, "p", 7, 9, "zz", "en"), (1, "p", 90, 91, "q", "en")], "doc_id long, pattern_id string, char_start long, char_end long, match_text string, lang string")
    texts = spark.createDataFrame([(1, "xx abc yy", 20)], "doc_id long, text string, body_len long")
    assert [r["match_text"] for r in items.precision_sample(found, texts, 5, ["pattern_id", "lang"]).collect()] == ["abc"]


def test_headings_that_no_category_knows(spark):
    docs = spark.createDataFrame([(1, "Odd Heading\n\ntext.\n\nMethods\n\nmore"), (2, "Odd heading\n\nx.")], "doc_id long, text string")
    assert {r["heading"]: r["n"] for r in sections.unmatched_headings(docs).collect()} == {"odd heading": 2, "more": 1}


def test_spread_places_are_those_of_plain_rounding(spark):
    rows = spark.createDataFrame([(g, v) for g, n in enumerate((1, 4, 5, 6, 8, 11, 23)) for v in range(n)], "g int, v int")
    for k in (1, 2, 5, 7):
        got = {(r.g, r.v) for r in sampling.spread(rows, ["g"], ["v"], k).collect()}
        want = set()
        for g, n in enumerate((1, 4, 5, 6, 8, 11, 23)):
            step = (n - 1) / (k - 1) if k > 1 else 0
            want |= {(g, v) for v in (range(n) if k >= n else [round(i * step) for i in range(k)])}
        assert got == want


def test_english_share_over_spaced_chunks(spark):
    english, french = "the cat of the house is in the garden and " * 8, "le chat de la maison dort dans son jardin vert " * 8
    texts = ["\n\n".join([english] * 3 + [french]), "\n \n".join([french, "12 34 56", english]), "too short", "", None, "\n\n".join([english] * 30 + [french] * 30)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").withColumn("chunks", tx.prose_chunks(F.col("text")))
    rows = rows.withColumn("share", tx.english_share(F.col("chunks")))
    got = {r.k: r for r in rows.withColumn("verdict", tx.usable_english(F.col("text"), F.col("share"), 50, 0.6)).collect()}
    a, b = len(english), len(french)
    assert len(got[0].chunks) == 4 and abs(got[0].share - 3 * a / (3 * a + b)) < 1e-9 and got[0].verdict == "ok"
    assert len(got[1].chunks) == 2 and got[1].verdict == "non_english"
    assert got[2].share is None and got[2].verdict == got[3].verdict == got[4].verdict == "no_text" and got[4].chunks is None
    assert len(got[5].chunks) == 30 and got[5].chunks.count(english) == 15  # places 0, 2, 4 ... of 60


def test_corrected_ratios_and_their_gaps(spark):
    rates = spark.createDataFrame([("a", "x", 2.0), ("a", "y", 3.0), ("b", "x", 0.0), ("b", "y", 1.0), ("c", "y", 1.0), ("d", "x", 1.0), ("d", "y", 2.0)], "pattern_id string, corpus string, rate double")
    judged = spark.createDataFrame([("a", "x", 8, 10), ("a", "y", 4, 10), ("d", "x", 0, 0)], "pattern_id string, corpus string, k long, n long")
    got = {r.pattern_id: (r.ratio, r.corrected) for r in items.corrected_ratios(rates, judged, "x", "y").collect()}
    assert got == {"a": (1.5, pytest.approx(0.75)), "b": (None, None), "d": (2.0, None)}


def test_focus_paths_need_a_file_there_or_below(spark):
    url = "https://github.com/o/r/"
    links = spark.createDataFrame([("r", url + x) for x in ("tree/main/src/a/", "blob/main/src/a/b.py", "tree/main/src/ab", "tree/dev/sr", "")] + [("q", url + "tree/main/src/a")], "repo string, url string")
    files = spark.createDataFrame([("r", "src/a/b.py"), ("r", "src/abc/d.py"), ("q", "c.py"), ("q", None)], "repo string, path string")
    assert {tuple(r) for r in items.focus_paths(links, files).collect()} == {("r", "src/a"), ("r", "src/a/b.py")}


def test_text_files_and_markdown(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x\ny|"), ("b", None)], "stem string, text string")
    writers.text_files(rows, str(tmp_path / "t"))
    files = {p.parent.name: p.read_text() for p in (tmp_path / "t").rglob("part-*.txt")}
    assert files == {"stem=a": "x\ny|\n", "stem=b": "\n"}
    assert writers.markdown_table(rows.orderBy("stem")) == "| stem | text |\n| --- | --- |\n| a | x y\\| |\n| b |  |\n"
    with pytest.raises(ValueError):
        writers.markdown_table(rows, 1)
