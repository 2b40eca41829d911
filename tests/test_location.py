"""Groups of Markdown sections, shares, cuts, shown windows, dropped documents, agreement of raters."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tropelens.operators import agreement, location, sections

MD = "preamble rather than\n# A Title: rather than\nskipped\n## Abstract\na1\n## 2. Our Method\nm1\n### Related work\nr1\n#### Deep\nm2\n##no heading\n## Ethics\ne1\n# References\nx\n### more\ny\n## Appendix A\nz\n####### seven\n## Conclusion"


def test_markdown_groups(spark):
    rows = spark.createDataFrame([(1, MD), (2, ""), (3, None), (4, "# Abstract\nab\n### odd\ncd"), (5, "text only")], "k int, t string")
    got = {r["k"]: r["g"] and [(g["grp"], g["text"].strip("\n")) for g in r["g"]] for r in rows.select("k", location.markdown_groups(F.col("t")).alias("g")).collect()}
    assert got[1] == [("abstract", "a1"), ("body", "m1"), ("related", "r1"), ("body", "m2\n##no heading"), ("limitations", "e1"), ("conclusion", "")]
    assert got[2] == [] and not got[3] and got[4] == [("abstract", "ab"), ("abstract", "cd")] and got[5] == []
    assert set(location.CATEGORY_GROUPS.values()) <= set(location.GROUPS)


def test_location_and_revision(spark):
    rows = spark.createDataFrame([("m", "a", "abstract", "x rather than y"), ("m", "a", "body", "one two three four"), ("m", "b", "abstract", "x rather than y rather than z"), ("m", "b", "odd", "rather than"), (None, "a", "body", "")], "s string, stage string, grp string, text string")
    counts = location.group_counts(rows, ["s", "stage"])
    got = {(r["s"], r["stage"], r["grp"]): (r["uses"], r["words"], r["rate"], r["share"], r["word_share"]) for r in location.location_table(counts, ["s", "stage"]).collect()}
    assert got["m", "a", "abstract"] == (1, 4, 250.0, 100.0, 50.0) and got["m", "a", "body"] == (0, 4, 0.0, 0.0, 50.0)
    assert got["m", "a", "all"] == (1, 8, 125.0, 100.0, 100.0) and got["m", "b", "scoping"] == (2, 7, pytest.approx(2000 / 7), 100.0, 100.0)
    assert got[None, "a", "body"] == (0, 0, None, None, None)
    added = {(r["s"], r["grp"]): r["added"] for r in location.added_by_revision(counts, ["s"], "stage", "a", "b").collect()}
    assert added == {("m", "abstract"): 1, ("m", "body"): 0, (None, "body"): 0}


def test_cuts_windows_and_dropped(spark):
    rows = spark.createDataFrame([("a rather than b\nrefs rather than", "a rather than b", True), ("p q", "p q", False), ("", "", False)], "f string, b string, c boolean")
    got = {r["kind"]: tuple(r)[1:] for r in location.cut_rates(rows, "f", "b", "c").collect()}
    assert got["cut"] == (1, 7.0, pytest.approx(2000 / 7), 4.0, 250.0) and got["whole"] == (2, 1.0, 0.0, 1.0, 0.0) and got["all"][0] == 3
    shown = spark.createDataFrame([("rather than", "x rather than y", None), ("", "x rather than y", "in contrast"), (None, "x rather than y", "instead of z")], "before string, sentence string, after string")
    assert [(r["again"], r["other"]) for r in location.shown_density(shown).collect()] == [(True, False), (False, False), (False, True)]
    one = spark.createDataFrame([(1, "long text"), (2, "x"), (3, "long text"), (4, "long text"), (9, "only here")], "doc_id long, text string")
    two = spark.createDataFrame([(1, "long text"), (2, "long text"), (3, "y"), (4, None)], "doc_id long, text string")
    listed = spark.createDataFrame([(1,), (1,), (77,)], "doc_id long")
    assess = lambda t: F.when(t.isNull(), "no text").when(F.length(t) < 3, "short")
    out = {r["doc_id"]: r["reason"] for r in location.dropped_documents({"one": one, "two": two}, assess, listed).collect()}
    assert out == {1: "excluded list", 2: "one: short", 3: "two: short", 4: "two: no text"}


def plain_agreement(pairs):
    n = len(pairs)
    a, b = Counter(x for x, _ in pairs), Counter(y for _, y in pairs)
    classes = set(a) | set(b)
    po = sum(x == y for x, y in pairs) / n
    pe = sum(a[c] * b[c] for c in classes) / n**2
    q = {c: (a[c] + b[c]) / (2 * n) for c in classes}
    pg = sum(v * (1 - v) for v in q.values()) / (len(classes) - 1) if len(classes) > 1 else None
    return n, len(classes), po, (po - pe) / (1 - pe) if pe < 1 else None, (po - pg) / (1 - pg) if pg is not None and pg < 1 else None


def test_agreement_over_classes(spark):
    labels = [("A", k, "xyz"[k % 3]) for k in range(30)] + [("B", k, "xyyz"[k % 4]) for k in range(3, 33)] + [("C", 3, "q"), ("A", 40, None), ("B", 40, "x"), (None, 4, "x"), ("A", None, "x"), ("A", 50, "garbled"), ("B", 50, "x")]
    table = spark.createDataFrame(labels, "rater string, item long, label string")
    pairs = agreement.label_pairs(table, "rater", "item", "label", "A", "B", ("garbled",))
    want = [("xyz"[k % 3], "xyyz"[k % 4]) for k in range(3, 30)]
    assert Counter((r["a"], r["b"]) for r in pairs.collect()) == Counter(want)
    assert tuple(agreement.agreement(pairs).first()) == pytest.approx(plain_agreement(want))
    more = pairs.withColumn("g", F.col("item") % 2).unionByName(spark.createDataFrame([(1, "x", "x", None), (2, "x", "x", None)], "item long, a string, b string, g long"))
    got = {r["g"]: tuple(r)[1:] for r in agreement.agreement(more, ["g"]).collect()}
    for g in (0, 1):
        assert got[g] == pytest.approx(plain_agreement([w for k, w in zip(range(3, 30), want, strict=True) if k % 2 == g]))
    assert got[None] == (2, 1, 1.0, None, None)
    assert agreement.agreement(pairs.limit(0)).count() == 0


def test_section_names_are_a_table(spark):
    rows = spark.createDataFrame([(1, "Top\n\nPlan\n\ntext of it\n\nOdd\n\nmore")], "doc_id long, text string")
    got = sections.section_rows(rows, aliases={"plan": "method"}).orderBy("pos").collect()
    assert [(r["category"], r["heading"]) for r in got] == [("front_matter", ""), ("method", "Plan")]
    assert {r["heading"] for r in sections.unmatched_headings(rows, aliases={"plan": "method"}).collect()} >= {"odd", "top"}


def test_texts_are_counted_once(spark):
    """The table is made from the counts' few rows; its plan doesn't go back to the texts."""
    rows = spark.createDataFrame([("s", "body", "it is rather than that"), ("s", "abstract", "one two")], "source string, grp string, text string")
    out = location.location_table(location.group_counts(rows, ["source"]), ["source"])
    assert "text" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.grp, r.uses, r.words) for r in out.collect()} == {("body", 1, 5), ("abstract", 0, 2), ("all", 1, 7), ("scoping", 0, 2)}
