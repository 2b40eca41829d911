"""Passages, changes, repositories."""

import pytest
from pyspark.sql import functions as F

from tropelens.operators import compare, passages, repositories


def one(spark, f, *values):
    names = [f"c{k}" for k in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(f(*map(F.col, names)).alias("x")).first()["x"]


def test_plain(spark):
    assert one(spark, passages.markdown_plain, "# Head\n- a **b** [c](d) `e` *f*\n| x | y |\n![i](j)```\ncode```") == "Head\na b c e f\n"
    assert one(spark, passages.redact_math, r"a $x$ b $$y$$ \(z\)") == "a [redacted] b [redacted] [redacted]"
    assert one(spark, passages.pdf_plain, "re-\nuse (Smith, 2019) [3]") == "reuse [redacted] [redacted]"
    assert one(spark, passages.without_headings, "Our Method\n\nWe go on.\nshort line\nthen text.") == "\nWe go on.\nshort line\nthen text."
    assert one(spark, passages.usable, "word " * 50) and not one(spark, passages.usable, "word " * 20) and not one(spark, passages.usable, None)


def test_redaction_spares_prices_and_finds_names(spark):
    assert one(spark, passages.redact_math, r"costs \$5 or \$6 and $x$") == r"costs \$5 or \$6 and [redacted]"
    assert one(spark, passages.redact_math, "$" + "y" * 300 + "$") == "$" + "y" * 300 + "$"
    assert one(spark, passages.redact_author_years, "As Smith and Doe (2020) and (see Roe et al., 2019; x) (in 2020) say") == "As [redacted] and [redacted] (in 2020) say"
    assert one(spark, passages.pdf_plain, "As Doe (2020) re-\nuse it in con28 Proceedings of the Nth Meeting of the Association for Computational Linguistics struction") == "As [redacted] reuse it in construction"
    assert not one(spark, passages.usable, "word " * 50 + "and , more") and not one(spark, passages.usable, ". " + "word " * 50) and not one(spark, passages.usable, "word " * 50 + "() x")


def test_delete_clause(spark):
    cases = [
        ("We use trees rather than lists.", "lists", "We use trees."),
        ("We use trees, rather than lists, and win.", "lists", "We use trees and win."),
        ("We use trees ,  rather than lists, and win.", "lists", "We use trees and win."),
        ("We use trees rather than lists, and win.", "lists", "We use trees, and win."),
        ("We use trees, rather than lists and win.", "lists", "We use trees, and win."),
        ("We  use trees rather than\n lists  now .", "lists", "We use trees now."),
        ("Rather than lists, we use trees.", "lists", "We use trees."),
        ("(Rather than lists ,  we use trees.)", "lists", "(We use trees.)"),
        ("Rather than lists", "lists", None),
        ("Rather than lists, ", "lists", None),
        ("We use trees rather than lists.", "heaps", None),
        ("We use trees rather than lists.", "", None),
        ("Rather than the ($x) lists, we", "the ($x) lists", "We"),
    ]
    rows = [(k, s, s.lower().index("rather than"), s.lower().index("rather than") + 11, y, want) for k, (s, y, want) in enumerate(cases)] + [(99, None, 1, 2, "x", None), (98, "a rather than b", 2, 13, None, None)]
    table = spark.createDataFrame(rows, "k int, sentence string, local_start long, local_end long, y string, want string")
    got = {r["k"]: (r["deleted"], r["want"]) for r in passages.deleted(table).collect()}
    assert {k: a for k, (a, _) in got.items()} == {k: b for k, (_, b) in got.items()}


def test_changes(spark):
    f = compare.classify_change
    old = "In this large paper we chose to use simple trees rather than lists here."
    assert one(spark, f, old, "In this large paper we chose to use simple trees.") == "removed_surgical"
    assert one(spark, f, old, "Everything is new.") == "removed"
    assert one(spark, f, "x", old) == "added" and one(spark, f, old, old) == "none" and one(spark, f, old, old + " More.") == "reworded"
    h = one(spark, compare.git_hunks, "diff\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n@@ -9 +9 @@\n-d\n")
    assert [(x["old_text"], x["new_text"]) for x in h] == [("a\nb", "a\nc"), ("d", "")]


def test_repositories(spark):
    docs = spark.createDataFrame([(1, "See github.com/x/y. Our code is at https://github.com/a/b. Done."), (2, "They use github.com/c/d here."), (3, None)], "doc_id long, text string")
    links = repositories.link_rows(docs)
    assert {(r["doc_id"], r["url"]) for r in links.collect()} == {(1, "github.com/x/y"), (1, "github.com/a/b"), (2, "github.com/c/d")}
    own = repositories.own_code(links)
    assert [r["doc_id"] for r in own.collect()] == [1]
    files = spark.createDataFrame([("r", "a.py", 1, 60), ("r", "b.py", 2, 60), ("r", "c.py", 3, 30), ("r", "README", 4, 5)], "repo string, path string, rank int, size int").withColumn("kind", repositories.file_kind(F.col("path")))
    assert {r["path"] for r in repositories.packed(files, 100, {"code": 0.95}).collect()} == {"a.py", "c.py", "README"}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "a string, b string")
    assert {(r["node"], r["depth"]) for r in repositories.reachable(edges, spark.createDataFrame([("a",)], "node string")).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert repositories.outline("class A:\n  def f(self): pass\n") == ["1: class A", "2: function f"] and repositories.outline("(") == []


def test_reachable_has_no_depth_limit(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(23)] + [(23, 5), (23, None)], "a long, b long")
    starts = spark.createDataFrame([(0,)], "node long")
    got = sorted((r["node"], r["depth"]) for r in repositories.reachable(edges, starts).where("node is not null").collect())
    assert got == [(k, k) for k in range(24)]
    with pytest.raises(RuntimeError):
        repositories.reachable(edges, starts, most_steps=4)
