"""Pattern counts, instances and text functions against small cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tropelens.functions import text as tx
from tropelens.functions.patterns import PATTERNS, word_count
from tropelens.operators import corpus
from tropelens.plans.demo import demo

# text -> (rather_than, not_but, x_not_y, cleft_pivot, not_only_just_merely_but; words)
CASES = {
    "This is not a bug but a feature.": (0, 1, 0, 0, 0, 8),
    "It scales not only in width but also in depth.": (0, 0, 0, 0, 1, 10),
    "We segment words, not characters, not only here.": (0, 0, 1, 0, 0, 8),
    "It's not a trick, it's a method. It is not small; it is large.": (0, 0, 0, 2, 0, 16),
    "We chose trees rather than lists, Rather\nthan sets.": (1, 0, 0, 0, 0, 9),
    "It is not X. But it works.": (0, 0, 0, 0, 0, 7),
    "not a, not b but c": (0, 1, 1, 0, 0, 6),
    "naïve rather than café": (1, 0, 0, 0, 0, 4),
}
NAMES = ["rather_than", "not_but", "x_not_y", "cleft_pivot", "not_only_just_merely_but", "words"]


def table(spark, texts, name="text"):
    return spark.createDataFrame(list(enumerate(texts)), f"doc_id long, {name} string")


def test_counts(spark):
    got = corpus.doc_counts(table(spark, CASES)).orderBy("doc_id").collect()
    assert [tuple(r[n] for n in NAMES) for r in got] == list(CASES.values())


def test_instances_agree_with_counts(spark):
    docs = table(spark, [*CASES, None, ""])
    counts = {(r["doc_id"], p.pattern_id): r[p.pattern_id] for r in corpus.doc_counts(docs).collect() for p in PATTERNS}
    rows = corpus.instances(docs).collect()
    for key, n in counts.items():
        assert sum((r["doc_id"], r["pattern_id"]) == key for r in rows) == n
    for r in rows:
        text = list(CASES)[r["doc_id"]]
        assert text[r["char_start"] : r["char_end"]] == r["match_text"] == r["sentence"][r["local_start"] : r["local_end"]]


def test_offsets(spark):
    rows = corpus.instances(table(spark, ["Ab rather than c. Rather than d, e RATHER THAN f"])).collect()
    assert sorted(r["char_start"] for r in rows) == [3, 18, 35]
    assert [r["context_before"] for r in sorted(rows, key=lambda r: r["char_start"])] == ["", "Ab rather than c.", "Ab rather than c."]


def test_demo_totals(spark):
    docs = demo(spark, "/root/testdata/sf0.01")
    got = {r["pattern_id"]: r["total"] for r in corpus.summary(corpus.doc_counts(docs.drop("v1"))).collect()}
    assert got == {"rather_than": 908, "instead_of": 1383, "as_opposed_to": 693, "in_contrast": 478, "not_but": 223, "x_not_y": 1895, "cleft_pivot": 70, "not_only_just_merely_but": 142, "not_to_say": 883}
    sums = docs.agg(F.sum(word_count(F.col("text"))).alias("w"), F.sum(F.size(tx.sentences(F.col("text")))).alias("s")).first()
    assert (sums["w"], sums["s"]) == (399824, 34283)


def test_sentences(spark):
    rows = corpus.sentence_rows(table(spark, ["A. B is 3. next C? Yes"])).orderBy("pos").collect()
    assert [(r["start"], r["sentence"]) for r in rows] == [(0, "A."), (3, "B is 3. next C?"), (19, "Yes")]


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, " a \n b\t", tx.squeezed) == "a b"
    assert one(spark, r"see \ref{a} and \citep[p. 3][]{b,c}.", tx.redact_refs) == "see [redacted] and [redacted]."
    assert one(spark, "a  b   c\n  d", tx.redact_gaps) == "a [redacted] b [redacted] c\n  d"
    assert one(spark, "x\nReferences\ny\fbibliography \nz", lambda t: tx.strip_references(t)[0]) == "x\nReferences\ny\f"
    assert one(spark, "no heading", lambda t: tx.strip_references(t)[1]) is False
    assert one(spark, "1905.1_v3", tx.without_version) == "1905.1" and one(spark, "1905.1_v3", tx.version_of) == 3 and one(spark, "x", tx.version_of) is None
    assert one(spark, "the mit license", tx.license_of) == "MIT" and one(spark, None, tx.license_of) == "NO_LICENSE_FILE"
    assert one(spark, "2.1 Related Work", tx.heading_category) == "related_work" and one(spark, "Related work.", tx.heading_category) is None
    assert one(spark, "Don't re-use it.", tx.lex_tokens) == ["don't", "re-use", "it", "."]
    assert one(spark, "a b c", lambda t: tx.ngrams(F.split(t, " "), 2)) == ["a b", "b c"] and one(spark, "a", lambda t: tx.ngrams(F.split(t, " "), 2)) == []
    assert one(spark, "we like x rather than y here", lambda t: tx.substituted(t, F.lit("rather than y"), F.lit("and also y"))) == "we like x and also y here"
    assert one(spark, "y y", lambda t: tx.substituted(t, F.lit("y"), F.lit("z"))) is None
    assert one(spark, "abcdef", lambda t: tx.marked(t, (F.lit(1), F.lit(2)), (F.lit(3), F.lit(4)))) == "a<x>b</x>c<y>d</y>ef"
    assert one(spark, "abcdef", lambda t: tx.marked(t, (F.lit(1), F.lit(3)), (F.lit(2), F.lit(4)))) is None
    assert one(spark, " ".join(map(str, range(9))), lambda t: tx.clipped(t, F.lit(8), 3)) == "6 7 8"


@pytest.mark.parametrize("parts", [1, 7])
def test_results_do_not_depend_on_partitions(spark, parts):
    docs = demo(spark, "/root/testdata/sf0.001").repartition(parts)
    got = corpus.summary(corpus.doc_counts(docs.drop("v1"))).select("pattern_id", "total", F.round("mean_rate", 6)).orderBy("pattern_id").collect()
    want = corpus.summary(corpus.doc_counts(demo(spark, "/root/testdata/sf0.001").drop("v1"))).select("pattern_id", "total", F.round("mean_rate", 6)).orderBy("pattern_id").collect()
    assert got == want
