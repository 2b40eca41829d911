"""Sources, sinks, sampling, sections, vectors, preferences, services, stream, entry points."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tropelens.operators import compare, corpus, preferences, sampling, sections, services, vectors
from tropelens.sources import readers, tei, writers
from tropelens.streaming import labels as stream


def test_valid_records(spark, tmp_path):
    ok = lambda i, t="t": json.dumps({"doc_id": i, "title": t, "sections": []})
    lines = [ok("a"), "{broken", "[1]", ok("a"), ok(""), ok("b", " "), "", ok("c"), "3"]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    valid, rejected = readers.valid_records(spark, str(tmp_path / "x.jsonl"))
    assert [r["doc_id"] for r in valid.collect()] == ["a", "c"] and rejected.count() == 7


def test_file_readers(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/p1.txt").write_bytes("caf\xe9 not".encode("latin-1"))
    (tmp_path / "t/p2.txt").write_text("naïve")
    assert {(r["doc_id"], r["text"]) for r in readers.text_files(spark, str(tmp_path / "t"), "c").collect()} == {("p1", "caf� not"), ("p2", "naïve")}
    (tmp_path / "ids").write_text("# all\nacl\tA0\n\nB1\n")
    assert {(r["corpus"], r["doc_id"]) for r in readers.id_list(spark, str(tmp_path / "ids"), "x").collect()} == {("acl", "A0"), ("x", "B1")}
    (tmp_path / "m/gpt/draft").mkdir(parents=True)
    (tmp_path / "m/gpt/draft/p.md").write_text("# T")
    assert tuple(readers.markdown_files(spark, str(tmp_path / "m")).first()) == ("gpt", "draft", "p", "# T")
    (tmp_path / "b.bib").write_text('@inproceedings{k1,\n title = "A {B}",\n year = "2019",\n pages = "1--9"\n}\n@proceedings{k2,\n title = "Proceedings of X",\n year = "2019"\n}\n@article{k3,\n title = {C},\n year = 2018\n}\n')
    assert [(r["key"], r["title"]) for r in readers.bibtex(spark, str(tmp_path / "b.bib"), 2019).collect()] == [("k1", "A {B}")]
    (tmp_path / "x.xml").write_text('<c><paper id="7"><title>A</title><pages>10–18</pages></paper></c>')
    assert readers.xml_papers(spark, str(tmp_path / "x.xml")).select("paper_id", "pages").first() == ("7", 9)
    (tmp_path / "u.tsv").write_text("corpus\tdoc_id\na\t\"1\n")
    assert tuple(readers.tab_separated(spark, str(tmp_path / "u.tsv"), "corpus string, doc_id string").first()) == ("a", '"1')


def test_tei(spark, tmp_path):
    body = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>T</title></titleStmt></fileDesc><profileDesc><abstract><p>Abs</p></abstract></profileDesc></teiHeader><text><body><div><head>One</head><p>a <b>b</b></p></div><div><div><head>In</head><p>c</p></div></div></body><back><div><listBibl><biblStruct/><biblStruct/></listBibl></div></back></text></TEI>'
    (tmp_path / "a.xml").write_text(body)
    (tmp_path / "b.xml").write_text("<broken")
    rows = {r["doc_id"]: r for r in tei.tei_files(spark, str(tmp_path)).collect()}
    assert [(s["heading"], s["text"]) for s in rows["a"]["sections"]] == [("One", "a b"), ("In", "c")]
    assert rows["a"]["n_references"] == 2 and rows["a"]["abstract"] == "Abs" and rows["b"]["error"]


def test_by_ids_and_union(spark, tmp_path):
    spark.createDataFrame([(x, x * 2) for x in "abcd"], "doc_id string, v string").write.parquet(str(tmp_path / "p"))
    assert [r["doc_id"] for r in readers.by_ids(spark, str(tmp_path / "p"), ["c", "a"]).collect()] == ["c", "a"]
    with pytest.raises(KeyError):
        readers.by_ids(spark, str(tmp_path / "p"), ["a", "z"])
    a = spark.createDataFrame([("x",)], "id string")
    with pytest.raises(ValueError):
        readers.union_view([a, a], "id")


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    out = str(tmp_path / "out")
    assert writers.resume(rows, out, ["id"]) == 2 and writers.resume(rows.union(spark.createDataFrame([(3, "c")], rows.schema)), out, ["id"]) == 1
    assert spark.read.parquet(out).count() == 3
    s = "annotator string, item string, label string, ts long"
    old = spark.createDataFrame([("A", "1", "x", 5), ("A", "2", "y", 6), ("B", "1", "z", 7)], s)
    new = spark.createDataFrame([("A", "1", "x", None), ("A", "3", "w", None)], s)
    assert {tuple(r) for r in writers.upsert(old, new, "annotator", ["annotator", "item"], "label", "ts").collect()} == {("B", "1", "z", 7), ("A", "1", "x", 5), ("A", "3", "w", None)}
    parts = writers.routed(spark.createDataFrame([("rep__1",), ("re2",), ("x",)], "k string"), "k", {"rep__": "r", "re": "s"})
    assert {k: v.count() for k, v in parts.items()} == {"r": 1, "s": 1, "": 1}
    assert writers.splice("a @D b", "@D", "</x>") == "a <\\/x> b"
    with pytest.raises(ValueError):
        writers.splice("a", "@D", "")


def test_sampling(spark):
    rows = spark.createDataFrame([(s, f"{s}{k}") for s in "AX" for k in range(10)], "corpus string, doc_id string")
    one = sampling.even_split(rows, "corpus", ["doc_id"], 7, ["A", "X"])
    assert {r["corpus"]: r["count"] for r in one.groupBy("corpus").count().collect()} == {"A": 4, "X": 3}
    assert set(one.collect()) == set(sampling.even_split(rows.repartition(5), "corpus", ["doc_id"], 7, ["A", "X"]).collect())
    registry = spark.createDataFrame([], "batch string, corpus string, doc_id string")
    first, log = sampling.draw_batch(rows, registry, "b1", "corpus", ["doc_id"], 6, ["A", "X"])
    registry = registry.union(log)
    again, more = sampling.draw_batch(rows, registry, "b1", "corpus", ["doc_id"], 6, ["A", "X"])
    assert set(again.collect()) == set(first.collect()) and more.count() == 0
    second, _ = sampling.draw_batch(rows, registry, "b2", "corpus", ["doc_id"], 6, ["A", "X"])
    assert not set(second.collect()) & set(first.collect())
    with pytest.raises(ValueError):
        sampling.draw_batch(rows, registry, "b1", "corpus", ["doc_id"], 5, ["A", "X"])
    with pytest.raises(ValueError):
        sampling.even_split(rows, "corpus", ["doc_id"], 40, ["A", "X"])


def test_sections_cover_every_character(spark):
    text = "Title\n\nAuthors\n\n" + "Long abstract. " * 30 + "\n\n1 Introduction\n\nwe go\n\nMethods\n\nrather than\n\nnot a heading.\n\nReferences\n\n[1]"
    rows = sections.section_rows(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "plain")], "doc_id long, text string")).orderBy("doc_id", "pos").collect()
    assert "".join(r["text"] for r in rows if r["doc_id"] == 1) == text
    assert [r["category"] for r in rows if r["doc_id"] == 1] == ["front_matter", "abstract", "introduction", "method", "references"]
    cut = sections.without_back_matter(spark.createDataFrame(rows)).where("doc_id = 1").first()
    assert cut["body"] == text and cut["truncated"]
    assert sections.markdown_sections("# T\n\n## 1. Methods\na\n### Deep\nb\n## References\nc\n## Odd\nd") == [("method", "a\nb"), ("body", "d")]


def test_versions_and_diffs(spark):
    rows = spark.createDataFrame([("p", 1, 5), ("p", 3, 7), ("p", 2, 6), ("q", 1, 1), ("r", 2, 1), ("r", 3, 1)], "paper string, version int, n int")
    assert [tuple(r) for r in corpus.version_pairs(rows, "paper", "version", ["n"]).select("paper", "first_n", "last_n", "latest").collect()] == [("p", 5, 7, 3)]
    assert compare.hunks_of("a\nb\nc\nd", "a\nx\nc\nd") == [("replace", 1, ["b"], ["x"], ["a"], ["c", "d"])]


def test_vectors(spark):
    rows = vectors.unit_vectors(spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 1.0], 0), (3, [0.0, 2.0], 1)], "vec_id long, embedding array<double>, label int"))
    t = {r["vec_id"]: r["typicality"] for r in vectors.typicality(rows).collect()}
    assert t[1] == pytest.approx((0.5**0.5 + 0) / 2)
    near = {(r["query"], r["vec_id"]) for r in vectors.nearest(rows, rows, 1).collect()}
    assert near == {(1, 2), (2, 1), (3, 2)}
    c = {(r["label_a"], r["label_b"]): r["mean_cosine"] for r in vectors.cohesion(rows).collect()}
    assert c[0, 0] == pytest.approx(0.5**0.5) and c[0, 1] == pytest.approx(0.5**0.5 / 2) and c[1, 1] is None


def test_preferences(spark):
    rows = spark.createDataFrame([("p", "a", "b", -2), ("p", "a", "b", 0), ("p", "c", "d", 1)], "prompt string, response1 string, response2 string, strength int")
    assert [(r["chosen"], r["rejected"], r["strength"]) for r in preferences.oriented(rows).collect()] == [("a", "b", 2), ("d", "c", 1)]
    pairs = spark.createDataFrame([("x rather than y", "x"), ("x", "x rather than z"), ("rather than", "rather than")], "chosen string, rejected string")
    assert {r["pattern_id"]: (r["only_chosen"], r["only_rejected"]) for r in preferences.discordance(pairs).collect()}["rather_than"] == (1, 1)
    scores = spark.createDataFrame([("m", "1", 2.0, 1.0, 1.5)], "model string, item_id string, original double, deleted double, control double")
    assert tuple(preferences.contrasts(scores).first()) == ("m", 1, 1.0, 0.5, 0.5)


def test_services_go_on_after_a_failure(spark):
    def scorer(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["text"] == "bad").any():
            raise ValueError("no")
        return pd.DataFrame({"item_id": batch["item_id"], "x": batch["text"].str.len().astype(float)})

    items = spark.createDataFrame([("1", "ab", "private"), ("2", "bad", "p"), ("3", "abc", "p"), ("4", "done", "p")], "item_id string, text string, author string")
    done = spark.createDataFrame([("4",)], "item_id string")
    got = {r["item_id"]: (r["x"], r["error"]) for r in services.scored(items, "item_id", ["text"], scorer, "item_id string, x double", done).collect()}
    assert got["1"] == (2.0, None) and got["3"] == (3.0, None) and got["2"][1] == "ValueError: no" and "4" not in got


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", 7, "a", 1.0), (2, "2024-01-01 00:05:00", 7, "a", 2.0), (2, "2024-01-01 00:05:00", 7, "a", 2.0), (3, "2024-01-01 00:03:00", 8, "b", 3.0)], "event_id long, t string, user_id long, event_type string, value double")
    rows.select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type", "value", F.lit("{}").alias("props")).write.parquet(str(tmp_path / "in"))
    q = stream.upsert_latest(stream.without_repeats(stream.event_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"), ["user_id", "event_type"], ["ts", "event_id"], ["value"])
    q.awaitTermination(60)
    last = sorted((tmp_path / "out").glob("v=*"), key=lambda p: int(p.name[2:]))[-1]
    assert {(r["user_id"], r["value"]) for r in spark.read.parquet(str(last)).collect()} == {(7, 2.0), (8, 3.0)}


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 9
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80
