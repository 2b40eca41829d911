"""Validating readers, atomic replacement, labels as stream state."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tropelens.sources import readers, records, snapshots
from tropelens.streaming import labels


def record(i="2019.test-1.1", **more):
    return {"doc_id": i, "title": "Seed title", "sections": [{"category": "abstract", "text": " Seed abstract "}, {"category": "body", "text": "b"}]} | more


def written(path, rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    return str(path)


def ids(rows):
    return [r["doc_id"] for r in rows.collect()]


def test_seed_records(spark, tmp_path):
    path = written(tmp_path / "a.jsonl", [record("missing-title", title=" "), record("no-abstract", sections=[]), record("", title="Present"), "null", record(), record(), record("last"), "{broken json"])
    valid, rejected = records.seed_records(spark, path)
    assert [tuple(r) for r in valid.collect()] == [("2019.test-1.1", "Seed title", "Seed abstract"), ("last", "Seed title", "Seed abstract")]
    got = {r["line"]: r["reason"] for r in rejected.collect()}
    assert got == {1: "missing title", 2: "missing abstract", 3: "missing id", 4: "not a JSON object", 6: "repeated id", 8: "not a JSON object"}


def test_limit_counts_valid_records(spark, tmp_path):
    path = written(tmp_path / "a.jsonl", [record("bad", sections=[]), record("a"), record("a"), record("b"), record("c")])
    assert ids(records.seed_records(spark, path, limit=2)[0]) == ["a", "b"]
    with pytest.raises(ValueError):
        records.seed_records(spark, path, limit=0)


def test_ids_names_and_choices(spark, tmp_path):
    rows = [record("x", title=None), record("x"), record("Ab"), record("aB"), record("z" * 300), record(7), record("n", sections="no"), record("two", sections=[{"category": "abstract", "text": "p"}, {"category": "abstract", "text": " q"}, 5, {"category": "abstract", "text": 3}]), "", record("e1"), record("E1", title="")]
    path = written(tmp_path / "a.jsonl", rows)
    valid, rejected = records.seed_records(spark, path)
    assert ids(valid) == ["Ab", "two", "e1"] and valid.where("doc_id = 'two'").first()["abstract"] == "p\n\nq"
    assert {r["line"]: r["reason"] for r in rejected.collect()} == {
        1: "missing title", 2: "repeated id", 4: "repeated file name", 5: "id too long for a file name", 6: "missing id", 7: "sections are no list", 9: "not a JSON object", 11: "repeated file name",
    }
    out = spark.createDataFrame([("Ab",), ("gone",), (None,)], "id string")
    valid, rejected = records.seed_records(spark, path, exclude=out)
    assert ids(valid) == ["aB", "two", "e1"] and 3 not in {r["line"] for r in rejected.collect()}
    assert ids(records.seed_records(spark, path, only=["e1", "two", "nowhere"])[0]) == ["two", "e1"]
    assert ids(records.seed_records(spark, path, only=[])[0]) == []
    with pytest.raises(ValueError):
        records.seed_records(spark, path, exclude=out, only=["Ab"])


def test_lines_are_numbered_over_splits_and_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [f"line {k} " + "x" * (k % 90) for k in range(3000)]
    (tmp_path / "in/b.txt").write_text("\n".join(lines))
    with gzip.open(tmp_path / "in/a.txt.gz", "wt") as f:
        f.write("\n".join(lines[:500]))
    (tmp_path / "in/c.txt").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = records.numbered_lines(spark, str(tmp_path / "in")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {(r["file"].rsplit("/", 1)[1], r["line"]): r["value"] for r in rows}
    assert len(rows) == 3500 and got == {("b.txt", k + 1): x for k, x in enumerate(lines)} | {("a.txt.gz", k + 1): x for k, x in enumerate(lines[:500])}


def test_an_invalid_record_takes_its_id(spark, tmp_path):
    path = written(tmp_path / "x.jsonl", [{"doc_id": "a", "sections": []}, {"doc_id": "a", "title": "t"}, {"doc_id": "b", "title": "t", "n_references": 3}, {"doc_id": "B", "title": "t"}])
    valid, rejected = readers.valid_records(spark, path)
    assert [(r["doc_id"], r["n_references"]) for r in valid.collect()] == [("b", 3)]
    assert {r["line"]: r["reason"] for r in rejected.collect()} == {1: "missing title", 2: "repeated id", 4: "repeated file name"}


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, text string")


def test_replacement_is_atomic(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, root)
    assert snapshots.replace_texts(table(spark, [("a", "1"), ("b", "2"), ("c", "3"), ("n", None)]), root)["added"] == 3
    got = snapshots.replace_texts(table(spark, [("a", "one"), ("b", "2"), ("c", " "), ("d", "4"), ("e", None)]), root)
    assert got == {"added": 1, "changed": 1, "unchanged": 1, "failed": 2, "untouched": 0}
    want = {("a", "one"), ("b", "2"), ("c", "3"), ("d", "4")}
    assert {tuple(r) for r in snapshots.read(spark, root).collect()} == want
    was = snapshots.current(spark, root)
    assert snapshots.replace_texts(table(spark, [("a", "one")]), root)["untouched"] == 3 and snapshots.current(spark, root) == was  # nothing to write
    broken = snapshots.read(spark, root).withColumn("text", F.when(F.col("doc_id") == "d", F.raise_error(F.lit("half-way"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="half-way"):
        snapshots.publish(broken, root)
    assert snapshots.current(spark, root) == was and {tuple(r) for r in snapshots.read(spark, root).collect()} == want
    with pytest.raises(ValueError):
        snapshots.replace_texts(table(spark, [("a", "1"), ("a", "2")]), root)
    open_reader = snapshots.read(spark, root)
    snapshots.publish(snapshots.read(spark, root).withColumn("text", F.upper("text")), root, keep=2)
    assert {tuple(r) for r in open_reader.collect()} == want and snapshots.read(spark, root).where("text = 'ONE'").count() == 1
    snapshots.publish(snapshots.read(spark, root), root, keep=1)
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v=")]) == 1


def test_gzip_files_are_rewritten(spark, tmp_path):
    root = str(tmp_path / "g")
    snapshots.publish(table(spark, [("a", "1")]), root, "json", compression="gzip")
    rows = snapshots.read(spark, root, "json", "doc_id string, text string").withColumn("title", F.lit("t"))
    version = snapshots.publish(rows, root, "json", compression="gzip")
    files = list((tmp_path / "g" / version).glob("*.json.gz"))
    assert files and json.loads(gzip.open(files[0], "rt").readline()) == {"doc_id": "a", "text": "1", "title": "t"}


SCHEMA = "rater string, item long, ts timestamp, n long, label string"


def test_stream_writes_changed_keys_only(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "ck"))

    def batch(rows):
        frame = spark.createDataFrame(rows, "rater string, item long, m int, n long, label string").withColumn("ts", F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, m, 0)"))
        frame.select("rater", "item", "ts", "n", "label").write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = labels.follow(labels.latest_changes(stream, ["rater", "item"], "ts", "n", ["label"], late="1 hour", forget="10 hours"), target, checkpoint)
        query.awaitTermination(120)
        assert query.exception() is None
        return {(r["rater"], r["item"], r["label"]) for r in spark.read.parquet(target).collect()}

    one = batch([("A", 1, 1, 1, "x"), ("A", 1, 3, 2, "y"), ("A", 1, 2, 3, "old"), ("B", 1, 1, 4, "z"), ("B", 2, 1, 5, None), (None, 2, 1, 6, "none")])
    assert one == {("A", 1, "y"), ("B", 1, "z"), ("B", 2, None)}
    two = batch([("A", 1, 2, 9, "late"), ("B", 1, 1, 10, "tie wins"), ("C", 1, 5, 11, "new")])  # a restart: state comes back
    assert two - one == {("B", 1, "tie wins"), ("C", 1, "new")}
    latest = labels.latest_of(spark.read.parquet(target), ["rater", "item"], "ts", "n")
    assert {(r["rater"], r["item"], r["label"]) for r in latest.collect()} == {("A", 1, "y"), ("B", 1, "tie wins"), ("B", 2, None), ("C", 1, "new")}
    three = batch([("A", 1, 3000, 20, "much later")])
    assert three - two == {("A", 1, "much later")}
    assert batch([("B", 1, 3001, 21, "after it was forgotten")]) - three == {("B", 1, "after it was forgotten")}
