"""Plain readers and writers."""

import gzip
import json

from pyspark.sql import functions as F

from tropelens.functions import text as tx
from tropelens.operators import corpus, preferences
from tropelens.sources import readers, writers


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1, "t": "x"}\n{"k": 2}\n')
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"k": 3, "t": "é"}\n')
    got = {(r["k"], r["t"]) for r in readers.json_lines(spark, str(tmp_path / "*.jsonl*"), "k int, t string").collect()}
    assert got == {(1, "x"), (2, None), (3, "é")}
    out = str(tmp_path / "out")
    writers.json_lines(spark.createDataFrame([(1, None), (2, "y")], "k int, t string"), out, "gzip")
    lines = [json.loads(x) for p in (tmp_path / "out").glob("*.json.gz") for x in gzip.open(p, "rt")]
    assert sorted(lines, key=lambda r: r["k"]) == [{"k": 1}, {"k": 2, "t": "y"}]


def test_comma_separated(spark, tmp_path):
    (tmp_path / "a.csv").write_text('word,type\n"a, b",style\nc,"say ""x"""\n')
    assert {tuple(r) for r in readers.csv(spark, str(tmp_path / "a.csv"), "word string, type string").collect()} == {("a, b", "style"), ("c", 'say "x"')}


def test_repository_walk(spark, tmp_path):
    for name, data in {"a.py": b"x = 1\n", "b/a copy.py": b"x = 1\n", "b/bin.py": b"a\x00b", "b/wide.bin": "a".encode("utf-16-le"), ".git/c.py": b"y", "b/min.js": b"z" * 900, "big.py": b"# a line\n" * 400, "latin.txt": "caf\xe9\n".encode("latin-1")}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["path"].split("/")[-1]: r for r in readers.repository_files(spark, str(tmp_path), 2000).collect()}
    assert set(got) == {"a.py", "latin.txt"} and got["a.py"]["bytes"] == 6 and got["latin.txt"]["text"] == "caf�\n"


def test_pools_registries_and_private_columns(spark, tmp_path):
    pool = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    out = writers.redraw(pool, spark.createDataFrame([("a",), ("z",)], "id string"), spark.createDataFrame([("c",)], "id string"), "id")
    assert {tuple(r) for r in out.collect()} == {("b", 2), ("c", None)}
    writers.split_private(pool, ["n"], str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s/private")).columns == ["id", "n"] and spark.read.parquet(str(tmp_path / "s/public")).columns == ["id"]
    path = str(tmp_path / "registry")
    for batch in ("one", "two"):
        writers.append_registry(spark.createDataFrame([(batch, "acl", "d" + batch)], readers.REGISTRY), path)
    rows = readers.tab_separated(spark, path, readers.REGISTRY, header=False)
    assert {tuple(r) for r in rows.collect()} == {("one", "acl", "done"), ("two", "acl", "dtwo")}


def test_wide_sentence_ends_and_neighbours(spark):
    text = spark.createDataFrame([("One. [Two] is. (Three) x. four. Five",)], "t string")
    assert text.select(tx.sentences(F.col("t"), tx.SENTENCE_END_WIDE)).first()[0] == ["One.", "[Two] is.", "(Three) x. four.", "Five"]
    assert text.select(tx.sentences(F.col("t"))).first()[0] == ["One. [Two] is. (Three) x. four.", "Five"]
    rows = spark.createDataFrame([("d", k, f"s{k}") for k in range(5)] + [("e", 0, "only")], "doc string, pos int, s string")
    got = {(r["doc"], r["pos"]): (r["before"], r["after"]) for r in corpus.neighbours(rows, "doc", "pos", "s", 2).collect()}
    assert got["d", 2] == (["s0", "s1"], ["s3", "s4"]) and got["d", 0] == ([], ["s1", "s2"]) and got["e", 0] == ([], [])


def test_ratings_that_are_numbers(spark):
    schema = "p int, completions array<struct<response string, annotations map<string, struct<Rating string>>>>"
    good, bad, lacking = ("r1", {"h": ("4",), "t": ("3.5",)}), ("r2", {"h": ("N/A",), "t": ("3",)}), ("r3", {"h": ("4",)})
    rows = preferences.rated(spark.createDataFrame([(1, [good, bad, lacking]), (2, []), (3, None)], schema), ["h", "t"]).collect()
    assert [(r["p"], r["at"], r["response"], r["h"], r["t"]) for r in rows] == [(1, 0, "r1", 4.0, 3.5)]
