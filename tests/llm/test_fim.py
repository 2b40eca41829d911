"""Fill-in-middle: against plain Python, DuckDB and round trips."""

import hashlib
import re
from collections import Counter

from helpers import docs, empty
from pyspark.sql import functions as F
from test_native import same_as_sql

from tropelens.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(i, text, seed=42, rate=50, spm_rate=80):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return i, len(units), "plain", None, None, text, text
    spm = h[3] % 100 < spm_rate
    return i, len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}", text


def test_every_text_is_cut_and_restored(spark):
    table, rows = docs(spark)
    more = [(100 + k, t, "en", "s") for k, t in enumerate(["a <P> b", "<S>", "<M", "P> <S <M ", "< P>", " \n", "x", "x ", " x", "a\x0bb\x1cc\xa0d", "\U0001f600 é b \t", "<" * 50, ">S> <M"] * 9)]
    table = table.union(spark.createDataFrame([(*r, 0, 1.0, None, 1, 1, "") for r in more], table.schema))
    for options in ({}, {"seed": 7, "rate": 100, "spm_rate": 50}):
        got = fim.fill_in_middle(table, **options).withColumn("restored", fim.restored(F.col("output"), F.col("form")))
        assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
        got = Counter(map(tuple, got.collect()))
        assert got == Counter(plainly(i, t, **options) for i, t, *_ in rows + more)
        assert {r[2] for r in got} == {"plain", "spm", "psm"}
    assert fim.fill_in_middle(empty(spark)).count() == 0


def test_the_query_agrees_with_its_sql(spark, tmp_path):
    table, _ = docs(spark)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    same_as_sql(fim.query(spark, str(tmp_path)), fim.SQL, table)


def test_no_shuffle(spark):
    table, _ = docs(spark)
    plan = fim.fill_in_middle(table.coalesce(1).select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange") <= 1  # the fixture's own repartition
