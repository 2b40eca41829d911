"""Quality rules, mixing, line dedup: DataFrame functions, checked against plain Python and DuckDB."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
from helpers import docs, empty

from tropelens.llm import line_dedup, mixing, quality_rules


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def same_as_sql(df, sql, table):
    con = duckdb.connect()
    con.register("documents", table.toPandas().astype({"doc_id": "Int64"}))
    want = con.sql(sql).df()
    got = df.toPandas()[list(want.columns)]

    def plain(v):
        return "null" if pd.isna(v) else str(v) if isinstance(v, (bool, np.bool_, str)) else round(float(v), 6)

    def key(f):
        return Counter(tuple(map(plain, r)) for r in f.astype(object).itertuples(index=False))

    assert key(got) == key(want)


def test_measures(spark):
    table, rows = docs(spark)
    more = [(60, "a b a b a b c\nx # $\n\nx # $ \nx # $", "en", "s0"), (61, "q q q q", None, "s9"), (62, "a b c a b", "en", "s9")]
    table = table.union(spark.createDataFrame([(*r, 0, 1.0, None, 1, 1, "") for r in more], table.schema))
    got = quality_rules.quality_rules(table)

    def want(i, t):
        w, body = words(t), t or ""
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(grams)
        covered = {k + s for k, g in enumerate(grams) if n[g] > 1 for s in range(3)}
        lines = [x for x in body.split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        return i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in body), len(lines) - len(set(lines)), len(covered), failed

    got_rows = got.collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in got_rows) == Counter(want(i, t) for i, t, *_ in rows + more)
    assert all(not r["kept"] for r in got_rows if r["base_failed"])
    same_as_sql(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"), quality_rules.SQL, table)
    assert quality_rules.quality_rules(empty(spark)).count() == 0


def test_bad_host_is_blocked(spark):
    good = " ".join(f"w{k}" for k in range(60))
    rows = [(k, good + f" x{k}", "good") for k in range(30)] + [(100 + k, "bad " * (60 if k % 10 else 1) + "x", "bad") for k in range(29)] + [(199, good, "bad"), (200, "short", "tiny"), (201, good, "tiny")]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[k] for k in range(30)) and not got[199] and not got[200]


def test_mixing(spark):
    table, rows = docs(spark)
    got = mixing.mix_counts(table, bin_rows=2).cache()
    by = defaultdict(list)
    for r in got.collect():
        by[r["source"]].append(r)
    total = sum(len(words(t)) for _, t, *_ in rows)
    names = sorted((s for s in by if s is not None)) + [None] * (None in by)
    size = {s: sum(r["size"] for r in by[s]) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, capped = {}, set()
    while True:  # reshare until none is above
        left = total - sum(3 * size[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * size[s] if s in capped else left * weight[s] / share for s in names}
        above = {s for s in names if s not in capped and target[s] > 3 * size[s]}
        if not above:
            break
        capped |= above
    for s in names:
        assert all(abs(r["target"] - target[s]) < 1e-6 and r["source_size"] == size[s] for r in by[s])
        assert all(r["taken"] == r["copies"] * r["size"] and r["taken"] <= 3 * r["size"] for r in by[s])
        assert abs(sum(r["taken"] for r in by[s]) - target[s]) <= 1.2 * max(r["size"] for r in by[s]) + 1e-6
    again = mixing.mix_counts(table.repartition(5))
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    assert Counter(map(tuple, again.select(cols).collect())) == Counter(map(tuple, got.select(cols).collect()))
    same_as_sql(got.select(cols), mixing.SQL, table)
    assert mixing.mix_counts(empty(spark)).count() == 0


def test_line_dedup(spark):
    table, rows = docs(spark)
    more = [(500 + k, f"Cookie notice \nbody {k} x\n\n Cookie notice\nend {k}", "en", "big") for k in range(8)] + [(600 + k, "same page\nagain", "en", "big") for k in range(30)] + [(700, "Cookie notice", "en", "big")]
    table = table.union(spark.createDataFrame([(*r, 0, 1.0, None, 1, 1, "") for r in more], table.schema))
    out = line_dedup.line_dedup(table)
    got = out.collect()
    assert len(got) == len(rows) + len(more)
    text = {r["doc_id"]: r["text"] for r in got}
    assert text[503] == "body 3 x\n\nend 3" and text[600] == "same page\nagain" and text[700] == "" and text[23] is None and text[24] == ""
    assert {r["doc_id"]: r["n_dropped"] for r in got}[500] == 2
    same_as_sql(out.select("doc_id", "n_lines", "n_dropped", "text"), line_dedup.SQL, table)
    assert line_dedup.line_dedup(empty(spark)).count() == 0
