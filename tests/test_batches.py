"""Work in bounded pieces gives what whole batches give."""

import numpy as np
import pandas as pd

from tropelens.operators import vectors


def test_nearest_in_pieces(spark):
    """Pieces of one and of many rows, with equal vectors, against all similarities sorted."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 4))
    v[10:25] = v[3]
    v[40:44] = v[20] = v[0]
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(60)], "vec_id long, embedding array<double>").repartition(3)
    want = {}
    for q in range(0, 60, 3):
        want[q] = sorted((-round(float(v[q] @ v[i]), 9), i) for i in range(60) if i != q)[:5]
    for cells in (1, 7 * 20, 1 << 20):
        got = vectors.nearest(rows, rows.where("vec_id % 3 = 0"), 5, block=20, cells=cells).toPandas()
        for q, g in got.groupby("query"):
            assert list(g.sort_values("rank")["vec_id"]) == [i for _, i in want[q]], (cells, q)
        assert len(got) == 5 * len(want)


def test_best_of():
    at, keys, sims = vectors.best_of(np.array([1, 0, 1, 1, 0]), np.array([9, 8, 7, 6, 5]), np.array([0.5, 0.1, 0.5, 0.9, 0.1]), 2)
    assert list(zip(at.tolist(), keys.tolist(), sims.tolist(), strict=True)) == [(0, 5, 0.1), (0, 8, 0.1), (1, 6, 0.9), (1, 7, 0.5)]
    assert pd.Series(at).is_monotonic_increasing


def test_pieces_are_bounded():
    """Every row once and in order; a piece has one row or at most so many characters."""
    from tropelens.functions.batches import pieces

    batch = pd.DataFrame({"k": range(7), "t": ["aaaa", None, "bb", "c" * 50, "", "dddd", "ee"], "u": ["", "x", "yy", None, "", "", "z"]})
    got = list(pieces(batch, ["t", "u"], 8))
    assert [k for p in got for k in p["k"]] == list(range(7))
    assert [list(p["k"]) for p in got] == [[0, 1], [2], [3], [4, 5, 6]]
    assert list(pieces(batch.iloc[:0], ["t", "u"])) == []


def test_large_batch_is_returned_in_pieces(spark, monkeypatch):
    """What a task makes of one batch comes out in several frames, with the same rows."""
    from tropelens.operators import corpus

    made = []
    frame = spark.createDataFrame([(0, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(frame), "mapInPandas", lambda self, run, schema: made.append(run))
    corpus.sentence_rows(frame)
    out = list(made[0](iter([pd.DataFrame({"doc_id": range(400), "__t": ["One is here. Two is there. " * 400] * 400})])))
    assert len(out) > 3 and sum(map(len, out)) == 400 * 800


def test_all_nearest_in_blocks_and_parts(spark):
    """Blocks and parts of any size, with many equal vectors and nulls, against all similarities sorted."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(150, 6))
    v[10:60] = v[3]
    v[90:95] = v[20] = v[0]
    v[100:110] = v[3] + 1e-8 * rng.normal(size=(10, 6))
    v /= np.linalg.norm(v, axis=1)[:, None]
    ids = rng.permutation(150) * 7
    rows = spark.createDataFrame([(int(i), [float(x) for x in u]) for i, u in zip(ids, v, strict=True)] + [(9999, None)], "vec_id long, embedding array<double>").repartition(3)
    want = {(int(ids[q]), int(i), r) for q in range(150) for r, (_, i) in enumerate(sorted((-round(float(v[q] @ v[o]), 9), ids[o]) for o in range(150) if o != q)[:5], 1)}
    for block, few, most in ((1024, 1 << 16, 1 << 18), (16, 40, 64), (7, 30, 150), (64, 150, 20)):
        got = vectors.all_nearest(rows, 5, block=block, few=few, most=most).collect()
        assert len(got) == len(want) and {(r["query"], r["vec_id"], r["rank"]) for r in got} == want, block
    assert {(r["query"], r["vec_id"], r["rank"]) for r in vectors.all_nearest(rows.where("vec_id < 21"), 5).collect()} == {(r["query"], r["vec_id"], r["rank"]) for r in vectors.nearest(rows.where("vec_id < 21"), rows.where("vec_id < 21"), 5).collect()}
    assert vectors.all_nearest(rows.limit(0), 5).count() == 0


def test_knn_label_share_asks_for_every_vector(spark, tmp_path):
    import duckdb

    from tropelens.plans import vector_queries  # noqa: F401
    from tropelens.plans.base import QUERIES, SQL

    rng = np.random.default_rng(7)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)], i % 3) for i in range(130)], "vec_id long, embedding array<float>, label int")
    rows.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = {(r["query"], r["share"]) for r in QUERIES["knn_label_share"](spark, str(tmp_path)).collect()}
    assert got == set(con.sql(SQL["knn_label_share"]).fetchall()) and len(got) == 130


def test_knn_permutation_asks_for_every_vector(spark, tmp_path):
    """Vectors of all numbers, but those divisible by 100, share labels with their neighbours."""
    import duckdb

    from tropelens.plans import item_queries  # noqa: F401
    from tropelens.plans.base import QUERIES, SQL

    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4) / 9 + np.eye(4)[i % 4]], i % 4 if i % 100 else 9) for i in range(120)], "vec_id long, embedding array<float>, label int")
    rows.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = QUERIES["knn_permutation"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == con.sql(SQL["knn_permutation"]).fetchall() and got[0]["observed"] > 0.9
