"""Queries over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tropelens.operators import vectors
from tropelens.plans.base import query, rounded
from tropelens.plans.demo import table

UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"


def units(spark, d):
    return vectors.unit_vectors(table(spark, d, "embeddings"))


@query("cosine_seed_max", f"WITH {UNIT}, s AS (SELECT u.vec_id, list_dot_product(u.v, q.v) AS sim, q.vec_id AS seed FROM u, u q WHERE q.vec_id % 100 = 0) SELECT vec_id, round(max(sim), 6) AS similarity FROM s GROUP BY vec_id")
def cosine_seed_max(spark, d):
    rows = units(spark, d)
    return rounded(vectors.seed_similarity(rows, rows.where("vec_id % 100 = 0")).select("vec_id", "similarity"))


@query("vector_typicality", f"WITH {UNIT}, s AS (SELECT a.vec_id, sum(list_dot_product(a.v, b.v)) AS total, count(*) AS n FROM u a JOIN u b ON a.vec_id <> b.vec_id GROUP BY a.vec_id) SELECT vec_id, round(total / n, 6) AS typicality FROM s")
def vector_typicality(spark, d):
    return rounded(vectors.typicality(units(spark, d)))


@query("label_cohesion", f"WITH {UNIT} SELECT a.label::BIGINT AS label_a, b.label::BIGINT AS label_b, round(avg(list_dot_product(a.v, b.v)), 6) AS mean_cosine FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.label <= b.label GROUP BY ALL")
def label_cohesion(spark, d):
    return rounded(vectors.cohesion(units(spark, d)))


KNN = f"WITH {UNIT}, s AS (SELECT q.vec_id AS query, q.label AS ql, b.vec_id, b.label, round(list_dot_product(q.v, b.v), 9) AS sim FROM u q JOIN u b ON q.vec_id <> b.vec_id WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) AS rank FROM s)"
#: The same for every vector as a query.
KNN_ALL = f"WITH {UNIT}, s AS (SELECT q.vec_id AS query, q.label AS ql, b.vec_id, b.label, round(list_dot_product(q.v, b.v), 9) AS sim FROM u q JOIN u b ON q.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) AS rank FROM s)"


@query("knn_neighbours", f"{KNN} SELECT query, vec_id, rank::BIGINT AS rank, round(sim, 6) AS similarity FROM r WHERE rank <= 5")
def knn_neighbours(spark, d):
    rows = units(spark, d)
    return rounded(vectors.nearest(rows, rows.where("vec_id % 100 = 0"), 5))


@query("knn_label_share", f"{KNN_ALL} SELECT query, round(avg((ql = label)::INT), 6) AS share FROM r WHERE rank <= 5 GROUP BY query")
def knn_label_share(spark, d):
    """Share of each vector's neighbours with its own label."""
    rows = units(spark, d)
    labels = rows.select("vec_id", "label")
    found = vectors.all_nearest(rows, 5).join(labels, "vec_id")
    found = found.join(labels.select(F.col("vec_id").alias("query"), F.col("label").alias("own")), "query")
    return rounded(found.groupBy("query").agg(F.avg((F.col("own") == F.col("label")).cast("int")).alias("share")))


@query("label_centroids", "SELECT label::BIGINT AS label, count(*)::BIGINT AS n, round(avg(embedding[1]::DOUBLE), 6) AS first FROM embeddings GROUP BY label")
def label_centroids(spark, d):
    sums = vectors.centroid_sums(table(spark, d, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double"))), ["label"])
    return rounded(sums.select("label", "n", (F.col("total")[0] / F.col("n")).alias("first")))
