"""Rows that every operator must stand: nulls, empty, blank and long texts, ties, repeated rows, clashing extra columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, component_id long, n_words long, text_2 string"


def prose(rng, n, words=None):
    words = words or [a + b + c for a in "bdfgk" for b in "aeiou" for c in ("n", "st", "rm", "lo")]
    return " ".join(rng.choice(words) for _ in range(n))


def docs(spark):
    """(DataFrame, rows) with hard cases."""
    rng = random.Random(3)
    base = [prose(rng, rng.randint(60, 140)) for _ in range(12)]
    rows = [(i, t, ("en", "fr")[i % 2], f"s{i % 3}") for i, t in enumerate(base)]
    near = base[0].split()
    near[40] = "changed"
    rows += [
        (20, base[0], "en", "s0"),
        (21, " ".join(near), "en", "s1"),
        (22, base[1].upper(), None, None),
        (23, None, "en", "s0"),
        (24, "", None, "s2"),
        (25, " \t\n\x0b ", "fr", None),
        (26, "one two", "en", "s1"),
        (27, "one two", "en", "s1"),
        (28, " ".join([prose(rng, 20_000), "mit license", prose(rng, 20)]), "en", "s0"),
        (5, base[5], "fr", "s2"),
        (5, base[5], "fr", "s2"),
        (None, base[2], "en", "s0"),
        (30, "é" * 5000 + " naïve word \U0001f600", "fr", "s0"),
    ]
    full = [(i, t, lang, s, len(t or ""), 7.0, None, -1, -2, "x") for i, t, lang, s in rows]
    return spark.createDataFrame(full, DOCS).repartition(3), rows


def empty(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")
