"""Quality classifier by co-training a text view and a page-metadata view."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tropelens.llm.common import written
from tropelens.llm.language import fold

#: Bounds of what is fitted: labelled documents of either label, documents that one view tells the other of each label in
#: a round, characters of one labelled document.
TRAIN_DOCS, TOLD_DOCS, TRAIN_CHARS = 1_500, 300, 100_000
GRAMS, TEXT_PLAIN, META_DIM, META_PLAIN = 2048, 10, 64, 12
TEXT_DIM = GRAMS + TEXT_PLAIN
CHUNK = 1 << 20


def text_view(text: bytes) -> np.ndarray:
    """The content, whatever its length: square roots of the shares of hashed byte 2- and 3-grams, then shares of kinds of
    characters, the length and variety of words, and the entropy of their first bytes."""
    total = np.zeros(GRAMS, dtype=np.int64)
    data = np.frombuffer(text, dtype=np.uint8)
    with np.errstate(over="ignore"):
        for k in range(0, max(1, len(data) - 2), CHUNK):
            b = data[k : k + CHUNK + 2].astype(np.uint32)
            two = b[:-1] * np.uint32(256) + b[1:]
            three = two[:-1] * np.uint32(256) + b[2:]
            for gram in (two, three):
                total += np.bincount((gram * np.uint32(2654435761)) >> np.uint32(21), minlength=GRAMS)
    c, words = np.bincount(data, minlength=256) / max(1, len(data)), text.split()
    first = np.bincount(np.frombuffer(b"".join([w[:1] for w in words]), dtype=np.uint8), minlength=256) / max(1, len(words))
    first = first[first > 0]
    plain = [
        min(len(text) / max(1, len(words)), 30) / 10,
        len(set(words)) / max(1, len(words)),
        5 * c[65:91].sum(),
        5 * c[48:58].sum(),
        5 * (c[33:39].sum() + c[42] + c[60:63].sum() + c[124]),
        5 * (c[44] + c[46]),
        c[97:123].sum(),
        c[128:].sum(),
        c[32] * 5,
        -(first * np.log(first)).sum() / 3 if len(first) else 0.0,
    ]
    return np.concatenate([np.sqrt(total / max(1, total.sum())), plain]).astype(np.float32)


def slot(kind: str, value: str | None) -> int:
    import xxhash

    return META_PLAIN + xxhash.xxh3_64_intdigest(f"{kind}:{value}") % (META_DIM - META_PLAIN)


def meta_view(text: bytes, lang: str | None, source: str | None) -> np.ndarray:
    """What is known of the page beside its wording: source, language, length and layout (lines only, no words or letters)."""
    out = np.zeros(META_DIM, dtype=np.float32)
    lines = text.split(b"\n")
    sizes = np.array([len(x) for x in lines], dtype=float)
    blank = sum(not x.strip() for x in lines) / len(lines)
    plain = [
        np.log1p(len(text)) / 10,
        np.log1p(len(lines)) / 5,
        np.log1p(sizes.mean()) / 8,
        np.log1p(sizes.std()) / 8,
        np.log1p(sizes.max()) / 10,
        np.log1p(sizes.min()) / 8,
        len(set(lines)) / len(lines),
        blank,
        float((sizes < 40).mean()),
        float(sum(x[:1] in (b" ", b"\t") for x in lines) / len(lines)),
        float(len(lines) == 1),
        float(len(text) == 0),
    ]
    out[:META_PLAIN] = plain
    out[slot("lang", lang)] = out[slot("source", source)] = 0.3
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 120, rate: float = 0.1, l2: float = 1e-4) -> np.ndarray:
    """Logistic regression by Adam over all rows at once; the last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x), dtype=np.float32)])
    w, m, v = (np.zeros(x.shape[1], dtype=np.float32) for _ in range(3))
    scale = weight.sum()
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = ((p - y) * weight) @ x / scale + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
    return w


def logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Calibration: weighted logistic regression of the label on one view's logit, or on the calibrated views'."""
    x = np.column_stack([np.ones(len(z)), z])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
    return w


class CoTrained:
    """Two views' classifiers, what each has been told by the other, their calibration and the combination."""

    def __init__(self, views: list[np.ndarray], y: np.ndarray, share: float):
        """share: the share of label 1 among all labelled documents (the sample has the labels evenly)."""
        ones = max(1, int(y.sum()))
        self.views, self.y = views, y
        self.weight = np.where(y == 1, share / ones, (1 - share) / max(1, len(y) - ones)) * len(y)
        self.test = np.arange(len(y)) % 4 == 0  # kept for calibration
        self.told: list[dict[int, tuple[int, np.ndarray]]] = [{}, {}]  # per view: text hash -> (label, features)
        self.sure = np.zeros((2, 2), dtype=np.int64)  # documents that a view was sure of in the last round, by label
        self.refit()

    def refit(self) -> None:
        self.weights = []
        for x, told in zip(self.views, self.told, strict=True):
            extra = [told[h] for h in sorted(told)]
            xs = np.concatenate([x[~self.test], *(f[None] for _, f in extra)])
            ys = np.concatenate([self.y[~self.test], np.array([label for label, _ in extra], dtype=float)])
            self.weights.append(fit(xs, ys, np.concatenate([np.ones((~self.test).sum()), np.full(len(extra), 0.5)])))
        z = [logit(x[self.test], w) for x, w in zip(self.views, self.weights, strict=True)]
        y, weight = self.y[self.test], self.weight[self.test]
        self.scales = [platt(v[:, None], y, weight) for v in z]
        self.final = platt(np.column_stack([s[0] + s[1] * v for s, v in zip(self.scales, z, strict=True)]), y, weight)

    def scorer(self) -> "Scorer":
        return Scorer(self.weights, self.scales, self.final)


class Scorer:
    """What the executors need: each view's weights and scale, and the combination."""

    def __init__(self, weights: list[np.ndarray], scales: list[np.ndarray], final: np.ndarray):
        self.weights, self.scales, self.final = weights, scales, final

    def each(self, views: list[np.ndarray]) -> list[np.ndarray]:
        """Either view's own probability of label 1, labels taken as equally frequent."""
        return [1 / (1 + np.exp(-logit(x, w))) for x, w in zip(views, self.weights, strict=True)]

    def score(self, views: list[np.ndarray]) -> np.ndarray:
        both = np.column_stack([s[0] + s[1] * logit(x, w) for s, x, w in zip(self.scales, views, self.weights, strict=True)])
        return 1 / (1 + np.exp(-np.clip(self.final[0] + both @ self.final[1:], -30, 30)))


def views_of(batch: pd.DataFrame) -> list[np.ndarray]:
    text = np.array([text_view(t) for t in batch["__text"]], dtype=np.float32).reshape(len(batch), TEXT_DIM)
    meta = np.array([meta_view(*r) for r in zip(batch["__text"], batch["__lang"], batch["__source"], strict=True)], dtype=np.float32)
    return [text, meta.reshape(len(batch), META_DIM)]


def parts_of(batch: pd.DataFrame, rows: int = 500) -> Iterator[pd.DataFrame]:
    for start in range(0, len(batch), rows):
        yield batch.iloc[start : start + rows]


def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(__key, __y) and both views as bytes."""
    for batch in batches:
        for part in parts_of(batch):
            text, meta = views_of(part)
            yield pd.DataFrame({"key": part["__key"].to_numpy(), "y": part["__y"].to_numpy(), "text": [r.astype(np.float16).tobytes() for r in text], "meta": [r.tobytes() for r in meta]})


def features(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(keys, labels, views) of a bounded number of rows, one for each key."""
    rows = rows.groupBy("__key", "__y").agg(F.min(F.struct("__text", "__lang", "__source")).alias("__r")).select("__key", "__y", "__r.*")
    got = rows.mapInPandas(featured, "key long, y int, text binary, meta binary").toPandas().sort_values(["key", "y"], kind="stable")
    text = np.frombuffer(b"".join(got["text"]), dtype=np.float16).reshape(-1, TEXT_DIM).astype(np.float32)
    meta = np.frombuffer(b"".join(got["meta"]), dtype=np.float32).reshape(-1, META_DIM)
    return got["key"].to_numpy(dtype=np.int64), got["y"].to_numpy(dtype=int), [text, meta]


def exchange(model: CoTrained, pool: DataFrame, confident: float, most: int) -> None:
    """One round: both views score every document of the pool, and each tells the other at most `most` more documents of each
    label, the first in the order of their texts' hashes among all that it is surest of.

    pool: __key (hash of the text), __text, __lang, __source. A task returns no more than `most` hashes a view and label.
    """
    shared = pool.sparkSession.sparkContext.broadcast((model.scorer(), [set(t) for t in model.told]))

    def sure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, known = shared.value
        best: dict[tuple[int, int], set[int]] = {(me, label): set() for me in (0, 1) for label in (0, 1)}
        seen = dict.fromkeys(best, 0)
        for batch in batches:
            for part in parts_of(batch):
                keys = part["__key"].to_numpy()
                for me, p in enumerate(scorer.each(views_of(part))):
                    for label, q in ((1, p), (0, 1 - p)):
                        found = keys[q >= confident]
                        seen[me, label] += len(found)
                        best[me, label].update(k for k in found.tolist() if k not in known[1 - me])
                        if len(best[me, label]) > 4 * most:
                            best[me, label] = set(sorted(best[me, label])[:most])
        for (me, label), keys in best.items():
            first = sorted(keys)[:most]
            yield pd.DataFrame({"me": me, "label": label, "key": pd.array([None, *first], dtype="Int64"), "n": [seen[me, label]] + [0] * len(first)})

    got = written(pool.mapInPandas(sure, "me int, label int, key long, n long"), "sure")
    model.sure = np.zeros((2, 2), dtype=np.int64)
    for r in got.groupBy("me", "label").agg(F.sum("n").alias("n")).collect():
        model.sure[r["me"], r["label"]] = r["n"]
    distinct = got.where("key is not null").select("me", "label", "key").distinct()
    picked = [r for me in (0, 1) for label in (0, 1) for r in distinct.where((F.col("me") == me) & (F.col("label") == label)).orderBy("key").limit(most).collect()]
    if not picked:
        return
    wanted = pool.sparkSession.createDataFrame([(k,) for k in sorted({r["key"] for r in picked})], "__key long")
    rows = pool.join(F.broadcast(wanted), "__key").withColumn("__y", F.lit(-1))
    at, _, views = features(rows)
    place = {int(k): i for i, k in enumerate(at)}
    for r in picked:
        other = 1 - r["me"]
        model.told[other].setdefault(r["key"], (r["label"], views[other][place[r["key"]]]))


def learn(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, held: int, folds: int, train_docs: int, told_docs: int, chars: int, rounds: int, confident: float) -> CoTrained | None:
    """docs: id, __text, __lang, __source. The labelled sample and what views tell each other is bounded; the pool of
    unlabelled documents isn't: every round reads all documents of the folds that are learned from."""
    spark = docs.sparkSession
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(F.col(id_col), folds) != held)).groupBy(id_col).agg(F.min(label_col).cast("int").alias("y"))
    shares = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not shares.get(0) or not shares.get(1):
        return None
    order = F.xxhash64(F.col(id_col))
    picked = [(r[0], y) for y in (0, 1) for r in marked.where(F.col("y") == y).orderBy(order, id_col).select(id_col).limit(train_docs).collect()]
    wanted = F.broadcast(spark.createDataFrame(picked, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, __y int"))
    marked_rows = docs.where(F.length("__text") <= chars).join(wanted, id_col)
    _, y, views = features(marked_rows.groupBy(id_col, "__y").agg(F.min(F.struct("__text", "__lang", "__source")).alias("__r")).select(F.xxhash64(id_col).alias("__key"), "__y", "__r.*"))
    if len(set(y)) < 2:
        return None
    mix = np.random.default_rng(5).permutation(len(y))
    model = CoTrained([v[mix] for v in views], y[mix], shares[1] / (shares[0] + shares[1]))
    pool = docs.where(fold(F.col(id_col), folds) != held).join(wanted, id_col, "left_anti").select(F.xxhash64("__text").alias("__key"), "__text", "__lang", "__source")
    for _ in range(rounds):
        exchange(model, pool, confident, told_docs)
        model.refit()
    return model


def quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    label_col: str = "quality",
    held: int = 0,
    folds: int = 5,
    train_docs: int = TRAIN_DOCS,
    told_docs: int = TOLD_DOCS,
    train_chars: int = TRAIN_CHARS,
    rounds: int = 2,
    confident: float = 0.97,
    least: float = 0.5,
) -> DataFrame:
    """docs with held_out, score (probability of label 1) and kept (score >= least) added.

    The text view (hashed byte n-grams) and the page view (source, language, length, layout) are first learned from at most
    train_docs documents of each label, of the folds (crc32 of the id) other than `held`. In each round both then score all
    other documents of these folds, and each tells the other up to told_docs texts a label of which it is `confident`, to
    learn from. Both are calibrated on a part of the labelled sample that neither saw, and the calibrated views combined
    score all documents, whole.

    Null text counts as empty; null language or source is a value of its own; repeated rows are each scored, and learned
    from once; an id labelled twice counts as 0 if one label says so; with fewer than two labels to learn from every score is
    1. Ties: of equal hashes the smaller id is taken; a score equal to `least` is kept. Labelled texts of over train_chars
    characters are left out of training only. Columns of docs are kept; held_out, score and kept replace columns of these
    names.
    """
    data = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("__text"), F.col(lang_col).cast("string").alias("__lang"), F.col(source_col).cast("string").alias("__source"))
    model = learn(data, labels, id_col, label_col, held, folds, train_docs, told_docs, train_chars, rounds, confident)
    docs = docs.withColumn("held_out", fold(F.col(id_col), folds) == held)
    if model is None:
        return docs.withColumns({"score": F.lit(1.0), "kept": F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast(model.scorer())

    def score(texts: pd.Series, langs: pd.Series, sources: pd.Series) -> pd.Series:
        batch, out = pd.DataFrame({"__text": texts, "__lang": langs, "__source": sources}), []
        for part in parts_of(batch):
            out.append(shared.value.score(views_of(part)))
        return pd.Series(np.concatenate(out) if out else np.empty(0))

    scorer = F.pandas_udf(score, "double").asNondeterministic()  # never evaluated twice
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    docs = docs.withColumn("score", scorer(text, F.col(lang_col).cast("string"), F.col(source_col).cast("string")))
    return docs.withColumn("kept", F.col("score") >= least)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "kept")
