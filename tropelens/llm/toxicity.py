"""Toxicity by a linear-chain conditional random field over tokens.

Documents have labels, tokens don't. A bounded sample of labelled documents gives the token labels: in toxic documents a
token is labelled toxic if it, or one of its beginnings, is far more frequent over toxic than over other documents. The
field learns tags from these labelled tokens (the words themselves, beginnings and ends, and the tag before), forward-
backward gives every token's marginal, and a small logistic model turns a document's marginals into its score. That model
is fitted on marginals from fields that were trained on the other half of the sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tropelens.llm.language import fold

#: Bounds of the training sample: documents of either label, and characters of one document.
TRAIN_DOCS, TRAIN_CHARS = 1_200, 100_000
#: Tokens of one piece of a chain: the recursion runs over all pieces of a batch at once, and messages pass between them.
CHAIN = 64
#: Words remembered between batches.
CACHE_WORDS = 200_000


#: Stripped from a token's ends.
OUTER = "".join(chr(c) for c in range(128) if not chr(c).isalpha())
KINDS = ("word", "begin3", "begin4", "begin5", "end3")


def features(token: str) -> tuple[str, ...]:
    """One for each of KINDS: the word and its ends, without case and outer punctuation; none for tokens without a word."""
    word = token.strip(OUTER).lower()
    return (word, word[:3], word[:4], word[:5], word[-3:]) if word else ()


class Emissions(dict):
    """token -> score of the tag toxic against the other; bounded in size."""

    def __init__(self, weights: list[dict[str, float]], bias: float):
        super().__init__()
        self.weights, self.bias = weights, bias

    def __missing__(self, token: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self.bias
        for table, feature in zip(self.weights, features(token), strict=False):
            value += table.get(feature, 0.0)
        self[token] = value
        return value


def marginals(scores: np.ndarray, trans: np.ndarray, sizes: np.ndarray | None = None, count: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over whole chains, each laid out in one or more rows (pieces) of equal length.

    scores: pieces x length, the toxic tag's score (the other has 0). trans[a, b]: score of tag b after a. sizes: tokens of
    each chain, which fills as many successive rows as it needs; what is left of its last row is padding. By default each
    row is a chain. A piece's steps are multiplied to a 2x2 matrix first; with it the messages pass from piece to piece, so
    the marginals are those of the whole chain. Returns P(toxic) of each token, and the expected transitions of each kind
    summed over all (zeros without `count`), both in probabilities.
    """
    n, length = scores.shape
    sizes = np.full(n, length) if sizes is None else np.asarray(sizes)
    rows = -(-sizes // length)
    head = np.cumsum(rows) - rows
    place = np.arange(n) - np.repeat(head, rows)
    first = place == 0
    real = (place * length + np.arange(length)[:, None]) < np.repeat(sizes, rows)  # length x pieces, as all that follows
    full = real.all(axis=1)
    e, t = np.ascontiguousarray(np.exp(np.clip(scores, -50, 50)).T), np.exp(trans)

    def forward(a0: np.ndarray, a1: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        n0, n1 = a0 * t[0, 0] + a1 * t[1, 0], (a0 * t[0, 1] + a1 * t[1, 1]) * e[k]
        if k == 0:
            n0, n1 = np.where(first, a0, n0), np.where(first, a1 * e[0], n1)
        return (n0, n1) if full[k] else (np.where(real[k], n0, a0), np.where(real[k], n1, a1))

    in0, in1, out0, out1 = np.full(n, 1.0), np.full(n, 1.0), np.full(n, 1.0), np.full(n, 1.0)
    longest = int(rows.max()) if len(rows) else 0
    if longest > 1:
        p00, p01, p10, p11 = np.ones(n), np.zeros(n), np.zeros(n), np.ones(n)
        for k in range(length):
            (p00, p01), (p10, p11) = forward(p00, p01, k), forward(p10, p11, k)
            total = p00 + p01 + p10 + p11
            p00, p01, p10, p11 = p00 / total, p01 / total, p10 / total, p11 / total
        order = np.argsort(-rows, kind="stable")
        heads, more = head[order], np.searchsorted(-rows[order], -np.arange(longest), side="left")  # chains of over k rows: more[k]
        for k in range(1, longest):
            r = heads[: more[k]] + k - 1
            x0, x1 = in0[r] * p00[r] + in1[r] * p10[r], in0[r] * p01[r] + in1[r] * p11[r]
            in0[r + 1], in1[r + 1] = x0 / (x0 + x1), x1 / (x0 + x1)
        for k in range(longest - 1, 0, -1):
            r = heads[: more[k]] + k
            x0, x1 = p00[r] * out0[r] + p01[r] * out1[r], p10[r] * out0[r] + p11[r] * out1[r]
            out0[r - 1], out1[r - 1] = x0 / (x0 + x1), x1 / (x0 + x1)
    f0, f1 = np.empty_like(e), np.empty_like(e)
    a0, a1 = in0, in1
    for k in range(length):
        a0, a1 = forward(a0, a1, k)
        total = a0 + a1
        a0, a1 = a0 / total, a1 / total
        f0[k], f1[k] = a0, a1
    p, pairs = np.empty_like(e), np.zeros((2, 2))
    b0, b1 = out0, out1
    for k in range(length - 1, -1, -1):
        x0, x1 = f0[k] * b0, f1[k] * b1
        p[k] = x1 / (x0 + x1)
        x1 = e[k] * b1
        if count:
            l0, l1, used = (f0[k - 1], f1[k - 1], real[k]) if k else (in0, in1, real[0] & ~first)
            m00, m01, m10, m11 = l0 * t[0, 0] * b0, l0 * t[0, 1] * x1, l1 * t[1, 0] * b0, l1 * t[1, 1] * x1
            s = np.where(used, 1 / (m00 + m01 + m10 + m11), 0.0)
            pairs += [[m00 @ s, m01 @ s], [m10 @ s, m11 @ s]]
        if k:
            x0, x1 = t[0, 0] * b0 + t[0, 1] * x1, t[1, 0] * b0 + t[1, 1] * x1
            total = x0 + x1
            x0, x1 = x0 / total, x1 / total
            b0, b1 = (x0, x1) if full[k] else (np.where(real[k], x0, b0), np.where(real[k], x1, b1))
    return p.T, pairs


def chained(values: np.ndarray, fill: float) -> np.ndarray:
    rows = -(-len(values) // CHAIN)
    out = np.full(rows * CHAIN, fill)
    out[: len(values)] = values
    return out.reshape(rows, CHAIN)


def token_labels(docs: list[list[str]], toxic: np.ndarray, least_docs: int = 4, least_share: float = 0.012, odds: float = 15.0) -> list[np.ndarray]:
    """0/1 for each token: in toxic documents, tokens with a telling feature."""
    telling_of = {t: [f for f in zip(KINDS[:4], features(t), strict=False) if f[0] != "begin3"] for d in docs for t in d}
    in_toxic, in_other = Counter(), Counter()
    for d, y in zip(docs, toxic, strict=True):
        (in_toxic if y else in_other).update({f for t in set(d) for f in telling_of[t]})
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    telling = {f for f, c in in_toxic.items() if c >= max(least_docs, least_share * n1) and (c / n1) / ((in_other[f] + 0.5) / n0) >= odds}
    bad = {t for d, y in zip(docs, toxic, strict=True) if y for t in set(d) if telling.intersection(telling_of[t])}
    return [np.array([t in bad for t in d], dtype=float) if y else np.zeros(len(d)) for d, y in zip(docs, toxic, strict=True)]


def fit_crf(docs: list[list[str]], labels: list[np.ndarray], rounds: int = 30, rate: float = 0.5, l2: float = 1e-4) -> tuple[list[dict[str, float]], float, np.ndarray]:
    """Weights by feature, bias and transitions: gradient ascent (AdaGrad) on the chains' log-likelihood."""
    vocabulary: dict[str, int] = {}
    ids = [np.array([vocabulary.setdefault(t, len(vocabulary)) for t in d], dtype=int) for d in docs]
    ids = [x for x in ids if len(x)]
    labels = [y for y in labels if len(y)]
    if not ids:
        return [{} for _ in KINDS], -5.0, np.zeros((2, 2))
    token = np.concatenate([chained(x, -1) for x in ids]).astype(int)
    y = np.concatenate([chained(x, 0) for x in labels])
    known: dict[tuple[str, str], int] = {}
    rows, slots = [], []
    for t, k in vocabulary.items():
        for f in zip(KINDS, features(t), strict=False):
            rows.append(k)
            slots.append(known.setdefault(f, len(known)))
    rows, slots, size = np.array(rows, dtype=int), np.array(slots, dtype=int), len(known)
    real, sizes = token >= 0, np.array([len(x) for x in ids])
    gold = sum(np.bincount((2 * x[:-1] + x[1:]).astype(int), minlength=4) for x in labels).reshape(2, 2).astype(float)
    w, bias, trans = np.zeros(size), -4.0, np.zeros((2, 2))
    gw, gb, gt = np.full(size, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    for _ in range(rounds):
        emit = bias + np.bincount(rows, weights=w[slots], minlength=len(vocabulary))
        p, pairs = marginals(np.where(real, emit[token], 0.0), trans, sizes)
        diff = np.where(real, y - p, 0.0)
        by_token = np.bincount(token[real], weights=diff[real], minlength=len(vocabulary))
        step = np.bincount(slots, weights=by_token[rows], minlength=size) - l2 * w
        gw += step**2
        w += rate * step / np.sqrt(gw)
        db, dt = diff.sum(), gold - pairs - l2 * trans
        gb, gt = gb + db**2, gt + dt**2
        bias += 0.2 * rate * db / np.sqrt(gb)
        trans += 0.2 * rate * dt / np.sqrt(gt)
    tables: list[dict[str, float]] = [{} for _ in KINDS]
    for (kind, f), value in zip(known, w, strict=True):
        if abs(value) >= 0.05:
            tables[KINDS.index(kind)][f] = float(value)
    return tables, float(bias), trans


def summary(p: np.ndarray) -> list[float]:
    """What a document's score is made from: the largest marginal, their sum, and their share."""
    if not len(p):
        return [0.0, 0.0, 0.0]
    return [float(p.max()), float(np.log1p(p.sum())), float(min(1.0, 10 * p.mean()))]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


class Tagger:
    """The trained field and the document model: as many weights as the bounded sample has features."""

    def __init__(self, docs: list[str], toxic: list[int]):
        tokens, y = [d.split() for d in docs], np.array(toxic, dtype=int)
        self.prior = float(y.mean()) if len(y) else 0.0
        seen = np.zeros((len(y), 3))
        for half in (0, 1):  # the document model learns from marginals of texts that their field hasn't seen
            rest, own = np.arange(half, len(y), 2), np.arange(1 - half, len(y), 2)
            self.learn([tokens[k] for k in own], y[own])
            for k, p in zip(rest, self.tag([tokens[k] for k in rest], Emissions(self.weights, self.bias)), strict=True):
                seen[k] = summary(p)
        self.logistic = fit_logistic(seen, y) if len(set(toxic)) == 2 else None
        self.learn(tokens, y)

    def learn(self, tokens: list[list[str]], y: np.ndarray) -> None:
        self.weights, self.bias, self.trans = fit_crf(tokens, token_labels(tokens, y))

    def tag(self, docs: list[list[str]], emissions: Emissions) -> list[np.ndarray]:
        """The marginals of each document's tokens."""
        sizes = [len(d) for d in docs]
        if not sum(sizes):
            return [np.empty(0) for _ in docs]
        rows = [chained(np.fromiter(map(emissions.__getitem__, d), dtype=float, count=len(d)), 0.0) for d in docs]
        p, _ = marginals(np.concatenate(rows), self.trans, np.array(sizes), count=False)
        out, at = [], 0
        for n, r in zip(sizes, rows, strict=True):
            out.append(p[at : at + len(r)].reshape(-1)[:n])
            at += len(r)
        return out

    def score(self, p: np.ndarray) -> float:
        if self.logistic is None:
            return self.prior
        return float(1 / (1 + np.exp(-np.clip(self.logistic[0] + self.logistic[1:] @ summary(p), -30, 30))))


def offending(text: str, p: np.ndarray) -> list[str]:
    """start-end in characters of each run of tokens that are toxic rather than not."""
    out, last = [], -2
    spans = [m.span() for m in re.finditer(r"\S+", text)] if (p >= 0.5).any() else []
    for k in np.flatnonzero(p >= 0.5):
        if k < len(spans):
            a, b = spans[k]
            if k == last + 1:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
            last = k
    return [f"{a}-{b}" for a, b in out]


def training_docs(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, held: int, folds: int, most: int, chars: int) -> tuple[list[str], list[int]]:
    """At most `most` whole documents of each label from the folds that are learned from, by hash of the id; of rows that
    share an id one text, so that repeated ids don't lift the bound."""
    marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(F.col(id_col), folds) != held)).groupBy(id_col).agg(F.max(label_col).alias("y"))
    order = F.xxhash64(F.col(id_col))
    picked = {int(y): [r[0] for r in marked.where(F.col("y") == y).orderBy(order, id_col).select(id_col).limit(most).collect()] for y in (0, 1)}
    wanted = docs.sparkSession.createDataFrame([(k, y) for y, ids in picked.items() for k in ids], f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, y int")
    rows = docs.select(id_col, F.col(text_col).alias("text")).where(F.col("text").isNotNull() & (F.length("text") <= chars)).join(F.broadcast(wanted), id_col)
    rows = rows.groupBy(id_col, "y").agg(F.min("text").alias("text")).orderBy(id_col).select("text", "y").toPandas()
    return list(rows["text"]), [int(y) for y in rows["y"]]


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    held: int = 0,
    folds: int = 5,
    train_docs: int = TRAIN_DOCS,
    train_chars: int = TRAIN_CHARS,
) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted (score >= 0.5), spans of offending characters.

    Learned from at most train_docs labelled documents of each label whose fold (crc32 of the id) isn't `held` and whose
    text has at most train_chars characters; labels, language, source and id are never inputs of a score. Texts are
    scored whole, each as one chain. Null and empty texts get the score of a text without a toxic token; with one
    label or none to learn from every score is that label's share (0 for none). Repeated rows are each scored; an empty
    table gives an empty result; extra columns are ignored; ids labelled twice count as toxic if one label says so; of
    repeated ids one text is learned from, the one that sorts first. Equal hashes of ids: the smaller id is taken.
    """
    tagger = Tagger(*training_docs(docs, labels, id_col, text_col, label_col, held, folds, train_docs, train_chars))
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = shared.value
        emissions = Emissions(tagger.weights, tagger.bias)
        for batch in batches:
            scores, spans = [], []
            for start in range(0, len(batch), 256):
                texts = list(batch.iloc[start : start + 256])
                for text, p in zip(texts, tagger.tag([t.split() for t in texts], emissions), strict=True):
                    scores.append(tagger.score(p))
                    spans.append(offending(text, p))
            yield pd.DataFrame({"score": scores, "predicted": [int(s >= 0.5) for s in scores], "spans": spans})

    scorer = F.pandas_udf(score, "score double, predicted int, spans array<string>", F.PandasUDFType.SCALAR_ITER).asNondeterministic()  # never evaluated twice
    found = scorer(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.select(F.col(id_col).alias(id_col), (fold(F.col(id_col), folds) == held).alias("held_out"), found.alias("__found")).select(id_col, "held_out", "__found.*")


def query(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
