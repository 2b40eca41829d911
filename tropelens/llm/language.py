"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tropelens.llm.common import BROADCAST_BYTES, written

BUCKETS = 1 << 15
#: Bound of the training sample, in distinct texts of each language. Counts of n-grams barely change beyond.
TRAIN_DOCS = 5_000
#: Bound of the languages that are learned, the most frequent ones: a column of 128 KB each.
MOST_LANGS = 500
#: Scores, not choices, are tempered to so many n-grams: those of a text aren't independent.
TEMPER = 60
CHUNK_CHARS = 1 << 19
MIX = np.uint32(2654435761)


def fold(key: Column, of: int) -> Column:
    """crc32 of the key as text, modulo `of`; null keys count as the empty string."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % of


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text; each run of ASCII characters that are no letters becomes one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = np.where((points >= 128) | ((points >= 97) & (points <= 122)), points, np.uint32(32))
    blank = points == 32
    return points[~(blank & np.concatenate([[False], blank[:-1]]))] if len(points) else points


def ngram_buckets(points: np.ndarray) -> np.ndarray:
    """Hashed 2- and 3-grams of code points, as two rows; the last positions repeat the end."""
    with np.errstate(over="ignore"):
        a = points * MIX
        b = (a[:-1] ^ (points[1:] + np.uint32(0x9E37))) * MIX
        c = (b[:-1] ^ (points[2:] + np.uint32(0x79B9))) * MIX
    return np.concatenate([b >> np.uint32(17), c >> np.uint32(17)]).astype(np.int32)


def chunks(points: np.ndarray, most: int = CHUNK_CHARS) -> Iterator[np.ndarray]:
    """Pieces that overlap by two characters, so that every n-gram is in exactly one, whatever the text's length."""
    for k in range(0, max(1, len(points) - 2), most):
        yield points[k : k + most + 2]


def count_ngrams(text: str) -> np.ndarray:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for piece in chunks(letters_of(text)):
        total += np.bincount(ngram_buckets(piece), minlength=BUCKETS)
    return total


def training_texts(rows: DataFrame, train_docs: int, most_langs: int = MOST_LANGS) -> tuple[DataFrame, dict[str, int]]:
    """(lang, hash, share of one row) of the texts to learn from, and how many rows each language has.

    rows: lang, hash, without nulls. Of every language the train_docs smallest hashes are taken, all that a rare one has. A
    text's weight is shared by the rows that repeat it. Counting moves a hash a text. Hashes are evenly spread, so those
    under a bound that leaves train_docs and some more a language are enough to take the smallest from: no task ranks all
    texts of a frequent language.
    """
    texts = written(rows.groupBy("lang", "hash").agg(F.count(F.lit(1)).alias("n")), "texts")
    sums = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("rows")).orderBy(F.col("rows").desc(), "lang").limit(most_langs).collect()
    enough = train_docs + 8 * math.isqrt(train_docs) + 32
    bound = [x for r in sums for x in (F.lit(r["lang"]), F.lit(min(1.0, enough / r["texts"]) * 2.0**64 - 2.0**63))]
    if not bound:
        return texts.limit(0).select("lang", "hash", F.lit(1.0).alias("share")), {}
    few = texts.where(F.col("hash").cast("double") <= F.element_at(F.create_map(*bound), F.col("lang")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    chosen = few.withColumn("place", place).where(F.col("place") <= train_docs).select("lang", "hash", (1.0 / F.col("n")).alias("share"))
    return chosen, {r["lang"]: r["rows"] for r in sums}


def train(docs: DataFrame, text_col: str, lang_col: str, train_docs: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log-probabilities as a matrix bucket x language, log priors) from rows with text and language.

    The priors are the languages' shares of all learnable rows. N-grams are counted over the chosen texts, whole: tasks
    count them by language, Spark sums the counts, and the driver gets at most one row per language and bucket.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    rows = rows.withColumn("hash", F.xxhash64("text"))
    chosen, sizes = training_texts(rows.select("lang", "hash"), train_docs)
    chosen = written(chosen, "chosen")
    if chosen.count() * 64 <= BROADCAST_BYTES:
        chosen = F.broadcast(chosen)
    sample = rows.join(chosen, ["lang", "hash"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for (lang, _), part in batch.groupby(["lang", "hash"], sort=False):
                sums[lang] = sums.get(lang, 0.0) + count_ngrams(part["text"].iloc[0]) * part["share"].sum()
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": total[at]})

    got = sample.mapInPandas(count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sizes)
    counts = np.zeros((BUCKETS, len(langs)))
    if len(got):
        counts[got["bucket"].to_numpy(dtype=int), np.searchsorted(langs, got["lang"])] = got["n"].round(6)
    prior = np.array([sizes[lang] for lang in langs], dtype=float)
    return langs, np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32), np.log(prior / max(1.0, prior.sum()))


def score_texts(texts: list[str | None], langs: list[str], columns: list[np.ndarray], prior: np.ndarray) -> tuple[list[str], list[float]]:
    """Language and score of each text. A batch's n-grams lie in one array; each language's log-probabilities are looked
    up for the n-grams that occur and summed by document. The language has the largest sum with its log prior; the score
    is its posterior, of which both sum and prior are tempered."""
    named, scores = ["und"] * len(texts), [0.0] * len(texts)
    sums, sizes, parts, owner, fill = np.zeros((len(texts), len(langs))), np.zeros(len(texts)), [], [], 0

    def settle() -> None:
        flat = np.concatenate(parts)
        starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
        for k, column in enumerate(columns):
            np.add.at(sums[:, k], owner, np.add.reduceat(column[flat], starts, dtype=np.float64))

    for i, text in enumerate(texts):
        if text is None or not any(map(str.isalpha, text)):
            continue
        for piece in chunks(letters_of(text)):
            grams = ngram_buckets(piece)
            if len(grams):
                parts.append(grams)
                owner.append(i)
                sizes[i] += len(grams)
                fill += len(grams)
            if fill >= CHUNK_CHARS:
                settle()
                parts, owner, fill = [], [], 0
        named[i] = langs[0] if langs else "und"
    if parts and langs:
        settle()
    if langs:
        sums += prior
        best = sums.argmax(axis=1)
        odds = np.exp((sums - sums.max(axis=1, keepdims=True)) * np.minimum(1.0, TEMPER / np.maximum(sizes, 1))[:, None])
        odds /= odds.sum(axis=1, keepdims=True)
        for i in range(len(texts)):
            if named[i] != "und":
                named[i], scores[i] = langs[best[i]], float(odds[i, best[i]])
    return named, scores


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held: int = 2, folds: int = 4, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row per document: id, held_out, lang_pred and score (the posterior of the language, tempered to 60
    n-grams; the choice itself is by the whole sum and the prior).

    Learned from documents with text and language whose fold (crc32 of the id) isn't `held`, from about train_docs distinct
    texts of each language (all that a rare one has) and the 500 most frequent languages; the language column, the source and the id are never inputs of a
    prediction. `und` with score 0 where the text is null, empty or without a letter, or where nothing could be learned.
    Equal scores: the language that sorts first. Very long texts are counted and scored whole, in pieces. Repeated rows are
    each scored; an empty table gives an empty result; extra columns are ignored.
    """
    is_held = fold(F.col(id_col), folds) == held
    langs, matrix, prior = train(docs.where(~is_held), text_col, lang_col, train_docs)
    shared = docs.sparkSession.sparkContext.broadcast((langs, [np.ascontiguousarray(matrix[:, k]) for k in range(len(langs))], prior))

    @F.pandas_udf("lang_pred string, score double")
    def score(texts: pd.Series) -> pd.DataFrame:
        named, scores = score_texts(list(texts), *shared.value)
        return pd.DataFrame({"lang_pred": named, "score": scores})

    found = score.asNondeterministic()(F.col(text_col).cast("string"))  # never evaluated twice
    return docs.select(F.col(id_col).alias(id_col), is_held.alias("held_out"), found.alias("__found")).select(id_col, "held_out", "__found.*")


def query(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
