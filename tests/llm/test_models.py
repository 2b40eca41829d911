"""Language, toxicity, quality: held-out accuracy, hard cases; WARC: round trip; the pipeline."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import docs, empty, labels, prose

from tropelens.llm import language, quality_classifier, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    tongues = {"aa": ["ban", "lor", "mint", "sod"], "bb": ["qux", "wiz", "jek", "vro"], "cc": ["ñandu", "éclat", "übung", "çava"]}
    rows, marks = [], []
    for i in range(360):
        lang = "abc"[i % 3] * 2
        w = prose(rng, rng.randint(40, 90), tongues[lang]).split()
        toxic, junk = i % 5 == 0, i % 7 == 0
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["Scumbag,", "idiotic", "moronize"]))
        text = " ".join(x + "%%%" for x in w) if junk else " ".join(w)
        rows.append((i, text, None if i % 50 == 0 else lang, f"s{i % 4}", len(text)))
        marks.append((i, int(not junk), int(toxic), ""))
    return spark.createDataFrame(rows, SCHEMA), labels(spark, marks), rows, marks


def test_language(spark, corpus):
    table, _, rows, _ = corpus
    got = {r["doc_id"]: r for r in language.identify(table).collect()}
    held = [i for i, *_ in rows if got[i]["held_out"]]
    assert len(held) > 50 and all(got[i]["lang_pred"] == "abc"[i % 3] * 2 for i in held)
    hard, hard_rows = docs(spark)
    out = language.identify(hard).collect()
    assert len(out) == len(hard_rows)
    assert {r["lang_pred"] for r in out if r["doc_id"] in (23, 24, 25)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in out)
    assert language.identify(empty(spark)).count() == 0
    assert {r["lang_pred"] for r in language.identify(hard.withColumn("lang", hard["lang"].substr(9, 1)).where("lang = 'x'")).collect()} <= {"und"}


def test_chunks_cover_each_ngram_once():
    points = language.letters_of("abcdefghij klmnop" * 9)
    whole = Counter(language.ngram_buckets(points).tolist())
    parts = Counter()
    for piece in language.chunks(points, 7):
        if len(piece) > 2:
            parts.update(language.ngram_buckets(piece)[len(piece) - 1 :].tolist())
    threes = Counter(language.ngram_buckets(points)[len(points) - 1 :].tolist())
    assert parts == threes and sum(whole.values()) == 2 * len(points) - 3


def test_toxicity(spark, corpus):
    table, marks, rows, truth = corpus
    got = {r["doc_id"]: r for r in toxicity.toxicity(table, marks).collect()}
    wrong = [i for i, _, toxic, _ in truth if got[i]["predicted"] != toxic]
    assert len(wrong) <= 4
    spans = [rows[i][1][int(a) : int(b)] for i in got for a, b in [s.split("-") for s in got[i]["spans"]]]
    assert spans and np.mean([any(x in s for x in ("Scum", "idiot", "moron")) for s in spans]) > 0.95
    hard, hard_rows = docs(spark)
    out = toxicity.toxicity(hard, marks.where("doc_id < 30")).collect()
    assert len(out) == len(hard_rows) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.toxicity(empty(spark), marks).count() == 0
    assert {r["score"] for r in toxicity.toxicity(hard, marks.where("toxic = 5")).collect()} == {0.0}


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    scores, trans = rng.normal(size=(2, 5)), rng.normal(size=(2, 2))
    p, pairs = toxicity.marginals(scores, trans)
    want, want_pairs = np.zeros((2, 5)), np.zeros((2, 2))
    for c in range(2):
        weights = {}
        for bits in range(32):
            tags = [(bits >> k) & 1 for k in range(5)]
            weights[tuple(tags)] = np.exp(sum(scores[c, k] * t for k, t in enumerate(tags)) + sum(trans[a, b] for a, b in zip(tags, tags[1:], strict=False)))
        z = sum(weights.values())
        for tags, w in weights.items():
            want[c] += np.array(tags) * w / z
            for a, b in zip(tags, tags[1:], strict=False):
                want_pairs[a, b] += w / z
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs)


def test_marginals_of_long_texts():
    """Texts of several pieces, one empty, tagged side by side: as plain forward-backward over each whole text."""
    rng = np.random.default_rng(3)
    tagger = object.__new__(toxicity.Tagger)
    tagger.trans = np.array([[1.5, -1.0], [-2.0, 2.5]])
    sizes = [300, 0, 64, 65, 10, 129, 1]
    texts = [[f"w{k}" for k in rng.integers(0, 50, n)] for n in sizes]
    emissions = {f"w{k}": x for k, x in enumerate(rng.normal(size=50))}
    want_pairs = np.zeros((2, 2))
    t = np.exp(tagger.trans)
    for words, got in zip(texts, tagger.tag(texts, emissions), strict=True):
        e = [np.array([1.0, np.exp(emissions[w])]) for w in words]
        f, b = [x.copy() for x in e], [np.ones(2) for _ in e]
        for k in range(1, len(e)):
            f[k] = (f[k - 1] @ t) * e[k]
            f[k] /= f[k].sum()
        for k in range(len(e) - 2, -1, -1):
            b[k] = t @ (e[k + 1] * b[k + 1])
            b[k] /= b[k].sum()
        assert len(got) == len(words) and np.allclose(got, [(x * y)[1] / (x * y).sum() for x, y in zip(f, b, strict=True)])
        for k in range(1, len(e)):
            m = f[k - 1][:, None] * t * (e[k] * b[k])
            want_pairs += m / m.sum()
    flat = [np.array([emissions[w] for w in d]) for d in texts]
    _, pairs = toxicity.marginals(np.concatenate([toxicity.chained(x, 0.0) for x in flat]), tagger.trans, np.array(sizes))
    assert np.allclose(pairs, want_pairs)


def test_quality(spark, corpus):
    table, marks, _, truth = corpus
    got = {r["doc_id"]: r for r in quality_classifier.quality(table, marks).collect()}
    assert sum(got[i]["kept"] != bool(q) for i, q, *_ in truth) <= 4
    hard, hard_rows = docs(spark)
    out = quality_classifier.quality(hard, marks.where("doc_id < 30")).collect()
    assert len(out) == len(hard_rows) and all(0 <= r["score"] <= 1 for r in out)
    assert quality_classifier.quality(empty(spark), marks).count() == 0
    assert {r["score"] for r in quality_classifier.quality(hard, marks.where("quality = 1")).collect()} == {1.0}


def test_warc(spark, tmp_path):
    big = "<p>é</p>" * 40
    rows = [(1, "http://a/ b\r\nc", big), (2, None, big), (3, "u", "x"), (4, "u", "x"), (5, "u", None), (None, "u", big), (7, "u", "y" * 3_000_000), (1, "v", big), (8, "", "z" * 100), (9, "", "z" * 100)]
    pages = spark.createDataFrame([(*r, 1, "q") for r in rows], "page_id long, url string, html string, bundle int, digest string").repartition(2)
    got = Counter(map(tuple, warc.warc_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    first = {big: 1, "y" * 3_000_000: 7, "z" * 100: 8}

    def want(i, html):
        data = (html or "").encode()
        to = first.get(html) if first.get(html) != i else None
        return i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if to is not None else "response", to

    assert got == Counter(want(i, h) for i, _, h in rows)
    assert warc.warc_round_trip(pages.limit(0)).count() == 0
    folder = str(tmp_path / "w")
    index = warc.write_bundles(warc.with_revisits(pages, "page_id", "url", "html", 100), folder, frame_bytes=500, bundle_bytes=4000)
    for place in index.where("page_id in (3, 7, 8)").collect():
        head, block = warc.read_record(folder, place)
        assert head["WARC-Record-ID"] == f"<urn:x-page:{place['page_id']}>"
        assert block.split(b"\r\n\r\n", 1)[1].decode() == {"3": "x", "7": "y" * 3_000_000, "8": "z" * 100}[place["page_id"]]


def test_pipeline(spark, tmp_path, corpus):
    import corpus_pipeline

    table, marks, rows, _ = corpus
    item = "plain words of a benchmark item that nobody else should ever repeat verbatim"
    extra = [(1000, rows[1][1] + " " + item, "aa", "s1", 1), (1001, rows[1][1], "aa", "s1", 1), (1002, None, "aa", "s0", 0), (None, rows[2][1] + " q", "aa", None, 3)]
    table.union(spark.createDataFrame(extra, table.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, now = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{k}")
        assert name == "mix" or now.columns == before.columns
        seen[name] = Counter(r["doc_id"] for r in now.select("doc_id").collect())
    assert sum(not i % 7 for i in seen["quality"] if i is not None and i < 360) <= 3
    assert 1001 not in seen["copies"] and 1000 not in seen["leaks"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sum(seen["mix"].values())
