"""Bounds, ties and independence: rare languages, equal ids, regions of templates, views, blocks, columns of the pipeline."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import docs, empty, labels, prose
from pyspark.sql import functions as F
from test_pairs import alnum, brute_components, brute_hits

from tropelens.llm import common, decontaminate, language, licenses, mixing, ngram_join, quality_classifier, toxicity, warc


def test_rare_language_is_learned(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 30, ["the", "house", "stands", "here"]), "en") for i in range(3000)]
    rows += [(5000 + i, prose(rng, 30, ["zwq", "kvu", "xjo"]), "xx") for i in range(4)] + [(6000 + i, "the same text again", "en") for i in range(500)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(table, train_docs=100).collect()}
    assert all(got[i] == lang for i, _, lang in rows)
    keyed = table.select("lang", F.xxhash64("text").alias("hash"))
    chosen, sizes = language.training_texts(keyed, 100)
    assert sizes == {"en": 3500, "xx": 4} and chosen.where("lang = 'xx'").count() == 4 and chosen.where("lang = 'en'").count() == 100
    assert {r["hash"] for r in chosen.where("lang = 'en'").collect()} == set(sorted({r["hash"] for r in keyed.where("lang = 'en'").collect()})[:100])


def test_a_rare_language_beside_a_near_relative(spark):
    """Close letter distributions, 100 to 1: texts that are long enough are told apart, whatever the prior."""
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnop "))
    near = rng.dirichlet(np.full(17, 5.0))
    shares = {"big": near, "small": near * np.where(np.arange(17) % 2, 1.35, 0.65)}

    def text(lang, n):
        return "".join(rng.choice(letters, n, p=shares[lang] / shares[lang].sum()))

    rows = [(k, text("big", 500), "big") for k in range(3000)] + [(10_000 + k, text("small", 5000), "small") for k in range(40)]
    tests = [(20_000 + k, text("small", 5000), None) for k in range(20)] + [(30_000 + k, text("big", 5000), None) for k in range(20)]
    table = spark.createDataFrame(rows + tests, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(table).collect()}
    assert sum(got[20_000 + k] == "small" for k in range(20)) >= 19 and sum(got[30_000 + k] == "big" for k in range(20)) >= 19


def test_language_against_plain_bayes(spark):
    """The same model with dictionaries and whole numbers."""
    rng = random.Random(6)
    tongues = {"a": ["ban", "lor", "mint"], "b": ["qux", "lor", "ñu"], "c": ["mint", "ßa", "ban"]}
    rows = [(i, prose(rng, rng.randint(2, 9), tongues["aab"[i % 3] if i % 10 else "c"]), "aab"[i % 3] if i % 10 else "c") for i in range(150)]
    rows += [(200, rows[3][1], rows[3][2]), (201, "x", None), (202, "--", "a"), (203, None, "b")]

    def grams(text):
        points = []
        for c in text.lower():
            c = c if ord(c) >= 128 or c.isalpha() else " "
            if not (c == " " and points and points[-1] == 32):
                points.append(ord(c))
        mix, out = 2654435761, []
        for k in range(len(points) - 1):
            two = (((points[k] * mix) % 2**32) ^ (points[k + 1] + 0x9E37)) * mix % 2**32
            out.append(two >> 17)
            if k + 2 < len(points):
                out.append(((two ^ (points[k + 2] + 0x79B9)) * mix % 2**32) >> 17)
        return out

    import zlib

    learned = [(t, lang) for i, t, lang in rows if t is not None and lang and zlib.crc32(str(i).encode()) % 4 != 2]
    many, counts = Counter(lang for _, lang in learned), defaultdict(Counter)
    for t, lang in set(learned):
        counts[lang].update(grams(t))
    total = {lang: sum(c.values()) for lang, c in counts.items()}

    def best(text):
        if text is None or not any(map(str.isalpha, text)):
            return "und", 0.0
        g = grams(text)
        z = {lang: math.log(many[lang] / len(learned)) + sum(math.log((counts[lang][x] + 0.5) / (total[lang] + 0.5 * language.BUCKETS)) for x in g) for lang in counts}
        top = max(z.values())
        share = {lang: math.exp((v - top) * min(1, 60 / max(1, len(g)))) for lang, v in z.items()}
        lang = min(z, key=lambda x: (-z[x], x))
        return lang, share[lang] / sum(share.values())

    for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect():
        lang, score = best(dict((i, t) for i, t, _ in rows)[r["doc_id"]])
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-3


def test_mixing_of_equal_ids_reruns(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 7]), prose(rng, 64 + k % 8), "s") for k in range(400)] + [(None, "one text", "t")] * 300
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = []
    for k in (1, 3, 7):
        out = mixing.mix_counts(table.repartition(k), bin_rows=50).select("doc_id", "source", "size", "text_hash", "taken")
        got.append(Counter(map(tuple, out.collect())))
    assert got[0] == got[1] == got[2] and sum(got[0].values()) == 700


def test_archives_of_string_ids(spark, tmp_path):
    ids = ["a b", "null", "x:1>", "é\r\n", "", None, "a b2"]
    rows = [(i, f"http://h/{k}", "same payload " * 20 if k % 2 else f"p{k}" * 60) for k, i in enumerate(ids)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.warc_round_trip(pages).collect()}
    assert set(got) == set(ids) and got["null"] == ("revisit", None) or got["null"][1] in ids
    first = min(i for k, i in enumerate(ids) if k % 2 and i is not None)
    assert all(got[i] == (("response", None) if i == first else ("revisit", first)) for k, i in enumerate(ids) if k % 2)
    many = spark.range(3000).selectExpr("id AS page_id", "'u' AS url", "repeat(md5(string(id)), 200) AS html").repartition(1)
    folder = str(tmp_path / "many")
    index = warc.write_bundles(warc.with_revisits(many, "page_id", "url", "html", 100), folder, frame_bytes=100_000)
    read = warc.read_bundles(index, folder).withColumn("task", F.spark_partition_id())
    assert read.select("task").distinct().count() > 1 and read.count() == 3000


def accepts(parts, words, spans, text, at):
    """Ends of all texts from `at` on that a template accepts, by trying everything. parts: words, ('opt', parts) or ('var', rx)."""
    if not parts:
        return {at}
    head, rest = parts[0], parts[1:]
    if isinstance(head, str):
        return accepts(rest, words, spans, text, at + 1) if at < len(words) and words[at] == head else set()
    if head[0] == "opt":
        out = set(accepts(rest, words, spans, text, at))
        for end in accepts(head[1], words, spans, text, at):
            out |= accepts(rest, words, spans, text, end)
        return out
    out = accepts(rest, words, spans, text, at) if re.fullmatch(head[1], "") else set()
    for end in range(at + 1, len(words) + 1):
        if re.fullmatch(head[1], text[spans[at][0] : spans[end - 1][1]], re.S | re.I):
            out |= accepts(rest, words, spans, text, end)
    return out


def parsed(markup):
    stack = [[]]
    for part in re.split(r"(<<.*?>>)", markup, flags=re.S):
        if part.startswith("<<beginOptional"):
            stack.append([])
        elif part.startswith("<<endOptional"):
            inner = stack.pop()
            stack[-1].append(("opt", inner))
        elif part.startswith("<<var"):
            stack[-1].append(("var", re.search('match="(.*?)"', part)[1]))
        else:
            stack[-1] += re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", part.lower())
    return stack[0]


def brute_match(markup, text, at):
    found = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    ends = accepts(parsed(markup), [text[a:b].lower() for a, b in found], found, text, at)
    return max(ends) if ends else None


@pytest.mark.parametrize(
    "markup",
    [
        'may <<beginOptional;name="x">>not<<endOptional>> copy <<var;name="who";original="it";match=".{1,9}">> freely',
        'may <<var;match=".+">> copy <<var;match=".*">> freely <<beginOptional>>now <<beginOptional>>then<<endOptional>><<endOptional>>',
        'may <<beginOptional>>not<<endOptional>><<beginOptional>>ever<<endOptional>> <<var;match="copy|it it">> freely',
        'may <<var;match=".{0,6}">><<var;match="[a-f ]+">> freely',
    ],
)
def test_templates_against_brute_force(markup):
    rng = random.Random(len(markup))
    a = licenses.compile_template("t", markup)
    for _ in range(400):
        text = " ".join(rng.choice(["may", "not", "copy", "it", "freely", "now", "then", "ever", "a, b", "é"]) for _ in range(rng.randint(1, 9)))
        text = f"may {text}"
        assert a.match(licenses.Words(text.encode()), 0) == brute_match(markup, text, 0), text


def filled(markup):
    rx = [("https?", "https"), ("[0-9]", "3"), ("this program|this library|it", "This program")]
    for m in re.findall("<<var.*?>>", markup):
        want = re.search('match="(.*?)"', m)[1]
        markup = markup.replace(m, dict(rx).get(want, "Jane Doe, Ltd. and others"), 1)
    return markup


@pytest.mark.parametrize("label", list(licenses.TEMPLATES))
def test_each_mandatory_word_counts(label):
    scanner = licenses.Scanner(licenses.BASE, licenses.TEMPLATES)
    markups = licenses.TEMPLATES[label]
    for markup in [markups] if isinstance(markups, str) else markups:
        text = re.sub("<<.*?>>", " ", filled(markup))
        assert label in scanner.scan(f"so {text} end".encode())["labels"].split(",")
        bare = re.sub("<<.*?>>", " ", re.sub("<<beginOptional.*?<<endOptional>>", " ", filled(markup), flags=re.S))
        words = alnum(bare)
        assert label in scanner.scan(" ".join(words).encode())["labels"].split(",")
        for k in range(0, len(words), max(1, len(words) // 12)):
            if not {"jane", "doe", "ltd", "and", "others"} & {words[k]}:
                assert label not in scanner.scan(" ".join([*words[:k], "zzz", *words[k + 1 :]]).encode())["labels"].split(",")
    assert "bsd-2-clause-text" not in scanner.scan(filled(licenses.TEMPLATES["bsd-3-clause-text"]).encode())["labels"]


def test_repeated_ids_do_not_lift_the_training_bound(spark):
    rows = [(1, f"text {k}") for k in range(500)] + [(k, f"other {k}") for k in range(2, 30)]
    marks = labels(spark, [(k, 1, k % 2, "") for k in range(1, 30)])
    texts, y = toxicity.training_docs(spark.createDataFrame(rows, "doc_id long, text string"), marks, "doc_id", "text", "toxic", 0, 5, 5, 1000)
    assert len(texts) <= 10 and len(texts) == len(y)


def test_toxicity_against_plain_scoring(spark):
    """Scores from forward-backward token by token, with weights looked up one by one."""
    rng = random.Random(9)
    rows = [(i, " ".join([prose(rng, rng.randint(5, 150)), *(["moronic", "scum"] if i % 3 == 0 else [])])) for i in range(160)] + [(500, ""), (501, None)]
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), labels(spark, [(i, 1, int(i % 3 == 0), "") for i in range(160)])
    tagger = toxicity.Tagger(*toxicity.training_docs(table, marks, "doc_id", "text", "toxic", 0, 5, toxicity.TRAIN_DOCS, toxicity.TRAIN_CHARS))

    def plain(text):
        tokens = (text or "").split()
        e = [np.exp([0.0, tagger.bias + sum(t.get(f, 0.0) for t, f in zip(tagger.weights, toxicity.features(w), strict=False))]) for w in tokens]
        t, f = np.exp(tagger.trans), []
        for k, x in enumerate(e):
            a = x if not k else (f[-1] @ t) * x
            f.append(a / a.sum())
        b, p = np.ones(2), []
        for k in range(len(e) - 1, -1, -1):
            m = f[k] * b
            p.append(m[1] / m.sum())
            b = t @ (e[k] * b)
            b /= b.sum()
        x = [max(p), math.log1p(sum(p)), min(1.0, 10 * sum(p) / len(p))] if p else [0.0, 0.0, 0.0]
        return 1 / (1 + math.exp(-(tagger.logistic[0] + tagger.logistic[1:] @ x)))

    for r in toxicity.toxicity(table, marks).collect():
        assert abs(r["score"] - plain(dict(rows)[r["doc_id"]])) < 1e-6


def quality_corpus(spark):
    rng = random.Random(12)
    rows, marks = [], []
    for i in range(400):
        good = i % 3 > 0
        text = prose(rng, rng.randint(30, 60))
        text = text if good else "\n".join(w + "%%" for w in text.split())  # junk: other characters, and many short lines
        rows.append((i, text, "en", f"s{i % 2}"))
        if i % 4 == 0:
            marks.append((i, int(good), 0, ""))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), labels(spark, marks), rows


def test_views_tell_each_other(spark):
    table, marks, rows = quality_corpus(spark)
    data = table.select("doc_id", table.text.cast("binary").alias("__text"), table.lang.alias("__lang"), table.source.alias("__source"))
    args = ("doc_id", "quality", 0, 5, 20, 40, 100_000)
    alone = quality_classifier.learn(data, marks, *args, 0, 0.9)
    model = quality_classifier.learn(data, marks, *args, 2, 0.9)
    assert not alone.told[0] and all(len(t) > 10 for t in model.told)
    assert model.sure.sum() > 100  # counted over all documents
    assert {label for t in model.told for label, _ in t.values()} == {0, 1}
    views = quality_classifier.views_of(data.toPandas())
    each, before = model.scorer().each(views), alone.scorer().each(views)  # the combined scores are near 0 and 1 either way
    assert min(abs(p - q).max() for p, q in zip(each, before, strict=True)) > 1e-4
    by_text = {t: i % 3 > 0 for i, t, *_ in rows}
    keys = {r["k"]: by_text[r["text"]] for r in table.select(F.xxhash64(F.col("text").cast("binary")).alias("k"), "text").collect()}
    told = [(keys[k], label) for t in model.told for k, (label, _) in t.items()]
    assert np.mean([bool(a) == bool(b) for a, b in told]) > 0.95


def test_quality_against_plain_scoring(spark):
    table, marks, rows = quality_corpus(spark)
    data = table.select("doc_id", table.text.cast("binary").alias("__text"), table.lang.alias("__lang"), table.source.alias("__source"))
    scorer = quality_classifier.learn(data, marks, "doc_id", "quality", 0, 5, 1500, 300, 100_000, 2, 0.97).scorer()
    for r in quality_classifier.quality(table, marks).collect():
        _, text, lang, source = rows[r["doc_id"]]
        z = []
        for view, w, scale in zip((quality_classifier.text_view(text.encode()), quality_classifier.meta_view(text.encode(), lang, source)), scorer.weights, scorer.scales, strict=True):
            total = sum(float(a) * float(b) for a, b in zip(view, w, strict=False)) + float(w[-1])
            z.append(scale[0] + scale[1] * total)
        want = 1 / (1 + math.exp(-(scorer.final[0] + sum(a * b for a, b in zip(z, scorer.final[1:], strict=True)))))
        assert abs(r["score"] - want) < 1e-3 and r["kept"] == (r["score"] >= 0.5)


def test_views_share_no_features():
    text = "Some words here, 12 of them.\nAnd a second line\n\nends"
    other = re.sub("[a-z]", "q", re.sub("[0-9]", "%", text))
    assert np.array_equal(quality_classifier.meta_view(text.encode(), "en", "s"), quality_classifier.meta_view(other.encode(), "en", "s"))
    assert not np.array_equal(quality_classifier.meta_view(text.encode(), "en", "s"), quality_classifier.meta_view(text.encode(), "fr", "s"))
    long = "word " * 300_000
    assert np.isfinite(quality_classifier.text_view(long.encode())).all() and np.isfinite(quality_classifier.meta_view(b"", None, None)).all()


def test_blocks_write_no_documents(spark):
    """Sixty blocks of test windows (items of eleven windows, cut in blocks of five): the postings are written once, and a block's findings stay small."""
    rng = random.Random(3)
    rows = [(k, prose(rng, 300)) for k in range(60)]
    items = [(k, " ".join(rows[k][1].split()[20:40])) for k in range(20)]
    folder = f"{common.shared_dir(spark)}/tropelens"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_windows=5)
    want = Counter((i, *brute_hits(t, items)) for i, t in rows)
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in out.collect()) == want
    new = Counter(x.split("-")[0] for x in set(os.listdir(folder)) - before)
    assert new == {"postings": 1, "findings": 60}


def test_unconnected_classes_of_one_bucket(spark):
    """A shingle that many unlike documents share, dealt in slices of two: the same links as by brute force."""
    rng = random.Random(13)
    rows = [(k, "a b c d e " + prose(rng, 3 + k % 5)) for k in range(40)] + [(100 + k, "a b c d e " + " ".join(f"w{j}" for j in range(12)) + (f" x{k}" if k else "")) for k in range(4)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    base = table.select("doc_id", table.text.cast("binary").alias("text")).withColumnRenamed("doc_id", "id")
    found = ngram_join.classes(base, 5)
    entries = ngram_join.entries(found.where("n_single >= 0").drop("id"))
    small, large = (ngram_join.bucket_pairs(entries, apart=False, part=p) for p in (2, 1000))
    assert Counter(map(tuple, small.collect())) == Counter(map(tuple, large.collect()))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(table).collect()}
    assert got == brute_components(rows)


def test_stages_keep_the_callers_columns(spark, tmp_path):
    import corpus_pipeline

    table, rows = docs(spark)
    table = table.withColumn("copy", F.lit("mine")).withColumn("n_hit", F.lit(5)).drop("n_chars")
    labels(spark, [(i, int(i % 4 > 0), i % 2, "") for i in range(30)]).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "words of an item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    own = Counter(map(str, table.select("score", "kept", "component_id", "n_words", "text_2", "copy", "n_hit").collect()))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, table, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        assert out.columns == table.columns + (["copy_1"] if name == "mix" else [])
        kept = Counter(map(str, out.select("score", "kept", "component_id", "n_words", "text_2", "copy", "n_hit").collect()))
        assert set(kept) <= set(own) and (name not in ("lines", "leaks") or kept == own)
        assert stage(spark, table.limit(0), str(tmp_path)).count() == 0


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage after the classifier again in plain Python, on what the stage before kept."""
    import corpus_pipeline

    rng = random.Random(21)
    item = prose(rng, 14)
    rows = []
    for k in range(60):
        body = [prose(rng, 12) for _ in range(6)] + (["Cookie notice"] if k % 3 else [])
        body = body if k % 10 else [" ".join(x + "%%" for x in body)]
        rows.append((k, "\n".join(body) + (f"\n{item}" if k % 17 == 3 else ""), "en", f"s{k % 3}"))
    rows += [(100 + k, rows[k][1] + (" tail" if k % 2 else ""), "en", f"s{k % 3}") for k in range(1, 9)] + [(None, rows[4][1], "en", None), (None, None, None, "s0"), (1, rows[1][1], "en", "s1")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, [(k, int(k % 10 > 0), 0, "") for k in range(60)]).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    first = corpus_pipeline.classify(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    now = [(r["doc_id"], r["text"], r["source"]) for r in first.collect()]
    pages, on = defaultdict(set), defaultdict(set)
    for _, t, s in now:
        if t is not None:
            pages[s].add(t)
            for line in t.split("\n"):
                on[s, line.strip()].add(t)
    bad = {k for k, p in on.items() if k[1] and len(p) >= 5 and len(p) > 0.02 * len(pages[k[0]])}
    now = [(i, None if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip()) not in bad), s) for i, t, s in now]
    group = brute_components([(i, t) for i, t, _ in now])
    gone = {i for i, c in group.items() if i != c}
    seen, kept = set(), []
    for i, t, s in now:
        if i is None or (i not in gone and (i, t) not in seen):
            kept.append((i, t, s))
            seen.add((i, t))
    now = [r for r in kept if not brute_hits(r[1], [(1, item)])[1]]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = defaultdict(int)
    for _, t, s in now:
        total[s] += size(t)
    names = sorted(s for s in total if s is not None) + [None] * (None in total)
    weight, cap = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {s: 3.0 * total[s] for s in names}
    full = set()
    while True:
        level = (sum(total.values()) - sum(cap[s] for s in full)) / max(1e-9, sum(weight[s] for s in names if s not in full))
        more = {s for s in names if s not in full and level * weight[s] > cap[s]}
        if not more:
            break
        full |= more
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    want = Counter()
    for s in names:
        rate = (cap[s] if s in full else level * weight[s]) / total[s] if total[s] else 0.0
        u = int(md5("7:" + ("0" if s is None else "1" + s))[:8], 16) / 2**32

        def place(r):
            n = size(r[1])
            bits = len(bin(n)) - 2
            return bits * 16 + n // 2 ** max(bits - 4, 0), md5("" if r[0] is None else str(r[0])), n, md5(r[1] or "")[:16], r[0] is not None, r[0] or 0

        for c, r in enumerate(sorted((r for r in now if r[2] == s), key=place), 1):
            for copy in range(1, math.floor(c * rate + u) - math.floor((c - 1) * rate + u) + 1):
                want[r[0], r[1], s, copy] += 1
    got = Counter((r["doc_id"], r["text"], r["source"], r["copy"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and want
    assert corpus_pipeline.mix(spark, empty(spark), str(tmp_path)).count() == 0


def test_a_long_item_is_cut_over_blocks(spark):
    rng = random.Random(12)
    words = [f"w{rng.randint(0, 60)}" for _ in range(64)]
    blocks = list(decontaminate.benchmark_blocks(spark.createDataFrame([(1, " ".join(words)), (2, "a b"), (3, ""), (4, None), (5, "w1 " * 10)], "i long, t string"), "i", "t", 10, 16))
    assert all(len(b.matrix) <= 16 for b in blocks) and len(blocks) == 4
    rows = [(k, " ".join(words[a:b])) for k, (a, b) in enumerate([(0, 64), (3, 30), (10, 25), (50, 64), (20, 29)])] + [(9, " ".join(words[:30] + ["x"] + words[31:])), (10, "none here")]
    items = [(1, " ".join(words)), (2, "a b")]
    got = []
    for block in (1 << 18, 16, 7):
        out = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_windows=block)
        got.append(sorted((r["doc_id"], r["n_hit"], tuple(r["hit_spans"]), tuple(r["items"]), r["n_near"], tuple(r["near_items"]), tuple(r["near_spans"])) for r in out.collect()))
    assert got[0] == got[1] == got[2] and {r[0] for r in got[0] if r[1]} == {0, 1, 2, 3, 9}
