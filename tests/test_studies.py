"""Closest sentences, verbatim overlap, cohesion under a mask, bootstrap and permutation, against plain loops."""

import difflib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tropelens.functions.patterns import PATTERNS
from tropelens.operators import cohesion, replicates, revisions, tells, verbatim

WORDS = ["tree", "list", "graph", "model", "data", "learns", "uses", "big", "small", "rather than", "not", "we"]


def a_sentence(rng, n=None):
    return " ".join(rng.choice(WORDS) for _ in range(n or rng.randint(3, 14)))


def closest_plainly(source, targets, least=0.6):
    best, top = None, least
    for pos, text in targets:
        if source or text:
            r = difflib.SequenceMatcher(None, text, source, autojunk=False).ratio()
            if r >= top:
                best, top = (pos, text, r), r
    return best


@pytest.mark.parametrize(("least", "slices"), [(0.6, 8), (0.8, 1), (0.3, 3)])
def test_closest_is_what_all_pairs_give(spark, least, slices):
    rng = random.Random(11)
    sources, targets = [], []
    for doc in range(6):
        old = [a_sentence(rng) for _ in range(12)] + ["ab", "é" * 9, "😀 tree"]
        new = []
        for s in old:
            words = s.split(" ")
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            new.append(" ".join(words))
        rng.shuffle(new)
        new += [new[0], new[3], "", a_sentence(rng, 60)]  # repeats: the later place wins
        sources += [(doc, k, s) for k, s in enumerate(old)]
        targets += [(doc, k, s) for k, s in enumerate(new)]
    sources += [(77, 0, "nothing there"), (0, 99, None), (0, 98, "")]
    a, b = (spark.createDataFrame(x, "d long, pos long, sentence string").repartition(3) for x in (sources, targets))
    got = {(r["d"], r["pos"]): r for r in revisions.closest(a, b, "d", least, slices).collect()}
    assert len(got) == len(sources) - 1
    for d, pos, s in sources:
        if s is None:
            continue
        want = closest_plainly(s, [(p, t) for e, p, t in targets if e == d], least) if s else got[d, pos]["match"] and (got[d, pos]["match_pos"], "", 1.0)
        r = got[d, pos]
        assert (r["match"] and (r["match_pos"], r["match"], r["ratio"])) == (want or None) or (s == "" and r["match"] == "")
    pairs = revisions.candidates(a.where("sentence is not null"), b, "d", least, slices)
    every = sum(x[0] == y[0] for x in sources for y in targets)
    assert pairs.count() < (0.5 if least > 0.5 else 0.9) * every and pairs.dropDuplicates(["d", "pos", "other"]).count() == pairs.count()


def test_substitutions(spark):
    docs = [
        (1, "We use trees rather than lists here. All is well. It is good.", "We use trees instead of lists here. All is well. It is good."),
        (2, "We use trees rather than lists here. Then we stop now.", "We use trees, lists here. Then we stop now."),
        (3, "We use trees rather than lists here.", "Completely different content follows below."),
        (4, "We use big trees rather than lists.", "We use trees rather than lists."),
        (5, "Nothing to see.", "We see nothing rather than something."),
        (6, None, "x rather than y."),
    ]
    got = {(r["direction"], r["outcome"]): r["n"] for r in revisions.substitutions(spark.createDataFrame(docs, "d long, a string, b string"), "d", "a", "b").collect()}
    assert got == {
        ("removed", "sentences"): 4, ("removed", "kept"): 1, ("removed", "unmatched"): 1, ("removed", "changed"): 2, ("removed", "form:instead_of"): 1, ("removed", "form:none"): 1,
        ("added", "sentences"): 3, ("added", "kept"): 1, ("added", "unmatched"): 2,
    }


def test_overlap_with_sources(spark):
    rng = random.Random(4)
    source = {d: [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(150)] for d in range(5)}
    text = {d: source[d][20:45] + ["new"] + source[d][100:140] + source[(d + 1) % 5][:30] for d in range(4)} | {4: ["one", "two"]}
    texts = spark.createDataFrame([*text.items(), (9, None)], "key long, tokens array<string>")
    sources = spark.createDataFrame([(d, t, t[:25] if d else None) for d, t in source.items()], "source long, tokens array<string>, abstract array<string>")
    pairs = verbatim.partners(spark.createDataFrame([("c", d) for d in range(5)], "corpus string, key long"))
    assert {(r["key"], r["source"]) for r in pairs.where("kind = 'other'").collect()} == {(d, (d + 1) % 5) for d in range(5)}
    got = {(r["key"], r["kind"]): r for r in verbatim.overlap(texts, sources, pairs, (3, 8), 3).collect()}

    def grams(t, n):
        return [tuple(t[i : i + n]) for i in range(len(t) - n + 1)]

    for d in range(5):
        for kind, s in (("own", d), ("other", (d + 1) % 5)):
            given = source[s][:25] if s else []
            for n in (3, 8):
                mine = set(grams(text[d], n))
                hit = {g for g in mine if g in set(grams(source[s], n)) - set(grams(given, n))}
                want = 100 * len(hit) / len(mine) if mine else None
                assert got[d, kind][f"share{n}"] == (pytest.approx(want) if want is not None else None)
            best, at, run = 0, 0, 0
            fresh = set(grams(source[s], 3)) - set(grams(given, 3))
            for i, g in enumerate(grams(text[d], 3)):
                run = run + 1 if g in fresh else 0
                if run and run + 2 > best:
                    best, at = run + 2, i - run + 1
            assert got[d, kind]["words"] == best and (got[d, kind]["run"] or "") == " ".join(text[d][at : at + best])


def test_overlap_of_odd_words_moves_texts_only(spark):
    rng = random.Random(9)
    odd = ["", "a", "b", "\x1f", "\x1e", "\x1e2", "\x1e0a", "a\x1f", "é", None, "a b"]
    text = {d: [rng.choice(odd) for _ in range(rng.choice([0, 1, 2, 40, 300]))] for d in range(40)}
    source = {d: text[d][len(text[d]) // 3 :] + [rng.choice(odd) for _ in range(60)] for d in range(40)}
    rows = [(d, t, t[5:30] if d % 3 else None) for d, t in source.items()]
    pairs = [(d, kind, (d + shift) % 41) for d in range(42) for kind, shift in (("own", 0), ("other", 1))]  # one has no source, one no text
    frames = [spark.createDataFrame([*text.items()], "key long, tokens array<string>"), spark.createDataFrame(rows, "source long, tokens array<string>, abstract array<string>"), spark.createDataFrame(pairs, "key long, kind string, source long")]
    out = verbatim.overlap(*frames, (1, 2, 5, 8), 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")]  # n-grams aren't rows of a shuffle
    got = {(r["key"], r["kind"]): r for r in out.collect()}
    assert len(got) == len(pairs)

    def grams(t, n):
        return [tuple(t[i : i + n]) for i in range(len(t) - n + 1)]

    for d, kind, s in pairs:
        t, given = text.get(d, []), (source[s][5:30] if s < 40 and s % 3 else [])
        fresh = {n: set(grams(source.get(s, []), n)) - set(grams(given, n)) for n in (1, 2, 5, 8)}
        for n in (1, 2, 5, 8):
            mine = set(grams(t, n))
            assert got[d, kind][f"share{n}"] == (pytest.approx(100 * len(mine & fresh[n]) / len(mine)) if mine else None)
        best, at, run = 0, 0, 0
        for i, g in enumerate(grams(t, 2)):
            run = run + 1 if g in fresh[2] else 0
            if run and run + 1 > best:
                best, at = run + 1, i - run + 1
        assert got[d, kind]["words"] == best
        assert got[d, kind]["run"] == (" ".join(w for w in t[at : at + best] if w is not None) if best else None)


def unit_rows(n=60, d=5, seed=2):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d))
    v[: n // 3] += 1.0
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    paper = ["hot" if k % 3 == 0 else f"p{k % 7}" for k in range(n)]
    return v, paper, [k < n // 3 for k in range(n)]


def plain_mean(v, paper, idx):
    values = [v[i] @ v[j] for i in idx for j in idx if paper[i] != paper[j]]
    return np.mean(values) if values else np.nan


@pytest.mark.parametrize("paper_rows", [4, 1000])
def test_cohesion_against_all_pairs(spark, paper_rows):
    v, paper, flag = unit_rows()
    n = len(v)
    rows = [(k, flag[k], paper[k], v[k].tolist()) for k in range(n)]
    table = spark.createDataFrame([*rows, (900, None, "x", v[0].tolist()), (901, True, None, v[0].tolist()), (902, True, "x", None)], "k long, f boolean, p string, embedding array<double>").repartition(3)
    got = {(r["label_a"], r["label_b"]): (r["pairs"], r["mean_cosine"]) for r in cohesion.masked_cohesion(table, "f", "p").collect()}
    for a, b in ((False, False), (False, True), (True, True)):
        values = [v[i] @ v[j] for i in range(n) for j in range(n) if flag[i] == a and flag[j] == b and paper[i] != paper[j]]
        assert got[a, b][0] == len(values) and got[a, b][1] == pytest.approx(np.mean(values))
    r = cohesion.cohesion_test(table, "k", "f", "p", replicates=50, seed=3, paper_rows=paper_rows).first()
    drawn = replicates.chosen(np.arange(n), n, sum(flag), 50, 3)
    assert (drawn.sum(1) == sum(flag)).all()
    null = np.array([plain_mean(v, paper, np.flatnonzero(x)) for x in drawn])
    seen = plain_mean(v, paper, np.flatnonzero(flag))
    assert (r["flagged"], r["observed"], r["expected"]) == (sum(flag), pytest.approx(seen), pytest.approx(null.mean()))
    assert r["p"] == pytest.approx((1 + (null >= seen - 1e-12).sum()) / 51)
    assert cohesion.cohesion_test(table.where("p = 'hot'"), "k", "f", "p", replicates=5).first()["observed"] is None
    assert cohesion.cohesion_test(table.limit(0), "k", "f", "p", replicates=5).first()["flagged"] == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 100, 1000])
def test_shuffles_are_permutations(n):
    got = replicates.shuffled_places(np.arange(n), n, 7, 1)
    assert all(sorted(r) == list(range(n)) for r in got.tolist())
    if n == 1000:
        assert len({tuple(r) for r in got.tolist()}) == 7 and abs(np.corrcoef(got[0], np.arange(n))[0, 1]) < 0.1
        many = replicates.chosen(np.arange(n), n, 300, 400, 9)
        assert abs(many.mean(0) - 0.3).max() < 0.12  # every row as often as any other


def test_weights_are_poisson():
    w = replicates.poisson_weights(np.arange(20_000) * 977 - 5_000_000, 3, 4)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and abs((w == 0).mean() - np.exp(-1)) < 0.01 and w.max() >= 6


def test_regressions_are_drawn_by_group(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(40):
        for _ in range(rng.integers(1, 7)):
            x, z = float(rng.integers(0, 2)), float(rng.normal())
            rows.append((g, x, z, 2 * x - z + 0.3 * g + float(rng.normal()), 0.5 * x + float(rng.normal())))
    rows += [(3, None, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0)]
    table = spark.createDataFrame(rows, "g int, x double, z double, y double, w double").repartition(4)
    got = {(r["y"], r["x"]): r for r in replicates.bootstrap_within(table, "g", ["x", "z"], ["y", "w"], 60, 2).collect()}
    groups = defaultdict(list)
    for r in rows:
        if None not in r:
            groups[r[0]].append(r[1:])
    groups = {g: np.array(v) for g, v in groups.items() if len(v) > 1}

    def fit(weights):
        xs = [np.repeat(v[:, :2] - v[:, :2].mean(0), int(w), 0) for (g, v), w in zip(groups.items(), weights, strict=True)]
        ys = [np.repeat(v[:, 2:] - v[:, 2:].mean(0), int(w), 0) for (g, v), w in zip(groups.items(), weights, strict=True)]
        return np.linalg.lstsq(np.vstack(xs), np.vstack(ys), rcond=None)[0]

    hashes = {r["g"]: r["h"] for r in spark.createDataFrame([(g,) for g in groups], "g int").select("g", F.xxhash64("g").alias("h")).collect()}
    weights = replicates.poisson_weights(np.array([hashes[g] for g in groups]), 60, 2)
    boots, whole = np.array([fit(w) for w in weights.astype(int)]), fit(np.ones(len(groups)))
    for i, x in enumerate("xz"):
        for j, y in enumerate("yw"):
            r = got[y, x]
            assert (r["estimate"], r["lower"], r["upper"]) == pytest.approx((whole[i, j], *np.percentile(boots[:, i, j], [2.5, 97.5])))
        r = got["y - w", x]
        assert (r["estimate"], r["lower"], r["upper"]) == pytest.approx((whole[i, 0] - whole[i, 1], *np.percentile(boots[:, i, 0] - boots[:, i, 1], [2.5, 97.5])))
    none = replicates.bootstrap_within(table.limit(0), "g", ["x"], ["y"], 10).first()
    assert none["estimate"] is None and none["lower"] is None


def test_permutation_keeps_the_number_of_flags(spark):
    rows = [(k, float(k % 11), k % 4 == 0) for k in range(80)] + [(100, None, True), (101, 1.0, None)]
    table = spark.createDataFrame(rows, "k long, v double, f boolean").repartition(3)
    r = replicates.permutation_difference(table, "v", "f", "k", 200, 7).first()
    v = np.array([x[1] for x in rows[:80]])
    f = np.array([x[2] for x in rows[:80]])
    seen = v[f].mean() - v[~f].mean()
    null = np.array([v[x == 1].mean() - v[x == 0].mean() for x in replicates.chosen(np.arange(80), 80, f.sum(), 200, 7)])
    assert r["observed"] == pytest.approx(seen) and r["p"] == pytest.approx((1 + (abs(null) >= abs(seen) - 1e-12).sum()) / 201)
    b = replicates.bootstrap_mean(table, "v", "k", 300).first()
    assert b["n"] == 81 and b["lower"] < b["mean"] < b["upper"]
    assert Counter(table.columns)["k"] == 1


def test_tells(spark):
    texts = ["Notably, we unlock a  payoff. It works — and---well.", "The matters  because of it. moreover, no", "plain", None, "notably we"]
    table = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = [tuple(r["m"]) for r in table.orderBy("k").select(tells.measures(F.col("t"), ["we", "it"]).alias("m")).collect()]
    assert got == [(pytest.approx(200 / 9), 2, True, 2, 9), (pytest.approx(100 / 7), 1, True, 0, 7), (0.0, 0, False, 0, 1), (0.0, 0, False, 0, 1), (50.0, 0, False, 0, 2)]
    shown = spark.createDataFrame([("a", "b", None), ("", "b", "c")], "x string, y string, z string").select(tells.shown_text(F.col("x"), F.col("y"), F.col("z"))).collect()
    assert [r[0] for r in shown] == ["a b", "b c"]


def test_tells_model_against_numpy(spark):
    import plain_stats

    rng = np.random.default_rng(8)
    rows, x, y = [], [], []
    for k in range(900):
        stratum = ["big", "mid", "small", "never"][min(3, int(rng.exponential(0.8)))]
        listed, said, initial, n = float(rng.uniform(0, 20)), int(rng.poisson(1)), bool(rng.random() < 0.3), int(rng.integers(5, 200))
        p = 1 / (1 + np.exp(1.5 - 0.1 * listed - 0.4 * np.log1p(said)))
        true = bool(rng.random() < p) and stratum != "never"
        rows.append((stratum, true, (listed, said, initial, 0, n)))
        x.append([1, listed, np.log1p(said), float(initial), np.log(n), float(stratum == "mid"), float(stratum == "small")])
        y.append(float(true))
    table = spark.createDataFrame([*rows, ("big", None, (1.0, 1, True, 0, 5)), (None, True, (1.0, 1, True, 0, 5))], "s string, y boolean, m struct<listed double, phrases long, initial boolean, dashes long, length long>")
    got = {r["term"]: r for r in tells.label_model(table, "y", "s").collect()}
    w, se = plain_stats.logistic(np.array(x), np.array(y))
    assert list(got) == ["listed", "phrases", "initial", "length", "stratum mid", "stratum small"]
    assert [got[t]["coefficient"] for t in got] == pytest.approx(w[1:].tolist(), abs=1e-6) and [got[t]["error"] for t in got] == pytest.approx(se[1:].tolist(), abs=1e-6)
    assert got["listed"]["mean_true"] == pytest.approx(np.mean([r[2][0] for r in rows if r[1]]))


def test_subsequence_bounds_similarity():
    """The bound holds for every pair, and is far under the bag of characters for texts in another order."""
    import random

    from tropelens.operators.revisions import letter_places, most_similar, similarity

    rng = random.Random(4)
    texts = ["", "a", "ab" * 40, "ba" * 40] + ["".join(rng.choice("abcde é\U0001f600") for _ in range(rng.randint(1, 90))) for _ in range(60)]
    for a in texts:
        for b in texts[:20]:
            assert similarity(a, b) <= most_similar(a, len(b), letter_places(b)) <= 1.0
    assert most_similar("abcdefgh", 8, letter_places("hgfedcba")) == 2 / 16


def test_rate_changes_search_a_text_once(spark, monkeypatch):
    """Each version of a text is searched once for each pattern, and its words counted beside it: in no plan more often."""
    made = []
    settled = revisions.settled

    def seen(df):
        spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
        made.append(df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all("))
        spark.conf.unset("spark.sql.debug.maxToStringFields")
        return settled(df)

    monkeypatch.setattr(revisions, "settled", seen)
    pairs = spark.createDataFrame([(1, "a b rather than c", "a b instead of c"), (2, "x y", None), (3, "", "it is so, not as such")], "k long, old string, new string").repartition(2)
    got = {r["pattern_id"]: r for r in revisions.rate_changes(pairs, "old", "new").collect()}
    assert got["rather_than"]["docs"] == 2 and got["rather_than"]["change"] == -100.0 and got["rather_than"]["changed"] == 1
    assert got["instead_of"]["new_rate"] == 100.0 and got["x_not_y"]["changed"] == 1 and got["instead_of"]["rho"] == pytest.approx(-1.0)
    assert sum(made) == 4 * len(PATTERNS)


def test_matches_in_a_row_are_what_all_pairs_give(spark, monkeypatch):
    """Chunks of any size, repeated ids, null and empty versions; rows of sentences aren't made and joined."""
    rng = random.Random(12)
    docs = []
    for doc in range(8):
        old = [a_sentence(rng).capitalize() + "." for _ in range(14)]
        new = [" ".join(rng.choice(WORDS) if rng.random() < 0.2 else w for w in s[:-1].split(" ")).capitalize() + "." if rng.random() < 0.7 else s for s in old]
        rng.shuffle(new)
        docs.append((doc // 2, " ".join(old), " ".join(new + new[:2])))
    docs += [(9, "Trees rather than lists. Yes.", None), (10, None, "Trees rather than lists."), (11, "Trees rather than lists.", ""), (None, "É rather than 😀.", "É rather than x😀.")]
    cut = lambda t: re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", t)
    want = Counter()
    for _, old, new in docs:
        for s in cut(old) if old else []:
            if re.search(r"\brather than\b", s, re.I):
                found = closest_plainly(s, list(enumerate(cut(new))), 0.6) if new else None
                want[found[1] if found else None] += 1
    pairs = spark.createDataFrame(docs, "d long, a string, b string").repartition(3)
    for asked, texts in ((64, 1024), (2, 3)):
        got = Counter(r["match"] for r in revisions.matched_in_row(pairs, "a", "b", PATTERNS[0], 0.6, asked, texts).collect())
        assert got == want and got[None] >= 2
    monkeypatch.setattr(revisions, "closest", None)
    told = {(r["direction"], r["outcome"]): r["n"] for r in revisions.substitutions(pairs, "d", "a", "b").collect()}
    assert told["removed", "sentences"] == sum(want.values()) and told["removed", "unmatched"] == want[None]
