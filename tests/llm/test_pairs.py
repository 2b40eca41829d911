"""N-gram join, decontamination, licences: against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from helpers import docs, empty, prose

from tropelens.llm import decontaminate, licenses, ngram_join
from tropelens.llm.components import connected_components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def found(df):
    return [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()]


def test_hard_cases(spark):
    table, rows = docs(spark)
    got = found(ngram_join.near_duplicates(table))
    want = brute_components([(i, t) for i, t, *_ in rows])
    assert Counter(got) == Counter((i, len(shingles(t)), want.get(i)) for i, t, *_ in rows)
    assert want[21] == 0 and want[27] == 26


def test_empty(spark):
    assert ngram_join.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("hot", [50_000, 3])
def test_chains_and_borders(spark, hot):
    """Families of edited copies, many near the threshold; once with every bucket treated as hot."""
    rng = random.Random(8)
    rows = []
    for family in range(12):
        text = prose(rng, rng.randint(8, 120)).split()
        for _ in range(8):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(copy) // 18))):
                copy[rng.randrange(len(copy))] = f"w{rng.randint(0, 99)}"
            if rng.random() < 0.3:
                text = copy  # chains
            rows.append((len(rows) * 3 + 1, " ".join(copy)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    assert {i: c for i, _, c in found(ngram_join.near_duplicates(table, hot_entries=hot, salts=3))} == want


def test_all_links(spark):
    rng = random.Random(4)
    base = prose(rng, 80).split()
    rows = []
    for k in range(14):
        copy = list(base)
        for _ in range(k // 4):
            copy[rng.randrange(len(copy))] = f"w{rng.randint(0, 999)}"
        rows.append((k, " ".join(copy)))
    members, links = ngram_join.all_links(spark.createDataFrame(rows, "doc_id long, text string"))
    of = {r["id"]: r["class"] for r in members.collect()}
    sets = {i: shingles(t) for i, t in rows}
    want = {tuple(sorted((of[i], of[j]))) for i in sets for j in sets if of[i] != of[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    got = [tuple(sorted((r["a"], r["b"]))) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)} | {200: 200, 201: 200}


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(text, items, width=10):
    words, hit, names = alnum(text), set(), set()
    for item, body in items:
        w = alnum(body)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            win = w[k : k + width]
            for at in range(len(words) - len(win) + 1):
                if words[at : at + len(win)] == win:
                    hit.update(range(at, at + len(win)))
                    names.add(str(item))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [1 << 20, 5])
def test_decontamination(spark, block):
    rng = random.Random(5)
    few = ["aa", "bb", "cc", "dd"]
    items = [(1, prose(rng, 25)), (2, prose(rng, 12, few)), (10, "Short, one!"), (3, ""), (4, None), (5, prose(rng, 10)), (6, "x")]
    table, rows = docs(spark)
    planted = [(100 + k, f"{prose(rng, 8)} {t.upper()}; {prose(rng, 8)} {t}", "en", "s0") for k, (_, t) in enumerate(items) if t]
    planted += [(200, prose(rng, 300, few), None, None), (201, " ".join(items[0][1].split()[3:13]), "en", "s")]
    full = [(*r, 0, 1.0, None, 1, 1, "") for r in planted]
    table = table.union(spark.createDataFrame(full, table.schema))
    got = decontaminate.contamination(table, spark.createDataFrame(items, "item_id long, text string"), block_windows=block)
    assert {"lang", "source", "text"} <= set(got.columns)
    want = Counter((i, *brute_hits(t, items)) for i, t, *_ in rows + planted)
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got.collect()) == want


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(empty(spark), none).count() == 0
    table, rows = docs(spark)
    assert decontaminate.contamination(table, none).where("contaminated").count() == 0


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, item), (2, item.replace("gamma", "gamma of")), (3, "beta alpha")]
    got = {r["doc_id"]: (r["n_hit"], r["n_near"]) for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: (10, 0), 2: (0, 1), 3: (0, 0)}


@pytest.mark.parametrize("block", [1 << 20, 1])
def test_proximity_over_all_terms(spark, block):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    w = item.split()
    changed = [(k, " ".join(["so", *w[:k], "other", *w[k + 1 :], "on"])) for k in range(10)]
    more = [(20, "x " + item), (21, "so alpha beta gamma delta of the epsilon zeta eta theta iota kappa"), (22, "alpha beta one two three four five six seven eight"), (23, " ".join(reversed(w))), (24, " ".join([*w[:3], "one", "two", "three", *w[6:]]))]
    docs_ = spark.createDataFrame(changed + more, "doc_id long, text string")
    out = decontaminate.contamination(docs_, spark.createDataFrame([(1, item), (2, item)], "item_id long, text string"), block_windows=block)
    got = {r["doc_id"]: r for r in out.collect()}
    for k in range(10):
        assert got[k]["near_items"] == ["1", "2"] and got[k]["near_spans"] == [1 + (k == 0), 11 - (k == 9)] and got[k]["n_hit"] == 0
    assert got[20]["near_items"] == [] and got[20]["near_spans"] == [] and got[20]["n_hit"] == 10
    assert got[21]["near_items"] == ["1", "2"] and got[21]["near_spans"] == [1, 13]
    assert all(got[k]["near_items"] == [] and got[k]["near_spans"] == [] for k in (22, 23, 24))
    assert got[21]["n_near"] == 1  # a window of two blocks counts once


def test_licenses(spark):
    table, rows = docs(spark)
    extra = [
        (300, "Released under the MIT License. mit\nlicense", "en", "s"),
        (301, "Licensed under the Apache License, Version 2.0. GNU General-Public License", None, None),
        (302, "licensed under CC BY-NC 4.0 and mit-licensed", "en", "s"),
    ]
    table = table.union(spark.createDataFrame([(*r, 0, 1.0, None, 1, 1, "") for r in extra], table.schema))
    got = licenses.license_scan(table).collect()

    def want(i, text):
        w, at, labels = alnum(text), [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            places = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += places
            labels |= {label} if places else set()
        return i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))

    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == Counter(want(i, t) for i, t, *_ in rows + extra)
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in got}
    assert labels[300] == ("mit,mit-notice", 1.0) and labels[28] == ("mit", 0.5) and labels[24] == ("", 0.0)
    assert labels[301] == ("apache,apache-2.0-notice,gpl", 1.0) and labels[302] == ("cc-by,cc-by-notice", 1.0)
    assert licenses.license_scan(empty(spark)).count() == 0


def test_template_regions():
    """Widths are counted in characters; tags may have attributes."""
    a = licenses.compile_template("t", 'may <<beginOptional;name="n">>not<<endOptional>> copy <<var;name="v";original="it";match=".{1,9}">> freely')
    match = lambda s: a.match(licenses.Words(s.encode()), 0)
    assert match("may copy it freely now") == 4
    assert match("may not copy all of it freely") == 7
    assert match("may copy freely") is None
    assert match("may copy all of those freely") is None
    assert match("may not not copy it freely") is None
    assert match("may copy éééé éééé freely") == 5
    for wrong in ("a <<beginOptional>> b", "a <<endOptional>>", "a <<var;name=x>>", "a <<other>> b"):
        with pytest.raises(ValueError):
            licenses.compile_template("t", wrong)
