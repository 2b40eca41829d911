"""Trees, X and Y, features and frames, against plain walks over the tree."""

import random
import re

from pyspark.sql import functions as F

from tropelens.operators import syntax

WORDS = ["Rather", "rather", "than", "we", "our", "it", "models", "fail", "running", ",", ";", ".", "good", "in", "must", "not"]
DEPS = ["nsubj", "nsubjpass", "auxpass", "conj", "cc", "pobj", "neg", "poss", "dep"]


def sentence(rng, n):
    root, order = rng.randrange(n), list(range(n))
    rng.shuffle(order)
    order.remove(root)
    placed, head = [root], {root: root}
    for i in order:  # any tree: every token hangs from one that was placed before
        head[i] = rng.choice(placed[-4:] if rng.random() < 0.7 else placed)
        placed.append(i)
    at, out = 0, []
    for i in range(n):
        w = "than" if i == n // 2 and rng.random() < 0.8 else rng.choice(WORDS)
        out.append((at, w, rng.choice(["VBG", "VBN", "NN", "MD", "IN"]), rng.choice(["NOUN", "VERB", "ADJ", "ADP", "PRON", "ADV"]), "ROOT" if i == root else rng.choice(DEPS), head[i]))
        at += len(w) + 1
    return out


class Plain:
    def __init__(self, tokens, start):
        self.t, self.start, self.n = tokens, start, range(len(tokens))
        self.than = next((i for i in self.n if tokens[i][1].lower() == "than" and tokens[i][0] >= start), None)

    def chain(self, i):
        out = [i]
        while self.t[i][5] != i:
            i = self.t[i][5]
            out.append(i)
        return out

    def under(self, h):
        return {i for i in self.n if h in self.chain(i)}

    def children(self, h):
        return [i for i in self.n if self.t[i][5] == h and i != h]

    def mark(self, i):
        return re.fullmatch(r"[,;.]+", self.t[i][1]) is not None

    def spans(self):
        t, than = self.t, self.than
        if than is None:
            return None
        x = t[than][5] if t[than][5] != than else None
        y = next((i for i in self.children(than) if t[i][1].lower() != "rather" and not self.mark(i)), None)
        if y is None and x is not None:
            y = next((i for i in self.children(x) if t[i][4] == "conj" and i > than), None)
        if y is None:
            rest = []
            for i in range(than + 1, len(t)):
                if t[i][1] in (";", ".", ":") or (t[i][4] == "cc" and i > than + 1):
                    break
                rest += [] if self.mark(i) else [i]
            if rest:
                y = min(rest, key=lambda i: (len(self.chain(i)), i))
                x = than if x is None else x
        if x is None or y is None:
            return None
        ys = self.under(y)
        return sorted(self.under(x) - ys - self.under(than) - {i for i in self.n if t[i][4] == "conj" and i > than}), sorted(ys)

    def head(self, span):
        return next((i for i in span if self.t[i][5] not in span or self.t[i][5] == i), None)

    def kind(self, i):
        tag, pos = self.t[i][2:4]
        return {"NOUN": "NP", "PRON": "NP", "VERB": "VP-ing" if tag == "VBG" else "VP", "ADJ": "AdjP", "ADP": "PP"}.get(pos, "other")

    def subject(self, root):
        s = next((i for i in self.children(root) if self.t[i][4] in ("nsubj", "nsubjpass", "csubj")), None)
        if s is None:
            return "none"
        if self.t[s][1].lower() == "we":
            return "we"
        if any(self.t[c][1].lower() == "our" and self.t[c][4] == "poss" for c in self.children(s)):
            return "our-NP"
        return "other pronoun" if self.t[s][3] == "PRON" else "NP"

    def features(self, lead):
        t = self.t
        x, y = self.spans() or ([], [])
        cats = ["other" if self.head(s) is None else self.kind(self.head(s)) for s in (x, y)]
        root = self.chain(next((i for i in self.n if t[i][0] >= self.start), 0))[-1]
        kids = {t[c][4] for c in self.children(root)}
        return (not re.search("[A-Za-z0-9]", lead), *cats, len(x), len(y), cats[0] == cats[1], self.subject(root), bool(kids & {"nsubjpass", "auxpass"}), any(k[2] == "MD" for k in t), any(k[4] == "neg" for k in t), sum(not self.mark(i) for i in self.n), max(len(self.chain(i)) - 1 for i in self.n))

    def patterns(self, lead):
        t = self.t
        out = set() if re.search("[A-Za-z0-9]", lead) else {"pos:initial"}
        rather = next((i for i in self.n if t[i][1].lower() == "rather" and t[i][0] >= self.start - 1), None)
        for name, i in (("than", self.than), ("rather", rather)):
            if i is not None:
                out.add(f"frame:{name}={t[i][4]}<-{t[t[i][5]][2]}")
        heads = [self.head(s) for s in self.spans() or ([], [])]
        for name, h in zip("XY", heads, strict=True):
            if h is not None:
                out |= {f"{name}:tag={t[h][2]}", f"{name}:dep={t[h][4]}"}
        if None not in heads:
            out.add("XY:" + "/".join(t[h][2] for h in heads))
        root = self.chain(next((i for i in self.n if t[i][0] >= self.start), 0))[-1]
        out |= {f"root:{t[root][2]}", f"subj:{self.subject(root)}"}
        for i in self.n:
            out.add(f"tag:{t[i][2]}")
            if t[i][5] != i:
                out |= {f"dep:{t[i][4]}", f"arc:{t[t[i][5]][2]}-{t[i][4]}->{t[i][2]}"}
        return out


def test_against_plain_walks(spark):
    rng, rows = random.Random(8), []
    for k in range(250):
        tokens = sentence(rng, rng.choice([1, 2, 3, 8, 15, 33]))
        start = rng.choice([0, 0, tokens[len(tokens) // 3][0], tokens[-1][0]])
        rows.append((k, tokens, start, " ".join(x[1] for x in tokens)[:start]))
    table = spark.createDataFrame(rows, f"id long, tokens {syntax.TOKENS}, start int, lead string")
    t, start, lead = F.col("tokens"), F.col("start"), F.col("lead")
    tree = syntax.trees(t)
    spans = syntax.contrast_spans(tree, syntax.contrast_places(tree, start))
    got = {r["id"]: r for r in table.select("id", spans.alias("s"), syntax.contrast_features(t, start, lead).alias("f"), syntax.contrast_patterns(t, start, lead).alias("p"), F.transform(tree, lambda k: F.struct(k["depth"], k["top"])).alias("d")).collect()}
    found = 0
    for k, tokens, start, lead in rows:
        plain, r = Plain(tokens, start), got[k]
        want = plain.spans()
        found += want is not None
        assert (r["s"] and ([x["i"] for x in r["s"]["x"]], [x["i"] for x in r["s"]["y"]])) == want
        assert [tuple(x) for x in r["d"]] == [(len(plain.chain(i)) - 1, plain.chain(i)[-1]) for i in plain.n]
        assert tuple(r["f"]) == plain.features(lead)
        assert set(r["p"]) == plain.patterns(lead) and len(r["p"]) == len(set(r["p"]))
    assert found > 60


def test_hard_parses(spark):
    rows = [(1, [], 0, ""), (2, None, 0, ""), (3, [(0, "than", "IN", "ADP", "ROOT", 0)], 0, ""), (4, [(0, "a", "DT", "DET", "det", 9), (2, "than", "IN", "ADP", "prep", -1)], 0, None)]
    rows.append((5, [(0, "than", "IN", "ADP", "prep", 0)] + [(5 + 2 * i, "x", "NN", "NOUN", "dep", i) for i in range(500)], 0, ""))
    table = spark.createDataFrame(rows, f"id long, tokens {syntax.TOKENS}, start int, lead string")
    t, start, lead = F.col("tokens"), F.col("start"), F.col("lead")
    got = {r["id"]: r["f"] for r in table.select("id", syntax.contrast_features(t, start, lead).alias("f")).collect()}
    assert got[1]["depth"] == 0 and got[1]["subj"] == "none" and got[1]["sent_len"] == 0
    assert got[3]["len_x"] == got[3]["len_y"] == 0 and got[3]["cat_x"] == "other" and got[5]["depth"] == 500 and got[5]["len_y"] == 0
    assert table.select(F.size(syntax.contrast_patterns(t, start, lead))).count() == 5
