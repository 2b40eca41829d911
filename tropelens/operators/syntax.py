"""Features of parsed sentences. The parser is not part of this library: a parse is a column of tokens in order,

array<struct<at int, text string, tag string, pos string, dep string, head int>>, with `at` the first character and `head` the
place (from 0) of the governing token; a root governs itself. Everything here is column expressions over that array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tropelens.functions.text import let

TOKENS = "array<struct<at int, text string, tag string, pos string, dep string, head int>>"
NOMINAL, VERBAL = ("NOUN", "PROPN", "PRON", "NUM"), ("VERB", "AUX")
SUBJECTS = ("nsubj", "nsubjpass", "csubj")


def placed(tokens: Column) -> Column:
    """The tokens with their place `i` and lower-cased `low`."""
    return F.transform(tokens, lambda t, i: F.struct(i.alias("i"), t["at"].alias("at"), F.lower(t["text"]).alias("low"), t["text"].alias("text"), t["tag"].alias("tag"), t["pos"].alias("pos"), t["dep"].alias("dep"), t["head"].alias("head")))


def first(tokens: Column, keep) -> Column:
    return F.get(F.filter(tokens, keep), F.lit(0))


def participle_contrast(tokens: Column, start: Column) -> Column:
    """(x, y): the past participles directly before `rather` and after `than`, from character `start` on; else null."""

    def around(t: Column, i: Column) -> Column:
        x, than, y = (F.when(i + k >= 0, F.get(t, i + k)) for k in (-1, 1, 2))
        return F.when((than["low"] == "than") & (x["tag"] == "VBN") & (y["tag"] == "VBN"), F.struct(x["text"].alias("x"), y["text"].alias("y")))

    return let(placed(tokens), lambda t: let(first(t, lambda k: (k["at"] >= start) & (k["low"] == "rather"))["i"], lambda i: around(t, i)))


def root_of(t: Column) -> Column:
    return first(t, lambda k: k["head"] == k["i"])


def subject_of(t: Column, root: Column) -> Column:
    """The kind of the subject that hangs from token `root` of placed tokens: none, we, our-NP, other pronoun or NP."""

    def kind(s: Column) -> Column:
        ours = F.exists(t, lambda k: (k["head"] == s["i"]) & (k["low"] == "our") & (k["dep"] == "poss"))
        return F.when(s.isNull(), "none").when(s["low"] == "we", "we").when(ours, "our-NP").when(s["pos"] == "PRON", "other pronoun").otherwise("NP")

    return let(first(t, lambda k: (k["head"] == root) & (k["i"] != root) & k["dep"].isin(*SUBJECTS)), kind)


def subject_type(tokens: Column) -> Column:
    """The main clause's subject: none, we, our-NP, other pronoun or NP."""
    return let(placed(tokens), lambda t: let(root_of(t)["i"], lambda root: subject_of(t, root)))


def span_head(tokens: Column, start: Column, end: Column) -> Column:
    """The first token of a character span that is governed from outside it (or is a root)."""

    def outermost(span: Column) -> Column:
        ends = F.struct(F.get(span, F.lit(0))["i"].alias("a"), F.try_element_at(span, F.lit(-1))["i"].alias("b"))
        return let(ends, lambda e: first(span, lambda k: ~k["head"].between(e["a"], e["b"]) | (k["head"] == k["i"])))

    return let(F.filter(placed(tokens), lambda k: (k["at"] < end) & (k["at"] + F.length(k["text"]) > start)), outermost)


def phrase_type(tokens: Column, start: Column, end: Column) -> Column:
    """NP, VP, VP-ing, AdjP, PP or other, by the head of a character span."""

    def kind(h: Column) -> Column:
        verbal = F.when(h["tag"] == "VBG", "VP-ing").otherwise("VP")
        return F.when(h["pos"].isin(*NOMINAL), "NP").when(h["pos"].isin(*VERBAL), verbal).when(h["pos"] == "ADJ", "AdjP").when(h["pos"] == "ADP", "PP").otherwise("other")

    return let(span_head(tokens, start, end), kind)


def sentence_patterns(tokens: Column) -> Column:
    """array<string>, each once: tag:T, dep:D and arc:H-D->T of every token that has a governor, root:T and subj:S."""

    def found(t: Column) -> Column:
        governed = F.filter(t, lambda k: k["head"] != k["i"])
        parts = [
            F.transform(t, lambda k: F.concat(F.lit("tag:"), k["tag"])),
            F.transform(governed, lambda k: F.concat(F.lit("dep:"), k["dep"])),
            F.transform(governed, lambda k: F.concat(F.lit("arc:"), F.get(t, k["head"])["tag"], F.lit("-"), k["dep"], F.lit("->"), k["tag"])),
            let(root_of(t), lambda r: F.array(F.concat(F.lit("root:"), r["tag"]), F.concat(F.lit("subj:"), subject_of(t, r["i"])))),
        ]
        return F.array_compact(F.array_distinct(F.concat(*parts)))

    return let(placed(tokens), found)


def doubled(heads: Column, values: Column, combine) -> Column:
    """values with each token's own combined with those of all tokens above it, by pointer doubling: after k rounds a token
    has met 2^k of them, so a sentence of n tokens takes about log2(n) rounds, however deep its tree is.

    combine(a, b) has to be associative, and a root's value is met again in further rounds: it has to be neutral then.
    """

    def step(s: Column, _: Column) -> Column:
        values = F.transform(s["v"], lambda x, i: combine(x, F.get(s["v"], F.get(s["jump"], i))))
        return F.struct(F.transform(s["jump"], lambda j: F.get(s["jump"], j)).alias("jump"), values.alias("v"))

    rounds = F.sequence(F.lit(0), F.length(F.bin(F.size(heads))))
    return F.aggregate(rounds, F.struct(heads.alias("jump"), values.alias("v")), step, lambda s: s["v"])


def trees(tokens: Column) -> Column:
    """Placed tokens with `depth` (a root's is 0) and `top`, the root above. A head outside the sentence makes a root."""

    def deepened(t: Column) -> Column:
        heads = F.transform(t, lambda k: F.when(k["head"].between(0, F.size(t) - 1), k["head"]).otherwise(k["i"]))

        def with_heads(h: Column) -> Column:
            depth = doubled(h, F.transform(h, lambda x, i: F.when(x == i, 0).otherwise(1)), lambda a, b: a + b)
            both = F.struct(depth.alias("depth"), doubled(h, h, lambda a, b: b).alias("top"))
            return let(both, lambda b: F.transform(t, lambda k: k.withField("head", F.get(h, k["i"])).withField("depth", F.get(b["depth"], k["i"])).withField("top", F.get(b["top"], k["i"]))))

        return let(heads, with_heads)

    return let(placed(tokens), deepened)


def is_mark(k: Column) -> Column:
    return k["text"].rlike(r"^\p{P}+$")


def contrast_places(t: Column, start: Column) -> Column:
    """struct(than, x, y): the places of `than` from character `start` on, and of the heads of X and Y; null without both.

    X is what `than` hangs from. Y is the first word that hangs from `than`, or a later conjunct of X; where the parse has
    neither, the highest word of the stretch after `than` (up to a stop or a coordinator), and X may be `than` itself.
    """

    def around(than: Column) -> Column:
        above = F.get(t, than)["head"]
        x = F.when(above != than, above)
        below = first(t, lambda k: (k["head"] == than) & (k["i"] != than) & (k["low"] != "rather") & ~is_mark(k))["i"]
        later = first(t, lambda k: (k["head"] == x) & (k["i"] != x) & (k["i"] > than) & (k["dep"] == "conj"))["i"]
        stops = first(t, lambda k: (k["i"] > than) & (k["text"].isin(";", ".", ":") | ((k["dep"] == "cc") & (k["i"] > than + 1))))["i"]

        def found(p: Column) -> Column:
            after = F.filter(t, lambda k: (k["i"] > than) & (k["i"] < p["stop"]) & ~is_mark(k))
            highest = F.array_min(F.transform(after, lambda k: F.struct(k["depth"].alias("depth"), k["i"].alias("i"))))["i"]
            y = F.coalesce(p["y"], highest)
            x = F.coalesce(p["x"], F.when(p["y"].isNull(), than))
            return F.when(x.isNotNull() & y.isNotNull(), F.struct(than.alias("than"), x.alias("x"), y.alias("y")))

        return let(F.struct(x.alias("x"), F.coalesce(below, later).alias("y"), F.coalesce(stops, F.size(t)).alias("stop")), found)

    return let(first(t, lambda k: (k["low"] == "than") & (k["at"] >= start))["i"], around)


def contrast_spans(t: Column, places: Column) -> Column:
    """struct(x, y) of the tokens of X and Y: subtrees of their heads, X without what belongs to `than` or Y and without
    conjuncts after `than`. Null places give nulls."""

    def spans(p: Column) -> Column:
        own = F.transform(t, lambda k: (k["i"] == p["x"]).cast("int") + (k["i"] == p["y"]).cast("int") * 2 + (k["i"] == p["than"]).cast("int") * 4)
        above = doubled(F.transform(t, lambda k: k["head"]), own, lambda a, b: a.bitwiseOR(b))

        def cut(bits: Column) -> Column:
            x = F.filter(t, lambda k: (F.get(bits, k["i"]) == 1) & ~((k["dep"] == "conj") & (k["i"] > p["than"])))
            return F.struct(x.alias("x"), F.filter(t, lambda k: F.get(bits, k["i"]).bitwiseAND(2) > 0).alias("y"))

        return F.when(p.isNotNull(), let(above, cut))

    return let(places, spans)


def head_in(span: Column) -> Column:
    """The first token of a span that nothing else in the span governs."""
    return let(F.transform(span, lambda k: k["i"]), lambda ids: first(span, lambda k: ~F.array_contains(ids, k["head"]) | (k["head"] == k["i"])))


def head_kind(h: Column) -> Column:
    verbal = F.when(h["tag"] == "VBG", "VP-ing").otherwise("VP")
    return F.when(h["pos"].isin(*NOMINAL), "NP").when(h["pos"].isin(*VERBAL), verbal).when(h["pos"] == "ADJ", "AdjP").when(h["pos"] == "ADP", "PP").otherwise("other")


def contrast_parts(tokens: Column, start: Column) -> Column:
    """struct(t, spans, hx, hy, root): the tree, X and Y, their heads, and the root of the clause that begins at `start`."""

    def with_tree(t: Column) -> Column:
        def with_spans(s: Column) -> Column:
            here = F.coalesce(first(t, lambda k: k["at"] >= start), F.get(t, F.lit(0)))
            return F.struct(t.alias("t"), s.alias("spans"), head_in(s["x"]).alias("hx"), head_in(s["y"]).alias("hy"), F.get(t, here["top"]).alias("root"))

        return let(contrast_spans(t, contrast_places(t, start)), with_spans)

    return let(trees(tokens), with_tree)


def contrast_features(tokens: Column, start: Column, lead: Column) -> Column:
    """struct of a sentence with the construction at character `start`, `lead` being the text before it: initial, cat_x, cat_y,
    len_x, len_y, parallel, subj, passive, modal, negation, sent_len, depth. Without X and Y their lengths are 0 and their
    categories `other`; an empty parse has no subject and depth 0."""

    def features(p: Column) -> Column:
        t = p["t"]
        cat = {n: F.when(p[f"h{n}"].isNull(), "other").otherwise(head_kind(p[f"h{n}"])) for n in "xy"}
        word = F.filter(t, lambda k: ~is_mark(k) & (F.trim(k["text"]) != ""))
        return F.struct(
            (~lead.rlike("[A-Za-z0-9]")).alias("initial"),
            cat["x"].alias("cat_x"),
            cat["y"].alias("cat_y"),
            *(F.coalesce(F.when(p["spans"].isNotNull(), F.size(p["spans"][n])), F.lit(0)).alias(f"len_{n}") for n in "xy"),
            (cat["x"] == cat["y"]).alias("parallel"),
            subject_of(t, p["root"]["i"]).alias("subj"),
            F.exists(t, lambda k: (k["head"] == p["root"]["i"]) & (k["i"] != p["root"]["i"]) & k["dep"].isin("nsubjpass", "auxpass")).alias("passive"),
            F.exists(t, lambda k: k["tag"] == "MD").alias("modal"),
            F.exists(t, lambda k: k["dep"] == "neg").alias("negation"),
            F.size(word).alias("sent_len"),
            F.coalesce(F.array_max(F.transform(t, lambda k: k["depth"])), F.lit(0)).alias("depth"),
        )

    return let(contrast_parts(tokens, start), features)


def contrast_patterns(tokens: Column, start: Column, lead: Column) -> Column:
    """array<string>, each once: what sentence_patterns finds (root and subject of the clause at `start`), and pos:initial,
    frame:than=dep<-head's tag, frame:rather=..., X:tag=, X:dep=, Y:tag=, Y:dep= and XY:tag/tag."""

    def found(p: Column) -> Column:
        t = p["t"]

        def frame(name: str, k: Column) -> Column:
            return F.concat(F.lit(f"frame:{name}="), k["dep"], F.lit("<-"), F.get(t, k["head"])["tag"])

        than = first(t, lambda k: (k["low"] == "than") & (k["at"] >= start))
        rather = first(t, lambda k: (k["low"] == "rather") & (k["at"] >= start - 1))
        own = [F.when(~lead.rlike("[A-Za-z0-9]"), "pos:initial"), let(than, lambda k: frame("than", k)), let(rather, lambda k: frame("rather", k))]
        for name, h in (("X", p["hx"]), ("Y", p["hy"])):
            own += [F.concat(F.lit(f"{name}:tag="), h["tag"]), F.concat(F.lit(f"{name}:dep="), h["dep"])]
        own += [F.concat(F.lit("XY:"), p["hx"]["tag"], F.lit("/"), p["hy"]["tag"]), F.concat(F.lit("root:"), p["root"]["tag"]), F.concat(F.lit("subj:"), subject_of(t, p["root"]["i"]))]
        kept = F.filter(t, lambda k: F.trim(k["text"]) != "")
        governed = F.filter(kept, lambda k: k["head"] != k["i"])
        parts = [
            F.transform(kept, lambda k: F.concat(F.lit("tag:"), k["tag"])),
            F.transform(governed, lambda k: F.concat(F.lit("dep:"), k["dep"])),
            F.transform(governed, lambda k: F.concat(F.lit("arc:"), F.get(t, k["head"])["tag"], F.lit("-"), k["dep"], F.lit("->"), k["tag"])),
        ]
        return F.array_compact(F.array_distinct(F.concat(F.array(*own), *parts)))

    return let(contrast_parts(tokens, start), found)


def pattern_shares(rows: DataFrame, flag: str, tokens: str = "tokens", least: int = 1, patterns: Column | None = None) -> DataFrame:
    """Per pattern: sentences with it among the flagged and among the others, and both totals (from one more row, '')."""
    patterns = sentence_patterns(F.col(tokens)) if patterns is None else patterns
    each = rows.select(F.col(flag).cast("boolean").alias("f"), F.explode(F.array_union(patterns, F.array(F.lit("")))).alias("pattern"))
    sums = each.groupBy("pattern").agg(F.sum(F.col("f").cast("long")).alias("flagged"), F.sum((~F.col("f")).cast("long")).alias("others"))
    return sums.where((F.col("flagged") + F.col("others") >= least) | (F.col("pattern") == ""))
