"""Column functions over texts: sentences, tokens, n-grams, redaction, cutting, classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Expressions of sentence ends, tokens and the placeholder.
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9])"
SENTENCE_END_WIDE = r"(?<=[.!?])\s+(?=[A-Z0-9\[(])"
LEX_TOKEN = r"[a-z0-9]+(?:[-'][a-z0-9]+)*|[^\sa-z0-9]"
AZ_TOKEN = r"[a-z]+(?:'[a-z]+)?"
PLACEHOLDER = "[redacted]"

# Licences by the first expression that is found, in this order.
LICENSES = [
    ("MIT", r"\bMIT License\b"),
    ("Apache-2.0", r"Apache License[,\s]+Version 2\.0"),
    ("BSD-3-Clause", r"(?s)Redistributions of source code must retain.*3\. Neither the name"),
    ("BSD-2-Clause", r"Redistributions of source code must retain"),
    ("GPL-3.0", r"GNU GENERAL PUBLIC LICENSE\s*\n*\s*Version 3"),
    ("GPL-2.0", r"GNU GENERAL PUBLIC LICENSE\s*\n*\s*Version 2"),
    ("LGPL", r"GNU LESSER GENERAL PUBLIC LICENSE"),
    ("AGPL", r"GNU AFFERO GENERAL PUBLIC LICENSE"),
    ("MPL-2.0", r"Mozilla Public License.*2\.0"),
    ("CC-BY-NC", r"Attribution-NonCommercial"),
    ("CC-BY", r"Creative Commons Attribution"),
    ("Unlicense", r"This is free and unencumbered software"),
    ("ISC", r"Permission to use, copy, modify, and(?:/or)? distribute this software"),
]

# Headings by section category.
SECTIONS = {
    "introduction": ["introduction"],
    "related_work": ["related work", "related works", "prior work", "background", "background and related work", "related work and background"],
    "method": ["method", "methods", "methodology", "approach", "approaches", "model", "our approach", "our method", "proposed method", "proposed approach", "system description", "our model"],
    "preliminaries": ["preliminaries", "preliminary", "problem formulation", "problem statement", "task formulation", "notation"],
    "experiments": ["experiments", "experiment", "experimental setup", "experimental settings", "experimental design", "setup", "experiment setup", "evaluation setup", "experiments and results"],
    "results": ["results", "results and discussion", "results and analysis", "experimental results", "findings", "evaluation results", "main results", "additional results", "additional experimental results"],
    "analysis": ["analysis", "discussion", "error analysis", "qualitative analysis"],
    "conclusion": ["conclusion", "conclusions", "conclusion and future work", "conclusions and future work", "summary", "summary and conclusion", "discussion and conclusion", "discussion and conclusions"],
    "limitations": ["limitations", "limitation"],
    "ethics": ["ethics statement", "ethical considerations", "broader impact", "broader impacts", "impact statement", "ethics", "broader impact statement"],
    "acknowledgments": ["acknowledgments", "acknowledgements", "acknowledgment", "acknowledgement"],
    "author_contributions": ["author contributions", "contributions", "authors' contributions"],
    "references": ["references", "bibliography", "reference"],
    "appendix": ["appendix", "appendices", "supplementary material", "supplementary materials", "appendix a"],
}


def squeezed(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def sentences(text: Column, end: str = SENTENCE_END) -> Column:
    return F.split(text, end)


def lex_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(LEX_TOKEN), F.lit(0))


def az_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(AZ_TOKEN), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams as strings, in order, repeats included; none for fewer than n tokens."""
    grams = F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def redact_refs(text: Column) -> Column:
    """LaTeX references and citations -> a placeholder."""
    text = F.regexp_replace(text, r"\\(?:[Cc]ref|eqref|autoref|pageref|nameref|ref)\*?\{[^{}]*\}", PLACEHOLDER)
    return F.regexp_replace(text, r"\\[Cc]ite\w*\*?(?:\[[^\]]*\]){0,2}\{[^{}]*\}", PLACEHOLDER)


def redact_gaps(text: Column) -> Column:
    """Runs of two or more blanks inside a line -> a placeholder between single spaces."""
    return F.regexp_replace(text, r"(?<=\S)[ \t]{2,}(?=\S)", f" {PLACEHOLDER} ".replace("[", r"\[").replace("]", r"\]"))


def strip_references(text: Column) -> tuple[Column, Column]:
    """(text before the last line that is only References, Reference or Bibliography, with or without a dot; whether there was one). A form feed
    ends a line as a newline does."""
    head = F.regexp_extract(text, r"(?is)^(.*(?:^|[\n\f]))[ \t]*(?:references?|bibliography)\.?[ \t]*(?:[\n\f]|$)", 1)
    cut = F.coalesce(text.rlike(r"(?is)(?:^|[\n\f])[ \t]*(?:references?|bibliography)\.?[ \t]*(?:[\n\f]|$)"), F.lit(False))
    return F.when(cut, head).otherwise(text), cut


def without_version(doc_id: Column) -> Column:
    return F.regexp_replace(doc_id, r"_v\d+$", "")


def version_of(doc_id: Column) -> Column:
    return F.nullif(F.regexp_extract(doc_id, r"_v(\d+)$", 1), F.lit("")).cast("int")


def license_of(text: Column) -> Column:
    """The first licence found; null text: NO_LICENSE_FILE; nothing found: unrecognized_license_text."""
    found = F.coalesce(*(F.when(text.rlike(f"(?i){rx}"), F.lit(name)) for name, rx in LICENSES))
    return F.when(text.isNull(), F.lit("NO_LICENSE_FILE")).otherwise(F.coalesce(found, F.lit("unrecognized_license_text")))


# Letter words, Latin words, and the characters of scripts that are written without spaces.
LETTER_WORD = r"\p{L}{2,}"
LATIN_WORD = "[A-Za-z]{2,}"
CJK = r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]"
#: Frequent English words; the default detector calls a chunk English if they are a tenth of its words.
FUNCTION_WORDS = "a an and are as at be been but by for from had has have he in is it its not of on or that the their they this to was we were which with".split()


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: inside a lambda it would be computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def by_function_words(chunk: Column) -> Column:
    """Stand-in for a language detector: en or other; null for a chunk without words. Function words are whole runs of letters
    of any script (what a word boundary is differs between engines)."""
    words, common = F.regexp_count(chunk, F.lit(LETTER_WORD + "|[A-Za-z]")), F.regexp_count(F.lower(chunk), F.lit(rf"(?<!\p{{L}})(?:{'|'.join(FUNCTION_WORDS)})(?!\p{{L}})"))
    return F.when(words > 0, F.when(10 * common >= words, F.lit("en")).otherwise(F.lit("other")))


def prose_chunks(text: Column, least_words: int = 30, most: int = 30) -> Column:
    """array<string>: paragraphs of at least so many letter words that make up over half of their characters; of more than
    `most` those at the places int(i * n / most), evenly spaced. Null text: null."""

    def long_enough(p: Column, words: Column) -> Column:
        return (F.size(words) >= least_words) & (F.length(F.array_join(words, "")) > 0.5 * F.length(F.regexp_replace(p, r"^\s+|\s+$", "")))

    def spaced(kept: Column) -> Column:
        places = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (F.size(kept) / most)).cast("int"))
        return F.when(F.size(kept) > most, F.transform(places, lambda i: F.get(kept, i))).otherwise(kept)

    kept = F.filter(F.split(text, r"\n\s*\n"), lambda p: let(F.regexp_extract_all(p, F.lit(LETTER_WORD), F.lit(0)), lambda words: long_enough(p, words)))
    return let(kept, spaced)


def english_share(chunks: Column, detect=by_function_words) -> Column:
    """The share of characters of chunks that `detect` (a chunk's column -> its language's) calls en, of those it calls
    anything; null if there are none."""
    found = F.transform(chunks, lambda c: F.struct(F.length(c).cast("long").alias("size"), detect(c).alias("lang")))

    def add(a: Column, c: Column) -> Column:
        return F.struct(*((a[k] + F.when(x, c["size"]).otherwise(0)).alias(k) for k, x in (("en", c["lang"] == "en"), ("all", c["lang"].isNotNull()))))

    none = F.lit(0).cast("long")
    return F.aggregate(found, F.struct(none.alias("en"), none.alias("all")), add, lambda a: F.when(a["all"] > 0, a["en"] / a["all"]))


def usable_english(text: Column, share: Column | None = None, least_words: int = 200, least_share: float = 0.5) -> Column:
    """no_text, non_english (CJK characters outweigh Latin words, or the English share is too small) or ok. share is a column
    of english_share(), best computed before; without one only the characters decide. Texts without a judged chunk: no_text."""
    words, latin, cjk = (F.regexp_count(text, F.lit(rx)) for rx in (LETTER_WORD, LATIN_WORD, CJK))
    out = F.when(text.isNull() | (words < least_words), F.lit("no_text")).when(cjk / 1.5 > latin, F.lit("non_english"))
    if share is not None:
        out = out.when(share.isNull(), F.lit("no_text")).when(share < least_share, F.lit("non_english"))
    return out.otherwise(F.lit("ok"))


def heading_category(line: Column) -> Column:
    """The section category of a heading line, or null. A leading number or single capital with a dot is ignored."""
    plain = F.lower(F.trim(F.regexp_replace(F.trim(line), r"^(?:\d+(?:\.\d+)*\.?|[A-Z]\.)\s+", "")))
    alias = F.create_map(*(F.lit(x) for category, names in SECTIONS.items() for name in names for x in (name, category)))
    ok = (F.length(F.trim(line)) <= 80) & ~F.trim(line).rlike(r"[.,:;]$")
    return F.when(ok, F.element_at(alias, plain))


def last_of_role(messages: Column, role: str) -> Column:
    """Content of the last message of a role in array<struct<role, content>>; null if there is none."""
    return F.get(F.filter(messages, lambda m: m["role"] == role), F.size(F.filter(messages, lambda m: m["role"] == role)) - 1)["content"]


def substituted(text: Column, clause: Column, replacement: Column, tolerance: int = 1) -> Column:
    """The text with the clause replaced, if it stands there exactly once and the word count changes by at most tolerance."""
    once = (F.length(text) - F.length(F.replace(text, clause, F.lit("")))) == F.length(clause)
    new = F.replace(text, clause, replacement)
    words = lambda x: F.regexp_count(x, F.lit(r"\S+"))
    return F.when(once & (clause != "") & (F.abs(words(new) - words(text)) <= tolerance), new)


def marked(text: Column, x: tuple[Column, Column], y: tuple[Column, Column]) -> Column:
    """The text with two character spans in <x> and <y>; null if they overlap."""
    (a, b), (c, d) = x, y

    def cut(i: Column, j: Column) -> Column:
        return F.substring(text, i + 1, j - i)

    first = F.concat(cut(F.lit(0), a), F.lit("<x>"), cut(a, b), F.lit("</x>"), cut(b, c), F.lit("<y>"), cut(c, d), F.lit("</y>"), cut(d, F.length(text)))
    second = F.concat(cut(F.lit(0), c), F.lit("<y>"), cut(c, d), F.lit("</y>"), cut(d, a), F.lit("<x>"), cut(a, b), F.lit("</x>"), cut(b, F.length(text)))
    return F.when(b <= c, first).when(d <= a, second)


def clipped(text: Column, at: Column, words: int = 300) -> Column:
    """At most `words` white-space words around the word number `at`."""
    parts = F.split(F.trim(text), r"\s+")
    start = F.greatest(F.lit(0), F.least(at - words // 2, F.size(parts) - words))
    return F.array_join(F.slice(parts, start + 1, words), " ")
