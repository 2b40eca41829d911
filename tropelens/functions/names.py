"""Names and display: file names, paper ids, page counts, phrases inside white space, texts for readers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that some file systems keep for devices.
DEVICES = r"(?i)^(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(?:\..*)?$"
MOST_STEM_BYTES = 240


def percent_encoded(text: Column) -> Column:
    """UTF-8 percent encoding; letters, digits and -_.~ stay."""
    out = F.url_encode(text)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def safe_stem(doc_id: Column) -> Column:
    """A file name that decodes to the id and that no file system refuses; null if it would be too long."""
    stem = percent_encoded(doc_id)
    stem = F.regexp_replace(F.regexp_replace(stem, r"^\.", "%2E"), r"\.$", "%2E")
    device = F.concat(F.lit("%"), F.upper(F.hex(F.substring(stem, 1, 1))), F.substring(stem, 2, MOST_STEM_BYTES))
    stem = F.when(stem.rlike(DEVICES), device).otherwise(stem)
    return F.when(F.octet_length(stem) <= MOST_STEM_BYTES, stem)


def decoded_stem(stem: Column) -> Column:
    return F.url_decode(F.replace(stem, F.lit("+"), F.lit("%2B")))


def paper_id(collection: Column, volume: Column, paper: Column) -> Column:
    """P19-1001, W19-0102 (workshops and volumes from 10 on: two digits each) or 2020.main-1.7 (collections that start with a digit)."""
    two = F.concat_ws("", collection, F.lit("-"), F.lpad(volume, 2, "0"), F.lpad(paper, 2, "0"))
    three = F.concat_ws("", collection, F.lit("-"), volume, F.lpad(paper, 3, "0"))
    return F.when(collection.rlike(r"^\d"), F.concat_ws("", collection, F.lit("-"), volume, F.lit("."), paper)).when(collection.startswith("W") | (volume.cast("int") >= 10), two).otherwise(three)


def page_count(pages: Column) -> Column:
    """Pages of a range such as 101--110; null if it isn't two numbers."""
    n = F.regexp_extract_all(pages, F.lit(r"\d+"), F.lit(0))
    return F.when(F.size(n) == 2, (n[1].cast("int") - n[0].cast("int") + 1).cast("long"))


def displayed(text: Column) -> Column:
    """Straight quotes, no empty parentheses, no space before marks or inside brackets, single spaces."""
    text = F.translate(text, "“”‘’", "\"\"''")
    for rx, new in ((r"\(\s*\)", ""), (r"\s+([,.;:)])", "$1"), (r"\(\s+", "("), (r"\s+", " ")):
        text = F.regexp_replace(text, rx, new)
    return F.trim(text)


def located(text: Column, phrase: Column) -> Column:
    """(start, end) in characters of a phrase whose words may stand apart by any white space; null if it isn't there."""
    escaped = F.regexp_replace(F.trim(phrase), r"([^\p{L}\p{N}_\s])", r"\\$1")
    rx = F.regexp_replace(escaped, r"\s+", r"\\s+")
    at = F.regexp_instr(text, F.concat(F.lit("("), rx, F.lit(")")))
    found = F.regexp_substr(text, rx)
    return F.when((at > 0) & (F.trim(phrase) != ""), F.struct((at - 1).alias("start"), (at - 1 + F.length(found)).alias("end")))


def letter_words(text: Column) -> Column:
    """array<string>: runs of two or more letters."""
    return F.regexp_extract_all(text, F.lit(r"\p{L}{2,}"), F.lit(0))
