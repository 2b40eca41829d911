"""TEI documents to section records: nested divisions need a tree, so each file is parsed in its own row."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tropelens.sources.readers import stem

NS = "{http://www.tei-c.org/ns/1.0}"
TEI = "doc_id string, title string, abstract string, n_references int, sections array<struct<heading string, text string>>, error string"


def words_of(node: ET.Element) -> str:
    return " ".join("".join(node.itertext()).split())


def leaves(div: ET.Element) -> Iterator[ET.Element]:
    """Divisions without divisions below them, in order."""
    inner = div.findall(f"{NS}div")
    for child in inner:
        yield from leaves(child)
    if not inner:
        yield div


def parse(content: bytes) -> dict:
    """Title, abstract, leaf sections of body and back, and the number of references; what can't be parsed has an error."""
    try:
        root = ET.fromstring(content)
    except ET.ParseError as e:
        return {"title": None, "abstract": None, "n_references": 0, "sections": [], "error": str(e)}
    title, abstract = root.find(f".//{NS}titleStmt/{NS}title"), root.find(f".//{NS}abstract")
    sections = []
    for part in ("body", "back"):
        for top in root.findall(f".//{NS}text/{NS}{part}/{NS}div"):
            for div in leaves(top):
                if div.find(f".//{NS}listBibl") is not None:
                    continue
                head = div.find(f"{NS}head")
                text = " ".join(words_of(p) for p in div if p.tag != f"{NS}head")
                sections.append({"heading": words_of(head) if head is not None else "", "text": text})
    n = len(root.findall(f".//{NS}listBibl/{NS}biblStruct"))
    return {"title": words_of(title) if title is not None else None, "abstract": words_of(abstract) if abstract is not None else None, "n_references": n, "sections": sections, "error": None}


def tei_files(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(path)
    from pyspark.sql import functions as F

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([{"doc_id": d, **parse(c)} for d, c in zip(batch["doc_id"], batch["content"], strict=True)], columns=[x.split()[0] for x in ("doc_id", "title", "abstract", "n_references", "sections", "error")])

    return rows.select(stem(F.col("path")).alias("doc_id"), "content").mapInPandas(run, TEI)
