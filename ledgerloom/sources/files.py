"""Files and lookup lists: text documents, code lists, ontologies."""

from __future__ import annotations

import functools
import html
import io
import re
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes that can be converted to text here; pdf needs a converter of its own (fixed values).
PLAIN = ("txt", "md", "html", "htm")
OFFICE = ("docx", "pptx", "xlsx")
KNOWN = (*PLAIN, *OFFICE, "pdf")
#: Cell values that say nothing (fixed values).
BLANK = ("", "nan", "None", "NaT")


def scan(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Files of known kinds (path, suffix, length, sha256, content), sorted by path; and the others' paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    named = files.withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    kept = named.where(F.col("suffix").isin(*KNOWN)).select("path", "suffix", "length", F.sha2("content", 256).alias("sha256"), "content")
    return kept.orderBy("path"), named.where(~F.col("suffix").isin(*KNOWN)).select("path")


def html_to_text(source: str) -> str:
    body = re.sub(r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ", source)
    body = re.sub(r"(?i)<(br|/p|/div|/h[1-6]|/li|/tr)\b[^>]*>", "\n", body)
    lines = (re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in html.unescape(re.sub(r"<[^>]+>", " ", body)).split("\n"))
    return "\n".join(x for x in lines if x)


def xml_texts(source: bytes, block: str) -> list[str]:
    """Text of each block element of an office document's part: its text runs, joined."""
    blocks = re.findall(rf"(?s)<{block}[ >].*?</{block}>", source.decode("utf-8", "replace"))
    return [html.unescape("".join(re.findall(r"(?s)<(?:\w+:)?t(?: [^>]*)?>(.*?)</(?:\w+:)?t>", b))) for b in blocks]


def sheet_rows(source: bytes, shared: list[str]) -> list[list[str]]:
    """Cells of each row of a sheet; cells of type s are numbers of shared strings."""
    out = []
    for row in re.findall(r"(?s)<row[ >].*?</row>", source.decode("utf-8", "replace")):
        cells = re.findall(r"(?s)<c(?=[ />])([^>]*?)(?:/>|>(.*?)</c>)", row)
        values = [(kind, re.search(r"(?s)<(?:v|t)[^>]*>(.*?)</(?:v|t)>", body)) for kind, body in cells]
        out.append([(shared[int(m[1])] if 't="s"' in kind else html.unescape(m[1])) if m else "" for kind, m in values])
    return out


def office_text(kind: str, content: bytes) -> str | None:
    """Paragraphs of a document, slides of a presentation, `column: value; …` lines of sheets; null if it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as parts:
            number = lambda n: [int(x) for x in re.findall(r"\d+", n)]
            names = sorted(parts.namelist(), key=lambda n: (number(n), n))
            if kind == "docx":
                return "\n\n".join(x for x in xml_texts(parts.read("word/document.xml"), "w:p") if x.strip())
            if kind == "pptx":
                slides = ("\n".join(x for x in xml_texts(parts.read(n), "a:p") if x.strip()) for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n))
                return "\n\n".join(x for x in slides if x)
            shared = xml_texts(parts.read("xl/sharedStrings.xml"), "si") if "xl/sharedStrings.xml" in names else []
            lines = []
            for n in names:
                if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n):
                    head, *rows = sheet_rows(parts.read(n), shared) or [[]]
                    lines += ["; ".join(f"{h}: {v}" for h, v in zip(head, row) if v.strip() not in BLANK) for row in rows]
            return "\n".join(x for x in lines if x)
    except (zipfile.BadZipFile, KeyError, ValueError, IndexError):
        return None


def convert(files: DataFrame, converters: dict | None = None) -> DataFrame:
    """path and text; null where no converter (suffix: bytes to text) is given for a kind."""
    found = {"txt": lambda b: b.decode("utf-8", "replace"), "md": lambda b: b.decode("utf-8", "replace"), "html": lambda b: html_to_text(b.decode("utf-8", "replace"))}
    found |= {"htm": found["html"]} | {kind: functools.partial(office_text, kind) for kind in OFFICE} | (converters or {})

    def run(batches):
        for batch in batches:
            texts = [found[s](c) if s in found else None for s, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["path", "text"])

    return files.select("path", "suffix", "content").mapInArrow(run, "path string, text string")


def lookup(spark: SparkSession, path: str) -> DataFrame:
    """A code list whose labels may hold commas."""
    from ledgerloom.operators.industry import read_lookup

    return read_lookup(spark.read.text(path))


def ontology(spark: SparkSession, path: str) -> DataFrame:
    """name, inverse, symmetric and definition of the object properties in an RDF/XML file."""
    schema = "`_rdf:about` string, `owl:inverseOf` struct<`_rdf:resource`: string>, `rdf:type` array<struct<`_rdf:resource`: string>>, `rdfs:comment` array<string>"
    rows = spark.read.format("xml").option("rowTag", "owl:ObjectProperty").schema(schema).load(path)
    local = lambda c: F.regexp_extract(c, r"([^#/]+)$", 1)
    return rows.select(
        local(F.col("`_rdf:about`")).alias("name"), F.nullif(local(F.col("`owl:inverseOf`.`_rdf:resource`")), F.lit("")).alias("inverse"),
        F.coalesce(F.exists("rdf:type", lambda t: t["_rdf:resource"].endswith("SymmetricProperty")), F.lit(False)).alias("symmetric"), F.try_element_at("rdfs:comment", F.lit(1)).alias("definition"),
    )


#: Curated relations: canonical and inverse name; the same twice where symmetric (fixed values).
RELATIONS = """
hasOrHadCorrespondent hasOrHadCorrespondent
hasOrHadEmployer isOrWasEmployerOf
hasOrHadManager isOrWasManagerOf
hasOrHadLeader isOrWasLeaderOf
hasOrHadMember isOrWasMemberOf
hasOrHadOwner isOrWasOwnerOf
hasOrHadController isOrWasControllerOf
hasOrHadSubdivision isOrWasSubdivisionOf
hasSuccessor isSuccessorOf
wasMergedInto resultedFromTheMergerOf
wasSplitInto resultedFromTheSplitOf
hasOrHadAuthorityOver isOrWasUnderAuthorityOf
hasOrHadSpouse hasOrHadSpouse
hasChild isChildOf
hasSibling hasSibling
hasAncestor hasDescendant
hasFamilyAssociationWith hasFamilyAssociationWith
hasOrHadTeacher hasOrHadStudent
hasOrHadWorkRelationWith hasOrHadWorkRelationWith
knows knows
agentHasOrHadLocation isOrWasLocationOfAgent
hasBirthPlace isBirthPlaceOf
hasDeathPlace isDeathPlaceOf
isAssociatedWithPlace isPlaceAssociatedWith
hasOrHadParticipant isOrWasParticipantIn
isAssociatedWithEvent isEventAssociatedWith
hasOrHadSubevent isOrWasSubeventOf
"""


def relation_types(spark: SparkSession) -> DataFrame:
    """rel and inverse as edge types, in both directions."""
    from ledgerloom.functions.text import relation_constant

    pairs = [tuple(x.split()) for x in RELATIONS.split("\n") if x]
    both = spark.createDataFrame(sorted({*pairs, *((b, a) for a, b in pairs)}), "a string, b string")
    return both.select(relation_constant(F.col("a")).alias("rel"), relation_constant(F.col("b")).alias("inverse"))
