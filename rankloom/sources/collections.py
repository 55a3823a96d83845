"""Document collections: SGML, web archives, tab-separated posts, XML records, archives of files."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import strip_html


def tag(text: Column, name: str) -> Column:
    """What stands in the first element ``name``, without tags inside it; null where there is none."""
    found = F.regexp_extract(text, rf"(?is)<{name}\b[^>]*>(.*?)</{name}\s*>", 1)
    return F.when(text.rlike(rf"(?i)<{name}\b"), F.trim(F.regexp_replace(F.regexp_replace(found, r"<[^>]*>", " "), r"\s+", " ")))


def all_tags(text: Column, name: str) -> Column:
    """The texts of all elements ``name``, joined by a blank."""
    parts = F.regexp_extract_all(text, F.lit(rf"(?is)<{name}\b[^>]*>(.*?)</{name}\s*>"), F.lit(1))
    return F.trim(F.regexp_replace(F.regexp_replace(F.array_join(parts, " "), r"<[^>]*>", " "), r"\s+", " "))


def read_sgml(spark: SparkSession, path: str, record: str = "DOC", id_tag: str = "DOCNO", fields: tuple[str, ...] = ("TEXT",), skip: tuple[str, ...] = (), merge: bool = True) -> DataFrame:
    """(docno, text) or one column for each field; compressed files are read as they are, directories recursively."""
    raw = spark.read.option("lineSep", f"</{record}>").option("recursiveFileLookup", "true").text(path)
    text = F.col("value")
    for name in skip:
        text = F.regexp_replace(text, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", " ")
    rows = raw.where(F.col("value").rlike(rf"(?i)<{id_tag}\b"))
    parts = [all_tags(text, name) for name in fields]
    if merge:
        return rows.select(tag(text, id_tag).alias("docno"), F.trim(F.concat_ws(" ", *parts)).alias("text"))
    return rows.select(tag(text, id_tag).alias("docno"), *(p.alias(name.lower()) for p, name in zip(parts, fields, strict=True)))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(id, url, title, content) of the response records of web archives; a record begins where a line begins with its version."""
    raw = spark.read.option("lineSep", "\nWARC/").option("recursiveFileLookup", "true").text(path)
    head = lambda name: F.nullif(F.trim(F.regexp_extract("value", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)), F.lit(""))
    # after the record's header and the response's own header
    body = F.regexp_extract("value", r"(?s)\r?\n\r?\n.*?\r?\n\r?\n(.*)$", 1)
    return raw.where(F.col("value").rlike(r"(?i)WARC-TREC-ID:")).select(head("WARC-TREC-ID").alias("id"), head("WARC-Target-URI").alias("url"), tag(body, "title").alias("title"), strip_html(body).alias("content"))


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """(id, user, status, time, content) of tab-separated short posts."""
    rows = spark.read.csv(path, sep="\t", schema="id string, user string, status string, time string, content string", quote="")
    named = F.try_to_timestamp(F.regexp_replace("time", r"^[A-Za-z]{3} (?=[A-Za-z])", ""), F.lit("MMM dd HH:mm:ss Z yyyy"))
    return rows.withColumn("time", F.coalesce(named, F.try_to_timestamp("time", F.lit("yyyyMMddHHmmss"))))


def read_xml(spark: SparkSession, path: str, row_tag: str, fields: dict[str, str]) -> DataFrame:
    """Records as columns {name: tag}; repeated tags are joined."""
    raw = spark.read.option("lineSep", f"</{row_tag}>").text(path).where(F.col("value").rlike(rf"<{row_tag}\b"))
    return raw.select(*(all_tags(F.col("value"), name).alias(column) for column, name in fields.items()))


def read_patents(spark: SparkSession, path: str) -> DataFrame:
    return read_xml(spark, path, "patent-document", {"id": "ucid", "title": "invention-title", "abstract": "abstract", "description": "description", "claims": "claims", "date": "date"})


def read_medline(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, text): title, abstract, headings and chemicals in one text."""
    rows = read_xml(spark, path, "MedlineCitation", {"pmid": "PMID", "title": "ArticleTitle", "abstract": "AbstractText", "mesh": "DescriptorName", "chemicals": "NameOfSubstance"})
    return rows.select("pmid", F.trim(F.concat_ws(" ", "title", "abstract", "mesh", "chemicals")).alias("text"))


def read_visits(spark: SparkSession, mapping: str, dropped: str) -> DataFrame:
    """(report, visit) of reports that belong to a visit: the first and third column of ``mapping``, without those that the
    second column of ``dropped`` names."""
    columns = lambda path, *at: spark.read.text(path).select(*(F.try_element_at(F.split(F.trim("value"), r"\s+"), F.lit(k)).alias(name) for name, k in at))
    rows = columns(mapping, ("report", 1), ("visit", 3)).where("lower(visit) <> 'null'").groupBy("report").agg(F.max("visit").alias("visit"))
    return rows.join(columns(dropped, ("report", 2)), "report", "left_anti")


def by_visit(reports: DataFrame, visits: DataFrame) -> DataFrame:
    """(docno, text): reports (docno, text) under the id of their visit; those without a visit go."""
    return reports.join(visits.withColumnRenamed("report", "docno"), "docno").select(F.col("visit").alias("docno"), "text")


def source_texts(docs: DataFrame, ids: DataFrame, on: str = "doc_id") -> DataFrame:
    """The documents that ``ids`` names, as they came."""
    return docs.join(ids.select(on), on, "left_semi")


def read_bookmarks(spark: SparkSession, path: str) -> DataFrame:
    """(urlmd5, title, tag, tagtitle, content) of social bookmarks, one row for each page."""
    rows = spark.read.csv(path, sep="\t", schema="urlmd5 string, title string, tag string", quote="")
    grouped = rows.groupBy("urlmd5").agg(F.max("title").alias("title"), F.array_join(F.array_sort(F.collect_list("tag")), " ").alias("tag"))
    return grouped.select("urlmd5", "title", "tag", F.concat_ws(" ", "tag", "title").alias("tagtitle"), F.concat_ws(" ", "title", "tag").alias("content"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, content) of the files in zip, tar, tar.gz and tgz archives; one task opens one archive at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for where, content in zip(frame["path"], frame["content"], strict=True):
                for name, data in members(where, content):
                    yield pd.DataFrame({"path": [where], "name": [name], "content": [data]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, name string, content binary")


def members(path: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    if path.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            yield from ((n, archive.read(n)) for n in archive.namelist() if not n.endswith(("/", ".DS_Store")))
    elif path.endswith((".tar", ".tar.gz", ".tgz")):
        with tarfile.open(fileobj=io.BytesIO(content)) as archive:
            yield from ((m.name, archive.extractfile(m).read()) for m in archive if m.isfile() and not m.name.endswith(".DS_Store"))


def read_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with title and text taken from the HTML."""
    return pages.withColumns({"title": tag(F.col(html_col), "title"), "text": strip_html(F.col(html_col))})
