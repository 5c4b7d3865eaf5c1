"""Readers and writers: Markdown, office packages, extracted items, redacted text, reports and history."""

from __future__ import annotations

import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators.assemble import NEEDED
from ..operators.history import RECORD
from ..operators.reports import export_name
from .document_files import located, write_documents

ITEMS = "doc_id long, page int, item_no int, str string, x double, y double, width double, height double, has_eol boolean"
REPORT_NAME = "文档_脱敏报告.md"
ENTRY = "struct<entry_no:int,name:string,declared_bytes:long>"
BLOCK = "struct<part_no:int,block_no:int,kind:string,style:string,text:string,rows:array<array<array<string>>>>"
PACKAGES = f"path string, entries array<{ENTRY}>, blocks array<{BLOCK}>, problem string"


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over all cores where the files have fewer filled splits than there are cores; others stay as they lie.

    For row-local jobs whose work on a row is large against its size. Only the splits' row counts are looked at.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    filled = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).count()
    return rows.repartition(4 * cores) if filled < cores else rows


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """file_name, n_bytes, text of Markdown files, one document a file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_size").alias("n_bytes"), F.col("value").alias("text"))
    return files.withColumn("source_format", F.lit("md"))


def _paragraph(node) -> str:
    """Text of a paragraph with its tabs and breaks."""
    marks = {"tab": "\t", "br": "\n", "cr": "\n"}
    tags = ((x, x.tag.rpartition("}")[2]) for x in node.iter())
    return "".join((x.text or "") if tag == "t" else marks.get(tag, "") for x, tag in tags)


def _entries(package: zipfile.ZipFile) -> list[tuple]:
    """(entry, name, declared bytes) of a package's directory."""
    return [(i, x.filename, x.file_size) for i, x in enumerate(package.infolist())]


def _blocks(package: zipfile.ZipFile):
    """(part, block, kind, style, text, rows) of a package's body, headers and footers; no other part is read."""
    import re

    if len(package.infolist()) > fixed.ENTRIES:
        raise ValueError("too many entries")
    if len(set(package.namelist())) < len(package.infolist()):
        raise ValueError("duplicate names")
    names = [n for n in package.namelist() if re.match(NEEDED, n)]
    if "word/document.xml" not in names:
        raise ValueError("no body")
    left = fixed.TOTAL_BYTES
    for info in (package.getinfo(n) for n in names):
        if info.file_size > min(fixed.PART_BYTES, left):
            raise ValueError("part too large")
        left -= info.file_size
    for part, name in enumerate(["word/document.xml", *sorted(n for n in names if n != "word/document.xml")]):
        root = ElementTree.fromstring(package.read(name))
        body = next((x for x in root.iter() if x.tag.endswith("}body")), root)
        for block, node in enumerate(body):
            tag = node.tag.rpartition("}")[2]
            if tag == "p":
                style = next((v for x in node.iter() if x.tag.endswith("}pStyle") for k, v in x.attrib.items() if k.endswith("}val")), None)
                yield part, block, "p", style, _paragraph(node), None
            elif tag == "tbl":
                own = lambda x, t: [c for c in x if c.tag.endswith("}" + t)]
                yield part, block, "tbl", None, None, [[[_paragraph(p) for p in own(c, "p")] for c in own(r, "tc")] for r in own(node, "tr")]


def opened_package(file) -> tuple[list | None, list | None, str | None]:
    """entries, blocks, problem of an open package: its directory and the parts that are needed are read, nothing else."""
    try:
        with zipfile.ZipFile(file) as package:
            entries = _entries(package)
            try:
                return entries, list(_blocks(package)), None
            except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                return entries, None, str(e) or type(e).__name__
    except (zipfile.BadZipFile, ValueError):  # the latter from a file too short to hold a directory
        return None, None, "no package"


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """path, entries, blocks, problem: one row a package, from one reading.

    Files are listed with their sizes and without their contents; those over the byte limit are never opened, of the others
    tasks read ranges. Packages are dealt out by size, so that tasks have about as many bytes.
    """

    def run(frames):
        for frame in frames:
            out = []
            for name in frame["path"]:
                system, place = located(name)
                with system.open_input_file(place) as file:
                    out.append((name, *opened_package(file)))
            yield pd.DataFrame(out, columns=["path", "entries", "blocks", "problem"])

    files = spark.read.format("binaryFile").load(path).select("path", "length")
    large, small = files.filter(F.col("length") > fixed.MARKDOWN_BYTES), files.filter(F.col("length") <= fixed.MARKDOWN_BYTES)
    read = spread(small).select("path").mapInPandas(run, PACKAGES)
    return read.unionByName(large.select("path", F.lit("too many bytes").alias("problem")), allowMissingColumns=True)


def package_blocks(packages: DataFrame) -> DataFrame:
    """Blocks of read packages; a package that can't be read is one row with its problem."""
    good = packages.filter("problem IS NULL").select("path", F.inline("blocks"), F.lit(None).cast("string").alias("problem"))
    return good.unionByName(packages.filter("problem IS NOT NULL").select("path", "problem"), allowMissingColumns=True)


def package_entries(packages: DataFrame) -> DataFrame:
    """Directory entries of read packages, for their admission and content warnings; none of what is no package."""
    return packages.filter("entries IS NOT NULL").select("path", F.inline("entries"))


def read_docx_blocks(spark: SparkSession, path: str) -> DataFrame:
    return package_blocks(read_packages(spark, path))


def read_package_entries(spark: SparkSession, path: str) -> DataFrame:
    return package_entries(read_packages(spark, path))


def read_text_items(spark: SparkSession, path: str) -> DataFrame:
    """Extracted PDF text items (JSON lines), one row an item."""
    return spark.read.schema(ITEMS).json(path)


def redacted_files(docs: DataFrame, is_pdf: bool = False) -> DataFrame:
    """folder (the document's id), file_name, content of redacted documents, named by their types."""
    return docs.select(F.col("doc_id").cast("string").alias("folder"), export_name(F.col("doc_type"), F.lit(is_pdf)).alias("file_name"), F.col("redacted").alias("content"))


def report_files(reports: DataFrame) -> DataFrame:
    """folder, file_name, content of reports (doc_id, report)."""
    return reports.select(F.col("doc_id").cast("string").alias("folder"), F.lit(REPORT_NAME).alias("file_name"), F.col("report").alias("content"))


def write_redacted(docs: DataFrame, path: str, is_pdf: bool = False) -> None:
    """One Markdown file for each redacted document."""
    write_documents(redacted_files(docs, is_pdf), path)


def write_reports(reports: DataFrame, path: str) -> None:
    """One Markdown file for each report."""
    write_documents(report_files(reports), path)


def write_history(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Records; rows that can't be read are dropped."""
    rows = spark.read.schema(RECORD + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.filter("_corrupt IS NULL").drop("_corrupt")
