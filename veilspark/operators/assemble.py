"""Text from extracted items: PDF pages and documents, office blocks and tables, package admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.dialect import BLANK, matches, replace, trim
from ..functions.spans import bound, swept

NEEDED = "^word/(?:document|(?:header|footer)[0-9]+)\\.xml$"


def page_texts(items: DataFrame) -> DataFrame:
    """doc_id, page, text: items in order joined by line breaks and blanks as their places ask for.

    Only the text's end decides on breaks, so a fold carries the end apart from the pieces. A page whose items
    hold no string has an empty text.
    """
    num = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    item = F.struct("item_no", "str", "x", "y", num("width").alias("width"), num("height").alias("height"), F.coalesce("has_eol", F.lit(False)).alias("has_eol"))
    # Dealt by a set number of partitions, as small ones would be merged into few tasks for a costly fold.
    dealt = items.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", "page")
    pages = dealt.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.when(F.col("str").isNotNull(), item))).alias("items"))
    prev = lambda i: F.get("items", i - 1)

    def joined(m, i):
        p, height = prev(i), F.greatest(F.abs(m["height"]), F.lit(1.0))
        line = (i > 0) & (F.abs(m["y"] - p["y"]) > F.greatest(height, F.abs(p["height"])) * 0.5)
        gap = m["x"] - (p["x"] + p["width"])
        words = p["str"].rlike("[A-Za-z0-9]\\z") & m["str"].rlike("^[A-Za-z0-9]")
        space = (i > 0) & ~line & ~matches(m["str"], "^\\s") & ((gap > height * 0.25) | (words & (gap > height * 0.08)))
        return F.struct(line.alias("line"), space.alias("space"), m["str"].alias("str"), m["has_eol"].alias("eol"))

    def step(state, m):
        brk = F.when(m["line"] & (state["end"] != "\n"), "\n").when(m["space"] & ~matches(state["end"], "^\\s"), " ").otherwise("")
        piece = F.concat(brk, m["str"], F.when(m["eol"], "\n").otherwise(""))
        return F.struct(F.when(piece == "", state["end"]).otherwise(F.right(piece, F.lit(1))).alias("end")), piece, F.lit(True)

    text = F.array_join(swept(F.transform("items", joined), F.struct(F.lit("").alias("end")), step, "array<string>"), "")
    text = F.regexp_replace(F.regexp_replace(text, "[ \\t]+\\n", "\n"), "\\n{3,}", "\n\n")
    return pages.select("doc_id", "page", trim(text).alias("text"))


def page_stats(pages: DataFrame) -> DataFrame:
    """doc_id, page, n_chars, is_empty, is_sparse, is_faulty."""
    n = F.length(replace(F.col("text"), "\\s"))
    fault = F.col("text").rlike("[\\uFFFD\\u0000-\\u0008\\u000B\\u000C\\u000E-\\u001F]")
    return pages.select("doc_id", "page", "text", n.cast("long").alias("n_chars"), (n == 0).alias("is_empty"), ((n > 0) & (n < fixed.SPARSE_CHARS)).alias("is_sparse"), fault.alias("is_faulty"))


def all_pages(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """``pages`` with an empty one for each page of ``counts`` (doc_id, n_pages) that has no items; further pages stay."""
    due = counts.select("doc_id", F.explode(F.sequence(F.lit(1), F.greatest(F.col("n_pages"), F.lit(1)))).alias("page"))
    return due.join(pages, ["doc_id", "page"], "full").select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text"))


def assembled(pages: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """doc_id, text, warnings, reject_reason of PDF documents from their pages; ``counts`` tells of pages without items."""
    stats = page_stats(pages if counts is None else all_pages(pages, counts))
    running = F.sum("n_chars").over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    fault = F.when(F.col("is_faulty"), F.concat(F.lit("fault on page "), F.col("page").cast("string"))).when(running > fixed.PDF_CHARS, "too many characters")
    heading = F.concat(F.lit("## PDF 第 "), F.col("page").cast("string"), F.lit(" 页\n\n"), F.when(F.col("text") == "", fixed.EMPTY_PAGE).otherwise(F.col("text")))
    rows = stats.withColumn("fault", fault).withColumn("part", heading)
    pages_where = lambda c: F.array_sort(F.collect_list(F.when(F.col(c), F.col("page"))))
    docs = rows.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.array_sort(F.collect_list(F.struct("page", "part"))).alias("parts"),
        pages_where("is_empty").alias("empty"), pages_where("is_sparse").alias("sparse"), F.min(F.when(F.col("fault").isNotNull(), F.struct("page", "fault"))).alias("first_fault"),
    )
    listed = lambda c: F.array_join(F.transform(c, lambda p: p.cast("string")), "、")
    warnings = F.array_compact(F.array(
        F.lit(fixed.PDF_NOTICE),
        F.concat(F.lit("共 "), F.col("n").cast("string"), F.lit(" 页，其中 "), (F.col("n") - F.size("empty")).cast("string"), F.lit(" 页提取到文字；提取到文字不代表该页内容完整。")),
        F.when(F.size("empty") > 0, F.concat(F.lit("第 "), listed("empty"), F.lit(" 页没有提取到文字，已在稿内标记，请勿将缺失内容理解为原文未载明。"))),
        F.when(F.size("sparse") > 0, F.concat(F.lit("第 "), listed("sparse"), F.lit(" 页提取文字很少，可能仅有页码或标题，请检查扫描内容是否遗漏。"))),
    ))
    reason = F.when(F.col("n") > fixed.PDF_PAGES, "too many pages").when(F.col("first_fault").isNotNull(), F.col("first_fault.fault")).when(F.col("chars") == 0, "no text")
    return docs.select("doc_id", F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n").alias("text"), warnings.alias("warnings"), reason.alias("reject_reason"))


def table_text(rows: Column) -> Column:
    """A table (rows of cells of paragraphs) as Markdown."""
    cell = lambda paragraphs: F.replace(F.array_join(F.filter(F.transform(paragraphs, trim), lambda p: p != ""), "；"), F.lit("|"), F.lit("\\|"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))

    def of(cells, width):  # both bound, as each row asks for the width
        full = lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))
        shown = F.transform(cells, lambda r, i: F.when(i == 0, F.concat(line(full(r)), F.lit("\n"), line(F.array_repeat(F.lit("---"), width)))).otherwise(line(full(r))))
        return F.array_join(shown, "\n")

    text = bound(F.transform(rows, lambda r: F.transform(r, cell)), lambda cells: bound(F.coalesce(F.array_max(F.transform(cells, F.size)), F.lit(0)), lambda width: of(cells, width)))
    return F.when(F.size(rows) == 0, "").otherwise(text)


def block_text(kind: Column, style: Column, text: Column, rows: Column) -> Column:
    level = F.regexp_extract(F.coalesce(style, F.lit("")), f"(?i)(?:Heading|标题)[{BLANK}]*([1-6])", 1)
    clean = trim(text)
    paragraph = F.when((level != "") & (clean != ""), F.concat(F.repeat(F.lit("#"), F.coalesce(F.try_to_number(level, F.lit("9")).cast("int"), F.lit(0))), F.lit(" "), clean)).otherwise(clean)
    return F.when(kind == "tbl", table_text(rows)).otherwise(paragraph)


def block_documents(blocks: DataFrame) -> DataFrame:
    """doc_id, text from blocks; part 0 is the body, the others are headers and footers by name."""
    md = F.coalesce(block_text(F.col("kind"), F.col("style"), F.col("text"), F.col("rows")), F.lit(""))
    block = bound(md, lambda m: F.when(m != "", F.struct("part_no", "block_no", m.alias("md"))))
    docs = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(block)).alias("blocks")).filter(F.size("blocks") > 0)
    # A block follows its part's one before it by an empty line; a part that is not the body has its notice first.
    follows = lambda b, i: (i > 0) & F.get("blocks", i - 1)["part_no"].eqNullSafe(b["part_no"])
    lead = lambda b, i: F.when(follows(b, i), "\n\n").when(b["part_no"] == 0, "").otherwise(fixed.PART_NOTICE)
    text = F.array_join(F.transform("blocks", lambda b, i: F.concat(lead(b, i), b["md"])), "")
    return docs.select("doc_id", trim(text).alias("text"))


def package_admission(entries: DataFrame) -> DataFrame:
    """doc_id, reject_reason, warnings of packages from their directory entries."""
    needed = F.col("name").rlike(NEEDED)
    before = Window.partitionBy("doc_id").orderBy("entry_no").rowsBetween(Window.unboundedPreceding, -1)
    size = F.when(needed, F.col("declared_bytes")).otherwise(0)
    rows = entries.withColumn("cap", F.least(F.lit(fixed.PART_BYTES), F.lit(fixed.TOTAL_BYTES) - F.coalesce(F.sum(size).over(before), F.lit(0)))).withColumn("over", needed & (F.col("declared_bytes") > F.col("cap")))
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    docs = rows.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_distinct("name").alias("names"), F.bool_or("over").alias("over"), has(F.col("name") == "word/document.xml").alias("body"),
        has(F.startswith("name", F.lit("word/media/"))).alias("media"), has(F.col("name") == "word/comments.xml").alias("comments"), has(F.startswith("name", F.lit("word/embeddings/"))).alias("embeddings"),
    )
    reason = F.when(F.col("n") > fixed.ENTRIES, "too many entries").when(F.col("names") < F.col("n"), "duplicate names").when(F.col("over"), "part too large").when(~F.col("body"), "no body")
    notes = F.array_compact(F.array(*[F.when(F.col(c), w) for c, w in zip(("media", "comments", "embeddings"), fixed.PACKAGE_WARNINGS, strict=True)]))
    return docs.select("doc_id", reason.alias("reject_reason"), notes.alias("warnings"))
