"""Counts, reports, prompts and summaries: never a sensitive value in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.classify import type_label
from .review import label


def label_counts(matches: DataFrame) -> DataFrame:
    """doc_id, label, n_selected, n_kept, first_ordinal from match rows."""
    return matches.groupBy("doc_id", label(F.col("category")).alias("label")).agg(
        F.count_if("selected").alias("n_selected"), F.count_if(~F.col("selected")).alias("n_kept"), F.min("ordinal").alias("first_ordinal"))


def local_time(created_at: Column) -> Column:
    """Time of day in UTC+8; hours of midnight show as 24, as browsers write them."""
    at = F.from_utc_timestamp(created_at, "Asia/Shanghai")
    return F.concat(F.date_format(at, "yyyy/M/d "), F.date_format(at, "kk:mm:ss"))


def _counted(matches: Column) -> Column:
    """Count lines of one document, labels in order of first match."""
    labels = F.array_distinct(F.transform(matches, lambda m: label(m["category"])))

    def line(name):
        mine = F.filter(matches, lambda m: label(m["category"]) == name)
        done = F.size(F.filter(mine, lambda m: m["selected"]))
        return F.concat(F.lit("- "), name, F.lit("：已处理 "), done.cast("string"), F.lit(" 处，用户保留 "), (F.size(mine) - done).cast("string"), F.lit(" 处"))

    return F.transform(labels, line)


def report_text(run_id: Column, version: Column, doc_type: Column, created_at: Column, matches: Column, warnings: Column | None = None, manual: bool = False) -> Column:
    head = F.array(
        F.lit("# 脱敏报告"), F.lit(""),
        F.concat(F.lit("- 摘要任务编号："), run_id), F.concat(F.lit("- 工具版本："), version),
        F.concat(F.lit("- 文书类型："), type_label(doc_type), F.lit("（手动输入）" if manual else "（自动识别）")),
        F.concat(F.lit("- 处理时间："), local_time(created_at), F.lit("（UTC+8）")),
        F.lit("- 输出格式：Markdown"), F.lit("- 说明：本报告不记录任何原始敏感值。"), F.lit(""), F.lit("## 处理统计"), F.lit(""),
    )
    counts = F.when(F.size(matches) == 0, F.array(F.lit(fixed.NO_FINDINGS))).otherwise(_counted(matches))
    parts = [head, counts]
    if warnings is not None:
        notes = F.concat(F.array(F.lit(""), F.lit("## 文件提示"), F.lit("")), F.transform(warnings, lambda w: F.concat(F.lit("- "), w)))
        parts.append(F.when(F.size(warnings) > 0, notes).otherwise(F.slice(notes, 1, 0)))
    parts.append(F.array(*[F.lit(x) for x in ("", "## 责任提示", "", fixed.DUTY, "")]))
    return F.array_join(F.concat(*parts), "\n")


def analysis_prompt(doc_type: Column) -> Column:
    focus = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in fixed.FOCUS.items() for x in pair]), doc_type), F.lit(fixed.FOCUS["generic"]))
    return F.concat(F.lit(fixed.PROMPT[0]), type_label(doc_type), F.lit(fixed.PROMPT[1]), focus, F.lit(fixed.PROMPT[2]))


def export_summary(n_selected: Column, is_pdf: Column) -> Column:
    tail = F.when(is_pdf, " 处候选信息。导出仅包含 PDF 提取文字的脱敏稿，不代表原 PDF 已脱敏或内容完整。").otherwise(" 处候选信息，输出文件只包含脱敏后的文本内容。")
    return F.concat(F.lit("已处理 "), n_selected.cast("string"), tail)


def risk_note(n_kept: Column) -> Column:
    return F.when(n_kept > 0, F.concat(F.lit("你保留了 "), n_kept.cast("string"), F.lit(" 处高风险信息。仍可导出，但请确认这些内容可以提交给大模型。"))).otherwise("")


def export_name(doc_type: Column, is_pdf: Column) -> Column:
    from .redact import safe_file_part

    return F.concat(safe_file_part(type_label(doc_type)), F.lit("_"), F.when(is_pdf, "PDF文字提取_").otherwise(""), F.lit("脱敏版.md"))
