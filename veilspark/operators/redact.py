"""Redaction of a corpus: admission, normalising, detection, resolution and replacement in each row.

The whole job is a narrow map: no shuffle, candidates stay nested in their document's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, detectors, entities, fixed, spans
from ..functions.dialect import MARKS, trim
from .terms import with_terms


def normalised(text: Column) -> Column:
    text = F.regexp_replace(text, "\\r\\n?", "\n")
    text = F.regexp_replace(text, "[\\t ]+\\n", "\n")
    return trim(F.regexp_replace(text, "\\n{4,}", "\n\n\n"))


def extension(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, "\\."), -1))


def reject_reason(text: Column, name: Column | None = None, n_bytes: Column | None = None) -> Column:
    """Why a document is not admitted; null if it is."""
    reason = F.when(F.length(text) > fixed.TEXT_CHARS, "too many characters").when(F.coalesce(trim(text), F.lit("")) == "", "no text").when(text.rlike(f"[{MARKS}]"), "reserved characters")
    if name is None:
        return reason
    kind = extension(name)
    routed = F.when(kind == "doc", "legacy format").when(~F.coalesce(kind, F.lit("")).isin("md", "markdown", "docx", "pdf"), "unknown format")
    if n_bytes is not None:
        routed = routed.when(n_bytes > F.when(kind == "pdf", fixed.PDF_BYTES).otherwise(fixed.MARKDOWN_BYTES), "too many bytes")
    return F.coalesce(routed, reason)


def safe_file_part(value: Column) -> Column:
    return F.coalesce(F.nullif(trim(F.regexp_replace(value, '[\\\\/:*?"<>|\\r\\n]+', "_")), F.lit("")), F.lit("文档"))


def admitted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with reject_reason, and text normalised where it is null."""
    name = F.col("file_name") if "file_name" in docs.columns else None
    size = F.col("n_bytes") if "n_bytes" in docs.columns else None
    reason = reject_reason(F.col(text_col), name, size)
    return docs.withColumn("reject_reason", reason).withColumn(text_col, F.when(F.col("reject_reason").isNull(), normalised(F.col(text_col))).otherwise(F.col(text_col)))


def detected(docs: DataFrame, rules: list[tuple] = fixed.DETECTORS, fields: list[tuple] | None = fixed.FIELDS, parties: bool = True, persons: bool = True, terms: str = "", keep_amounts: bool = False, manual_type: str | None = None, term_table: DataFrame | None = None, folder: str | None = None) -> DataFrame:
    """``docs`` (normalised text) with doc_type, type_name and candidates in order of insertion.

    ``terms`` is a user's list; ``term_table`` (term_no, term) is for many, see ``terms.with_terms``.
    """
    text = F.col("text")
    manual = None if manual_type is None else F.lit(manual_type)
    out = docs.withColumn("doc_type", classify.document_type(text, manual)).withColumn("type_name", classify.type_name(text, F.col("doc_type"), manual))
    found = [detectors.pattern_candidates(text, rules, keep_amounts)] if rules else []
    if parties:
        out = entities.with_labelled_parties(out, "__labelled").withColumn("__declared", entities.declared_roles(text))
        out = out.withColumn("parties", entities.assigned_parties("__labelled", "__declared")).drop("__labelled", "__declared")
        out = out.withColumn("related", entities.related_entities(text, F.col("parties"))).withColumn("aliases", entities.party_aliases(text, F.col("parties")))
        found.append(entities.mention_candidates(text, F.concat("parties", "related", "aliases")))
    if fields:
        found.append(detectors.field_candidates(text, F.col("doc_type"), fields))
    if persons:
        found.append(detectors.person_candidates(text))
    if terms:
        found.append(detectors.term_candidates(text, detectors.parsed_terms(terms)))
    if term_table is not None:
        out = with_terms(out, term_table, "__terms", folder=folder)
        found.append(F.col("__terms"))
    return out.withColumn("candidates", F.concat(*found)).drop("__terms")


def matched(docs: DataFrame, strict: bool = False) -> DataFrame:
    """``docs`` with matches: the candidates without clause numbers and overlaps, all selected."""
    some = F.size("candidates") > 0  # without candidates there is nothing that a number could be mistaken for
    kept = docs.withColumn("__clauses", F.when(some, spans.clauses(F.col("text"))).otherwise(F.array())).withColumn("matches", spans.resolved(F.col("candidates"), F.col("__clauses"), strict))
    return kept.drop("__clauses", "candidates").withColumn("matches", F.transform("matches", lambda m: F.struct(spans.match_id(m).alias("match_id"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), m["category"].alias("category"), m["placeholder"].alias("placeholder"), F.lit(True).alias("selected"))))


def replaced(docs: DataFrame) -> DataFrame:
    """``docs`` with redacted: selected matches replaced; text taken from PDF is headed by its warnings."""
    docs = docs.withColumn("__chosen", F.filter("matches", lambda m: m["selected"]))
    text = spans.applied(F.col("text"), F.col("__chosen"))
    if "source_format" in docs.columns and "warnings" in docs.columns:
        text = F.when(F.col("source_format") == "pdf", F.concat(F.lit("> "), F.array_join("warnings", "\n> "), F.lit("\n\n"), text)).otherwise(text)
    return docs.withColumn("redacted", text).drop("__chosen")


def redact(docs: DataFrame, **options) -> DataFrame:
    """The job from documents to redacted documents; rejected ones are left to ``admitted``."""
    strict = options.pop("strict", False)
    good = admitted(docs).filter("reject_reason IS NULL").drop("reject_reason")
    return replaced(matched(detected(good, **options), strict))


OUTCOMES = "accepted", "rejected"


def with_outcome(docs: DataFrame, **options) -> DataFrame:
    """Every document once: its outcome (accepted or rejected), the reason, and what redaction made of it (null if rejected).

    Rejected texts stay as they came and are not searched: the plan sees an empty text in their place.
    """
    strict = options.pop("strict", False)
    every = admitted(docs).withColumn("__raw", F.when(F.col("reject_reason").isNotNull(), F.col("text"))).withColumn("text", F.when(F.col("reject_reason").isNull(), F.col("text")).otherwise(""))
    done = replaced(matched(detected(every, **options), strict))
    made = [c for c in done.columns if c not in docs.columns and c not in ("reject_reason", "__raw")]
    good = F.col("reject_reason").isNull()
    shown = done.withColumns({c: F.when(good, F.col(c)) for c in made}).withColumn("text", F.when(good, F.col("text")).otherwise(F.col("__raw")))
    return shown.drop("__raw").withColumn("outcome", F.when(good, OUTCOMES[0]).otherwise(OUTCOMES[1]))


def write_outcomes(docs: DataFrame, path: str, **options) -> None:
    """Both sinks from one pass and one commit: ``path``/outcome=accepted and ``path``/outcome=rejected."""
    with_outcome(docs, **options).write.partitionBy("outcome").parquet(path)


def with_late_term(docs: DataFrame, term: str) -> DataFrame:
    """Adds a term to documents already matched; without hits nothing changes."""
    added = F.transform(detectors.term_candidates(F.col("text"), [term.strip()] if term.strip() else [], numbered=False), lambda c: F.struct(spans.match_id(c).alias("match_id"), c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"), c["category"].alias("category"), c["placeholder"].alias("placeholder"), F.lit(True).alias("selected")))
    plain = lambda m: F.struct(*[m[x].alias(x) for x in ("start", "end", "value", "category", "placeholder")])
    both = docs.withColumn("__all", F.concat("matches", added))
    kept = spans.resolved(F.transform("__all", plain), spans.clauses(F.col("text")))
    # The flags of the matches that stay are looked up by their id.
    flags = F.transform(kept, lambda m: spans.bound(spans.match_id(m), lambda key: F.filter("__all", lambda x: (x["match_id"] == key) & (x["placeholder"] == m["placeholder"]))[0]))
    return both.withColumn("matches", F.when(F.size(added) > 0, flags).otherwise(F.col("matches"))).drop("__all")
