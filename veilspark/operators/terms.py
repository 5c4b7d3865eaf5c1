"""Custom terms given as a table: all of them are found in one pass over each text.

The terms are an Aho-Corasick automaton in the tasks; the plan has one expression for it, however many terms there are.
A part of the table is collected and broadcast only up to PART_CHARS characters. A larger table is cut into such parts by hash; each part's hits are
written to the shared folder by a pass of its own and gathered for each document afterwards.

Defined cases: terms are trimmed, null and blank ones are left out; repeated terms give their hits for each of their numbers; hits
of one term do not overlap, those of different terms may (resolution settles that); a null text has no hits.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import trim
from ..functions.spans import CANDIDATE, none

PART_CHARS = 4_000_000
ROW = CANDIDATE.removeprefix("array<").removesuffix(">")


def numbered(terms: DataFrame, no_col: str = "term_no", term_col: str = "term") -> DataFrame:
    """no (its number), term."""
    return terms.select(F.col(no_col).cast("long").alias("no"), trim(F.col(term_col)).alias("term")).filter("term <> ''")


def _automaton(rows: list[tuple[int, str]]):
    import ahocorasick

    automaton, numbers = ahocorasick.Automaton(), {}
    for no, term in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        numbers.setdefault(term, []).append(no)
    for term, nos in numbers.items():
        automaton.add_word(term, (len(term), nos))
    automaton.make_automaton()
    return automaton


def found_terms(automaton, text: str | None, shown: str) -> list[tuple]:
    """Hits (number, start, end, value, placeholder) by number of the term, then by place; ``shown`` has {} for the number."""
    hits, ends = [], {}
    for last, (size, nos) in automaton.iter(text) if text else ():
        start = last + 1 - size
        term = text[start : last + 1]
        if start >= ends.get(term, 0):  # the next hit of a term begins after its last one
            ends[term] = last + 1
            hits += [(no, start, last + 1, term, shown.format(no)) for no in nos]
    return sorted(hits, key=lambda h: (h[0] is None, h[0], h[1]))


def _scanner(broadcast, shown: str):
    """A function over batches of texts; a Python worker builds the automaton once."""
    built = []

    def scan(texts: pd.Series) -> list[list[tuple]]:
        if not built:
            built.append(_automaton(broadcast.value))
        return [found_terms(built[0], t, shown) for t in texts]

    return scan


def _as_dict(hit: tuple) -> dict:
    return {"start": hit[1], "end": hit[2], "value": hit[3], "category": "custom", "placeholder": hit[4]}


def with_terms(docs: DataFrame, terms: DataFrame, name: str = "term_candidates", text_col: str = "text", shown: str = "【敏感信息{}】", folder: str | None = None) -> DataFrame:
    """``docs`` with the candidates of all terms, in the order of their numbers. ``folder``: shared, for tables of several parts."""
    spark, rows = docs.sparkSession, numbered(terms)
    chars = rows.agg(F.coalesce(F.sum(F.length("term")), F.lit(0))).first()[0]
    if chars == 0:
        return docs.withColumn(name, none(CANDIDATE))
    parts = -(-chars // PART_CHARS)
    part_rows = lambda i: [(r.no, r.term) for r in rows.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == i).collect()]
    if parts == 1:
        scan = _scanner(spark.sparkContext.broadcast(part_rows(0)), shown)

        @F.pandas_udf(CANDIDATE)
        def candidates(texts: pd.Series) -> pd.Series:
            return pd.Series([[_as_dict(h) for h in hits] for hits in scan(texts)])

        return docs.withColumn(name, candidates(F.col(text_col)))
    if folder is None:
        raise ValueError(f"{chars} characters of terms are more than {PART_CHARS}: a shared folder is needed")
    # Texts are known by their digest, so no id is asked for and equal texts are searched for once.
    texts = docs.select(F.sha2(text_col, 256).alias("digest"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    paths = []
    for i in range(parts):
        sent = spark.sparkContext.broadcast(part_rows(i))
        scan = _scanner(sent, shown)

        def run(frames, scan=scan):
            for frame in frames:
                out = [(digest, no, start, end, value, "custom", text) for digest, hits in zip(frame["digest"], scan(frame["text"]), strict=True) for no, start, end, value, text in hits]
                yield pd.DataFrame(out, columns=["digest", "no", "start", "end", "value", "category", "placeholder"])

        paths.append(f"{folder.rstrip('/')}/terms-{uuid.uuid4().hex}")
        texts.mapInPandas(run, "digest string, no long, start int, end int, value string, category string, placeholder string").dropDuplicates(["digest", "no", "start"]).write.parquet(paths[-1])
        sent.destroy()
    hits = spark.read.parquet(*paths).groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("no", "start", F.struct("start", "end", "value", "category", "placeholder").alias("c")))).alias("hits"))
    joined = docs.withColumn("__digest", F.sha2(text_col, 256)).join(hits.withColumnsRenamed({"digest": "__digest", "hits": "__hits"}), "__digest", "left")
    return joined.withColumn(name, F.coalesce(F.transform("__hits", lambda h: h["c"]), none(CANDIDATE))).drop("__digest", "__hits")


def term_placeholders(found: Column) -> Column:
    """How many hits each placeholder has."""
    names = F.array_distinct(F.transform(found, lambda c: c["placeholder"]))
    return F.map_from_arrays(names, F.transform(names, lambda p: F.size(F.filter(found, lambda c: c["placeholder"] == p))))


__all__ = ["PART_CHARS", "found_terms", "numbered", "term_placeholders", "with_terms"]
