"""Toxicity: a two-state linear-chain conditional random field over words.

Word tags come from document labels: words and word beginnings that toxic documents hold far more often
than clean ones, in many documents and after many different words, are tagged in toxic documents. The
field has weights for a word (a rare one counts as its beginning), the word before and the word after,
and for the transitions; it is fitted by gradient ascent with forward-backward sums. Marginals of all words of every whole text give the document's score,
the largest marginal, and the offending spans.

The fit uses at most ``SAMPLE`` toxic and ``CLEAN`` clean labelled ids, those of smallest hash, one row of each id and
``FIT_BYTES`` of whole texts at most; a documented bound. Clean rows weigh less where there are more of them. Scoring covers all rows.

Defined cases: null, empty or wordless text scores 0 and is not toxic; null labels are no labels;
repeated rows are scored alike; without labels of both classes every score is 0; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_of_id, documents, text_of, text_slices

FIT_BYTES = 64 << 20
SAMPLE, CLEAN, FOLDS, STEPS, LEAST_DOCS, LEAST_ODDS, STEM = 500, 1500, 5, 30, 5, 3.0, 5
WORD = re.compile(r"[^\W\d_]+")


def stem(word: str) -> str:
    """What a rare word counts as: its beginning, marked so that it is no word."""
    return word[:STEM] + "*"


class Known(dict):
    """Ids of words; those of other words (their beginning's, else 0) are remembered up to a bound."""

    most = 500_000

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__(vocabulary)
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
            self.update(self.vocabulary)
        i = self[word] = self.vocabulary.get(stem(word), 0)
        return i

    def __reduce__(self):
        return Known, (self.vocabulary,)


class Field:
    """The fitted field: vocabulary, weights (word, word before, word after) and transitions."""

    def __init__(self, vocabulary: dict[str, int], size: int):
        self.vocabulary = Known(vocabulary)
        self.weights = np.zeros((3, size + 1))
        self.trans = np.zeros((2, 2))
        self.start = 0.0

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (0: unknown) and the number of words of each text."""
        ids = [np.fromiter(map(self.vocabulary.__getitem__, WORD.findall(text.lower())), dtype=np.int32) for text in texts]
        return np.concatenate([np.zeros(0, dtype=np.int32), *ids]), np.array([len(x) for x in ids], dtype=np.int64)

    def neighbours(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words before and after (last id: none), and which words are first."""
        first = np.zeros(len(ids), dtype=bool)
        starts = np.cumsum(counts) - counts
        first[starts[counts > 0]] = True
        none = self.weights.shape[1] - 1
        before, after = np.roll(ids, 1), np.roll(ids, -1)
        before[first] = none
        after[np.roll(first, -1)] = none
        return before, after, first

    def odds(self, emit: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward odds of the toxic state; all texts advance together, a word at a time."""
        order = np.argsort(-counts, kind="stable")
        starts, long = (np.cumsum(counts) - counts)[order], counts[order]
        a, e = np.exp(self.trans), np.exp(np.clip(emit, -30, 30))
        forward, backward = np.empty(len(emit)), np.empty(len(emit))
        alive = np.searchsorted(-long, -np.arange(1, (long[0] if len(long) else 0) + 1), side="right")
        r = np.full(len(counts), math.exp(self.start))
        for t, n in enumerate(alive.tolist()):
            at = starts[:n] + t
            x = r[:n] if t == 0 else (r[:n] * a[1, 1] + a[0, 1]) / (r[:n] * a[1, 0] + a[0, 0])
            r = x * e[at]
            forward[at] = r
        s, ahead = np.ones(len(counts)), 0
        for t in range(len(alive) - 1, -1, -1):
            n = int(alive[t])
            at = starts[:n] + t
            if ahead:
                x = e[at[:ahead] + 1] * s[:ahead]
                s[:ahead] = (a[1, 0] + a[1, 1] * x) / (a[0, 0] + a[0, 1] * x)
            backward[at] = s[:n]
            ahead = n
        return forward, backward

    def marginals(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        before, after, _ = self.neighbours(ids, counts)
        w = self.weights
        forward, backward = self.odds(w[0][ids] + w[1][before] + w[2][after], counts)
        both = forward * backward
        return both / (1 + both)


def _distinct(keys: np.ndarray, others: np.ndarray, size: int) -> np.ndarray:
    """For each of ``size`` keys, the number of different others it occurs with."""
    return np.bincount(np.unique(keys.astype(np.int64) << 32 | others) >> 32, minlength=size)


def toxic_words(keys: np.ndarray, before: np.ndarray, doc: np.ndarray, toxic: np.ndarray, size: int) -> np.ndarray:
    """Which keys (of words or beginnings) mark toxic documents: frequent there, rare in clean ones.

    A key counts once for a document and once for each different word before it, and the smaller number
    holds: neither a document that repeats a word nor one that was copied many times makes a mark.
    """
    bad = toxic[doc]
    support = np.minimum(_distinct(keys[bad], doc[bad], size), _distinct(keys[bad], before[bad], size))
    clean = _distinct(keys[~bad], doc[~bad], size)
    n, m = int(toxic.sum()) + 1, int((~toxic).sum()) + 1
    return (support >= max(LEAST_DOCS, n // 100)) & (np.log((support + 0.5) / n) - np.log((clean + 0.5) / m) >= LEAST_ODDS)


def fit(texts: list[str], toxic: list[bool], steps: int = STEPS) -> Field | None:
    if not any(toxic) or all(toxic):
        return None
    codes: dict[str, int] = {}
    each = [np.fromiter((codes.setdefault(w, len(codes)) for w in WORD.findall(t.lower())), dtype=np.int32) for t in texts]
    counts = np.array([len(x) for x in each], dtype=np.int64)
    flat, doc = np.concatenate(each), np.repeat(np.arange(len(texts)), counts)
    if not len(flat):
        return None
    prior = np.roll(flat, 1)
    prior[(np.cumsum(counts) - counts)[counts > 0]] = len(codes)
    stems: dict[str, int] = {}
    stem_of = np.fromiter((stems.setdefault(stem(w), len(stems)) for w in codes), dtype=np.int32)
    bad = np.array(toxic)
    is_toxic = toxic_words(flat, prior, doc, bad, len(codes)) | toxic_words(stem_of[flat], prior, doc, bad, len(stems))[stem_of]
    spread = _distinct(flat, doc, len(codes))
    names = [w for w, n in zip(codes, spread.tolist(), strict=True) if n > 1] + list(stems)
    vocabulary = {w: i + 1 for i, w in enumerate(sorted(names))}
    field = Field(vocabulary, len(vocabulary) + 1)
    y = is_toxic[flat] & bad[doc]
    weight = np.where(bad, 1.0, min(1.0, bad.sum() / (~bad).sum()) ** 0.5)[doc]
    del each, prior, doc, flat, codes
    ids, counts = field.words(texts)
    before, after, first = field.neighbours(ids, counts)
    later = np.flatnonzero(~first)
    size = field.weights.shape[1]
    grad_true = np.stack([np.bincount(k, weights=y, minlength=size) for k in (ids, before, after)])
    pairs_true = np.bincount(y[later - 1] * 2 + y[later], weights=weight[later], minlength=4).reshape(2, 2)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (field.weights, field.trans)]
    for step in range(1, steps + 1):
        w = field.weights
        emit = w[0][ids] + w[1][before] + w[2][after]
        forward, backward = field.odds(emit, counts)
        both = forward * backward
        p = both / (1 + both)
        grad = grad_true - np.stack([np.bincount(k, weights=p * weight, minlength=size) for k in (ids, before, after)]) - 0.1 * w
        left, right = forward[later - 1], np.exp(np.clip(emit[later], -30, 30)) * backward[later]
        (a00, a01), (a10, a11) = np.exp(field.trans)
        each = weight[later] / (a00 + a01 * right + a10 * left + a11 * left * right)
        joint = np.array([[a00 * each.sum(), a01 * (right @ each)], [a10 * (left @ each), a11 * ((left * right) @ each)]])
        for value, g, (m, v) in zip((field.weights, field.trans), (grad, pairs_true - joint - 0.1 * field.trans), moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += 0.5 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return field


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, clean: int = CLEAN, label_col: str = "toxic") -> Field | None:
    """Fits the field on at most ``sample`` toxic and ``clean`` clean rows outside the held-out fold, ``FIT_BYTES`` in all."""
    known = labels.filter(F.col(label_col).isin(0, 1)).groupBy("doc_id").agg(F.max(label_col).alias("y"))
    known = known.filter(F.col("doc_id").isNotNull() & (F.pmod(crc_of_id(), F.lit(FOLDS)) != 0))
    drawn = known.filter("y = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).unionAll(known.filter("y = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(clean))
    rows = docs.select("doc_id", text_of().alias("t")).join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("t").alias("t"), F.first("y").alias("y"))
    # Each class has half of the bytes; long texts come last, and a class is never without its first text.
    size = F.octet_length("t").cast("long")
    upto = Window.partitionBy("y").orderBy(size > FIT_BYTES // 64, F.xxhash64("doc_id"), "doc_id")  # over at most sample or clean rows
    rows = rows.withColumn("nth", F.row_number().over(upto)).withColumn("bytes", F.sum(size).over(upto.rowsBetween(Window.unboundedPreceding, 0))).filter((F.col("bytes") <= FIT_BYTES // 2) | (F.col("nth") == 1))
    rows = rows.select("doc_id", "t", "y").orderBy("doc_id").collect()
    return fit([r["t"] for r in rows], [r["y"] == 1 for r in rows])


def score(docs: DataFrame, field: Field | None, keep: list[str], spans: bool = False, text_col: str = "text") -> DataFrame:
    """``keep`` columns with score and, if asked for, the spans (start, end, value) whose words are toxic at 0.5."""
    model = docs.sparkSession.sparkContext.broadcast(field)
    kind = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("value", "string"))
    schema = docs.select(*keep).schema.add("score", "double")
    if spans:
        schema = schema.add("spans", kind)

    def run(batches):
        for batch in text_slices(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            best, p, counts = np.zeros(len(texts)), np.zeros(0), np.zeros(len(texts), dtype=np.int64)
            if model.value is not None:
                ids, counts = model.value.words(texts)
                p = model.value.marginals(ids, counts)
                some = counts > 0
                if some.any():
                    best[some] = np.maximum.reduceat(p, (np.cumsum(counts) - counts)[some])
            out = batch.drop_columns([batch.schema.names[-1]]).append_column("score", pa.array(best))
            if spans:
                ends, rows = np.cumsum(counts), []
                for text, at, n in zip(texts, ends - counts, counts, strict=True):
                    hits = set(np.flatnonzero(p[at : at + n] >= 0.5).tolist())
                    rows.append([{"start": m.start(), "end": m.end(), "value": m.group()} for i, m in enumerate(WORD.finditer(text.lower())) if i in hits] if hits else [])
                out = out.append_column("spans", pa.array(rows, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))))
            yield out

    return docs.select(*keep, text_of(text_col).alias("__text")).mapInArrow(run, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    field = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("doc_id", "text"), field, ["doc_id"])
    return scored.select("doc_id", (F.pmod(crc_of_id(), F.lit(FOLDS)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
