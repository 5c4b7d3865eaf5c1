"""Substring dedup: sharded FM-indexes report repeated windows of words.

A window is ``WINDOW`` consecutive words. Its anchor is its least run of ``RUN`` words by hash, so
equal windows have equal anchors. Windows in a row with one anchor are a passage. Anchors are counted
over all texts; passages of anchors that occur once cannot repeat. The others are cut out as words, equal
ones are combined before they are shuffled (the first place is kept), and go to shards by anchor. Each shard has
a compressed FM-index of its passages over bytes of word numbers, and streams their windows through it by
backward search: a window's matching statistic reaches the window's length where the interval holds more than the
window itself, and the interval's first place tells whether that was earlier. Equal bytes are
confirmed on the words. Every copy of a passage takes its windows from the passage's report.

Passages of an anchor with more than ``HOT`` different ones are cut into single windows, which go to shards by
their content, so that no shard grows with an anchor; their reports are put together again. Both ways give
the same windows.

Defined cases: null text has no words; documents are ordered by id, nulls first, then by a hash of the
text; rows that agree in id and text count as one document and are reported each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, scratch, text_of, text_slices
from .fm_index import FMIndex
from .shingles import WordHashes, grams, mixed

WINDOW, RUN, HOT = 20, 6, 20_000
SHARD_SYMBOLS = 1_000_000


def _anchors(hashes: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window, the place of its anchor; and the hashes of all runs."""
    g = grams(hashes, run)
    width = window - run + 1
    if len(g) < width:
        return np.zeros(0, dtype=np.int64), g
    # A place in the low bits settles ties, so one minimum finds both; windows are far shorter than 4096.
    low = np.uint64(0xFFF)
    key = (g & ~low) | (np.arange(len(g), dtype=np.uint64) & low)
    size = 1
    while 2 * size <= width:
        key = np.minimum(key[: len(key) - size], key[size:])
        size *= 2
    n = len(g) - width + 1
    key = np.minimum(key[:n], key[width - size : width - size + n])
    first = np.arange(n)
    return first + (((key & low).astype(np.int64) - first) & 0xFFF), g


def _passages(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First windows of the passages, and how many windows each has."""
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, dtype=np.int64)
    return first, np.diff(np.append(first, len(at)))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("kt"), text_of(text_col).alias("t"))


SPOTS = "array<struct<anchor:long,first:int,n:int>>"


def anchors(texts: DataFrame, window: int, run: int) -> DataFrame:
    """row (a number of its own), doc_id, kt, spots (anchor, first window and windows of each passage)."""

    def find(batches):
        words, row = WordHashes(), TaskContext.get().partitionId() << 33
        for batch in text_slices(batches):
            none = np.zeros(0, dtype=np.int64)
            anchor, first, n, sizes = [none], [none], [none], [0]
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                at, g = _anchors(words.of(text.split()), window, run)
                f, k = _passages(at)
                anchor.append(g[at[f]].view(np.int64))
                first.append(f)
                n.append(k)
                sizes.append(len(f))
            cols = [pa.array(np.concatenate(c), t) for c, t in ((anchor, pa.int64()), (first, pa.int32()), (n, pa.int32()))]
            spots = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.StructArray.from_arrays(cols, ["anchor", "first", "n"]))
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(batch.num_rows)), batch.column(0), batch.column(1), spots], ["row", "doc_id", "kt", "spots"])
            row += batch.num_rows

    return texts.mapInArrow(find, f"row long, doc_id long, kt long, spots {SPOTS}")


def suspects(found: DataFrame) -> DataFrame:
    """doc_id, kt, spots: the passages whose anchors occur more than once, a row for each different document."""
    each = found.select("row", F.explode("spots").alias("s")).select("row", "s.anchor", "s.first", "s.n")
    # Stored, so that the join shuffles both sides for itself and can split what one anchor holds.
    repeated = scratch(each.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1").select("anchor"), "repeated")
    spots = each.join(repeated, "anchor").groupBy("row").agg(F.collect_list(F.struct("anchor", "first", "n")).alias("spots"))
    one = found.groupBy("doc_id", "kt").agg(F.min("row").alias("row"))
    return one.join(spots, "row").select("doc_id", "kt", "spots")


def _with_texts(texts: DataFrame, more: DataFrame, how: str) -> DataFrame:
    """Texts beside what is known of their documents; texts travel compressed."""
    packed = texts.select("doc_id", "kt", F.col("t").cast("binary").alias("t")).mapInArrow(_squeeze, "doc_id long, kt long, z binary")
    more = more.withColumnsRenamed({"doc_id": "id", "kt": "k"})
    return packed.join(more, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("kt") == F.col("k")), how).drop("id", "k")


def _squeeze(batches):
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([press.compress(t) for t in batch.column(2).to_pylist()], pa.binary())], ["doc_id", "kt", "z"])


PASSAGE = "route long, digest binary, words binary, doc_id long, kt long, first int, n int"
PASSAGE_TYPES = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())


def _batch(rows: list[list], types, names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], [x.split()[0] for x in names.split(", ")])


def _digest(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def passages(texts: DataFrame, marked: DataFrame, window: int) -> DataFrame:
    """The marked passages of all texts: route (the anchor), digest, words (joined by a blank), doc_id, kt, first, n."""

    def cut(batches):
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = [[] for _ in PASSAGE_TYPES]
            for doc_id, kt, z, spots in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = unpress.decompress(z).split()
                for s in spots:
                    words = b" ".join(tokens[s["first"] : s["first"] + s["n"] + window - 1])
                    for col, v in zip(rows, (s["anchor"], _digest(words), words, doc_id, kt, s["first"], s["n"]), strict=True):
                        col.append(v)
            yield _batch(rows, PASSAGE_TYPES, PASSAGE)

    return _with_texts(texts, marked, "inner").select("doc_id", "kt", "z", "spots").mapInArrow(cut, PASSAGE)


def repeats_in_shard(contents: list[bytes], window: int) -> list[np.ndarray]:
    """For passages in document order, the windows of each whose words occur earlier."""
    numbers: dict[bytes, int] = {}
    split = [c.split() for c in contents]
    lengths = np.array([len(c) for c in split])
    starts = np.cumsum(lengths + 1) - lengths - 1
    flat = np.zeros(int(lengths.sum()) + len(split), dtype=np.int64)
    inner = np.ones(len(flat), dtype=bool)
    inner[starts + lengths] = False
    flat[inner] = np.fromiter((numbers.setdefault(w, len(numbers)) for c in split for w in c), dtype=np.int64, count=int(lengths.sum()))
    del split
    symbols = np.where(inner, 1 + (mixed(flat.view(np.uint64)) % np.uint64(255)).astype(np.int64), 0)
    index = FMIndex(symbols, window)
    sizes = lengths - window + 1
    owner = np.repeat(np.arange(len(contents)), sizes)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = starts[owner] + inside
    earliest = np.empty(len(at), dtype=np.int64)
    for a in range(0, len(at), 1 << 17):
        part = at[a : a + (1 << 17)]
        earliest[a : a + (1 << 17)] = index.earliest(*index.search(symbols[part[:, None] + np.arange(window)], own=True))
    repeated = (earliest >= 0) & (earliest < at)
    # Equal bytes are not yet equal words.
    unsure = np.flatnonzero(repeated)
    differ = np.zeros(len(unsure), dtype=bool)
    for i in range(window):
        differ |= flat[at[unsure] + i] != flat[earliest[unsure] + i]
    if differ.any():
        doubtful = np.isin(earliest, earliest[unsure[differ]])
        _, back = np.unique(flat[at[doubtful][:, None] + np.arange(window)], axis=0, return_inverse=True)
        first = np.full(back.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, back.ravel(), at[doubtful])
        repeated[doubtful] = first[back.ravel()] < at[doubtful]
    cuts = np.searchsorted(owner, np.arange(len(contents) + 1))
    return [inside[a:b][repeated[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]


REPORT = "route long, digest binary, doc_id long, kt long, first int, n int, repeated array<int>"
REPORT_TYPES = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()))


def shard_reports(distinct: DataFrame, window: int) -> DataFrame:
    """Of different passages (PASSAGE, at their first places) the windows that occur earlier in their shard."""

    def shards(batches):
        held, size, route = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != route and size > SHARD_SYMBOLS:
                    yield done(held)
                    held, size = [], 0
                route = row[0]
                held.append(row)
                size += row[6] + window
        if held:
            yield done(held)

    def done(rows):
        rows.sort(key=lambda r: (r[3] is not None, r[3] or 0, r[4], r[5]))
        repeated = repeats_in_shard([r[2] for r in rows], window)
        cols = [list(c) for c in zip(*rows, strict=True)]
        return _batch([cols[0], cols[1], *cols[3:], [x.tolist() for x in repeated]], REPORT_TYPES, REPORT)

    return distinct.repartition("route").sortWithinPartitions("route").mapInArrow(shards, REPORT)


def _combined(found: DataFrame) -> DataFrame:
    """Different passages at their first places."""
    merged = found.groupBy("route", "words").agg(F.min(F.struct("doc_id", "kt", "first")).alias("at"), F.first("digest").alias("digest"), F.first("n").alias("n"))
    return merged.select("route", "digest", "words", "at.doc_id", "at.kt", "at.first", "n")


def same_place(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.kt") == F.col(f"{b}.kt")) & (F.col(f"{a}.first") == F.col(f"{b}.first"))


def reports(found: DataFrame, window: int, hot: int) -> DataFrame:
    """For each different passage: its first place and which of its windows occur before that."""
    distinct = scratch(_combined(found), "distinct")
    crowded = scratch(distinct.groupBy("route").count().filter(F.col("count") > hot).select("route"), "crowded")
    if crowded.isEmpty():
        return shard_reports(distinct, window)

    def windows(batches):
        for batch in batches:
            rows = [[] for _ in range(9)]
            for route, digest, words, doc_id, kt, first, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = words.split()
                for i in range(n):
                    part = b" ".join(tokens[i : i + window])
                    for col, v in zip(rows, (xxhash.xxh3_64_intdigest(part) - (1 << 63), _digest(part), part, doc_id, kt, first + i, 1, route, digest), strict=True):
                        col.append(v)
            yield _batch(rows, (*PASSAGE_TYPES, pa.int64(), pa.binary()), PASSAGE + ", of_route long, of_digest binary")

    single = scratch(distinct.join(crowded, "route").mapInArrow(windows, PASSAGE + ", of_route long, of_digest binary"), "windows")
    told = shard_reports(_combined(single.drop("of_route", "of_digest")), window)
    met = single.alias("w").join(told.alias("r"), ["route", "digest"])
    owner = distinct.select(F.col("route").alias("of_route"), F.col("digest").alias("of_digest"), F.col("first").alias("begins"))
    gone = met.select("w.of_route", "w.of_digest", F.col("w.first").alias("place"), (~same_place("w", "r") | (F.size("r.repeated") > 0)).alias("gone")).filter("gone")
    gone = gone.join(owner, ["of_route", "of_digest"]).groupBy("of_route", "of_digest").agg(F.collect_list(F.col("place") - F.col("begins")).alias("repeated"))
    parts = distinct.join(crowded, "route").drop("words").join(gone.withColumnsRenamed({"of_route": "route", "of_digest": "digest"}), ["route", "digest"], "left")
    parts = parts.withColumn("repeated", F.coalesce("repeated", F.array().cast("array<int>")))
    return shard_reports(distinct.join(crowded, "route", "left_anti"), window).unionByName(parts)


def substring_dedup(docs: DataFrame, window: int = WINDOW, run: int = RUN, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, removed (ranges of words), kept_text."""
    texts = _texts(docs, id_col, text_col)
    marked = scratch(suspects(scratch(anchors(texts, window, run), "anchors")), "suspects")
    found = scratch(passages(texts, marked, window), "passages")
    told = scratch(reports(found, window, hot), "reports")
    copies = found.select("route", "digest", "doc_id", "kt", "first").alias("c").join(told.alias("r"), ["route", "digest"])
    first = same_place("c", "r")
    gone = copies.filter(~first | (F.size("r.repeated") > 0)).select("c.doc_id", "c.kt", F.struct("c.first", "r.n", F.when(first, F.col("r.repeated")).alias("repeated")).alias("gone"))
    known = gone.groupBy("doc_id", "kt").agg(F.collect_list("gone").alias("gone"))

    def strip(batches):
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            n_words, removed, kept = [], [], []
            for z, gone in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                tokens = unpress.decompress(z).split()
                n_words.append(len(tokens))
                if not gone:
                    removed.append([])
                    kept.append(b" ".join(tokens))
                    continue
                cover = np.zeros(len(tokens) + 1, dtype=np.int64)
                for part in gone:
                    if part["repeated"] is None:  # a later copy: all its windows have occurred
                        cover[part["first"]] += 1
                        cover[part["first"] + part["n"] + window - 1] -= 1
                    for i in part["repeated"] or ():
                        cover[part["first"] + i] += 1
                        cover[part["first"] + i + window] -= 1
                out = np.cumsum(cover[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([0], out.astype(np.int8), [0]))))
                removed.append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
                kept.append(b" ".join([t for t, o in zip(tokens, out.tolist(), strict=True) if not o]))
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "removed", "kept_text"])

    joined = _with_texts(texts, known, "left").select("doc_id", "z", "gone")
    return joined.mapInArrow(strip, "doc_id long, n_words long, removed array<struct<start:int,end:int>>, kept_text string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup(documents(spark, sf_dir))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return done.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))
