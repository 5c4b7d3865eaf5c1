"""Best-fit packing by exact-complement hashing.

Texts become token ids and pieces of at most ``size`` ids in one pass. Only the count of pieces by
length, at most ``size`` numbers, goes to the driver. The plan is made on these counts: an index of
available lengths finds single, pair and triple sums that fill the gap beside the longest piece
exactly; whole batches of equal combinations are consumed at once, as far as counts allow; where no
sum fits exactly, the gap is filled best-fit. A recipe (copies, lengths) stands for all its copies, so the plan's size
depends on ``size`` and not on the data. Pieces find their recipe by their rank among pieces of
their length; ranks are counted in salted groups, so a length that most pieces share is spread.

Defined cases: null text is the empty text, which is the end id alone; repeated rows are pieces of
their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, scratch, text_of, text_slices

SIZE, END_ID, SALTS = 1024, 2, 256
REACHES = (1.0, 0.9, 0.8, 0.5, 0.0)
# The pre-splitting of the byte-level vocabulary (a fixed value of its file).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of a byte-level BPE file. Ordinary text takes the faster of two libraries with equal ids."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        of_char = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(of_char[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.fast = tiktoken.Encoding("pieces", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece of each document; ``with_ids`` adds the ids."""
    path = tokenizer or default_tokenizer()
    ids_type = ", ids binary" if with_ids else ""

    def cut(batches):
        encoder = Encoder(path)
        for batch in text_slices(batches):
            cols = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encoder.ids(text.as_py()), np.uint32(END_ID)).astype("<u4")
                first = (len(ids) - 1) % size + 1
                bounds = [0, *range(first, len(ids) + 1, size)]
                for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    raw = ids[a:b].tobytes()
                    for k, v in zip(cols, (doc_id, i, a, b - a, zlib.crc32(raw), raw if with_ids else None), strict=True):
                        cols[k].append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = {k: pa.array(v, t) for (k, v), t in zip(cols.items(), types, strict=True) if with_ids or k != "ids"}
            yield pa.RecordBatch.from_pydict(arrays)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t")).mapInArrow(cut, PIECES + ids_type)


class Lengths:
    """Available counts by length, with exact look-ups of one, two or three lengths by their sum.

    Pairs are indexed by their sum, made when a sum is first asked for; as counts only fall, what has run out
    leaves the index for good. A triple is a length and an indexed pair.
    """

    def __init__(self, counts: dict[int, int], size: int):
        self.left = np.zeros(size + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.size = size
        self.pairs: dict[int, list[int]] = {}

    def enough(self, combo: tuple[int, ...]) -> int:
        """How many times the combination can be taken."""
        return min(int(self.left[x]) // combo.count(x) for x in set(combo))

    def take(self, combo: tuple[int, ...], times: int) -> None:
        for x in combo:
            self.left[x] -= times

    def pair(self, total: int, beside: tuple[int, ...] = ()) -> tuple[int, int] | None:
        """The most uneven available pair of this sum."""
        if total not in self.pairs:
            longer = np.arange((total + 1) // 2, total)
            self.pairs[total] = longer[(self.left[longer] > 0) & (self.left[total - longer] > 0)].tolist()  # the most uneven last
        held = self.pairs[total]
        while held and not (self.left[held[-1]] and self.left[total - held[-1]]):
            held.pop()
        return next(((a, total - a) for a in reversed(held) if self.enough((*beside, a, total - a))), None)

    def complement(self, longest: int, reach: float) -> tuple[int, ...] | None:
        """A single, pair or triple that fills the gap beside ``longest`` exactly, its longest part
        not under ``reach`` times the longest that fits (smaller parts are left for other gaps)."""
        gap = self.size - longest
        if gap == 0:
            return ()
        parts = np.flatnonzero(self.left[: gap + 1] > 0)[::-1]
        for x in parts[parts >= parts[0] * reach].tolist() if len(parts) else ():
            rest = gap - x
            found = (x,) if rest == 0 else (x, rest) if self.left[rest] > 0 else None
            if found is None and rest > 1 and (two := self.pair(rest, (longest, x))):
                found = (x, *two)
            if found and self.enough((longest, *found)):
                return found
        return None

    def best_fit(self, longest: int) -> tuple[int, ...]:
        """The longest piece and, again and again, the longest that still fits."""
        combo, gap, used = [longest], self.size - longest, np.zeros_like(self.left)
        used[longest] = 1
        while gap > 0:
            fits = np.flatnonzero((self.left - used)[: gap + 1] > 0)
            if not len(fits):
                break
            x = int(fits[-1])
            n = min(gap // x, int(self.left[x] - used[x]))
            combo += [x] * n
            used[x] += n
            gap -= n * x
        return tuple(combo)


def packing_plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """Recipes (copies, lengths in place order) that use every piece once; of several reaches, the best."""
    plans = []
    for reach in REACHES:
        lengths, plan = Lengths(counts, size), []
        for longest in range(size, 0, -1):
            while lengths.left[longest] > 0:
                exact = lengths.complement(longest, reach)
                combo = lengths.best_fit(longest) if exact is None else (longest, *exact)
                times = lengths.enough(combo)
                lengths.take(combo, times)
                plan.append((times, combo))
        plans.append(plan)
    return min(plans, key=lambda plan: sum(times for times, _ in plan))


def _places(plan: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces of this length in a copy, offset of the first), sorted."""
    rows, rank, sequence = [], {}, 0
    for times, combo in plan:
        offset = 0
        for x in sorted(set(combo), reverse=True):
            n = combo.count(x)
            rows.append((x, rank.get(x, 0), sequence, n, offset))
            rank[x] = rank.get(x, 0) + times * n
            offset += n * x
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """The pieces (a stored table with doc_id, piece, length and more) with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = _places(packing_plan(counts, size))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)
    groups = groups.select("length", "salt", (F.sum("n").over(before) - F.col("n")).alias("base"))
    ranked = salted.join(groups, ["length", "salt"])
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = ranked.withColumn("rank", F.col("base") + F.row_number().over(order) - 1).drop("salt", "base")
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches):
        span = 1 << 40
        keys = places[:, 0] * span + places[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("length", "rank"))
            row = places[np.searchsorted(keys, length * span + rank, side="right") - 1]
            nth = rank - row[:, 1]
            out = batch.drop_columns(["rank"])
            out = out.append_column("sequence_id", pa.array(row[:, 2] + nth // np.maximum(row[:, 3], 1)))
            yield out.append_column("offset", pa.array(row[:, 4] + nth % np.maximum(row[:, 3], 1) * length))

    return ranked.mapInArrow(place, schema)


def packed_documents(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    return pack(scratch(pieces(docs, tokenizer, size, id_col, text_col, with_ids), "pieces"), size)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = packed_documents(documents(spark, sf_dir))
    return done.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
