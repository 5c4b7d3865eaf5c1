"""Language-model scoring with an interpolated trigram model in an Elias-Fano trie.

Counting covers all training rows and keeps every word, pair and triple. Every token of every text, with the two words before it,
goes once to a shard, by the word before it. A shard counts what comes from training texts, builds its part of the trie (pairs
under their first word, contexts of two words, triples under their context), and looks up all tokens in it, those
of training texts too. So no table of n-grams has to fit the driver, a broadcast or a file that all tasks
read. Words travel by number, the commonest by their rank and others by their hash. A shard has about ``SHARD`` training tokens; a word with more occurrences is split into parts by the word
before it, and pairs under it are counted in its part: the context of such a pair is the word and the part.
Only the commonest words' own counts (at most 1 / ``LEAST_SHARE``) are broadcast, and the list of the table's files; those of all other words meet texts and
shards in joins.

Probabilities: words have (c + 1) / (N + V + 1); longer n-grams are discounted by ``DISCOUNT`` and
interpolated with the shorter ones; what does not occur backs off with the weight of its context. The trie holds
how much a token gains on its base in its context. Words are known by 63 bits that are distinct among
the training words; a word that training lacks could meet one of them with a probability of about V / 2**63.

Defined cases: null text is the empty text, which is one end token; repeated rows are scored alike
and counted each; null ids count as the empty id; without training rows every probability is 1 by the
base formula; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_of_id, documents, scratch, text_of, text_slices
from .ngram_trie import Level
from .shingles import WordHashes, mixed

FOLDS, TEST_FOLD, LEAST_SHARE, DISCOUNT = 7, 2, 2e-7, 0.75
END = b"\n"  # no word holds a line feed
FLUSH, SHARD = 300_000, 600_000
SLICE = 6 << 20  # bytes of text at a time


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased (bytes methods touch ASCII only), then the end."""
    found = text.lower().split()
    found.append(END)
    return found


def _texts(batch) -> list[bytes]:
    return batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()


def count_words(rows: DataFrame) -> DataFrame:
    """word (binary), n of a one-column table of texts."""

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in _texts(batch):
                seen.update(words_of(text))
                if len(seen) > FLUSH:
                    yield pa.RecordBatch.from_pydict({"word": pa.array(seen.keys(), pa.binary()), "n": pa.array(seen.values(), pa.int64())})
                    seen.clear()
        yield pa.RecordBatch.from_pydict({"word": pa.array(seen.keys(), pa.binary()), "n": pa.array(seen.values(), pa.int64())})

    return rows.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Hashes(WordHashes):
    """63-bit hashes of words with a seed."""

    def __init__(self, seed: int):
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed) >> 1
        return h


def _hashed(counts: DataFrame) -> tuple[DataFrame, int]:
    """word, n, h of the words, and the seed that keeps their hashes apart."""
    seed = 0
    while True:

        def run(batches, seed=seed):
            for batch in batches:
                h = _Hashes(seed).of(batch.column(0).to_pylist())
                yield batch.append_column("h", pa.array(h.view(np.int64)))

        found = scratch(counts.mapInArrow(run, "word binary, n long, h long"), "words")
        if found.groupBy("h").count().filter("count > 1").isEmpty():
            return found, seed
        seed += 1


RARE, NONE = np.uint64(1 << 63), np.uint64((1 << 63) - 1)  # marks the codes of rare words; the code of no word


class Model:
    """Codes of words (the commonest have their rank, others their marked hash), and how tokens are dealt to shards."""

    def __init__(self, known: np.ndarray, counts: np.ndarray, n: int, v: int, seed: int = 0, shard: int = SHARD):
        order = np.lexsort((known, -counts))
        self.counts = counts[order]
        by_hash = np.argsort(known[order])
        self.keys, self.ranks = known[order][by_hash], by_hash
        self.n, self.v, self.seed = n, v, seed
        self.shards = max(1, -(-n // shard))
        self.parts = -(-self.counts[self.counts > shard] // shard)  # of the words that are split, the first ones by rank
        self._hashes: _Hashes | None = None

    def __getstate__(self):
        return self.__dict__ | {"_hashes": None}

    def codes(self, words: list[bytes]) -> np.ndarray:
        if self._hashes is None:
            self._hashes = _Hashes(self.seed)
        h, at = np.unique(self._hashes.of(words), return_inverse=True)
        rank = _looked_up(self.keys, self.ranks, h)
        return np.where(rank >= 0, rank.astype(np.uint64), h | RARE)[at]

    def own(self, codes: np.ndarray) -> np.ndarray:
        """Counts of words; -1 for rare ones and no word."""
        if not len(self.counts):
            return np.full(len(codes), -1)
        return np.where(codes < NONE, self.counts[np.minimum(codes, np.uint64(len(self.counts) - 1)).astype(np.int64)], -1)

    def log_word(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 1) / (self.n + self.v + 1))

    def part(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In which part of the word before (b) the n-grams with the word two before (a) are."""
        if not len(self.parts):
            return np.zeros(len(b), dtype=np.int64)
        split = b < np.uint64(len(self.parts))
        parts = np.where(split, self.parts[np.where(split, b, np.uint64(0)).astype(np.int64)], 1)
        return (mixed(a) % parts.astype(np.uint64)).astype(np.int64)

    def shard(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Parts of a word lie in shards side by side, which are different ones."""
        return ((mixed(b) % np.uint64(self.shards)).astype(np.int64) + self.part(a, b)) % self.shards


def _looked_up(keys: np.ndarray, values: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values beside sorted keys; -1 where there is none."""
    if not len(keys):
        return np.full(len(h), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, values[at], -1)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, all first ones before all second ones and so on: like ones stand together."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _numbers(raw: bytes, kind, n: int, at: int) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(raw, dtype=np.uint8, count=n * size, offset=at).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel(), at + n * size


def _pack(a: np.ndarray, b: np.ndarray, c: np.ndarray, more: np.ndarray) -> bytes:
    """The columns in one compressed piece; words have numbers of the piece's own, in the order of their codes; codes of
    common words and the other column are told by their steps."""
    words, at = np.unique(np.concatenate((a, b, c)), return_inverse=True)
    common = int(np.searchsorted(words, NONE))
    at = at.astype(np.uint16 if len(words) < 1 << 16 else np.uint32)
    head = np.array([len(words), common, len(a)]).tobytes()
    parts = [head, _planes(np.diff(words[:common], prepend=np.uint64(0)).astype(np.uint32)), words[common:].tobytes(), *(_planes(x) for x in at.reshape(3, -1)), _planes(np.diff(more, prepend=0))]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of words, their numbers (rows of a, b, c), and the other column."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    v, common, n = np.frombuffer(raw, dtype=np.int64, count=3).tolist()
    steps, at = _numbers(raw, np.uint32, common, 24)
    words, at = np.concatenate((np.cumsum(steps, dtype=np.uint64), np.frombuffer(raw, dtype=np.uint64, count=v - common, offset=at))), at + 8 * (v - common)
    columns = np.empty((3, n), dtype=np.int64)
    for i in range(3):
        columns[i], at = _numbers(raw, np.uint16 if v < 1 << 16 else np.uint32, n, at)
    return words, columns, np.cumsum(_numbers(raw, np.int64, n, at)[0])


def _by_shard(shard: np.ndarray, *columns: np.ndarray):
    """Each shard with its part of the columns."""
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    bounds = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))) if len(shard) else np.zeros(0, dtype=np.int64)
    for x, y in zip(bounds, bounds[1:], strict=False):
        yield int(shard[x]), *(col[order[x:y]] for col in columns)


def _runs(batches):
    """Each key with the batches that hold its rows; rows come sorted by their first column."""
    now, held = None, []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else np.zeros(0, dtype=np.int64)
        for x, y in zip(bounds, bounds[1:], strict=False):
            if held and keys[x] != now:
                yield int(now), held
                held = []
            now = keys[x]
            held.append(batch.slice(x, y - x))
    if held:
        yield int(now), held


class Trie:
    """A shard's trie: pairs under their first word, contexts of two words, triples under their context.

    Words are numbers; triples come as different (b, a, c), sorted, with their counts in training; a is ``none`` where
    a text has no word before. ``own`` has the words' own counts.
    """

    def __init__(self, b: np.ndarray, a: np.ndarray, c: np.ndarray, n: np.ndarray, none: int, own: np.ndarray, total: int):
        self.firsts, first = np.unique(b, return_inverse=True)
        span = np.int64(len(own))
        keys, pair = np.unique(first * span + c, return_inverse=True)
        n2, first2, word2 = np.bincount(pair, n, len(keys)), keys // span, keys % span
        seen, kept = np.bincount(first2, n2, len(self.firsts)), np.maximum(n2 - DISCOUNT, 0)
        back = np.clip(1 - np.bincount(first2, kept, len(self.firsts)) / np.maximum(seen, 1), 1e-9, 1)
        alone = (own[word2] + 1) / total
        p = kept / seen[first2] + back[first2] * alone
        self.log_back = np.log10(back)
        self.pairs = Level(len(self.firsts), first2, word2, np.log10(np.minimum(p, 1) / alone))
        whole = a != none
        first, a, c, n, pair = first[whole], a[whole], c[whole], n[whole], pair[whole]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (first[1:] != first[:-1])
        context, size = np.cumsum(new) - 1, int(new.sum())
        seen, kept = np.bincount(context, n, size), np.maximum(n - DISCOUNT, 0)
        back = np.clip(1 - np.bincount(context, kept, size) / np.maximum(seen, 1), 1e-9, 1)
        p3 = kept / seen[context] + back[context] * np.minimum(p[pair], 1)
        self.contexts = Level(len(self.firsts), first[new], a[new], log_back=np.log10(back))
        self.triples = Level(size, context, c, np.log10(np.minimum(p3, 1) / alone[pair]))

    @staticmethod
    def _found(level: Level, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        found = np.full(len(parent), -1, dtype=np.int64)
        may = np.flatnonzero(parent >= 0)
        if len(may) and level.words.n:
            found[may] = level.find(parent[may], word[may])
        return found

    def gains(self, b: np.ndarray, a: np.ndarray, nth: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 of the probability of words c, each in its context (b, a)[nth], less that of the word alone. The longest
        n-gram is sought first, shorter ones only where it is missing."""
        out = np.zeros(len(c))
        if not len(self.firsts):
            return out
        first = np.minimum(np.searchsorted(self.firsts, b), len(self.firsts) - 1)
        first = np.where(self.firsts[first] == b, first, -1)
        context = self._found(self.contexts, first, a)
        triple = self._found(self.triples, context[nth], c)
        out[triple >= 0] = self.triples.log_p(triple[triple >= 0])
        rest = np.flatnonzero(triple < 0)
        first, context = first[nth[rest]], context[nth[rest]]
        gain = np.where(first >= 0, self.log_back[first], 0.0)
        pair = self._found(self.pairs, first, c[rest])
        gain[pair >= 0] = self.pairs.log_p(pair[pair >= 0])
        gain[context >= 0] += self.contexts.log_back[context[context >= 0]]
        out[rest] = gain
        return out


def shard_gains(blobs: list[bytes], rare: np.ndarray, rare_n: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the gains of their tokens in this shard; the trie is built from the training ones of them."""
    parts = [_unpack(blob) for blob in blobs]
    words, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    starts = np.cumsum([0, *(len(p[0]) for p in parts)])
    a, b, c = (np.concatenate([at[s:][p[1][i]] for s, p in zip(starts, parts, strict=False)]) for i in range(3))
    more = np.concatenate([p[2] for p in parts])
    del parts, at
    row, training, span = more >> 1, more & 1, np.int64(len(words) + 1)
    contexts, context = np.unique(b * span + a, return_inverse=True)
    triples, nth = np.unique(context * span + c, return_inverse=True)
    n = np.bincount(nth, training, len(triples))
    of, c = triples // span, triples % span
    a, b = contexts % span, contexts // span
    none = int(np.searchsorted(words, NONE))
    none = none if none < len(words) and words[none] == NONE else -1
    own = model.own(words)
    order = np.argsort(rare)
    own = np.maximum(np.where(own < 0, _looked_up(rare[order] | RARE, rare_n[order], words), own), 0)
    seen = n > 0
    trie = Trie(b[of[seen]], a[of[seen]], c[seen], n[seen], none, own, model.n + model.v + 1)
    a = np.where(a == none, len(words), a)  # no context holds this number
    rows, place = np.unique(row, return_inverse=True)
    return rows, np.bincount(place, trie.gains(b, a, of, c)[nth], len(rows))


def train(rows: DataFrame, least_share: float = LEAST_SHARE, shard: int = SHARD) -> tuple[Model, DataFrame]:
    """The words of a one-column table of texts: the model of the commonest ones, and the table (word, n, h) of all."""
    counts, seed = _hashed(count_words(rows))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    least = max(1.0, least_share * total["n"])
    frequent = counts.filter(F.col("n") >= least).select("h", "n").toArrow()  # at most 1 / least_share rows
    return Model(frequent.column("h").to_numpy().view(np.uint64), frequent.column("n").to_numpy(), total["n"], total["v"], seed, shard), counts


TOLD = "n_tokens long, n_here long, base_here double, rare array<long>, __row long, shard long, h long"


class Tokens:
    """The tokens of a batch of texts: codes, text of each, tokens of each text, and the places of all but a text's first."""

    def __init__(self, batch, model: Model):
        split = [words_of(t) for t in _texts(batch)]
        self.n = np.array([len(x) for x in split], dtype=np.int64)
        self.codes, self.starts = model.codes([w for x in split for w in x]), np.cumsum(self.n) - self.n
        self.text = np.repeat(np.arange(len(self.n)), self.n)
        self.learning = batch.column(batch.num_columns - 2).to_numpy().astype(np.int64)
        self.here = np.flatnonzero(np.arange(len(self.codes)) > self.starts[self.text])

    def grams(self, here: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The word two before (none at a text's second token), the word before and the word."""
        return np.where(here > self.starts[self.text[here]] + 1, self.codes[here - 2], NONE), self.codes[here - 1], self.codes[here]


MOST_TASKS = 20_000  # a task takes several shards in order beyond that
BUCKET = 20  # bits of a row's number below its bucket's: a task sums the answers for so many rows at most
FILE = 40  # bits of a row's number below its file's


class Numbers:
    """Numbers of a stored table's rows, by file and place in the file: the same ones however the files are split."""

    def __init__(self, rows: DataFrame):
        self.of = {self.plain(name): i for i, name in enumerate(sorted(rows.inputFiles()))}

    @staticmethod
    def plain(name: str) -> str:
        """An address as both listings give it: one slash after the scheme, nothing escaped."""
        return re.sub("^([A-Za-z0-9+.-]+:)/+", r"\1/", unquote(name))

    def __call__(self, batch) -> np.ndarray:
        files, place = batch.column(0).dictionary_encode(), batch.column(1).to_numpy().astype(np.int64)
        first = np.array([self.of[self.plain(name)] for name in files.dictionary.to_pylist()], dtype=np.int64)
        return (first[files.indices.to_numpy()] << FILE) + place if batch.num_rows else place


def _placed(rows: DataFrame) -> DataFrame:
    """Rows of a stored table behind their file and place in it."""
    return rows.select(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place"), "*")


def _told(rows: DataFrame, model: Model, keep: int) -> DataFrame:
    """Of each row what the commonest words tell of it, and its rare words; and the rare words (h) whose counts a shard needs."""
    shared, numbers = rows.sparkSession.sparkContext.broadcast(model), rows.sparkSession.sparkContext.broadcast(Numbers(rows))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema[:keep]])
    for field in T._parse_datatype_string(TOLD):
        schema = schema.add(field)

    def run(batches):
        m = shared.value
        for batch in text_slices(batches, most=SLICE):
            t = Tokens(batch, m)
            own = m.own(t.codes)
            known, base = own >= 0, np.where(own >= 0, m.log_word(np.maximum(own, 0)), 0.0)
            unknown, many = np.flatnonzero(~known), len(t.n)
            rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(t.text[unknown], np.arange(many + 1)), pa.int32()), pa.array((t.codes[unknown] & NONE).view(np.int64)))
            told = [pa.array(t.n), *(pa.array(np.add.reduceat(x, t.starts)) for x in (known.astype(np.int64), base)), rare, pa.array(numbers.value(batch)), pa.nulls(many, pa.int64()), pa.nulls(many, pa.int64())]
            out = pa.RecordBatch.from_arrays([*batch.columns[2 : keep + 2], *told], schema.names)
            yield out
            need = t.here[~known[t.here] & (t.learning[t.text[t.here]] == 1)]
            if len(need):
                a, b, c = t.grams(need)
                shard = m.shard(a, b)
                order = np.lexsort((c, shard))
                shard, c = shard[order], c[order]
                new = np.append(True, (shard[1:] != shard[:-1]) | (c[1:] != c[:-1]))
                filled = {"shard": pa.array(shard[new]), "h": pa.array((c[new] & NONE).view(np.int64))}
                yield pa.RecordBatch.from_arrays([filled.get(f.name, pa.nulls(int(new.sum()), f.type)) for f in out.schema], schema.names)

    return scratch(_placed(rows).mapInArrow(run, schema), "told")


def _pieces(rows: DataFrame, model: Model) -> DataFrame:
    """shard, blob: the tokens of all rows with the words before them, in pieces for their shards."""
    shared, numbers = rows.sparkSession.sparkContext.broadcast(model), rows.sparkSession.sparkContext.broadcast(Numbers(rows))

    def run(batches):
        m = shared.value
        for batch in text_slices(batches, most=SLICE):
            t, row = Tokens(batch, m), numbers.value(batch)
            (a, b, c), of = t.grams(t.here), t.text[t.here]
            found = [(k, _pack(*part)) for k, *part in _by_shard(m.shard(a, b), a, b, c, row[of] * 2 + t.learning[of])]
            yield pa.RecordBatch.from_pydict({"shard": pa.array([k for k, _ in found], pa.int64()), "blob": pa.array([x for _, x in found], pa.binary())})

    return _placed(rows).mapInArrow(run, "shard long, blob binary")


def _gains(rows: DataFrame, told: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """__row, gain: what the shards answer, summed for each row. Answers travel packed, to the task that sums their
    bucket's rows (the high bits of a row's number)."""
    shared = told.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        def done(rare, rare_n, blobs):
            at = np.concatenate([np.zeros(0, dtype=np.int64), *rare]).view(np.uint64)
            rows, gain = shard_gains(blobs, at, np.concatenate([np.zeros(0, dtype=np.int64), *rare_n]), shared.value)
            found = [(k, _planes(np.diff(r, prepend=0).astype(np.uint32)) + _planes(g)) for k, r, g in _by_shard(rows >> BUCKET, rows & ((1 << BUCKET) - 1), gain.astype(np.float32))]
            press = zstandard.ZstdCompressor(level=3)
            return pa.RecordBatch.from_pydict({"bucket": pa.array([k for k, _ in found], pa.int64()), "sums": pa.array([press.compress(x) for _, x in found], pa.binary())})

        for _, held in _runs(batches):
            rare, rare_n, blobs = [], [], []
            for part in held:
                found = part.filter(part.column(4).is_null())
                rare.append(found.column(2).to_numpy())
                rare_n.append(found.column(3).to_numpy())
                blobs += part.column(4).drop_null().to_pylist()
            if blobs:
                yield done(rare, rare_n, blobs)

    def add(batches):
        for k, held in _runs(batches):
            rows, gains = [], []
            for raw in (zstandard.ZstdDecompressor().decompress(x) for batch in held for x in batch.column(1).to_pylist()):
                steps, at = _numbers(raw, np.uint32, len(raw) // 8, 0)
                rows.append(np.cumsum(steps, dtype=np.int64))
                gains.append(_numbers(raw, np.float32, len(raw) // 8, at)[0])
            found, place = np.unique(np.concatenate(rows), return_inverse=True)
            yield pa.RecordBatch.from_pydict({"__row": pa.array((k << BUCKET) + found), "gain": pa.array(np.bincount(place, np.concatenate(gains), len(found)))})

    own = told.filter("h IS NOT NULL").select("shard", "h").join(counts.select("h", "n"), "h")
    both = own.selectExpr("shard", "0 AS kind", "h", "n", "CAST(NULL AS binary) AS blob").unionAll(_pieces(rows, model).selectExpr("shard", "1 AS kind", "0L AS h", "0L AS n", "blob"))
    met = both.repartition(min(model.shards, MOST_TASKS), "shard").sortWithinPartitions("shard", "kind")
    sums = met.mapInArrow(run, "bucket long, sums binary").repartition("bucket").sortWithinPartitions("bucket")
    return sums.mapInArrow(add, "__row long, gain double")


def score(docs: DataFrame, learn, keep: list[str], text_col: str = "text", least_share: float = LEAST_SHARE, shard: int = SHARD, stored: bool = False) -> DataFrame:
    """``keep`` columns with n_tokens, n_known, train_tokens, base_score and score, learnt from rows where ``learn`` holds.

    Rows are read twice and known by their files and places there: ``docs`` is stored first, unless it comes straight from ``stored`` files.
    """
    learn = F.coalesce(learn, F.lit(False)).cast("int").alias("__learn")
    rows = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], learn, text_of(text_col).alias("__text"))
    rows = rows if stored else scratch(rows, "rows")
    model, counts = train(rows.filter("__learn = 1").select("__text"), least_share, shard)
    told = _told(rows, model, len(keep))
    scored = told.filter("h IS NULL")
    asked = scored.select("__row", F.explode("rare").alias("h"))
    found = asked.join(counts.select("h", "n"), "h", "left").select("__row", F.coalesce("n", F.lit(0)).alias("n"))
    rest = found.groupBy("__row").agg(F.sum(F.log10((F.col("n") + 1) / F.lit(float(model.n + model.v + 1)))).alias("more"), F.count_if(F.col("n") > 0).alias("known"))
    more, known = F.coalesce("more", F.lit(0.0)), F.coalesce("known", F.lit(0))
    base = F.col("base_here") + more
    return scored.join(rest, "__row", "left").join(_gains(rows, told, counts, model), "__row", "left").select(
        *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "n_tokens", (F.col("n_here") + known).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        base.alias("base_score"), (base + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(crc_of_id(), F.lit(FOLDS)) == TEST_FOLD
    docs = documents(spark, sf_dir).select("doc_id", held_out.alias("held_out"), "text")
    return score(docs, ~F.col("held_out"), ["doc_id", "held_out"], stored=True).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
