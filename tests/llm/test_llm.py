"""Operators on small tables: brute force, SQL, odd rows (nulls, empties, ties, repeats, clashing columns)."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from veilspark.llm import exact_dedup, line_dedup, lm_scoring, minhash_dedup, mixing, nn_descent, packing, sharding, substring_dedup, toxicity
from veilspark.llm.fm_index import FMIndex
from veilspark.llm.ngram_trie import EliasFano
from veilspark.llm.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(3000))
ODD = [(1, "a b c d e f", "x", 1), (1, "a b c d e f", "x", 1), (2, None, None, 2), (3, "", "y", 3), (None, "null id row", "y", 4), (4, "a b c d e f", "x", 5), (5, LONG, "x", 6), (6, LONG, "z", 7), (7, " \t\n ", "z", 8), (8, "idiot " * 30, "y", 9)]
SCHEMA = "doc_id long, text string, source string, size long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_meets_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        con.sql(f"create view {table} as select * from '{DIR}/{table}.parquet'")
    want, got = con.sql(SQL[name]).df(), QUERIES[name](spark, DIR).toPandas()
    cols = sorted(want.columns)
    shape = lambda d: d[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert shape(want).equals(shape(got))


def test_odd_rows_and_empty_tables(spark, odd):
    none = spark.createDataFrame([], SCHEMA)
    runs = [exact_dedup.exact_dedup, line_dedup.line_dedup, sharding.extendible_shards, mixing.mix_sources, minhash_dedup.near_duplicates, substring_dedup.substring_dedup]
    for run in runs:
        assert run(odd).count() == len(ODD), run
        assert run(none).count() == 0, run
    assert packing.packed_documents(none).count() == 0
    for docs in (odd, none):
        assert lm_scoring.score(docs, F.lit(True), ["doc_id", "size"]).count() == docs.count()
        assert lm_scoring.score(docs, F.lit(None).cast("boolean"), ["doc_id"]).count() == docs.count()
    assert toxicity.score(odd, None, ["doc_id"]).count() == len(ODD)


def test_columns_that_clash_change_nothing(spark):
    """Extra columns named like an operator's own are ignored."""
    names = "digest salt n t hash depth chunk row size skey start node sig label route words anchor spots kt lines key shard blob h score rank piece length offset source_size".split()
    plain = spark.createDataFrame([(i, f"a line of text that several hold\nown {i} " + "w " * i, "xy"[i % 2]) for i in range(9)], "doc_id long, text string, source string")
    crowded = plain.withColumns({x: F.lit("z") for x in names})
    lm = lambda d: lm_scoring.score(d, F.lit(True), ["doc_id"])
    tagged = lambda d: toxicity.score(d, None, ["doc_id"])
    for run in (exact_dedup.exact_dedup, line_dedup.line_dedup, sharding.extendible_shards, mixing.mix_sources, minhash_dedup.near_duplicates, substring_dedup.substring_dedup, packing.packed_documents, lm, tagged):
        rows = [sorted(map(str, run(d).collect())) for d in (plain, crowded)]
        assert rows[0] == rows[1], run


def test_ties_in_exact_and_line_dedup(spark):
    """Equal ids and equal texts: all rows of the largest id stay; lines count once a row."""
    line = "a shared line of twenty chars"
    docs = spark.createDataFrame([(1, line), (1, line), (2, line + "\n" + line), (2, line), (None, line)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect())
    assert got == [("1", 2, 4, False), ("1", 2, 4, False), ("2", 2, 1, True), ("2", 2, 4, True), ("None", 2, 4, False)]
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(docs).collect())
    assert got == [("1", 1, 1), ("1", 1, 1), ("2", 1, 0), ("2", 2, 0), ("None", 1, 1)]


def test_near_duplicates_on_odd_rows(odd):
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(odd).collect()}
    assert got[4].component_id == 1 and got[6].component_id == 5 and got[2].component_id == 2 and got[2].n_shingles == 0
    assert got[None].component_id is None and got[None].kept


def test_near_duplicates_of_a_graded_group_by_brute_force(spark):
    """One group whose members lie at all similarities, with edits that many of them share."""
    rng = np.random.default_rng(5)
    base, texts = [f"b{i}" for i in range(120)], []
    for i in range(300):
        words = list(base)
        for at in rng.integers(0, 120, i % 15):
            words[at] = f"e{rng.integers(0, 6)}"
        texts.append(" ".join(words))
    sets = [{tuple(w[j : j + 4]) for j in range(len(w) - 3)} for w in map(str.split, texts)]
    root = list(range(len(sets)))
    for _ in sets:  # labels fall until they rest
        new = [min(root[j] for j, y in enumerate(sets) if 100 * len(x & y) >= 80 * len(x | y)) for x in sets]
        if new == root:
            break
        root = new
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].component_id for i in range(len(texts))] == root
    assert 1 < len(set(root)) < len(root)


def test_pipeline_dedup_by_brute_force(spark):
    """Spread edits part pairs at five words that four would link; ids repeat with other texts."""
    rng = np.random.default_rng(11)
    rows = [(None, "null id row of some words", "s"), (None, "null id row of some words here", "s"), (3, None, "s"), (4, " ", "s")]
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(120)]
        for i in range(4):
            words = list(base)
            for at in range(20, 20 + 40 * i, 40):  # 1 to 3 edits, 3 of 120 words: 0.81 at four words, 0.77 at five
                words[at] = f"e{i}x{rng.integers(1000)}"
            rows.append(((100 + g) if i in (0, g % 4) else 200 + 10 * g + i, " ".join(words), "s"))
    rows += [(100, "a unique text under an id that repeats", "s"), (209, "one more text", "s"), (209, "one more text", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    best = {}
    for x in rows:  # of equal texts the largest id
        text = x[1] or ""
        if text not in best or best[text][0] is None or (x[0] is not None and x[0] > best[text][0]):
            best[text] = x
    left = list(best.values())
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w and x[0] is not None else set() for x in left for w in [(x[1] or "").split()]]
    root = list(range(len(left)))
    for _ in left:
        root = [min(root[j] for j, y in enumerate(sets) if i == j or x and y and 100 * len(x & y) >= 80 * len(x | y)) for i, x in enumerate(sets)]
    rank = lambda i: (left[i][0] or 0, hashlib.sha256((left[i][1] or "").encode()).hexdigest())
    want = [left[min((i for i in range(len(left)) if root[i] == k), key=rank)] for k in set(root)]
    first = corpus_pipeline.drop_copies(spark, docs, DIR)
    got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, first, DIR).collect()]
    shape = lambda rows: sorted((str(i), t or "") for i, t, _ in rows)
    assert shape(got) == shape(want) and 12 < len(want) < len(left)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents and labels: toxic, copied, near-copied, odd and repeated rows."""
    rng, path = np.random.default_rng(12), tmp_path_factory.mktemp("corpus")
    plain = "the quiet garden holds many green trees you are there today".split()
    rows = [(i, " ".join(rng.permutation(plain + [f"u{i}x{j}" for j in range(40)] + (["stupid", "worthless", "idiot"] if i % 4 == 0 else []))), "en", "abc"[i % 3], 5) for i in range(240)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(240)]
    base = [f"n{j}" for j in range(120)]
    rows += [(300 + i, " ".join(base[:60] + [f"e{i}"] + base[61:]), "en", "a", 5) for i in range(4)]
    rows += [(400, rows[1][1], "en", "b", 5), (401, rows[1][1], "de", None, 5), (402, None, None, None, None), (403, "", "en", "c", 0), (None, "no id here", "en", "a", 3), (404, "same row twice", "en", "a", 3), (404, "same row twice", "en", "a", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_pipeline_stages_by_brute_force(spark, corpus):
    path, rows = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    shape = lambda found: sorted((tuple(map(str, r)) for r in found))
    clean = corpus_pipeline.drop_toxic(spark, docs, path)
    want = [r for r in rows if not (r[0] is not None and r[0] < 240 and r[0] % 4 == 0)]
    assert clean.columns == docs.columns and shape(clean.collect()) == shape(want)
    one = corpus_pipeline.drop_copies(spark, clean, path)
    best = {}
    for r in want:
        text = r[1] or ""
        if text not in best or (r[0] or -1) > (best[text][0] or -1):
            best[text] = r
    assert one.columns == docs.columns and shape(one.collect()) == shape(best.values())
    near = corpus_pipeline.drop_near_copies(spark, one, path)
    left = [r for r in best.values() if r[0] not in (301, 302, 303)]
    assert near.columns == docs.columns and shape(near.collect()) == shape(left)
    mixed = corpus_pipeline.mix(spark, near, path)
    taken = mixing.mix_sources(near).toPandas()
    assert mixed.columns == docs.columns
    assert sum(len(r.text.split()) for r in mixed.collect()) == taken.taken.sum() and abs(taken.taken.sum() - 1.5 * taken["size"].sum()) < 200
    pieces = corpus_pipeline.pack(spark, mixed, path).toPandas()
    encoder = packing.Encoder(packing.default_tokenizer())
    assert pieces.length.sum() == sum(len(encoder.ids(r.text or "")) + 1 for r in mixed.collect())
    ran = corpus_pipeline.run(spark, path).toPandas()
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert ran[cols].astype(str).sort_values(cols).reset_index(drop=True).equals(pieces[cols].astype(str).sort_values(cols).reset_index(drop=True))


def test_pipeline_on_an_empty_table(spark, corpus):
    path, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0, name


def test_substring_windows_by_brute_force(spark):
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(40):
        words = [f"r{x}" for x in rng.integers(0, 5000, 50)]
        at = int(rng.integers(0, 50))
        texts.append(" ".join(words[:at] + passage[int(rng.integers(0, 20)) : 60 - int(rng.integers(0, 15))] + words[at:]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot in (1, 20_000):
        got = {r.doc_id: r.kept_text for r in substring_dedup.substring_dedup(docs, hot=hot).collect()}
        seen = set()
        for i, text in enumerate(texts):
            words = text.split()
            gone = np.zeros(len(words), dtype=bool)
            for j in range(len(words) - 19):
                key = tuple(words[j : j + 20])
                if key in seen:
                    gone[j : j + 20] = True
                seen.add(key)
            assert got[i] == " ".join(w for w, g in zip(words, gone, strict=True) if not g)


def test_substring_words_of_equal_low_hashes_differ(spark):
    """Two words whose hashes agree in their low 32 bits are two words."""
    words = [f"c{i}" for i in range(19)]
    texts = [" ".join([*words[:10], "q14145", *words[10:]]), " ".join([*words[:10], "q21754", *words[10:]]), " ".join([*words[:10], "q14145", *words[10:]])]
    got = {r.doc_id: r.removed for r in substring_dedup.substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [len(got[i]) for i in range(3)] == [0, 0, 1]


def test_substring_windows_on_odd_rows(spark):
    """Null ids come first, equal rows count as one, a text repeats itself, copies of a hot passage stand in other words."""
    hot = " ".join(f"h{i}" for i in range(30))
    rows = [(None, hot), (3, hot), (3, hot), (1, "own " + hot + " end"), (2, None), (4, ""), (5, "a b c " * 20), (6, f"{hot} {hot}"), (9, hot.upper())]
    rows += [(100 + i, f"x{i} y{i} {hot} z{i}") for i in range(40)]
    for limit in (2, 20_000):
        got = sorted(((r.doc_id if r.doc_id is not None else -1, r.n_words, r.kept_text) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), hot=limit).collect()))
        seen, want = set(), []
        for doc_id, text in sorted({(-1 if i is None else i, t or "") for i, t in rows}):
            words = text.split()
            gone = np.zeros(len(words), dtype=bool)
            for j in range(len(words) - 19):
                key = tuple(words[j : j + 20])
                gone[j : j + 20] |= key in seen
                seen.add(key)
            want += [(doc_id, len(words), " ".join(w for w, g in zip(words, gone, strict=True) if not g))] * (2 if doc_id == 3 else 1)
        assert got == sorted(want)


def test_fm_index_counts():
    text = np.random.default_rng(1).integers(1, 4, 500)
    index = FMIndex(text, 5)
    patterns = text[np.arange(490)[:, None] + np.arange(5)]
    low, high = index.search(patterns)
    windows = Counter(map(tuple, text[np.arange(496)[:, None] + np.arange(5)].tolist()))
    assert (high - low).tolist() == [windows[tuple(p)] for p in patterns.tolist()]
    first = {}
    for i, p in enumerate(patterns.tolist()):
        first.setdefault(tuple(p), i)
    for own in (False, True):
        got = index.earliest(*index.search(patterns, own)).tolist()
        assert got == [first[tuple(p)] if windows[tuple(p)] > 1 else -1 for p in patterns.tolist()]


def test_elias_fano_successor():
    values = np.sort(np.random.default_rng(2).integers(0, 10_000, 300))
    ef, targets = EliasFano(values), np.arange(0, 10_050)
    at, hit = ef.successor(targets)
    assert (at == np.searchsorted(values, targets)).all() and (hit == np.isin(targets, values)).all()
    assert (ef.at(np.arange(300)) == values).all()


def test_pieces_hold_the_tokenizers_ids(spark):
    """Ids, pieces, starts and check sums against the tokenizer file's own library, on all texts and odd ones."""
    import zlib

    from tokenizers import Tokenizer

    odd = [(10**6 + i, t, 1) for i, t in enumerate(["", " \t\n ", "x" * 9000, "naïve 你好 😀 it's 1234", "<|endoftext|> [UNK] </s>", "a\u0000b\ufeff", LONG])] + [(-1, None, 2), (-1, None, 2)]
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", F.lit(1).alias("length")).unionAll(spark.createDataFrame(odd, "doc_id long, text string, length int"))
    exact, want = Tokenizer.from_file(packing.default_tokenizer()), []
    for r in docs.collect():
        ids = np.array([*exact.encode(r.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        bounds = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want += [(r.doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    rows = packing.packed_documents(docs).toPandas().sort_values(["sequence_id", "offset"])
    assert sorted(want) == sorted(zip(rows.doc_id, rows.piece, rows.start, rows.length, rows.ids_crc32))
    total = rows.groupby("sequence_id")["length"]
    assert (rows["offset"] == total.cumsum() - rows["length"]).all() and total.sum().max() <= 1024


def test_pair_index_follows_the_counts():
    rng = np.random.default_rng(6)
    counts = {int(x): int(n) for x, n in zip(rng.choice(np.arange(1, 65), 30, replace=False), rng.integers(1, 9, 30))}
    plan, left = packing.packing_plan(counts, 64), Counter(counts)
    for times, combo in plan:
        assert sum(combo) <= 64
        for x in combo:
            left[x] -= times
    assert not any(left.values())
    lengths = packing.Lengths(counts, 64)
    for total in range(2, 64):
        brute = [(a, total - a) for a in range(total - 1, (total + 1) // 2 - 1, -1) if lengths.left[a] and lengths.left[total - a] and lengths.enough((a, total - a))]
        assert lengths.pair(total) == (brute[0] if brute else None)


def test_packing_is_gapless_and_tight(spark):
    rows = packing.op1_packing(spark, DIR).toPandas().sort_values(["sequence_id", "offset"])
    total = rows.groupby("sequence_id")["length"]
    assert (rows["offset"] == total.cumsum() - rows["length"]).all() and total.sum().max() <= 1024
    lengths = Counter(rows["length"].tolist())
    assert total.ngroups <= max(-(-rows["length"].sum() // 1024), sum(n for x, n in lengths.items() if x > 512)) * 1.02


def test_mixing_meets_targets(spark):
    rows = mixing.op2_mixing(spark, DIR).toPandas()
    assert (rows.taken <= 2 * rows["size"]).all()
    by = rows.groupby("target").agg(taken=("taken", "sum"), n=("source_size", "nunique"), sizes=("source_size", "first"))
    one = by[by.n == 1]
    assert ((one.taken - one.index).abs() <= 3 * mixing.BLOCK_WORDS).all()


def test_shards_counts_are_drawn_and_decide(spark):
    """Slots by shard and source follow the draw; other counts give other shards; totals meet the plan."""
    sizes = spark.createDataFrame([("=a", "a", 40_000), ("=b", "b", 20_000), ("", None, 9_000)], "skey string, source string, source_size long")
    plan = mixing.slot_plan(mixing.source_targets(sizes))
    counts = mixing.shard_counts(plan, 100)
    drawn = {(r.shard, r.skey): r.n for r in counts.collect()}
    slots = mixing.draw_slots(plan, counts).toPandas()
    assert slots.groupby(["shard", "skey"]).size().to_dict() == drawn
    due = {r.skey: (r.slots, r.blocks) for r in plan.collect()}
    for key, (n, blocks) in due.items():
        own = slots[slots.skey == key]
        assert len(own) == n and own.groupby("round").block.nunique().max() == min(n, blocks) and not own.duplicated(["round", "block"]).any()
    share = np.array([drawn[s, "=a"] for s in range(sum(n for n, _ in due.values()) // 100)]) / 100
    assert 0.02 < share.std() < 0.08 and abs(share.mean() - due["=a"][0] / sum(n for n, _ in due.values())) < 0.03
    other = mixing.draw_slots(plan, counts.withColumn("shard", -F.col("shard") + 100)).toPandas()
    order = ["skey", "round", "block", "shard"]
    assert not slots.sort_values(order)[order].reset_index(drop=True).equals(other.sort_values(order)[order].reset_index(drop=True))


def test_runs_take_only_new_hashes(spark):
    """Each hash has one entry in all runs, and repeats across batches are found by what was seen again."""
    rng = np.random.default_rng(4)
    batches = [rng.integers(0, 40, 30).tolist() for _ in range(5)]
    runs = line_dedup.LevelledRuns()
    for b in batches:
        runs.add(spark.createDataFrame([(x,) for x in b], "hash long"))
    entries = [r.hash for run in runs.held() for r in run.collect()]
    every = Counter(x for b in batches for x in b)
    assert sorted(entries) == sorted(every) and len(runs.held()) == 2
    assert sorted(r.hash for r in runs.repeated(3).collect()) == sorted(x for x, n in every.items() if n >= 3)
    alone = [sum(x in c for c in map(set, batches)) > 1 for x in every]
    assert any(alone) and {r.hash for run in runs.again for r in run.collect()} == {x for x, a in zip(every, alone, strict=True) if a}


def test_mixed_documents_by_brute_force(spark):
    """What a document gives in all rounds is what the mix takes of it; words are its own, in order."""
    docs = spark.createDataFrame([(i, " ".join(f"d{i}w{j}" for j in range(10 + 17 * i % 300)), "abc"[i % 3], 7) for i in range(90)] + [(200, None, "a", 1), (201, " ", None, 1)], "doc_id long, text string, source string, size long")
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(docs).collect()}
    rows = mixing.mixed_documents(docs).collect()
    got = Counter()
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        words = r.text.split()
        at = [int(w.split("w")[1]) for w in words]
        assert at == sorted(at) and all(w.startswith(f"d{r.doc_id}w") for w in words) and r.size == 7
        assert len(words) < len(text[r.doc_id].split()) or r.text == text[r.doc_id]
        got[r.doc_id] += len(words)
    assert {k: v for k, v in taken.items() if v} == dict(got)


def test_language_model_beats_its_base(spark):
    rows = lm_scoring.op10_lm_scoring(spark, DIR).toPandas()
    held = rows[rows.held_out]
    assert held.score.sum() > held.base_score.sum() and (rows.n_known <= rows.n_tokens).all()


def test_language_model_keeps_all_ngrams_at_any_size(spark):
    """Rare pairs and triples count, whatever share of the corpus they have and however it is sharded."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.5, 60) % 50) for _ in range(60)] + ["x y z", "z y x", "w1", ""]
    asked = [*texts[:20], "x y z w1 w2", "w1 unseen w2 y z", "z"]
    split = lambda t: [*t.split(), "\n"]
    grams = lambda k: Counter(tuple(s[i : i + k]) for s in map(split, texts) for i in range(len(s) - k + 1))
    one, three = grams(1), grams(3)
    total = sum(one.values()) + len(one) + 1
    rows = [(-1 - i, t, True) for i, t in enumerate(texts)] + [(i, t, False) for i, t in enumerate(asked)] + [(999, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(3)
    for shard in (200, 10**6):  # words split over many shards; one shard
        model, _ = lm_scoring.train(docs.filter("learn").select("text"), least_share=0.02, shard=shard)
        code = lambda w: model.codes([w.encode()])
        part = lambda s, i: int(model.part(code(s[i - 2]) if i > 1 else np.array([lm_scoring.NONE]), code(s[i - 1]))[0])
        two = Counter((part(s, i), s[i - 1], s[i]) for s in map(split, texts) for i in range(1, len(s)))  # a split word's pairs are counted by part
        assert (len(model.parts) > 0) == (shard == 200)
        follow = lambda counts, context: [n for g, n in counts.items() if g[:-1] == context]

        def p(s, i, k):
            if k == 1:
                return (one[(s[i],)] + 1) / total
            if k > i + 1:
                return p(s, i, k - 1)
            counts, gram = (two, (part(s, i), s[i - 1], s[i])) if k == 2 else (three, tuple(s[i - 2 : i + 1]))
            seen, near = follow(counts, gram[:-1]), p(s, i, k - 1)
            if not seen:
                return near
            kept = [max(n - lm_scoring.DISCOUNT, 0) for n in seen]
            return max(counts[gram] - lm_scoring.DISCOUNT, 0) / sum(seen) + (1 - sum(kept) / sum(seen)) * near

        got = {r.doc_id: r for r in lm_scoring.score(docs, F.col("learn"), ["doc_id"], least_share=0.02, shard=shard).collect()}
        for i, s in enumerate(map(split, asked)):
            assert abs(got[i].score - sum(np.log10(p(s, j, 3)) for j in range(len(s)))) < 0.02
            assert abs(got[i].base_score - sum(np.log10((one[(w,)] + 1) / total) for w in s)) < 1e-9
            assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(s), sum(one[(w,)] > 0 for w in s), sum(one.values()))


def test_toxicity_on_odd_rows(spark):
    """Null, empty and repeated rows, labels without texts, null labels, one id with many rows, clashing columns."""
    rng, plain = np.random.default_rng(8), "you are the quiet garden holds many green trees today".split()
    bad = "you are a stupid worthless idiot today"
    texts = [(i, " ".join(rng.permutation(plain + (["stupid", "worthless", "idiot"] if i % 2 else ["calm"]))), "s") for i in range(400)] + [(1, bad, "s")] * 50 + [(None, bad, "s"), (401, None, "s"), (402, "", "s"), (403, " 12 ", "s"), (403, " 12 ", "s")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (5000, 1), (7, None), (9, 3)], "doc_id long, toxic int")
    field = toxicity.learn(docs, labels)
    got = toxicity.score(docs.drop("score"), field, ["doc_id"]).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got)
    assert all((r.score >= 0.5) == bool(r.doc_id % 2) for r in got if r.doc_id is not None and r.doc_id < 400)
    assert all(r.score == 0 for r in got if r.doc_id in (401, 402, 403)) and [r.score >= 0.5 for r in got if r.doc_id is None] == [True]
    assert toxicity.learn(docs, labels.filter("toxic = 1")) is None and toxicity.learn(docs.limit(0), labels) is None and toxicity.learn(docs, labels.limit(0)) is None


def test_toxicity_on_held_out_rows(spark):
    got = toxicity.op6_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    held = got.merge(labels, on="doc_id").query("held_out")
    assert held[held.toxic == 0].predicted.mean() < 0.02 and held[held.toxic == 1].predicted.mean() > 0.5


def test_nearest_neighbours_recall(spark):
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").toPandas()
    x = np.stack(rows.embedding.values).astype(float)
    got = nn_descent.op5_nn_descent(spark, DIR).toPandas().groupby("query_id").vec_id.apply(set)
    hits = []
    for i in np.flatnonzero(rows.vec_id.values % 20 == 0):
        near = x @ x[i]
        near[i] = -np.inf
        hits.append(len(got[rows.vec_id[i]] & set(rows.vec_id.values[np.argsort(-near)[:20]])) / 20)
    assert np.mean(hits) >= 0.9


def test_nearest_neighbours_on_odd_rows(spark):
    """Vectors that take no part, repeated ids, ties, clashing columns; lists are complete and scores exact."""
    rng = np.random.default_rng(9)
    x = rng.integers(-3, 4, (60, 6)).astype(float)
    x[x.any(1) == 0] = 1.0
    rows = [(i, v.tolist(), 1.0) for i, v in enumerate(x)]
    rows += [(100, None, 1.0), (101, [0.0] * 6, 1.0), (102, [float("nan")] * 6, 1.0), (103, [float("inf")] + [1.0] * 5, 1.0), (104, [1.0, 2.0], 1.0), (105, [None] + [1.0] * 5, 1.0), (None, [1.0] * 6, 1.0), (7, x[7].tolist(), 2.0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double")
    got = nn_descent.nearest_neighbours(table).toPandas().sort_values(["query_id", "rank"])
    for q in (0, 20, 40):
        mine = got[got.query_id == q]
        want = sorted((-float(x[q] @ x[j]), j) for j in range(60) if j != q)[:20]
        assert list(mine["rank"]) == list(range(1, 21)) and [(-s, j) for s, j in zip(mine.score, mine.vec_id)] == want
    assert set(got.query_id) == {0, 20, 40} and nn_descent.nearest_neighbours(table.limit(0)).count() == 0


def test_nearest_neighbours_leave_closed_groups(spark):
    """Four groups of thirteen far from each other: every query finds twenty."""
    rng = np.random.default_rng(1)
    x = np.repeat(np.eye(4) * 10, 13, axis=0) + 0.01 * rng.standard_normal((52, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = nn_descent.nearest_neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), query_every=1)
    found = Counter(r.query_id for r in got.collect())
    assert len(found) == 52 and set(found.values()) == {20}


def test_nearest_neighbours_among_copies(spark):
    """A third of the rows are copies of one vector: the smaller ids come first, and their group has edges to others."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((240, 16))
    x[::3] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nn_descent.nearest_neighbours(table, query_every=1).toPandas().sort_values(["query_id", "rank"]).groupby("query_id").vec_id.apply(list)
    copies = np.arange(0, 240, 3)
    hits = []
    for i in range(240):
        near = [j for j in sorted(range(240), key=lambda j: (-round(float(x[i] @ x[j]), 9), j)) if j != i][:20]
        hits.append(len(set(near) & set(got[i])) / 20)
        if i in copies:
            assert got[i] == near
    assert np.mean(hits) >= 0.95
    rows = table.selectExpr("vec_id AS id", "embedding AS vector")
    codes = nn_descent._coded(rows, nn_descent.scaling(rows)[0])
    edges = {r.id: [e.other for e in r.near] for r in nn_descent.neighbour_graph(codes, cell=20).collect()}
    tied = [edges[i][: nn_descent.DEGREE] for i in copies.tolist()]
    assert all(t == sorted(t) for t in tied)


def test_cells_are_bounded_among_copies(spark):
    codes = spark.createDataFrame([(i, np.ones(4, dtype=np.float16).tobytes()) for i in range(400)], "id long, code binary")
    near = {}
    for r in nn_descent._cell_neighbours(codes, 1, 40).collect():
        near.setdefault(r.id, set()).add(r.other)
    group, left = [], set(near)
    while left:  # cells do not mix on one line
        todo, cell = [left.pop()], set()
        while todo:
            i = todo.pop()
            cell.add(i)
            todo += [j for j in near[i] if j in left]
            left -= near[i]
        group.append(len(cell))
    assert max(group) <= 80


def test_nearest_neighbours_recall_beyond_the_cells(spark):
    """Cells hold a small share of the table, so the joins find most neighbours."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((3000, 4)) @ rng.standard_normal((4, 32)) + 0.1 * rng.standard_normal((3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    codes = nn_descent._coded(rows, nn_descent.scaling(rows)[0])
    near = x @ x.T
    np.fill_diagonal(near, -np.inf)
    graph = nn_descent.neighbour_graph(codes, lines=2, cell=50).collect()
    assert np.mean([len({e.other for e in r.near} & set(np.argsort(-near[r.id])[:20])) / 20 for r in graph]) >= 0.9


def test_kept_text_of_lines(spark):
    docs = spark.createDataFrame([(i, "Shared line of twenty chars\nown " + str(i)) for i in range(3)] + [(9, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert got[0].kept_text == "own 0" and got[2].n_dropped == 0 and got[9].n_lines == 1
    assert hashlib.sha256(got[9].kept_text.encode()).hexdigest().startswith("e3b0c4")
