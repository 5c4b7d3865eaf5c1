"""Rules searched in fragments find what a search in the whole text finds."""

import random

from pyspark.sql import functions as F

from veilspark.functions import detectors, fixed, spans
from veilspark.functions.dialect import java
from veilspark.plans import catalogue


def _texts():
    rng = random.Random(7)
    lines = [line.replace("{k}", "001234") for _, line, _ in catalogue.RULE_LINES + catalogue.ROLE_LINES + catalogue.AMOUNT_LINES] + [t[0] for t in catalogue.BOUNDARY_TEXTS]
    bits = [line[i : i + n] for line in lines for i in range(0, len(line), 3) for n in (2, 5)] + list("。；;、为的在 \n　0159一半%‰元万￥$US年月日（）【】[]-至to@.,，期折") + ["ABCDEFGHJKLMNPQRTU"]
    return ["".join(rng.choices(bits, k=rng.randint(1, 60))) for _ in range(150)] + ["".join(rng.sample(lines, 12)) for _ in range(60)] + ["\n".join(lines), "", "plain words only", "税 ABCDEFGHJKLMNPQRTU", "ABCDEFGHJKLMNPQRTU", "a" * 300 + "5元"]


def test_fragments_find_what_whole_texts_hold(spark):
    docs = spark.createDataFrame(list(enumerate(_texts())), "i int, text string").repartition(4)
    rules = fixed.DETECTORS
    plain = F.transform(spans.scan_each(F.col("text"), [(None, r[2], r[3]) for r in rules]), lambda hits: F.transform(hits, lambda h: F.struct(h["start"], h["value"])))
    # As candidates: trimmed, with their rule's category, in the order of the rules.
    want = docs.select("i", F.flatten(F.transform(plain, lambda hits, r: F.transform(hits, lambda h: F.struct(spans.candidate(h["start"], h["value"], F.get(F.array(*[F.lit(x[1]) for x in rules]), r), "")))))
        .alias("c")).select("i", F.transform("c", lambda x: F.concat_ws("|", x.getField("col1")["start"].cast("string"), x.getField("col1")["value"], x.getField("col1")["category"])).alias("c"))
    got = docs.select("i", F.transform(detectors.pattern_candidates(F.col("text")), lambda x: F.concat_ws("|", x["start"].cast("string"), x["value"], x["category"])).alias("c"))
    want, got = ({r.i: r.c for r in rows.collect()} for rows in (want, got))
    assert sum(map(len, want.values())) > 2000
    assert got == want


def test_rules_that_look_at_any_character_are_not_parted():
    assert not any(map(spans.separable, ["[^a]", "a.b", "a$", "\\ba", "[\\u4e00-\\u9fa5]", "[一-龥]", "[ -~]", "甲。"]))
    assert all(map(spans.separable, ["[+-]\\d+", "\\.[.]\\s*元", "(?<!\\d)[A-Z]{2}(?!\\d)"]))
    assert [r[0] for r in fixed.DETECTORS if not spans.separable(r[2])] == ["D17"]


def test_a_rule_of_ones_own_is_searched_in_the_whole_text(spark):
    docs = spark.createDataFrame([("甲为乙。丙",)], "text string")
    rules = [("D22", "percentage", "为[^丁]。", False, "X%"), *fixed.DETECTORS[:2]]
    assert [(c.start, c.value) for c in docs.select(detectors.pattern_candidates(F.col("text"), rules).alias("c")).first().c] == [(1, "为乙。")]


def test_labels_need_the_words_that_are_looked_for(spark):
    docs = spark.createDataFrame([(x,) for x in _texts()], "text string").repartition(4)
    labels = [(f[2], fixed.FIELD_WORDS[f[0]]) for f in fixed.FIELDS] + [(fixed.ROLE_LABEL, fixed.ROLES.split("|")), (fixed.RELATED_LABEL, fixed.RELATED_WORDS), (fixed.LECTURER, ("师", "主讲人"))]
    found = [F.count_if(F.regexp_like("text", F.lit(java(label))) & ~spans.holds(F.col("text"), words)) for label, words in labels]
    some = [F.count_if(F.regexp_like("text", F.lit(java(label)))) for label, _ in labels]
    assert set(docs.agg(*[c.alias(f"c{i}") for i, c in enumerate(found)]).first()) == {0}
    assert min(docs.agg(*[c.alias(f"c{i}") for i, c in enumerate(some)]).first()) > 0


def test_texts_of_ascii_are_not_searched_for_labels(spark):
    """Of the stream's texts without Chinese characters only the rules that need none are searched."""
    docs = spark.createDataFrame([("plain words. " * 20,), ("甲方",)], "text string")
    assert [r.h for r in docs.select(spans.holds(F.col("text"), ("方", "words")).alias("h")).collect()] == [False, True]
