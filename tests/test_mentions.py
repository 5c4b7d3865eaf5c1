"""Mentions by the text without blanks are those of one pattern for each entity."""

import random
import time

import pytest
from pyspark.sql import functions as F

from veilspark.functions import entities, spans

ENTITIES = "array<struct<value:string,category:string,placeholder:string>>"
NAMES = ["甲乙公司", "乙公司", "公公", "a+b(公司)", "A B公司", "公司\\E公", "😀公司"]
PIECES = ["甲", "乙", "公", "司", "公司", "甲乙公司", "a+b(公司)", "\\E", "A", "B公司", "😀", " ", "\n", "　", " ", "【", "】", "[", "]", "【甲乙公司】", "[乙 公司]", "A \t B公司", "x"]


def mentions(spark, texts, names, hits=None):
    rows = [(i, t, [(n, "entityOther", "【主体】") for n in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, entities {ENTITIES}")
    if hits is None:
        found = entities.mention_candidates(F.col("text"), F.col("entities"))
    else:
        found = F.flatten(F.transform("entities", lambda e: F.transform(hits(F.col("text"), e["value"]), lambda h: spans.candidate(h["start"], h["value"], e["category"], e["placeholder"]))))
    return {r.doc_id: [tuple(c) for c in r.found] for r in docs.select("doc_id", found.alias("found")).collect()}


def test_equal_to_one_pattern_for_each_entity(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices(PIECES, k=rng.randrange(60))) for _ in range(400)]
    found = mentions(spark, texts, NAMES)
    assert found == mentions(spark, texts, NAMES, entities._pattern_hits)
    assert sum(map(len, found.values())) > 1000
    for i, text in enumerate(texts):
        assert all(text[c[0] : c[1]] == c[2] for c in found[i])


@pytest.mark.parametrize(
    "text,names,expected",
    [
        (None, ["甲乙公司"], []),
        ("", ["甲乙公司"], []),
        (" \n ", ["甲乙公司"], []),
        ("甲乙公司", [], []),
        ("甲乙公司", [""], []),
        (" 甲\n乙 公司", ["甲乙公司"], [(1, 7, "甲\n乙 公司")]),
        ("【甲乙公司】", ["甲乙公司"], [(0, 6, "【甲乙公司】")]),
        ("【 甲乙公司】", ["甲乙公司"], [(2, 6, "甲乙公司")]),
        ("[甲乙公司】", ["甲乙公司"], [(1, 5, "甲乙公司")]),
        ("aaa", ["aa"], [(0, 2, "aa")]),
        ("aa", ["aa", "a"], [(0, 2, "aa"), (0, 1, "a"), (1, 2, "a")]),
        ("J o hn Smith, JohnSmith", ["John Smith"], [(0, 12, "J o hn Smith")]),
    ],
)
def test_edges(spark, text, names, expected):
    assert [c[:3] for c in mentions(spark, [text], names)[0]] == expected


def test_aliases_need_a_word_for_short_names(spark):
    party = [("上海云帆有限公司", "entityA", None)]
    rows = [(0, "上海云帆有限公司（以下简称云帆）", party), (1, "上海云帆有限公司（云帆）", party), (2, None, party), (3, "上海 云帆有限公司【后称“上海云帆”】", party)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, parties {ENTITIES}")
    got = docs.select("doc_id", entities.party_aliases(F.col("text"), F.col("parties")).alias("a")).collect()
    assert {r.doc_id: [(a.value, a.placeholder) for a in r.a or []] for r in got} == {0: [("云帆", "【主体A简称】")], 1: [], 2: [], 3: [("上海云帆", "【主体A简称】")]}


def test_two_hundred_entities_cost_little_more_than_ten(spark):
    names = [f"第{i:03d}号供应链管理有限公司" for i in range(200)]
    text = "".join(f"本段说明{names[i % 200]}的履约情况，无其他内容。\n" for i in range(6000))[:199_000]

    def seconds(k):
        mentions(spark, [text], names[:k])
        begun = time.time()
        found = mentions(spark, [text], names[:k])[0]
        assert len(found) == sum(text.count(n) for n in names[:k])
        return time.time() - begun

    few, many = seconds(10), seconds(200)
    assert many < few + 8, (few, many)
