"""One-liners with expected redactions, and invariants of matches."""

import pytest
from pyspark.sql import functions as F

from veilspark.functions import entities, spans
from veilspark.functions.dialect import java
from veilspark.operators import redact

CASES = [
    ("统一社会信用代码：91310115MA1K4AB12C", "统一社会信用代码：【统一社会信用代码已删除】"),
    ("联系电话：13812345678", "联系电话：【联系方式已删除】"),
    ("邮箱：a.b@example.com", "邮箱：【邮箱已删除】"),
    ("税率为6%，阶段付款比例为30%-40%", "税率为X%，阶段付款比例为X%-Y%"),
    ("场地服务费按22元/㎡/月计算", "场地服务费按X元/㎡/月计算"),
    ("有效期自[2026.01.01]至[2026.12.31]", "有效期自[20XX年XX月XX日]至[20XX年XX月XX日]"),
    ("期限共12个月", "期限共X个月"),
    ("应在24小时内响应", "应在Y小时内响应"),
    ("周期为第1-2周", "周期为第Y-Z周"),
    ("交付日期为8月31日", "交付日期为XX月XX日"),
    ("合同编号：HT-2025-001", "合同编号：【文档编号】"),
    ("12.5%以上", "12.5%以上"),
    ("2026.03.01签署", "2026.03.01签署"),
    ("within 5 days", "within Xdays"),
]


@pytest.fixture(scope="module")
def done(spark):
    rows = [(i, text) for i, (text, _) in enumerate(CASES)]
    return {r.doc_id: r for r in redact.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_one_liner(done, i):
    assert done[i].redacted == CASES[i][1]


def test_matches_are_disjoint_and_hold_their_values(done):
    for row in done.values():
        end = 0
        for m in row.matches:
            assert m.start >= end and row.text[m.start : m.end] == m.value
            end = m.end


def test_rejects(spark):
    rows = [(0, "a.md", "x"), (1, "a.doc", "x"), (2, "a.txt", "x"), (3, "a.md", " \n"), (4, "a.md", "y" * 200_001), (5, "a.md", None)]
    out = redact.admitted(spark.createDataFrame(rows, "doc_id long, file_name string, text string")).collect()
    assert [r.reject_reason for r in sorted(out)] == [None, "legacy format", "unknown format", "no text", "too many characters", "no text"]


def test_java_dialect():
    assert java("a$") == "a\\z" and "\\u3000" in java("\\s") and java("[\\s]").count("[") == 1


def test_scan_offsets_count_code_points(spark):
    row = spark.range(1).select(spans.scan(F.lit("😀a1😀22"), "[0-9]+").alias("h")).first()
    assert [(h.start, h.value) for h in row.h] == [(2, "1"), (4, "22")]


def test_party_letters(spark):
    df = spark.createDataFrame([([("甲司", "entityA"), ("乙司", "entityA")], ["丙人"])], "a array<struct<value:string,category:string>>, b array<string>")
    got = df.select(entities.assigned_parties("a", "b").alias("p")).first().p
    assert [(p.value, p.category) for p in got] == [("甲司", "entityA"), ("乙司", "entityC"), ("丙人", "entityB")]
