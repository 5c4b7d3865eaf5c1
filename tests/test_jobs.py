"""Registered queries against their SQL on the smallest tables; history edges; office packages."""

import io
import os
import zipfile
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from veilspark.operators import assemble, history, redact, review
from veilspark.plans.catalogue import ORACLE, QUERIES
from veilspark.sources import files
from veilspark.sources.document_files import read_documents
from veilspark.streaming import jobs

DIR = "/root/testdata/sf0.001"
TABLES = "customer orders lineitem events documents".split()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_meets_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want, got = con.sql(ORACLE[name]).df(), QUERIES[name](spark, DIR).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    shape = lambda d: d[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert shape(want).equals(shape(got))


def test_history_edges(spark):
    now, ok = datetime(2024, 2, 1), "2024.01.02.3+0123456789"
    rid = lambda n: f"JQ-{n:08x}-0000-0000-0000-000000000000"
    rows = [(1, rid(0), now - timedelta(days=30), ok, [], 0), (1, rid(1), now, ok, [("amount", -1.0, 0.0), ("amount", 1.0, 0.0), ("phone", 2.5, 0.0), ("date", 3.0, 1.0), ("nope", 1.0, 1.0)], 1), (1, rid(2), now + timedelta(seconds=1), ok, [], 2), (1, rid(1), now - timedelta(days=1), ok, [], 3), (1, "bad", now, ok, [], 4), (1, rid(5), now, "x", [], 5)]
    rows += [(2, rid(100 + i), now - timedelta(minutes=i), ok, [], i) for i in range(101)]
    got = history.cleaned(spark.createDataFrame(rows, history.RECORD + ", pos long"), F.lit(now)).collect()
    assert [(r.pos, [(c.category, c.replaced, c.kept) for c in r.counts]) for r in got if r.client_id == 1] == [(1, [("date", 3, 1)])]
    assert sorted(r.pos for r in got if r.client_id == 2) == list(range(100))


def test_office_package(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p>{p("x")}<w:tbl><w:tr><w:tc>{p("a")}</w:tc><w:tc>{p("b|c")}</w:tc></w:tr><w:tr><w:tc>{p("d")}</w:tc></w:tr></w:tbl></w:body></w:document>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/footer1.xml", f"<w:ftr {w}>{p('end')}</w:ftr>")
    (tmp_path / "a.docx").write_bytes(raw.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no zip")
    blocks = files.read_docx_blocks(spark, str(tmp_path))
    assert blocks.filter("problem IS NOT NULL").count() == 1
    docs = assemble.block_documents(blocks.filter("problem IS NULL").withColumn("doc_id", F.col("path")))
    assert docs.first().text == "# T\n\nx\n\n| a | b\\|c |\n| --- | --- |\n| d |  |\n\n---\n\n> 页眉或页脚内容\n\nend"


def test_packages_are_read_in_ranges(spark, tmp_path):
    """A package of nine million bytes of pictures: its directory and body are read, not its pictures; one reading gives entries and blocks."""
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/media/a.png", os.urandom(9_000_000))
        z.writestr("word/document.xml", "<d><body><p><t>x</t></p></body></d>".replace("<d>", '<d xmlns="w">'))
    (tmp_path / "a b.docx").write_bytes(raw.getvalue())

    class Counting(io.BytesIO):
        n = 0

        def read(self, size=-1):
            got = super().read(size)
            self.n += len(got)
            return got

    file = Counting(raw.getvalue())
    entries, blocks, problem = files.opened_package(file)
    assert len(entries) == 2 and [b[4] for b in blocks] == ["x"] and problem is None and file.n < 200_000
    packages = files.read_packages(spark, str(tmp_path))
    assert "content" not in packages._jdf.queryExecution().executedPlan().toString()
    row = packages.first()
    assert [e.name for e in row.entries] == ["word/media/a.png", "word/document.xml"] and row.blocks[0].text == "x"


def test_office_package_admission(spark, tmp_path):
    """Packages over the limit and with repeated names are rows with their reasons; entries feed the content warnings."""
    (tmp_path / "large.docx").write_bytes(b"x" * (10 * 1024 * 1024 + 1))
    with zipfile.ZipFile(tmp_path / "twice.docx", "w") as z, pytest.warns(UserWarning):
        z.writestr("word/document.xml", "<a/>")
        z.writestr("word/document.xml", "<a/>")
    with zipfile.ZipFile(tmp_path / "media.docx", "w") as z:
        z.writestr("word/document.xml", "<a/>")
        z.writestr("word/media/a.png", b"1")
    name = F.element_at(F.split("path", "/"), -1)
    got = {r.name: r.problem for r in files.read_docx_blocks(spark, str(tmp_path)).filter("problem IS NOT NULL").select(name.alias("name"), "problem").collect()}
    assert got == {"large.docx": "too many bytes", "twice.docx": "duplicate names"}
    entries = files.read_package_entries(spark, str(tmp_path)).withColumn("doc_id", name)
    told = {r.doc_id: (r.reject_reason, len(r.warnings)) for r in assemble.package_admission(entries).collect()}
    assert told == {"twice.docx": ("duplicate names", 0), "media.docx": (None, 1)}


def test_files_written_and_read_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# 授权书\n联系电话：13812345678", encoding="utf-8")
    docs = files.read_markdown(spark, str(tmp_path / "in")).withColumn("doc_id", F.lit(1))
    files.write_redacted(redact.redact(docs), str(tmp_path / "out"))
    assert tuple(read_documents(spark, str(tmp_path / "out")).first()) == ("1", "授权书_脱敏版.md", "# 授权书\n联系电话：【联系方式已删除】")
    files.write_reports(spark.createDataFrame([(1, "# r")], "doc_id long, report string"), str(tmp_path / "reports"))
    assert tuple(read_documents(spark, str(tmp_path / "reports")).first()) == ("1", "文档_脱敏报告.md", "# r")
    (tmp_path / "items.json").write_text('{"doc_id": 1, "page": 2, "item_no": 0, "str": "ab", "x": 1.0, "y": 0.0, "width": 2.0, "height": 1.0, "has_eol": false}\n', encoding="utf-8")
    assert assemble.page_texts(files.read_text_items(spark, str(tmp_path / "items.json"))).first().text == "ab"
    records = spark.createDataFrame([(1, "JQ-x", datetime(2024, 1, 1), "v", [("amount", 1.0, 0.0)])], history.RECORD)
    files.write_history(records, str(tmp_path / "history"))
    assert files.read_history(spark, str(tmp_path / "history")).collect() == records.collect()


def test_streamed_documents_match_the_batch(spark):
    rows = lambda name: sorted(map(tuple, QUERIES[name](spark, DIR).select("doc_id", "n_matches", "redacted_sha256").collect()))
    assert rows("stream_redact") == rows("redact_documents")


def test_decisions_without_ids_are_left_out(spark):
    match = "match_id string, start int, `end` int, value string, category string, placeholder string, selected boolean"
    docs = spark.createDataFrame([(1, [("a-0-1", 0, 1, "v", "amount", "P", True)])], f"doc_id long, matches array<struct<{match.replace(' ', ':').replace(',:', ',')}>>")
    decisions = spark.createDataFrame([(1, None, False, ""), (None, "a-0-1", False, ""), (1, "a-0-1", False, "")], "doc_id long, match_id string, selected boolean, placeholder string")
    got = review.with_decisions(docs, decisions).first().matches[0]
    assert (got.selected, got.placeholder) == (False, "【已删除】")


def test_pages_without_items_are_kept(spark):
    items = spark.createDataFrame([(1, 1, 0, "ab", 0.0, 0.0, 1.0, 1.0, False), (1, 3, 0, "cd", 0.0, 0.0, 1.0, 1.0, False), (2, 1, 0, None, 0.0, 0.0, 1.0, 1.0, False)], files.ITEMS)
    counts = spark.createDataFrame([(1, 3), (2, 2), (3, 1)], "doc_id long, n_pages int")
    got = {r.doc_id: r for r in assemble.assembled(assemble.page_texts(items), counts).collect()}
    assert "共 3 页，其中 2 页" in got[1].warnings[1] and "第 2 页没有提取到文字" in got[1].warnings[2] and got[1].reject_reason is None
    assert got[2].reject_reason == "no text" and got[3].reject_reason == "no text"


def test_page_text_breaks(spark):
    rows = [(1, 1, 0, "ab", 0.0, 0.0, 10.0, 10.0, False), (1, 1, 1, "cd", 11.0, 0.0, 10.0, 10.0, False), (1, 1, 2, "", 0.0, -20.0, 0.0, 10.0, False), (1, 1, 3, "ef", 0.0, -20.0, 10.0, 10.0, True), (1, 1, 4, "g", 0.0, -60.0, 1.0, 10.0, False)]
    out = assemble.page_texts(spark.createDataFrame(rows, "doc_id long, page int, item_no int, str string, x double, y double, width double, height double, has_eol boolean")).first()
    assert out.text == "ab cd\nef\ng"
