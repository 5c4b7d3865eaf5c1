"""One file for each document: names, commit, failed and repeated attempts."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veilspark.sources import document_files as sink


def found(path):
    out = {}
    for top, _, names in os.walk(path):
        out |= {os.path.relpath(f"{top}/{n}", path): open(f"{top}/{n}", encoding="utf-8").read() for n in names if not n.endswith(".crc")}
    return out


def test_one_file_a_row(spark, tmp_path):
    rows = [(str(i), "授权书_脱敏版.md", f"text {i}\n第二行") for i in range(50)] + [("a/b", "x:y?.md", None), ("..", " ", "z"), (None, None, "n")]
    sink.write_documents(spark.createDataFrame(rows, sink.SCHEMA).repartition(5), str(tmp_path / "out"))
    got = found(tmp_path / "out")
    assert all(p.startswith("part-") and p.count("/") == 2 for p in got)
    shown = sorted((p.split("/", 1)[1], c) for p, c in got.items())
    assert [x for x in shown if x[0][0].isdigit()] == sorted((f"{i}/授权书_脱敏版.md", f"text {i}\n第二行") for i in range(50))
    assert ("a_b/x_y_.md", "") in shown and len(shown) == 53
    again = {(r.folder, r.file_name, r.content) for r in sink.read_documents(spark, str(tmp_path / "out")).filter("folder rlike '^[0-9]+$'").collect()}
    assert again == {(a, b, c) for a, b, c in rows[:50]}
    sink.write_documents(spark.createDataFrame([("1", "a.md", "x"), ("1", "a.md", "y")], sink.SCHEMA).coalesce(1), str(tmp_path / "out"))
    assert len(found(tmp_path / "out")) == 55


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    """Some tasks have written their files when another fails."""
    rows = spark.range(0, 40, 1, 4).select(F.col("id").cast("string").alias("folder"), F.lit("a.md").alias("file_name"), F.when(F.col("id") == 39, F.raise_error("late")).otherwise("x").alias("content"))
    with pytest.raises(PySparkException):
        sink.write_documents(rows, str(tmp_path / "out"))
    assert found(tmp_path / "out") == {}


def test_only_the_committed_attempt_counts(tmp_path):
    """Two attempts of one task wrote their files; the job was told of the second."""
    writer = sink.DocumentFilesWriter(str(tmp_path))
    writer.write(iter([("1", "a.md", "first"), ("2", "a.md", "first")]))
    done = writer.write(iter([("1", "a.md", "second")]))
    writer.commit([done, writer.write(iter([])), None])
    assert [(p.split("/", 1)[1], c) for p, c in found(tmp_path).items()] == [("1/a.md", "second")]
