"""Tasks that go on writing after their job was aborted; the table of terms against its SQL with all the tables it names."""

import os

import duckdb
import pytest

from veilspark.plans.catalogue import ORACLE, QUERIES
from veilspark.sources.document_files import DocumentFilesWriter

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("made", [0, 1, 3])
def test_a_task_that_outlives_its_job_leaves_nothing(tmp_path, made):
    writer = DocumentFilesWriter(str(tmp_path / "out"))

    def rows():
        for i in range(6):
            if i == made:
                writer.abort([None])
            yield str(i), "a.md", "x"

    with pytest.raises((OSError, RuntimeError)):
        writer.write(rows())
    assert os.listdir(tmp_path / "out") == []


def test_term_table_meets_its_sql_with_all_its_tables(spark):
    con = duckdb.connect()
    for t in (f.removesuffix(".parquet") for f in os.listdir(DIR)):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want, got = con.sql(ORACLE["term_table"]).df(), QUERIES["term_table"](spark, DIR).toPandas()
    cols = sorted(want.columns)
    shape = lambda d: d[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert cols == sorted(got.columns) and len(want) and shape(want).equals(shape(got))
