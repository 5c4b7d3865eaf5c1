"""Office blocks and tables as Markdown: odd parts and rows, and a width that is worked out once."""

from pyspark.sql import functions as F

from veilspark.operators import assemble

BLOCKS = "doc_id long, part_no int, block_no int, kind string, style string, text string, rows array<array<array<string>>>"


def test_parts_and_ragged_tables(spark):
    rows = [[["a", " "], ["b|c"], ["d"]], [], [["e", "f"]]]
    blocks = [
        (1, 1, 0, "p", None, "foot", None), (1, 0, 1, "tbl", None, None, rows), (1, 0, 0, "p", "Heading2", " Head ", None), (1, 0, 2, "p", None, "  ", None), (1, 2, 1, "p", None, "y", None), (1, 2, 0, "p", None, "x", None),
        (2, 0, 0, "p", None, " ", None), (3, 4, 0, "tbl", None, None, []), (3, 5, 0, "p", None, "only a header", None), (4, None, 0, "p", None, "m", None), (4, None, 1, "p", None, "n", None), (5, 0, 0, "tbl", None, None, [[]]),
    ]
    got = {r.doc_id: r.text for r in assemble.block_documents(spark.createDataFrame(blocks, BLOCKS)).collect()}
    notice = assemble.fixed.PART_NOTICE
    assert got == {
        1: "## Head\n\n| a | b\\|c | d |\n| --- | --- | --- |\n|  |  |  |\n| e；f |  |  |" + notice + "foot" + notice + "x\n\ny",
        3: (notice + "only a header").strip(), 4: (notice + "m\n\nn").strip(), 5: "|  |\n|  |",
    }


def test_cells_are_read_once_in_a_table(spark):
    """Work by cell: each cell is trimmed in one place of the plan, and the document's blocks are grouped once."""
    table = spark.createDataFrame([(1, 0, 0, "tbl", None, None, [[["a"]]])], BLOCKS)
    plan = assemble.block_documents(table)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1
    one = table.select(assemble.table_text(F.col("rows")).alias("z"))._jdf.queryExecution().optimizedPlan().toString()
    assert one.count("array_max") == 1 and one.count("；") == 1
