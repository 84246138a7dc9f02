"""The relations between two ways to one result take words apart inside rows: none of them is shuffled as a row."""

import pyspark.sql.functions as F

from foliolake.operators import tables
from foliolake.plans import governance


def test_no_word_is_a_row(spark, tiny):
    plan = governance.v10(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(split(" in plan  # lines are rows
    assert "posexplode(words" not in plan


def test_a_row_is_inserted_beside_the_rows_that_are_there(spark):
    rows = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["c"]), (None, 0, ["d"])], "table_index long, row_index long, cells array<string>")
    found = tables.insert_row(rows, 0)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(1, 0, ["a", "b"]), (1, 1, ["", ""]), (1, 2, ["c"]), (None, 0, ["d"]), (None, 1, [""])], key=repr)
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_lines_that_share_a_place_are_one_case(spark, tmp_path, tiny):
    """Documents of one id are one case a line number, as in SQL, and every relation of texts holds."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(3).withColumn("doc_id", F.lit(7).cast("long")).withColumn("text", F.lit("one two three four five six seven eight\nnine"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{tiny}/lineitem.parquet").limit(20).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = {r.relation: (r.cases, r.holds) for r in governance.v10(spark, str(tmp_path)).collect()}
    assert found["m3-track-accept-eq-direct"] == found["m4-item-accept-eq-all"] == found["m5-item-reject-eq-all"] == (2, 2)
    assert found["m6-batch-eq-sequential"] == (6, 6)
    assert found["m7-insert-delete-row-eq-original"][0] == found["m7-insert-delete-row-eq-original"][1] == 20
