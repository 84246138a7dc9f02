"""Functions of records hand over bounded batches, whatever Spark gives them and whatever a record makes."""

import pyarrow as pa
from pyspark.sql.types import StructType

from foliolake.functions import batches
from foliolake.sources import docx


def _run(function, schema, given):
    return list(batches.batches_of(function, StructType.fromDDL(schema))(iter(given)))


def test_batches_are_bounded_by_rows_and_bytes(spark):
    given = [pa.RecordBatch.from_pydict({"id": list(range(5000)), "text": ["x" * 3000] * 5000})]
    found = _run(lambda r: [(r.id, r.text, k) for k in range(4)], "id long, text string, k long", given)
    assert sum(b.num_rows for b in found) == 20_000
    assert max(b.nbytes for b in found) < 2 * batches.BYTES
    many = _run(lambda r: [(r.id, k) for k in range(10)], "id long, k long", given)
    assert sum(b.num_rows for b in many) == 50_000
    assert max(b.num_rows for b in many) == batches.ROWS


def test_a_record_with_many_rows_comes_in_several_batches(spark):
    given = [pa.RecordBatch.from_pydict({"id": pa.array([None], pa.int64())})]
    found = _run(lambda r: ((r.id, k) for k in range(3 * batches.ROWS + 1)), "id long, k long", given)
    assert [b.num_rows for b in found] == [batches.ROWS] * 3 + [1]
    assert found[0].column(0).null_count == batches.ROWS


def test_large_ids_stand_beside_null(spark):
    """Read through floats, as before, the large id would be another."""
    rows = spark.createDataFrame([((1 << 62) + 1, "a"), (None, "b")], "package_id long, text string").coalesce(1)
    members = docx.members(docx.packages_from_texts(rows.selectExpr("package_id", "text", "'me' as header")))
    assert {r.package_id for r in members.select("package_id").collect()} == {(1 << 62) + 1, None}



def test_queries_that_look_at_items_several_times_read_packages_once(spark, tiny):
    from foliolake.plans import packages

    for query in (packages.w5, packages.a24, packages.j1, packages.d12):
        assert not any("documents.parquet" in file for file in query(spark, tiny).inputFiles()), query.__name__
