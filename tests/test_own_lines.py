"""Styles and font sizes are worked out from the documents' own lines, in Spark and in SQL alike."""

import duckdb
import pytest

from weftgraph import catalog

TEXTS = ["a title alone that is long", "short\nand a line below that is longer than it", "the first line here is longer\nx", "", "\n \nabc"]
WANTED = {
    "font_histogram": ("body_size", [(18.0,), (10.0,), (18.0,), (10.0,)]),
    "layout_style": ("body, margin", [(18.0, 51.0), (10.0, 51.0), (18.0, 51.0), (10.0, 50.0)]),
}


@pytest.mark.parametrize("name", sorted(WANTED))
def test_own_lines(spark, tmp_path, name):
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(path)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    columns, wanted = WANTED[name]
    catalog.queries()[name](spark, str(tmp_path)).createOrReplaceTempView("found")
    found = [tuple(map(float, r)) for r in spark.sql(f"SELECT {columns} FROM found ORDER BY doc_id").collect()]
    sql = duck.sql(f"SELECT {columns} FROM ({catalog.oracle_sql()[name]}) ORDER BY doc_id").fetchall()
    assert found == [tuple(map(float, r)) for r in sql] == wanted
