"""Markdown of documents whose title goes as a repeated line, in Spark and in SQL alike."""

import duckdb
import pytest

from weftgraph import catalog


def _word(i: int) -> str:
    return chr(97 + i % 26) + chr(97 + i // 26)


# the title is like the bold lines (line 9 and so on for document 5) and goes with them; the next line's kind follows from doc_id
@pytest.mark.parametrize("doc_id, begin", [(5, "  b) ba and more"), (0, "- **ba **and more"), (6, "ba and more")])
def test_begins_with_what_is_left(spark, tmp_path, doc_id, begin):
    text = "\n".join("same" if i == 0 or (i + doc_id) % 10 == 4 else _word(i) for i in range(120))
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(doc_id, text)], "doc_id long, text string").write.parquet(path)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    found = [r.markdown for r in catalog.queries()["layout_markdown"](spark, str(tmp_path)).collect()]
    sql = [r[0] for r in duck.sql(f"SELECT markdown FROM ({catalog.oracle_sql()['layout_markdown']})").fetchall()]
    assert found == sql
    assert found[0].startswith(begin)


def test_no_text_and_dotted_capitals(spark, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(1, None), (2, "plain\nwords\nin İstanbul")], "doc_id long, text string").write.parquet(path)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    found = sorted(tuple(r) for r in catalog.queries()["layout_markdown"](spark, str(tmp_path)).collect())
    sql = duck.sql(f"SELECT doc_id, markdown FROM ({catalog.oracle_sql()['layout_markdown']})").fetchall()
    assert found == sorted(sql)
    assert [f[0] for f in found] == ["1", "2"]
