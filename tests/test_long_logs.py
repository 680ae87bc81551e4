"""The logs made of orders, where one customer has more lines than a tail keeps."""

from datetime import date

from loomlog import catalog


def test_no_order_is_cut(spark, tmp_path):
    n = 6000
    rows = [(1, i, date(2020, 1, 1), "1-URGENT", "O") for i in range(n)]
    spark.createDataFrame(rows, "o_custkey long, o_orderkey long, o_orderdate date, o_orderpriority string, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    q = catalog.queries()
    plain = sorted(r.line_number for r in q["assemble_plain"](spark, str(tmp_path)).collect())
    assert plain == [3 * i + 2 for i in range(n)]
    extended = sorted(r.line_number for r in q["assemble_extended"](spark, str(tmp_path)).collect())
    assert extended == list(range(1, 2 * n + 1))
    assert [r.source for r in q["format_sniff"](spark, str(tmp_path)).collect()] == ["1"]
