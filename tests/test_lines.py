import __spark_entry__ as entry


def test_every_line_reaches_the_reader(spark, tmp_path):
    lines = ["162\t3522\t4\t1263054102", '16057,7587,5,"1455286376', "\t1 2 3", "4,5,-1,7", '"6,7,1', "8,9,0", "é,1,2"]
    spark.createDataFrame(list(enumerate(lines)), "line_id bigint, raw_line string").write.parquet(f"{tmp_path}/raw_rating_lines.parquet")
    rows = entry.queries()["edge_list_all_lines"](spark, str(tmp_path)).collect()
    assert {(r["line_no"], r["source"], r["target"], r["weight"]) for r in rows} == {(0, 162, 3522, 4.0), (1, 16057, 7587, 5.0), (2, 1, 2, 3.0), (3, 4, 5, -1.0)}
