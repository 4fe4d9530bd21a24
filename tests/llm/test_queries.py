from signetry.llm import catalogue

COLUMNS = {
    "p2_found": [("source", "bigint"), ("target", "bigint"), ("event_id", "bigint"), ("sign", "int"), ("timestamp", "bigint")],
    "p3_found": [("split_name", "string"), ("train_event_id", "bigint"), ("eval_event_id", "bigint")],
    "p6_found": [("node_id", "bigint"), ("cluster_id", "bigint")],
}


def test_columns_and_sql_names(spark):
    queries = catalogue.queries()
    assert set(catalogue.oracle_sql()) <= set(queries)
    for name, columns in COLUMNS.items():
        assert queries[name](spark, "/root/testdata/sf0.001").dtypes == columns
