from loreloom.llm import queries


def test_all_queries_run(spark, data_dir):
    for name, f in queries.QUERIES.items():
        df = f(spark, data_dir)
        assert df.columns and df.count() >= 0, name


def test_found_columns(spark, data_dir):
    want = {
        "p1_found": [("group_path", "string"), ("path", "string")], "p2_found": [("field", "string"), ("tag", "string"), ("mark", "string")],
        "p4_found": [("link_id", "bigint"), ("topic_id", "bigint")], "p5_found": [("path", "string"), ("kind", "string")],
        "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")], "p8_found": [("doc_id", "bigint")],
    }
    for name, dtypes in want.items():
        assert queries.QUERIES[name](spark, data_dir).dtypes == dtypes, name
