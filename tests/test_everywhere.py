"""Substring search for a table of queries against a scan a query."""

from pyspark.sql import functions as F

from sparkloom.operators import everywhere as ev

ROWS = [("memories", "a", "Solar plan"), ("memories", "b", "plan B"), ("memories", "c", None), ("memories", "d", ""), ("decisions", "a", "PLAN the plan"), ("decisions", "e", "x" * 500 + "ünïque"), ("workflows", "f", "ab")]
QUERIES = [(1, "plan"), (2, "Plan b"), (3, "a"), (4, "ab"), (5, ""), (6, None), (7, "nothing here"), (8, "NÏQ"), (9, "xxx"), (10, "plan"), (11, " ")]


def test_substrings_of_any_length_equal_a_scan(spark):
    rows = spark.createDataFrame([(c, i, f"t{i}", t, n) for n, (c, i, t) in enumerate(ROWS)], "category string, id string, title string, text string, at long").withColumn("needle", F.lit("clash")).drop("needle")
    q = spark.createDataFrame(QUERIES, "query_id long, query string")
    got = sorted((r.query_id, r.category, r.id) for r in ev.substring_search(q, rows, limit=9).collect())
    want = sorted((i, c, k) for i, s in QUERIES if s for c, k, t in ROWS if t is not None and s.lower() in t.lower())
    assert got == want and len(want) > 12
    one = ev.substring_search(q, rows, ev.run_index(rows), 1).filter("query_id = 1").collect()
    assert sorted((r.category, r.id, r["rank"]) for r in one) == [("decisions", "a", 1), ("memories", "b", 1)]  # the newest of each
    assert ev.substring_search(q.limit(0), rows).count() == ev.substring_search(q, rows.limit(0)).count() == 0


def test_a_query_looks_up_its_rarest_run(spark):
    rows = spark.createDataFrame([("m", str(i), "common words " + ("zebra" if i == 3 else ""), i) for i in range(20)], "category string, id string, text string, at long")
    index = ev.run_index(rows)
    key = ev.keys_of(spark.createDataFrame([(1, "words zebra")], "query_id long, query string"), index).first()
    assert index.filter(F.col("run") == key.run).count() == 1


def test_all_domains_come_in_one_table(spark):
    q = spark.createDataFrame([(1, "plan")], "query_id long, query string")
    hits = spark.createDataFrame([(1, "chk", 1), (1, "far", 30)], "query_id long, chunk_id string, rank int")
    d = spark.createDataFrame([(7, "t", "a plan", 5)], "id long, title string, text string, at long")
    got = sorted((r.category, r.id, r["rank"]) for r in ev.search_everywhere(q, hits, 10, workflows=d, automations=d).collect())
    assert got == [("automations", "7", 1), ("knowledge", "chk", 1), ("workflows", "7", 1)]


def test_the_sql_leaves_out_queries_without_a_vector():
    import duckdb

    from sparkloom.plans import knowledge  # noqa: F401
    from sparkloom.plans.views import with_ctes

    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT 1 AS doc_id, 'some words' AS text, 'web' AS source")
    con.execute("CREATE TABLE benchmark AS SELECT * FROM (VALUES (1, 'words'), (2, ', ')) b(item_id, text)")
    assert con.execute(with_ctes("vec", "SELECT query_id, rank FROM vec")).fetchall() == [(1, 1)]
