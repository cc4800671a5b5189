import pytest
from pyspark.sql import functions as F

from spanveil.plans.fixtures import corpus, people
from spanveil.plans.queries import QUERIES
from spanveil.sources.workspace import ROWS_PER_TASK, spread


def _customers(spark, root, n):
    """A customer table of one file with one row group; every fifth key comes twice, the last key is null."""
    keys = F.when(F.col("id") < n - 1, F.col("id") - F.when(F.col("id") % 5 == 4, 1).otherwise(0))
    rows = spark.range(0, n, 1, 1).select(
        keys.alias("c_custkey"), F.lit("Customer").alias("c_name"), F.lit(1).alias("c_nationkey"),
        F.lit(1.0).alias("c_acctbal"), F.when(F.col("id") % 7 > 0, "BUILDING").alias("c_mktsegment"),
    )
    rows.write.parquet(f"{root}/customer.parquet")
    return rows


def test_people_of_one_row_group_are_spread_over_tasks(spark, tmp_path):
    n = 4 * ROWS_PER_TASK + 1
    _customers(spark, tmp_path, n)
    spark.range(1).select(F.lit(0).alias("page_id"), F.lit("a").alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    spark.range(1).selectExpr("0 as doc_id", "'b' as text", "'s' as source").write.parquet(f"{tmp_path}/documents.parquet")
    for rows, at in ((people(spark, tmp_path), "id"), (QUERIES["scrub_header"](spark, tmp_path), "id"), (corpus(spark, tmp_path), "text")):
        sizes = [r["count"] for r in rows.select(at, F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
        assert max(sizes) <= 2 * ROWS_PER_TASK
        assert len([s for s in sizes if s > ROWS_PER_TASK // 2]) >= 4


@pytest.mark.parametrize("name", ["scrub_fake", "scrub_remove"])
def test_scrub_queries_deal_out_customers_of_one_row_group(spark, tmp_path, name):
    n = 4 * ROWS_PER_TASK + 1
    customers = _customers(spark, tmp_path, n)
    spark.range(1).select(F.lit(0).alias("page_id"), F.lit("a").alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    spark.range(1).selectExpr("0 as doc_id", "'b' as text", "'s' as source").write.parquet(f"{tmp_path}/documents.parquet")
    scrubbed = QUERIES[name](spark, tmp_path)
    sizes = [r["count"] for r in scrubbed.select("text", F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    assert sum(sizes) == n + 2
    assert max(sizes) <= 2 * ROWS_PER_TASK
    ids = scrubbed.select("id").exceptAll(customers.select(F.concat(F.lit("c"), "c_custkey").alias("id")))
    assert sorted(r.id for r in ids.collect()) == ["d0", "p0"]
    assert scrubbed.filter(F.col("text").contains(".example.com")).isEmpty()


def test_spread_keeps_every_row(spark, tmp_path):
    rows = _customers(spark, tmp_path, 1000)
    read = spark.read.parquet(f"{tmp_path}/customer.parquet")
    assert spread(read, 1000) is read
    dealt = spread(read, 64)
    assert dealt.rdd.getNumPartitions() == 16
    assert dealt.exceptAll(rows).isEmpty() and rows.exceptAll(dealt).isEmpty()
