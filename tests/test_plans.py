"""Plans of the larger queries: what reaches the scan, what is shuffled."""

from timberline.operators import analysis as A
from timberline.plans import registry
from timberline.session import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark, small):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    t = table(spark, small, "line_index").select("file_id", "line_number", "timestamp_us", "level")
    p = plan(A.filtered(t, least="ERROR", between=(1, 2)))
    assert "In(level" in p.split("PushedFilters")[1] and "GreaterThanOrEqual(timestamp_us" in p.split("PushedFilters")[1]
    assert "message_preview" not in p and "source_file" not in p


def test_one_shuffle_per_analysis(spark, small):
    lines = spark.createDataFrame([(1, 0, "x")], "doc_id int, pos int, line string")
    for f in (A.totals, A.level_histogram, A.anomaly_summary, A.platform, A.categories):
        assert plan(f(lines)).count("Exchange hashpartitioning") == 1
        assert "Python" not in plan(f(lines)) and "Arrow" not in plan(f(lines))


def test_no_cross_joins(spark, small):
    for name, q in registry.queries().items():
        if name in registry.oracle_sql() and not name.startswith("stream") and name not in ("alert_rate", "file_scan", "read_by_offset"):
            p = plan(q(spark, small))
            assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
