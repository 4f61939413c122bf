from tallyspring.streaming import monthly

from pyspark.sql import functions as F


def test_daily_state_adds_up_to_months(spark, tmp_path):
    folder = str(tmp_path / "in")
    df = spark.range(400).selectExpr("CAST(id % 2 AS STRING) AS s", "timestamp '2024-01-01' + make_interval(0, 0, 0, CAST(id / 4 AS INT)) AS at", "CASE WHEN id % 50 = 7 THEN NULL ELSE CAST(id AS DOUBLE) END AS v")
    df.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = monthly.monthly_totals(stream, ["s"], "at", "v", "300 days").writeStream.outputMode("complete").format("memory").queryName("days").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.s, r.month): (r.value, r.n) for r in monthly.to_months(spark.table("days"), ["s"]).collect()}
    expected = {(r.s, r.m): (r.v, r.n) for r in df.groupBy("s", F.trunc(F.to_date("at"), "month").alias("m")).agg(F.sum("v").alias("v"), F.count("v").alias("n")).collect()}
    assert got == expected


def test_lines_are_parsed_as_they_arrive(spark, tmp_path):
    folder = str(tmp_path / "lines")
    df = spark.createDataFrame([(1, "2024-01-01,a,b,1,2"), (2, "x"), (3, '2024-01-01,"a,b,1,2')], "line_id long, raw_line string")
    df.write.parquet(folder)
    q = monthly.parsed_lines(spark.readStream.schema(df.schema).parquet(folder)).writeStream.format("memory").queryName("parsed").start()
    q.processAllAvailable()
    q.stop()
    assert {r.line_id: r.reason for r in spark.table("parsed").collect()} == {1: None, 2: "columns", 3: "quoting"}
