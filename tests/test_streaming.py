"""The windowed sum on a stream: late rows within the delay count, later ones do not."""

from datetime import datetime

from tillmark.streaming.ingest import daily_spend

SCHEMA = "ts timestamp, shopper_id long, total_cents long"


def test_daily_spend_with_late_rows(spark, tmp_path):
    rows = [
        [(datetime(2026, 1, 1, 9), 1, 100), (datetime(2026, 1, 1, 10), 1, 50), (datetime(2026, 1, 1, 9), 2, 5)],
        [(datetime(2026, 1, 2, 9), 1, 10)],
        [(datetime(2026, 1, 1, 11), 1, 7), (datetime(2026, 1, 9, 1), 1, 1)],
        [(datetime(2026, 1, 1, 12), 1, 1000), (datetime(2026, 1, 20, 1), 1, 1)],
    ]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    q = None
    for k, part in enumerate(rows):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = daily_spend(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r["window"]["start"].day, r["shopper_id"]): (r["cents"], r["receipts"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got[1, 1] == (157, 3) and got[1, 2] == (5, 1) and got[2, 1] == (10, 1)
