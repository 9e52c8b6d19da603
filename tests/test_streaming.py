"""Counts of a stream by tile and time."""

from __future__ import annotations

from pyspark.sql import functions as F

from genolake.streaming import tiles

SCHEMA = "chr string, pos int, ts string"
ROWS = [("1", 1, "2024-01-01 00:05:00"), ("1", 100_000, "2024-01-01 00:50:00"), ("1", 100_001, "2024-01-01 00:50:00"), ("2", 7, "2024-01-01 00:10:00"), ("1", 5, "2024-01-01 03:00:00"), ("2", 9, "2024-01-01 05:00:00")]
LATE = [("1", 2, "2024-01-01 00:06:00"), ("2", 8, "2024-01-01 05:30:00"), ("1", 3, "2024-01-01 09:00:00")]


def counts(rows):
    out = {}
    for c, p, t in rows:
        key = (t[11:13], c, (p - 1) // 100_000 * 100_000 + 1)
        out[key] = out.get(key, 0) + 1
    return out


def typed(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def read(df):
    return {(r["window"]["start"].strftime("%H"), r["chr"], r["start"]): r["n"] for r in df.collect()}


def test_table_and_stream_agree_and_late_events_stay_out(spark, tmp_path):
    assert read(tiles.tile_counts(typed(spark.createDataFrame(ROWS + LATE, SCHEMA)))) == counts(ROWS + LATE)
    source, done = str(tmp_path / "in"), str(tmp_path / "state")
    for k, rows in enumerate((ROWS, LATE)):  # a batch each: the second has an hour that the watermark has closed
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(source)
        stream = typed(spark.readStream.schema(SCHEMA).json(source))
        query = tiles.tile_counts(stream).writeStream.outputMode("append").format("parquet").option("checkpointLocation", done).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination(120)
        assert k < 2 and query.exception() is None
    got = read(spark.read.parquet(str(tmp_path / "out")))
    whole = counts(ROWS)
    assert all(got[key] == n for key, n in whole.items() if key[0] in ("00", "03"))  # not the late one
    assert ("09", "1", 1) not in got  # still open
