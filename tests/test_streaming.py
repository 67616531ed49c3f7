"""The streamed index equals the batch count."""

from echotrace.streaming.window_index import WINDOWS, bucket_sizes, maintain


def test_index(spark, tmp_path):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    src, idx, cp = (str(tmp_path / x) for x in ("src", "idx", "cp"))
    one = [(1, 1, p, "ab", t) for p in range(5)] + [(1, 1, 0, "0xAB", t), (1, 2, 0, None, t), (1, 2, 1, "0", t)]
    spark.createDataFrame(one, WINDOWS).write.mode("append").parquet(src)
    maintain(spark, src, idx, cp).awaitTermination()
    spark.createDataFrame([(1, 3, 9, "AB", t), (1, 1, 2, "ab", t), (2, 1, 1, "c", t)], WINDOWS).write.mode("append").parquet(src)
    maintain(spark, src, idx, cp).awaitTermination()
    assert {(r.run_id, r.hv): r.bucket_size for r in bucket_sizes(spark, idx).collect()} == {(1, 0xAB): 6, (2, 0xC): 1}


def test_index_keeps_late_and_timeless_windows(spark, tmp_path):
    from datetime import datetime

    new, old = datetime(2024, 10, 1), datetime(2024, 6, 1)
    src, idx, cp = (str(tmp_path / x) for x in ("src", "idx", "cp"))
    for part in ([(1, 1, 0, "ab", new), (1, 1, 1, "ab", None)], [(1, 1, 5, "ab", new)], [(1, 2, 0, "ab", old), (1, 1, 0, "ab", old), (1, 1, 1, "ab", old)]):
        spark.createDataFrame(part, WINDOWS).write.mode("append").parquet(src)
        maintain(spark, src, idx, cp).awaitTermination()
    assert [(r.run_id, r.hv, r.bucket_size) for r in bucket_sizes(spark, idx).collect()] == [(1, 0xAB, 4)]
