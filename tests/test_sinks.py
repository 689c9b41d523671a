"""The push sink, the metric sink and bounded prefix counters under retries and restarts."""

import random
from collections import Counter

from pyspark.sql import functions as F
from pyspark.sql import Row

from flowscope.operators import series
from flowscope.session import shared_folder
from flowscope.streaming import lossy, metric_sink, push, sinks


def documents(writer, batch, texts):
    staged = [writer.write(iter([Row(document=t) for t in part])) for part in texts]
    writer.commit(staged, batch)


def test_a_retried_batch_leaves_one_document_each(spark):
    folder = shared_folder(spark, "t-push")
    writer = push.PushWriter(f"{folder}/pushed")
    documents(writer, 0, [["a", "b"], ["c"], []])
    documents(writer, 1, [["d", None]])
    documents(writer, 1, [["d"], ["x"]])  # committed before: its files go
    lost = writer.write(iter([Row(document="never committed")]))
    failed = writer.write(iter([Row(document="aborted")]))
    writer.abort([failed, None], 2)
    documents(writer, 2, [["é 漢"]])
    got = sorted((r.batch, r.document) for r in push.read_pushed(spark, folder).collect())
    assert got == [(0, "a"), (0, "b"), (0, "c"), (1, "d"), (2, "é 漢")]
    staged = {r.file for r in spark.read.text(f"{folder}/pushed/staged").select(F.col("_metadata.file_name").alias("file")).collect()}
    assert lost.file in staged and failed.file not in staged and len(staged) == 5


def test_a_restarted_stream_goes_on(spark, tmp_path):
    path, folder = str(tmp_path / "in"), shared_folder(spark, "t-push")
    for k in range(3):
        spark.createDataFrame([(f"{k}-{i}",) for i in range(4)], "document string").coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema("document string").option("maxFilesPerTrigger", 1).parquet(path)
        push.push(stream, folder).awaitTermination()
    got = sorted(r.document for r in push.read_pushed(spark, folder).collect())
    assert got == sorted(f"{k}-{i}" for k in range(3) for i in range(4))


def test_steps_are_written_once_when_their_bucket_closes(spark, tmp_path):
    sinks.use_rocksdb(spark)
    rnd = random.Random(8)
    rows = [("m", rnd.choice("ab"), s + rnd.choice([0, -3]), rnd.randrange(1, 100)) for s in range(100, 400)]
    path, folder = str(tmp_path / "in"), shared_folder(spark, "t-steps")
    for k in range(12):
        part = [r for r in rows if k * 25 <= r[2] - 97 < (k + 1) * 25]
        spark.createDataFrame(part, "metric string, label string, s bigint, bytes bigint").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(path)
    whole = spark.read.parquet(path)
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(path)
    metric_sink.append_steps(metric_sink.counter_steps(stream, "10 seconds"), folder).awaitTermination()
    closed = max(r[2] for r in rows) - 10
    value = lambda df: sorted((r.metric, r.label, r.ts, r.value) for r in df.collect())
    want = series.counter_series(whole).where(F.unix_seconds("ts") <= closed)
    got = metric_sink.read_counters(spark, folder)
    assert value(got) == value(want) and got.count() > 80
    assert len(sinks.epochs(spark, f"{folder}/data")) <= 2 * sinks.COMPACT
    rates = series.metric_rate(got).collect()
    assert sorted(map(repr, rates)) == sorted(map(repr, series.metric_rate(want).collect()))


def test_gauge_steps_keep_the_last_value(spark, tmp_path):
    sinks.use_rocksdb(spark)
    path, folder = str(tmp_path / "in"), shared_folder(spark, "t-gauges")
    rows = [("cpu", "a", 1001, 5.0), ("cpu", "a", 1004, 7.0), ("cpu", "b", 1003, 1.0), ("cpu", "a", 1006, 2.0), ("cpu", "a", 1100, 9.0)]
    spark.createDataFrame(rows, "metric string, label string, s bigint, value double").withColumn("ts", F.timestamp_seconds("s")).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    metric_sink.append_steps(metric_sink.gauge_steps(stream, "10 seconds"), folder).awaitTermination()
    got = sorted((r.label, int(r.ts.timestamp()), r.value) for r in metric_sink.read_steps(spark, folder).collect())
    assert got == [("a", 1005, 7.0), ("a", 1010, 2.0), ("b", 1005, 1.0)]


def test_prefix_counters_stay_few_and_within_their_error(spark):
    rnd = random.Random(6)
    folder, counters, truth, total = shared_folder(spark, "t-lossy"), 40, Counter(), 0
    apply = lossy.lossy_batch(folder, counters, levels=(16, 32))
    for epoch in range(5):
        rows = [(f"10.{rnd.randrange(3)}.0.{int(rnd.paretovariate(0.7)) % 250}", rnd.randrange(1, 1000)) for _ in range(400)]
        rows += [(f"172.{rnd.randrange(250)}.{rnd.randrange(250)}.{rnd.randrange(250)}", rnd.randrange(1, 200)) for _ in range(1500)]
        rows += [("nonsense", 10**9), (None, 10**9), ("10.0.0.1", -5), ("10.0.0.1", 0)]
        for ip, n in rows:
            if ip and ip != "nonsense" and n > 0:
                parts = ip.split(".")
                truth[32, ip] += n
                truth[16, ".".join(parts[:2] + ["0", "0"])] += n
                total += n
        batch = spark.createDataFrame(rows, "dst_ip string, bytes bigint")
        for _ in range(1 + (epoch == 2)):  # the third is tried twice
            apply(batch, epoch).write.mode("overwrite").parquet(f"{folder}/data/epoch={epoch}")
    got = {(r.mask_len, ".".join(str(r.network >> s & 255) for s in (24, 16, 8, 0))): (r.low, r.high) for r in lossy.read_counters(spark, folder).collect()}
    errors = {}
    for (k, ip), (low, high) in got.items():
        assert low <= truth[k, ip] <= high
        errors[k] = high - low
    assert all(e * (counters + 1) <= total for e in errors.values()) and errors[32] > 0
    assert all(sum(k == level for level, _ in got) <= counters for k in (16, 32))
    for (k, ip), n in truth.items():
        assert n <= errors[k] or (k, ip) in got
    heavy = lossy.maybe_heavy(lossy.read_counters(spark, folder), 20_000).count()
    assert heavy >= sum(n >= 20_000 + errors[k] for (k, _), n in truth.items()) > 3
    assert len(sinks.epochs(spark, f"{folder}/data")) <= 3
    assert lossy.merge_counters(spark.createDataFrame([], "mask_len int, network bigint, bytes bigint"), None, 5).count() == 0
