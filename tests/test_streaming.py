"""Multi-batch streaming runs equal the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from flowscope.operators import anchors, policy, prefixes, series
from flowscope.plans import inputs as I
from flowscope.session import shared_folder
from flowscope.streaming import anchored, deltas, rule_state, sinks
from flowscope.streaming import operators as st
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    sinks.use_rocksdb(spark)
    path = str(tmp_path_factory.mktemp("stream") / "events")
    events = I.table(spark, SF, "events").orderBy("ts").coalesce(1)
    for i in range(3):
        events.where(f"event_id % 3 = {i}").write.mode("append").parquet(path)
    return path, events.schema


def stream(spark, many_files):
    path, schema = many_files
    return I.event_flows(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))


def test_prefixes_over_batches(spark, many_files):
    folder = shared_folder(spark, "t-hhh")
    sinks.run_available(st.heavy_prefix_sums(stream(spark, many_files), 5000), folder)
    got = prefixes.name_prefixes(sinks.read_latest(spark, folder, ["mask_len", "network"]))
    want = prefixes.hhh_prefixes(I.flows(spark, SF), 5000)
    assert rows(got, "prefix", "parent", "bytes") == rows(want, "prefix", "parent", "bytes")


def test_policy_over_batches(spark, many_files):
    rules_at, out = shared_folder(spark, "t-rules"), shared_folder(spark, "t-policy")
    events = stream(spark, many_files)
    rules = policy.normalize_policy_events(events.where(I.POLICY_CHOICE).selectExpr(*I.POLICY_EVENTS))
    traffic = events.select("event_id", "ts", "src_ip")
    before = shared_folder(spark, "t-policy")
    sinks.run_available(traffic, before, "append", st.policy_batch(rules_at, rules.schema))
    assert sinks.read_all(spark, before).where("dropped").count() == 0  # no rule has been written yet
    sinks.run_available(st.sliced_rules(rules), rules_at, "append", partition_by=["rule_day"])
    sinks.run_available(traffic, out, "append", st.policy_batch(rules_at, rules.schema))
    got = sinks.read_all(spark, out)
    want = policy.policy_apply(I.flows(spark, SF), policy.normalize_policy_events(I.policy_events(spark, SF)))
    assert rows(got, "event_id", "dropped") == rows(want, "event_id", "dropped")


def test_policy_reads_only_the_slices_of_the_batch(spark, many_files):
    rules_at = shared_folder(spark, "t-rules")
    rules = policy.normalize_policy_events(I.policy_events(spark, SF))
    st.sliced_rules(rules).write.partitionBy("rule_day").parquet(f"{rules_at}/data/epoch=0")
    batch = I.flows(spark, SF).select("event_id", "ts", "src_ip").where("ts < '2024-01-02'")
    applied = st.policy_batch(rules_at, rules.schema)(batch, 1)
    plan = applied._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(rule_day" in plan and "GreaterThanOrEqual(rule_slice" in plan


def in_files(spark, path, rows, cuts):
    for cut in cuts:
        rows.where(cut).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def polled(spark):
    return I.snapshots(spark, SF).withColumn("at", F.timestamp_seconds("poll_id"))


DELTA_COLS = ["agent_id", "src_ip", "dst_port", "poll_id", "bytes", "packets"]


def test_deltas_when_polls_are_cut_and_late(spark, tmp_path):
    late = "src_ip LIKE '%3' AND poll_id = 2"
    rest = f"NOT ({late}) AND poll_id <= 6"
    half = "dst_port % 2 = 0"
    cuts = [f"{rest} AND poll_id = 1", f"{rest} AND poll_id = 2 AND {half}", f"{rest} AND poll_id = 2 AND NOT {half}",
            f"{rest} AND poll_id = 3", f"{rest} AND poll_id BETWEEN 4 AND 6 AND {half}", late,
            f"{rest} AND poll_id BETWEEN 4 AND 6 AND NOT {half}", f"{rest} AND poll_id = 3"]
    folder, snaps = shared_folder(spark, "t-deltas"), polled(spark).cache()
    sinks.use_rocksdb(spark)
    stream = in_files(spark, str(tmp_path / "snaps"), snaps, cuts)
    sinks.run_available(deltas.stream_deltas(stream, "at", "10 seconds", 20_000), folder, keys=[*deltas.KEYS, "poll_id"])
    want = series.counter_deltas(snaps.where("poll_id <= 6"))
    assert rows(deltas.read_deltas(spark, folder), *DELTA_COLS) == rows(want, *DELTA_COLS)


def test_delta_state_forgets_keys_and_is_touched_by_key(spark, tmp_path):
    """A large old state costs nothing while few keys report, and is gone when the watermark has passed it."""
    sinks.use_rocksdb(spark)
    folder, path = shared_folder(spark, "t-deltas"), str(tmp_path / "snaps")
    many = spark.range(3000).selectExpr("'a' as agent_id", "concat('10.0.0.', id) as src_ip", "'d' as dst_ip", "'TCP' as proto", "1 as src_port",
                                        "2 as dst_port", "1 as poll_id", "id + 1 as total_bytes", "1L as total_packets", "timestamp_seconds(1) as at")
    few = many.where("src_ip in ('10.0.0.1', '10.0.0.2')")
    later = lambda p: few.withColumn("poll_id", F.lit(p)).withColumn("at", F.timestamp_seconds(F.lit(p))).withColumn(
        "total_bytes", F.col("total_bytes") + 100 * p)
    for part in (many, later(2), later(3), later(50), later(51), later(1).withColumn("total_bytes", F.lit(7).cast("bigint"))):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(many.schema).option("maxFilesPerTrigger", 1).parquet(path)
    run = sinks.run_available(deltas.stream_deltas(stream, "at", "5 seconds", 10_000), folder, keys=[*deltas.KEYS, "poll_id"])
    state = {p.batchId: (p.numInputRows, p.stateOperators[0].numRowsTotal, p.stateOperators[0].numRowsUpdated) for p in run.recentProgress if p.numInputRows}
    ran = sorted(state)
    assert state[ran[0]][1] >= 3000  # keys and their timers
    assert all(state[i][2] <= 20 for i in ran[1:3]) and state[ran[2]][1] >= 3000
    assert state[ran[-1]][1] < 20
    got = {(r.src_ip, r.poll_id): r.bytes for r in deltas.read_deltas(spark, folder).collect() if r.src_ip == "10.0.0.1"}
    assert got == {("10.0.0.1", 1): 2, ("10.0.0.1", 2): 200, ("10.0.0.1", 3): 100, ("10.0.0.1", 50): 5002, ("10.0.0.1", 51): 100}


def rule_table(spark, events):
    """(second, seq, action, ip, ttl) as normalised events."""
    made = spark.createDataFrame(events, "s bigint, seq bigint, action string, ip string, ttl_s bigint").select(
        F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "seq", "action", F.lit(None).cast("string").alias("match"), "ip", "ttl_s")
    return policy.normalize_policy_events(made)


def test_rule_ends_with_late_and_repeated_rules(spark, tmp_path):
    sinks.use_rocksdb(spark)
    first = [(100, 1, "block", "1.1.1.1", 60), (100, 2, "block", "2.2.2.2", 3600), (110, 3, "block", "3.3.3.3", 30), (100, 1, "block", "1.1.1.1", 60),
             (120, 4, "block", "4.4.4.4", 50), (120, 5, "block", "4.4.4.4", 20), (3590, 6, "block", "5.5.5.5", 60)]
    second = [(3500, 7, "block", "6.6.6.6", 3600), (3595, 8, "unblock", "6.6.6.6", None), (3585, 9, "unblock", "2.2.2.2", None),  # late by 5 s
              (3592, 10, "block", "5.5.5.5", 3600)]
    third = [(7300, 12, "block", "7.7.7.7", 3600), (7195, 13, "unblock", "5.5.5.5", None), (120, 11, "unblock", "3.3.3.3", None)]  # too late
    path, folder = str(tmp_path / "rules"), shared_folder(spark, "t-rules")
    for part in (first, second, third):
        rule_table(spark, part).coalesce(1).write.mode("append").parquet(path)
    schema = rule_table(spark, first).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    run = sinks.run_available(rule_state.rule_ends(stream, late="100 seconds"), folder, "append")
    got = sorted((r.ip, int(r.from_ts.timestamp()), int(r.end_ts.timestamp()), r.reason) for r in sinks.read_all(spark, folder).select(
        "ip", F.col("from_ts").cast("timestamp").alias("from_ts"), F.col("end_ts").cast("timestamp").alias("end_ts"), "reason").collect())
    assert got == [("1.1.1.1", 100, 160, "expired"), ("2.2.2.2", 100, 3585, "deleted"), ("3.3.3.3", 110, 140, "expired"), ("4.4.4.4", 120, 140, "expired"),
                   ("5.5.5.5", 3590, 3592, "replaced"), ("5.5.5.5", 3592, 7192, "expired"), ("6.6.6.6", 3500, 3595, "deleted")]
    live = spark.read.format("statestore").option("stateVarName", "live").load(f"{folder}/checkpoint")
    assert {r.key.ip for r in live.collect()} <= {"7.7.7.7"}
    assert run.lastProgress.stateOperators[0].numRowsTotal < 10


def test_rules_of_a_table_end_as_in_batch(spark):
    rules = policy.normalize_policy_events(I.policy_events(spark, SF))
    want = rule_state.ended_rules(rules, "2024-01-20 00:00:00")
    spans = policy.rule_intervals(rules)
    assert want.count() > 0 and want.select("ip", "from_ts").distinct().count() == want.count() <= spans.count()


def plain_anchors(seconds, every=30):
    out = []
    for s in sorted(set(seconds)):
        if not out or s >= out[-1] + every:
            out.append(s)
    return out


@pytest.mark.parametrize("every,slice_seconds", [(30, 600), (30, 30), (7, 20)])
def test_anchored_windows(spark, every, slice_seconds):
    rnd = random.Random(every + slice_seconds)
    seconds = {
        "busy": [int(rnd.random() * 4000) for _ in range(3000)], "sparse": [i * 977 for i in range(12)], "every": list(range(0, 3000, every)),
        "pair": [5, 5 + every], "one": [12345], None: [1, 2, 3, every, every + 1], "drift": [i * (every + 1) // 2 for i in range(200)],
    }
    made = [(k, s, "a", "b", 1, 2, "TCP", 10, 1) for k, ss in seconds.items() for s in ss] + [("one", None, "a", "b", 1, 2, "TCP", 10, 1)]
    flows = spark.createDataFrame(made, "agent_id string, s bigint, src_ip string, dst_ip string, src_port int, dst_port int, proto string, bytes bigint, packets bigint")
    flows = flows.withColumn("ts", F.timestamp_seconds("s")).repartition(5)
    got = anchors.anchored_windows(flows, every=every, slice_seconds=slice_seconds)
    got = {(r.agent_id, r.a): (r.z, r.packets) for r in got.selectExpr(
        "*", "unix_seconds(cast(window_start as timestamp)) a", "unix_seconds(cast(window_end as timestamp)) z").collect()}
    want = {}
    for k, ss in seconds.items():
        starts = plain_anchors(ss, every)
        for a, z in zip(starts, [*starts[1:], None], strict=True):
            want[k, a] = (z, sum(a <= s and (z is None or s < z) for s in ss))
    assert got == want


def test_anchored_windows_of_a_stream_take_late_packets_as_they_come(spark, tmp_path):
    parts = [[("a", 0), ("a", 29), ("b", 5)], [("a", 40), ("a", 3), ("a", 75)], [("b", 6), ("a", 80), ("a", 30)], [("b", 100), ("a", 200)]]
    path, folder = str(tmp_path / "packets"), shared_folder(spark, "t-anchored")
    for part in parts:
        made = spark.createDataFrame([(k, s) for k, s in part], "agent_id string, s bigint").selectExpr(
            "agent_id", "timestamp_seconds(s) as ts", "'x' as src_ip", "'y' as dst_ip", "1 as src_port", "2 as dst_port", "'TCP' as proto", "1L as bytes", "1L as packets")
        made.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(path)
    sinks.run_available(stream, folder, "append", anchored.anchored_batch(folder))
    got = sorted((r.agent_id, r.a, r.z, r.packets) for r in anchored.read_anchored(spark, folder).selectExpr(
        "*", "unix_seconds(cast(window_start as timestamp)) a", "unix_seconds(cast(window_end as timestamp)) z").collect())
    assert got == [("a", 0, 40, 3), ("a", 40, 75, 1), ("a", 75, 200, 3), ("a", 200, None, 1), ("b", 5, 100, 2), ("b", 100, None, 1)]
    assert len(sinks.epochs(spark, f"{folder}/state")) <= 2


def test_repeated_documents_are_dropped_and_their_keys_forgotten(spark, tmp_path):
    sinks.use_rocksdb(spark)
    path, folder = str(tmp_path / "docs"), shared_folder(spark, "t-dedup")
    for k in range(6):
        stamps = [(f"a{i % 40}", 1000 + 100 * k + i) for i in range(100)]
        docs = spark.createDataFrame([*stamps, *stamps[90:], *[(a, t - 100) for a, t in stamps[95:] if k]], "agent string, timestamp bigint")
        docs.withColumn("at", F.timestamp_seconds("timestamp")).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    run = sinks.run_available(st.new_batches(stream, "at", late="20 seconds"), folder, "append")
    got = sinks.read_all(spark, folder)
    assert got.count() == got.distinct().count() == 600
    kept = [p.stateOperators[0].numRowsTotal for p in run.recentProgress]
    assert kept[-1] < 60 and max(kept) < 250  # of 600 keys


def test_many_epochs_leave_a_bounded_number_of_folders(spark, tmp_path):
    path, folder = str(tmp_path / "many"), shared_folder(spark, "t-many")
    for i in range(25):
        spark.createDataFrame([(i % 3, i)], "k int, v int").coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema("k int, v int").option("maxFilesPerTrigger", 1).parquet(path)
    sinks.run_available(source.groupBy("k").agg(F.sum("v").alias("v")), folder, "update", keys=["k"])
    assert len(sinks.epochs(spark, f"{folder}/data")) <= 2 * sinks.COMPACT
    assert len(sinks.epochs(spark, f"{folder}/base")) <= 2
    got = {r.k: r.v for r in sinks.read_latest(spark, folder, ["k"]).collect()}
    assert got == {k: sum(range(k, 25, 3)) for k in range(3)}


class _Conf:
    """Stands in for a session whose configuration cannot be changed while it runs."""

    def __init__(self, master, folder=None):
        self.conf = self.sparkContext = self
        self.master, self.folder = master, folder

    def get(self, key, default=None):
        return self.folder if key == "spark.checkpoint.dir" else default

    def getConf(self):
        return self


def test_shared_folder_follows_the_session_setting():
    assert shared_folder(_Conf("spark://x", "hdfs://shared/"), "x").startswith("hdfs://shared/x-")
    with pytest.raises(ValueError):
        shared_folder(_Conf("spark://x"), "x")
    assert shared_folder(_Conf("local[2]"), "x") != shared_folder(_Conf("local[2]"), "x")


@pytest.mark.parametrize("name", ["stream_rate", "stream_dedup"])
def test_no_row_is_late_however_long_the_table(spark, tmp_path, name):
    """Event ids, and with them both time axes, are spread over more than nine months."""
    path = str(tmp_path / "events.parquet")
    I.table(spark, SF, "events").withColumn("event_id", F.col("event_id") * 1_000_003).coalesce(1).write.parquet(path)
    con = duck(SF)
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    assert compare(queries()[name](spark, str(tmp_path)), con, oracle_sql()[name]) is None
