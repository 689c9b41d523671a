"""Distinct counts of time ranges, running reports, and documents as streams."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from flowscope.operators import distinct_ranges as dr
from flowscope.operators import loglog
from flowscope.plans import inputs as I
from flowscope.session import shared_folder
from flowscope.sources import dump_stream
from flowscope.streaming import reports, sinks

SF = "/root/testdata/sf0.001"


def test_runs_cover_an_interval_once_and_are_few(spark):
    rnd = random.Random(2)
    ends = [(i, a, a + n) for i, (a, n) in enumerate((rnd.randrange(0, 5000), rnd.choice([1, 2, 3, 60, 700, 4096])) for _ in range(200))]
    df = spark.createDataFrame(ends, "id bigint, lo bigint, hi bigint")
    for r in df.select("*", dr.runs_of(F.col("lo"), F.col("hi"), 8).alias("runs")).collect():
        covered = sorted(s for run in r.runs for s in range(run.slot << run.level, (run.slot + 1) << run.level))
        assert covered == list(range(r.lo, r.hi))
        assert len(r.runs) <= 2 * 8 + (r.hi - r.lo) // 256


def ranges_and_rows(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("xy"), rnd.randrange(0, 200 * 60), f"v{int(rnd.paretovariate(0.4)) % 30000}") for _ in range(20000)]
    rows += [("x", None, "v1"), ("y", 5, None)]
    return spark.createDataFrame(rows, "g string, s bigint, v string").withColumn("ts", F.timestamp_seconds("s")), rows


def test_estimates_are_within_the_bound_and_tables_merge(spark, tmp_path):
    df, rows = ranges_and_rows(spark)
    asked = [(i, a, a + n) for i, (a, n) in enumerate([(0, 200), (3, 1), (17, 100), (199, 5), (300, 9), (50, 0), (60, -3), (1, 31)])] + [(99, None, 4)]
    intervals = spark.createDataFrame(asked, "id bigint, lo bigint, hi bigint")
    whole = dr.build_ranges(df, "v", seconds=60, levels=7)
    halves = [dr.build_ranges(df.where(f"s % 2 = {k}"), "v", seconds=60, levels=7) for k in (0, 1)]
    dr.save_ranges(dr.merge_ranges(*halves), str(tmp_path / "ranges"))
    stored = dr.load_ranges(spark, str(tmp_path / "ranges"), levels=7)
    exact = {r.id: r.exact for r in dr.exact_in(df, "v", intervals, seconds=60, levels=7).collect()}
    for table in (whole, stored):
        got = {r.id: r.estimate for r in dr.distinct_in(table, intervals).collect()}
        assert got.keys() == exact.keys()
        for i, lo, hi in asked:
            want = len({v for _, s, v in rows if s is not None and v is not None and lo is not None and lo <= s // 60 < hi})
            assert exact[i] == want and abs(got[i] - want) <= dr.relative_error(dr.LG_K) * want + 1
    with pytest.raises(ValueError):
        dr.merge_ranges(whole, dr.build_ranges(df, "v", seconds=60, levels=6))
    with pytest.raises(Exception, match="another shape"):
        dr.load_ranges(spark, str(tmp_path / "ranges"), lg_k=11, levels=7).table.collect()
    with pytest.raises(Exception, match="already exists"):
        dr.save_ranges(whole, str(tmp_path / "ranges"))


def test_ranges_by_group(spark):
    df, rows = ranges_and_rows(spark)
    intervals = spark.createDataFrame([(1, 10, 90)], "id bigint, lo bigint, hi bigint")
    for r in dr.distinct_in(dr.build_ranges(df, "v", seconds=60, by=("g",), levels=6), intervals).collect():
        want = len({v for g, s, v in rows if g == r.g and s is not None and v is not None and 10 <= s // 60 < 90})
        assert abs(r.estimate - want) <= dr.relative_error(dr.LG_K) * want + 1


def test_many_intervals_share_what_they_read(spark):
    """The disk taken does not grow with intervals times their runs or values; keys that come again count as before."""
    rnd = random.Random(7)
    rows = [(rnd.randrange(-50, 350), f"v{rnd.randrange(5000)}") for _ in range(20000)]
    df = spark.createDataFrame(rows, "slot bigint, v string").select("v", F.timestamp_seconds(F.col("slot") * 60).alias("ts"))
    starts = [(i, rnd.randrange(-60, 350), rnd.choice([1, 63, 64, 65, 130, 300])) for i in range(3000)]
    asked = [(i, lo, lo + n) for i, lo, n in starts] + [(3000, 4, 4), (3001, 9, 3), (3002, None, 7)]
    asked += [(1, *asked[1][1:]), (2, None, 5), (3003, -20, 3), (3003, 200, 290), (3004, 0, 70), (3004, 60, 100)]
    intervals = spark.createDataFrame(asked, "id bigint, lo bigint, hi bigint")
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    used = lambda: sum(f.stat().st_size for top in folders for f in Path(str(top)).rglob("*") if f.is_file())
    before = used()
    exact = [(r.id, r.exact) for r in dr.exact_in(df, "v", intervals, seconds=60, levels=6).collect()]
    got = {r.id: r for r in dr.distinct_in(dr.build_ranges(df, "v", seconds=60, levels=6), intervals).collect()}
    assert used() - before < 24e6
    values, want, runs = {}, {}, {}
    for slot, v in rows:
        values.setdefault(slot, set()).add(v)
    for i, lo, hi in asked:
        want.setdefault(i, set()).update(*(values.get(s, ()) for s in range(lo, hi)) if lo is not None else ())
    assert sorted(exact) == sorted((i, len(want[i])) for i, _, _ in asked)
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert abs(r.estimate - len(want[i])) <= dr.relative_error(dr.LG_K, 5) * len(want[i]) + 1
    covers = intervals.where("lo < hi").select("id", F.size(dr.runs_of(F.col("lo"), F.col("hi"), 6)).alias("n"))
    for r in covers.collect():
        runs[r.id] = max(runs.get(r.id, 0), r.n)
    assert {i: r.runs for i, r in got.items()} == {i: runs.get(i, 0) for i in got}


def test_last_report_equals_the_batch_query_and_a_retry_changes_nothing(spark):
    folder = shared_folder(spark, "t-reports")
    flows = I.flows(spark, SF)
    parts = [flows.where(f"event_id % 3 = {k}") for k in range(3)]
    run = reports.report_batch(folder)
    for epoch in (0, 1, 1, 2):  # the second micro-batch is tried twice
        run(parts[epoch], epoch).write.mode("overwrite").parquet(f"{folder}/data/epoch={epoch}")
    got = {r.report: r for r in reports.read_reports(spark, folder).collect()}
    assert set(got) == {0, 1, 2, None}
    want = loglog.diversity_score(loglog.cardinalities(loglog.dimension_registers(flows))).first()
    totals = flows.agg(F.count("*").alias("f"), F.sum("bytes").alias("b"), F.sum("packets").alias("p")).first()
    for final in (got[2], got[None]):
        assert all(final[c] == want[c] for c in want.asDict())
        assert (final.total_flows, final.total_bytes, final.total_packets) == tuple(totals)
    assert got[0].total_flows < got[1].total_flows < got[2].total_flows
    empty = reports.report_of(reports.running_state(flows.limit(0))).first()
    assert empty.total_flows == 0 and empty.unique_flows == 0 and empty.diversity_score == 0


def document(agent, stamp, n, **more):
    flow = {"src_ip": "1.1.1.1", "dst_ip": "2.2.2.2", "src_port": 1, "dst_port": 2, "protocol": "TCP", "packet_count": 1, "byte_count": 9,
            "first_seen": stamp, "last_seen": stamp}
    return json.dumps({"agent": agent, "timestamp": stamp, "flow_count": n, "flows": [flow] * n} | more, indent=1)


def test_flow_documents_are_read_once_across_restarts(spark, tmp_path):
    sinks.use_rocksdb(spark)
    inbox, folder = tmp_path / "inbox", shared_folder(spark, "t-docs")
    inbox.mkdir()
    put = lambda name, text: (inbox / name).write_text(text)
    put("a1.json", document("a", 1000, 2))
    put("a1-again.json", document("a", 1000, 2))
    put("b1.json", document("b", 1000, 1))
    put("bad.json", '{"agent": "a", "timest')
    put("empty.json", document("a", 1001, 0))
    run = lambda: sinks.run_available(dump_stream.stream_flow_batches(spark, str(inbox), per_trigger=2), folder, "append")
    run()
    put("a1-late.json", document("a", 1000, 2))
    put("a2.json", document("a", 1060, 3))
    run()
    run()
    got = sorted((r.agent, r.batch_ts, r["count"]) for r in sinks.read_all(spark, folder).groupBy("agent", "batch_ts").count().collect())
    assert got == [("a", 1000, 2), ("a", 1060, 3), ("b", 1000, 1)]


def test_dumps_in_three_encodings_and_repeats(spark, tmp_path):
    sinks.use_rocksdb(spark)
    inbox, folder = tmp_path / "dumps", shared_folder(spark, "t-dumps")
    key = [10, 0, 0, 1, 172, 16, 0, 2, 0x50, 0xC3, 0xBB, 0x01, 6, 0, 0, 0]
    value = [5, *[0] * 7, 2, *[0] * 7]
    forms = [[f"0x{b:02x}" for b in key], key, " ".join(f"{b:02x}" for b in key)]
    for poll, form in enumerate(forms):
        where = inbox / "agent_id=a" / f"poll_id={poll}" / f"polled={1000 + poll}" / "part=0"
        where.mkdir(parents=True)
        (where / "one.json").write_text(json.dumps([{"key": form, "value": value}, {"key": ["0x01"], "value": value}]))
        (where / "same.json").write_text(json.dumps([{"key": form, "value": value}]))
    (inbox / "agent_id=a" / "poll_id=2" / "polled=1002" / "part=1").mkdir()
    (inbox / "agent_id=a" / "poll_id=2" / "polled=1002" / "part=1" / "cut.json").write_text('[{"key": [')
    for _ in range(2):
        sinks.run_available(dump_stream.stream_counter_dumps(spark, str(inbox), per_trigger=3), folder, "append")
    got = sorted(tuple(r) for r in sinks.read_all(spark, folder).select("poll_id", "src_ip", "dst_port", "total_bytes", "total_packets").collect())
    assert got == [(p, "10.0.0.1", 443, 5, 2) for p in range(3)]
