"""Every named query: ``name -> function(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowscope.functions import labels, net
from flowscope.functions.hashing import CmsSpec, HllSpec
from flowscope.operators import countmin as cm
from flowscope.operators import anchors, detect, peers, policy, prefixes, report, rollup, scenario, series
from flowscope.operators import distinct_ranges as ranges_of
from flowscope.operators import loglog as ll
from flowscope.operators.sliced import time_slice
from flowscope.plans import inputs as I
from flowscope.session import shared_folder, use_utc
from flowscope.sources import dump_stream, flow_batches, snapshots, summaries, telemetry
from flowscope.sources import frames as frame_source
from flowscope.streaming import anchored, lossy, metric_sink, push, reports, rule_state, sinks
from flowscope.streaming import deltas as stream_deltas_op
from flowscope.streaming import operators as st

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

THRESHOLD = 5000
HMAC_KEY = "k"
B_SPEC = CmsSpec(family="B")


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output types: integers as BIGINT, doubles rounded to six places, instants without zone."""
    out = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(field.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(field.name))
    return df.select(*out)


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(fn(use_utc(spark), sf_dir))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


# --- flows, totals, counters ------------------------------------------------------------------------------------


@query
def flow_rollup(spark, d):
    return rollup.flow_rollup(I.flows(spark, d))


@query
def flow_rollup_volume(spark, d):
    return rollup.flow_rollup(I.volume_flows(spark, d))


@query
def flow_listing(spark, d):
    return rollup.flow_listing(rollup.flow_rollup(I.flows(spark, d)), I.ASOF)


@query
def flow_keys(spark, d):
    f = I.flows(spark, d)
    return f.select("event_id", net.flow_key().alias("flow_key"), net.flow_id().alias("flow_id"))


@query
def traffic_totals(spark, d):
    return rollup.traffic_totals(I.batch_flows(spark, d))


@query
def traffic_counters(spark, d):
    return rollup.traffic_counters(I.flows(spark, d))


@query
def traffic_counters_volume(spark, d):
    return rollup.traffic_counters(I.volume_flows(spark, d))


@query
def top_flows_per_batch(spark, d):
    return rollup.top_flows_per_batch(I.flows(spark, d))


@query
def batch_cardinalities(spark, d):
    return rollup.batch_cardinalities(I.flows(spark, d))


@query
def agent_health(spark, d):
    samples = I.flows(spark, d).select("agent_id", F.struct("ts", "event_id").alias("at"), (F.col("k") + 0.5).cast("double").alias("cpu"))
    return rollup.agent_health(samples, ts="at")


@query
def distinct_flow_keys(spark, d):
    f = I.flows(spark, d)
    return rollup.distinct_flow_keys(f.where("agent_id IN ('agent-0', 'agent-1')"), f.where("agent_id <> 'agent-0'"))


# --- prefixes ---------------------------------------------------------------------------------------------------


def _prefixes(spark, d):
    return prefixes.hhh_prefixes(I.flows(spark, d), THRESHOLD)


@query
def hhh_prefixes(spark, d):
    return _prefixes(spark, d).drop("mask_len")


@query
def hhh_prefixes_volume(spark, d):
    return prefixes.hhh_prefixes(I.volume_flows(spark, d), 1_000_000).drop("mask_len")


@query
def hhh_prefixes_truncated(spark, d):
    """Prefixes as an aggregator sees them when agents only ship their top 20 flows per poll."""
    return prefixes.hhh_prefixes(rollup.top_flows_per_batch(I.flows(spark, d)), THRESHOLD).drop("mask_len")


@query
def hhh_parent_check(spark, d):
    return prefixes.parent_check(_prefixes(spark, d))


@query
def top_prefixes(spark, d):
    return prefixes.top_prefixes(_prefixes(spark, d))


@query
def top_subnets24(spark, d):
    return prefixes.top_subnets(_prefixes(spark, d))


@query
def spray_index(spark, d):
    whole = prefixes.spray_index(_prefixes(spark, d)).select(F.lit("nested").alias("scope"), "spray_index")
    single = prefixes.spray_index(_prefixes(spark, d), mask_len=32).select(F.lit("/32").alias("scope"), "spray_index")
    return whole.unionByName(single)


# --- Count-Min --------------------------------------------------------------------------------------------------


def _cms(spark, d, spec=CmsSpec()):
    return cm.cms_build(I.flows(spark, d), net.flow_key(), "bytes", spec)


@query
def cms_build(spark, d):
    return _cms(spark, d).cells


@query
def cms_build_odd_width(spark, d):
    return _cms(spark, d, CmsSpec(1000, 3)).cells


@query
def cms_build_volume(spark, d):
    return cm.cms_build(I.volume_flows(spark, d), net.flow_key(), "bytes").cells


@query
def cms_build_metrics(spark, d):
    return cm.cms_build_metrics(I.flows(spark, d)).cells


@query
def cms_build_b(spark, d):
    return cm.cms_build(I.flows(spark, d), net.flow_id(), "bytes", B_SPEC).cells


@query
def cms_estimate(spark, d):
    return cm.cms_estimate(_cms(spark, d), cm.flow_truth(I.flows(spark, d)), "flow")


@query
def cms_merge(spark, d):
    f = I.flows(spark, d)
    part = lambda cond: cm.cms_build(f.where(cond), net.flow_key(), "bytes")
    return cm.cms_merge(part("user_id % 2 = 0"), part("user_id % 2 = 1")).cells


@query
def cms_heavy_hitters(spark, d):
    return cm.cms_heavy_hitters_all(I.flows(spark, d), 10)


@query
def cms_heavy_hitters_b(spark, d):
    f = I.with_ids(I.flows(spark, d))
    return cm.cms_heavy_hitters_b(f, cm.cms_build(f, "flow_id", "bytes", B_SPEC))


@query
def ip_statistics(spark, d):
    f = I.flows(spark, d)
    sketch = cm.cms_build_metrics(f)
    return cm.ip_statistics_both(f, sketch)


# --- HyperLogLog ------------------------------------------------------------------------------------------------


@query
def hll_registers(spark, d):
    return ll.hll_build(I.flows(spark, d), net.flow_key()).table


@query
def hll_count(spark, d):
    return ll.hll_count(ll.hll_build(I.flows(spark, d), net.flow_key()))


@query
def hll_count_volume(spark, d):
    return ll.hll_count(ll.hll_build(I.volume_flows(spark, d), net.flow_key()))


@query
def hll_count_b(spark, d):
    return ll.hll_count(ll.hll_build(I.flows(spark, d), net.flow_id(), HllSpec(12, "B")))


@query
def hll_merge(spark, d):
    f = I.flows(spark, d)
    part = lambda cond: ll.hll_build(f.where(cond), net.flow_key())
    return ll.hll_count(ll.hll_merge(part("user_id % 3 = 0"), part("user_id % 3 <> 0")))


@query
def cardinalities(spark, d):
    return ll.cardinalities(ll.dimension_registers(I.flows(spark, d)))


@query
def diversity_score(spark, d):
    return ll.diversity_score(ll.cardinalities(ll.dimension_registers(I.flows(spark, d))))


@query
def cardinality_unpivot(spark, d):
    return ll.cardinality_rows(ll.diversity_score(ll.cardinalities(ll.dimension_registers(I.flows(spark, d)))))


@query
def batch_diversity(spark, d):
    return ll.batch_diversity(I.with_ids(I.flows(spark, d)))


@query
def approx_unique_flows(spark, d):
    rows = ll.approx_unique_flows(I.flows(spark, d))
    near = lambda c: (F.abs(F.col(c) - F.col("exact")) <= 0.05 * F.col("exact")).alias(f"{c}_near")
    return rows.select("exact", near("approx_flows"), near("datasketch_flows"))


RANGE_EVERY, RANGE_MOST = 29, 500


@query
def distinct_over_ranges(spark, d):
    """Intervals of 1 to 500 hours, each starting at an event: exact counts, and whether the estimate is close enough."""
    rows = I.flows(spark, d)
    first = time_slice("ts", 3600)
    asked = rows.where(F.col("event_id") % RANGE_EVERY == 0).select(
        F.col("event_id").alias("id"), first.alias("lo"), (first + 1 + F.col("event_id") * 37 % RANGE_MOST).alias("hi"))
    ranges = ranges_of.build_ranges(rows, net.flow_key(), levels=10)
    got = ranges_of.distinct_in(ranges, asked).join(ranges_of.exact_in(rows, net.flow_key(), asked, levels=10), "id").join(asked, "id")
    near = F.abs(F.col("estimate") - F.col("exact")) <= ranges_of.relative_error(ranges.lg_k) * F.col("exact") + 1
    few = F.col("runs") <= 2 * F.ceil(F.log2(F.col("hi") - F.col("lo") + 1))
    return got.select("id", "lo", "hi", "exact", near.alias("near"), few.alias("few_runs"))


@query
def sketch_memory(spark, d):
    return ll.sketch_memory(I.flows(spark, d))


@query
def sketch_roundtrip(spark, d):
    """Both sketch kinds written, read back and queried."""
    f = I.flows(spark, d)
    path = shared_folder(spark, "sketches")
    cm.save_cms(_cms(spark, d), path, "bytes")
    ll.save_registers(ll.hll_build(f, net.flow_key()), path, "flows")
    cells = cm.load_cms(spark, path, "bytes", CmsSpec()).cells
    regs = ll.load_registers(spark, path, "flows", HllSpec())
    sums = cells.groupBy(F.concat(F.lit("cms row "), F.col("row_i").cast("string")).alias("item")).agg(
        F.sum("cnt").cast("bigint").alias("value")
    )
    return sums.unionByName(ll.hll_count(regs, "value").select(F.lit("hll flows").alias("item"), "value"))


@query
def state_roundtrip(spark, d):
    """The full state written and read back: three Count-Min sketches, five cardinalities, both keyed maps, the run."""
    f, path = I.batch_flows(spark, d), shared_folder(spark, "state")
    cm.save_cms(cm.cms_build_metrics(f), path, "cms")
    ll.save_registers(ll.dimension_registers(f), path, "dimensions")
    ll.save_registers(ll.hll_build(f, "dst_port", ll.KEYED, ("src_ip",)), path, "src_to_dst_ports")
    ll.save_registers(ll.hll_build(f, "src_ip", ll.KEYED, ("dst_port",)), path, "dst_to_src_ips")
    rollup.traffic_totals(f).write.parquet(f"{path}/metadata")
    cells = cm.load_cms(spark, path, "cms", CmsSpec()).cells
    tables = [cells.groupBy(F.concat(F.lit("cms "), "metric", F.lit(" row "), F.col("row_i").cast("string")).alias("item")).agg(
        F.sum("cnt").cast("bigint").alias("value")
    )]
    load = lambda name, spec, by: ll.load_registers(spark, path, name, spec, by)
    tables.append(ll.hll_count(load("dimensions", HllSpec(), ("dimension",)), "value").select(
        F.concat(F.lit("hll "), "dimension").alias("item"), "value"))
    for name, by in (("src_to_dst_ports", "src_ip"), ("dst_to_src_ips", "dst_port")):
        tables.append(ll.hll_count(load(name, ll.KEYED, (by,)), "value").select(
            F.concat(F.lit(f"{name} "), F.col(by).cast("string")).alias("item"), "value"))
    run = spark.read.parquet(f"{path}/metadata")
    tables.append(run.unpivot([], ["flows_processed", "batches_processed"], "item", "value"))
    return reduce(DataFrame.unionByName, tables)


# --- detectors --------------------------------------------------------------------------------------------------


@query
def port_scanners(spark, d):
    return detect.port_scanners(I.flows(spark, d), 20)


@query
def port_scanners_hll(spark, d):
    return detect.port_scanners_hll(I.flows(spark, d), 20)


@query
def port_scanners_volume(spark, d):
    return detect.port_scanners(I.volume_flows(spark, d))


@query
def popular_services(spark, d):
    return detect.popular_services(I.flows(spark, d))


@query
def popular_services_hll(spark, d):
    return detect.popular_services_hll(I.flows(spark, d))


# --- sources ----------------------------------------------------------------------------------------------------


@query
def src_flow_batches(spark, d):
    """Flow-batch files written as JSON lines and read back; copies are kept."""
    path = shared_folder(spark, "flow-batches")
    I.flow_documents(spark, d).write.text(path)
    return flow_batches.explode_batches(flow_batches.read_flow_batches(spark, path))


@query
def dedup_batches(spark, d):
    docs = flow_batches.dedup_batches(flow_batches.parse_flow_batches(I.flow_documents(spark, d)))
    return flow_batches.explode_batches(docs).select("agent", "batch_ts", "src_ip", "dst_ip", "bytes")


@query
def src_counter_snapshots(spark, d):
    return snapshots.decode_counter_dumps(I.counter_dumps(spark, d).drop("part"))


@query
def src_telemetry(spark, d):
    p = telemetry.parse_telemetry(I.telemetry_lines(spark, d))
    return telemetry.heavy_flow_rows(
        p.select("agent_ip", "timestamp", "agent_cpu", "total_bytes", "unique_flows", "heavy_flows"), keep_idle=True
    )


@query
def decode_frames(spark, d):
    return frame_source.decode_frames(I.frames(spark, d))


@query
def decode_frames_v6(spark, d):
    return frame_source.decode_frames(I.frames(spark, d), "v4v6_tcpudp")


@query
def packet_rollup(spark, d):
    return rollup.packet_rollup(frame_source.decode_frames(I.frames(spark, d)))


def _peer_docs(spark, d):
    return summaries.latest_per_peer(summaries.parse_peer_summaries(I.peer_documents(spark, d)))


@query
def latest_summary_per_peer(spark, d):
    docs = _peer_docs(spark, d)
    return docs.groupBy("peer", "file_ts").agg(
        F.max("flows_processed").alias("flows_processed"),
        F.max("cms.total_bytes").alias("total_bytes"),
        F.count(F.lit(1)).alias("parts"),
    )


@query
def peer_consolidation(spark, d):
    return peers.peer_consolidation(_peer_docs(spark, d))


@query
def peer_view(spark, d):
    return peers.peer_consolidation(summaries.select_peers(_peer_docs(spark, d), "peer2"))


@query
def peer_union(spark, d):
    return peers.peer_union(I.flows(spark, d).withColumn("peer", F.expr(I.PEER)))


@query
def scanner_rollcall(spark, d):
    return peers.scanner_rollcall(_peer_docs(spark, d))


@query
def top_flows_across_peers(spark, d):
    return peers.top_flows_across_peers(summaries.heavy_hitter_rows(_peer_docs(spark, d)))


@query
def ddos_victims(spark, d):
    return peers.ddos_victims(summaries.heavy_hitter_rows(_peer_docs(spark, d)), 3)


# --- expressions ------------------------------------------------------------------------------------------------


@query
def anonymize_ips(spark, d):
    f = I.flows(spark, d)
    hide = lambda c: net.anonymize_ip(F.col(c), HMAC_KEY).alias(c)
    return f.select("event_id", hide("src_ip"), hide("dst_ip"), "bytes")


@query
def anonymized_totals(spark, d):
    f = I.flows(spark, d)
    return f.groupBy(net.anonymize_ip(F.col("src_ip"), HMAC_KEY).alias("src")).agg(F.sum("bytes").alias("bytes"))


@query
def parse_flow_key(spark, d):
    """Endpoints of good, IPv6 and malformed keys."""
    key = (
        F.when(F.col("event_id") % 10 == 1, F.concat(F.lit("2001:db8::"), F.col("user_id"), F.lit(":443->2001:db8::1:80/TCP")))
        .when(F.col("event_id") % 10 == 2, F.col("src_ip"))
        .otherwise(net.flow_key())
    )
    f = I.flows(spark, d).withColumn("flow", key)
    src, dst = net.flow_key_endpoints(F.col("flow"))
    return f.select("event_id", "flow", src.alias("src"), dst.alias("dst"))


@query
def ip_convert(spark, d):
    """Good addresses, five octets, and an octet above 255."""
    kind = F.col("event_id") % 9
    text = F.when(kind == 0, F.concat(F.col("dst_ip"), F.lit(".9"))).when(kind == 1, F.lit("172.16.0.256")).otherwise(F.col("dst_ip"))
    f = I.flows(spark, d).select("event_id", text.alias("ip")).withColumn("ip_long", net.ipv4_to_long(F.col("ip")))
    v = F.col("ip_long")
    return f.select("event_id", "ip", "ip_long", net.long_to_ipv4(v).alias("dotted"), net.cidr(v, 24).alias("cidr24"),
                    net.cidr(v, 12).alias("cidr12"))


@query
def format_units(spark, d):
    big = F.col("bytes") * F.when(F.col("event_id") % 3 == 0, 1).when(F.col("event_id") % 3 == 1, 1000).otherwise(1000000)
    f = I.flows(spark, d).select("event_id", big.alias("b"), (F.col("bytes") / 8).alias("m"))
    return f.select("event_id", labels.bytes_label(F.col("b")).alias("bytes_label"), labels.mbps_label(F.col("m")).alias("mbps_label"))


@query
def cpu_ceiling(spark, d):
    f = I.flows(spark, d).select("agent_id", "poll_id", (F.col("k") * F.col("poll_id") / 60).alias("cpu"))
    return f.groupBy("agent_id", "poll_id").agg(F.max("cpu").alias("m")).select(
        "agent_id", "poll_id", labels.axis_ceiling(F.col("m")).alias("ceiling")
    )


# --- time series ------------------------------------------------------------------------------------------------


@query
def counter_deltas(spark, d):
    return series.counter_deltas(I.snapshots(spark, d))


@query
def live_rate(spark, d):
    f = I.flows(spark, d).select("event_id", F.col("live_ts").alias("ts"), "bytes")
    return series.live_rate(f).select("event_id", "rate", "mbps")


@query
def live_rate_ticks(spark, d):
    """Two-hour rates at every full hour, idle hours too."""
    return series.live_rate_ticks(I.flows(spark, d).select("ts", "bytes"), seconds=7200, step=3600)


@query
def rolling_baseline(spark, d):
    return series.rolling_baseline(I.ticks(spark, d), ["mbps", "spray"]).select("tenant", "ts", "mbps_p95", "spray_p95")


@query
def lowslow_score(spark, d):
    return series.lowslow_score(I.ticks(spark, d)).select("tenant", "ts", "score", "label")


@query
def carry_forward(spark, d):
    f = I.flows(spark, d)
    values = {
        "last_flow_bytes": F.when(F.col("event_type") != "view", F.col("bytes")),
        "last_unique": F.when(F.col("k") > 90, F.col("k")),
    }
    out = series.carry_forward(f.select("event_id", "ts", "event_type", "bytes", "k"), values, order=("event_id",))
    return out.select("event_id", "last_flow_bytes", "last_unique")


@query
def carry_forward_by_agent(spark, d):
    f = I.flows(spark, d).select("event_id", "ts", "agent_id", "event_type", "bytes")
    values = {"last_signup_bytes": F.when(F.col("event_type") == "signup", F.col("bytes"))}
    out = series.carry_forward(f, values, by=("agent_id",), order=("event_id",))
    return out.select("event_id", "agent_id", "last_signup_bytes")


def _drop_polls(spark, d):
    hourly = _applied(spark, d).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(
        F.count_if("dropped").alias("n")
    )
    total = series.sliced_running_sum(hourly, [], "ts", "n", "drops_total", seconds=24 * 3600)
    return total.select("ts", F.col("drops_total").cast("bigint").alias("drops_total"))


@query
def drops_rate(spark, d):
    return series.drops_rate(_drop_polls(spark, d))


@query
def bounded_history(spark, d):
    f = I.flows(spark, d).select("event_id", "ts", "agent_id", "bytes")
    whole = series.bounded_history(f, 60, order=("event_id",)).select(F.lit("all").alias("scope"), "event_id", "bytes")
    each = series.bounded_history(f, 120, by=("agent_id",), order=("event_id",))
    return whole.unionByName(each.select(F.col("agent_id").alias("scope"), "event_id", "bytes"))


@query
def metric_scrape(spark, d):
    f = I.flows(spark, d).select(
        F.lit("agent_cpu").alias("metric"), F.col("agent_id").alias("label"), F.col("live_ts").alias("ts"),
        (F.col("k") + 0.5).cast("double").alias("value"),
    )
    return series.metric_scrape(f)


@query
def metric_series(spark, d):
    return I.counter_samples(spark, d)


@query
def metric_rate_1m(spark, d):
    return series.metric_rate(I.counter_samples(spark, d), 60)


@query
def metric_rate_1h(spark, d):
    return series.metric_rate(I.counter_samples(spark, d), 3600)


@query
def topk_dest_rate(spark, d):
    return series.topk_rate(series.step_rates(I.counter_samples(spark, d, ["dest_bytes"]), 3600, 900), 5)


@query
def topk_port_rate(spark, d):
    return series.topk_rate(series.step_rates(I.counter_samples(spark, d, ["port_bytes"]), 3600, 900), 10)


@query
def protocol_rate(spark, d):
    return series.step_rates(I.counter_samples(spark, d, ["protocol_bytes"]), 60, 15)


@query
def resample_linear(spark, d):
    samples = I.scenario_samples(spark, d).select(F.col("scenario").alias("series"), "idx", "value")
    return series.resample_linear(samples, 30)


@query
def agent_cpu_history(spark, d):
    f = I.flows(spark, d).select("agent_id", "ts", F.col("event_id").alias("seq"), (F.col("k") + 0.5).cast("double").alias("cpu"))
    return series.agent_cpu_history(f)


# --- policy -----------------------------------------------------------------------------------------------------


def _rules(spark, d):
    return policy.normalize_policy_events(I.policy_events(spark, d))


def _applied(spark, d):
    traffic = I.flows(spark, d).select("event_id", "ts", "src_ip", "bytes")
    return policy.policy_apply(traffic, _rules(spark, d))


@query
def normalize_policy_events(spark, d):
    return _rules(spark, d)


@query
def policy_apply(spark, d):
    return _applied(spark, d).select("event_id", "dropped")


@query
def policy_dropped(spark, d):
    return policy.policy_dropped(_applied(spark, d))


@query
def policy_passed(spark, d):
    return policy.policy_passed(_applied(spark, d))


@query
def policy_drops_total(spark, d):
    return policy.policy_drops_total(_applied(spark, d))


@query
def active_rules(spark, d):
    """Rules in force when the newest block rule was an hour from its end, and at its very end."""
    rules = _rules(spark, d)
    newest = rules.where("expiry IS NOT NULL").agg(F.max(F.struct("expiry", "ts")).alias("r")).first().r
    if newest is None:
        return policy.active_rules(rules, I.ASOF).select(F.lit("").alias("moment"), "*")
    asof = {"start": newest.ts, "end": newest.expiry}
    parts = [policy.active_rules(rules, v).select(F.lit(k).alias("moment"), "*") for k, v in asof.items()]
    return reduce(DataFrame.unionByName, parts)


# --- documents and scenarios ------------------------------------------------------------------------------------


@query
def summary_document(spark, d):
    return report.summary_document(I.flows(spark, d), I.ASOF, private=False)


@query
def summary_record(spark, d):
    return report.summary_record(I.batch_flows(spark, d), I.ASOF, I.STARTED, private=False)


@query
def agent_gauges(spark, d):
    return report.agent_gauges(I.payloads(spark, d))


@query
def agent_payload(spark, d):
    p = I.payloads(spark, d)
    listed = F.transform("heavy_flows", lambda f: F.concat_ws(
        "|", f["src_ip"], f["dst_ip"], f["proto"], f["src_port"].cast("string"), f["dst_port"].cast("string"),
        f["bytes"].cast("string")))
    return p.select("agent_id", "poll_id", "agent_cpu", "flows_processed", "total_bytes", "total_packets",
                    "unique_src_ips", "unique_src_ports", "unique_dst_ports", "unique_flows", "diversity_score",
                    F.array_join(listed, " ").alias("heavy_flows"))


@query
def push_document(spark, d):
    return report.push_document(I.payloads(spark, d), _prefixes(spark, d))


@query
def scenario_compare(spark, d):
    return scenario.scenario_compare(scenario.scenario_stats(I.scenario_samples(spark, d)), "Baseline")


# --- streams ----------------------------------------------------------------------------------------------------


FILES = 4
ROWS_PER_FILE = 1_000_000


def _stream(spark, d, name="events"):
    """The table as a stream of several files, one per micro-batch; rows of a file are spread over the whole time."""
    sinks.use_rocksdb(spark)
    source = shared_folder(spark, f"stream-{name}")
    rows = I.table(spark, d, name)
    rows.repartition(FILES, F.col(rows.columns[0]) % FILES).write.parquet(source)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)


def _event_stream(spark, d):
    return I.event_flows(_stream(spark, d))


LATE = "10 seconds"


def _in_time_order(spark, rows, ts):
    """``rows`` as a stream of micro-batches that follow each other in time, as they would arrive."""
    sinks.use_rocksdb(spark)
    source = shared_folder(spark, "arrivals")
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    span = rows.agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count("*").alias("n")).first()
    part = F.coalesce(F.floor((at - (span.lo or 0)) * FILES / ((span.hi or 0) - (span.lo or 0) + 1)), F.lit(0))
    files = 1 + span.n // (FILES * ROWS_PER_FILE)  # of each part: a micro-batch takes exactly one part
    for i in range(FILES):
        rows.where(part == i).repartition(files).write.mode("append").parquet(source)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(source)


def _current(spark, stream, name, keys):
    """The newest row of each key once the stream has run."""
    folder = shared_folder(spark, name)
    sinks.run_available(stream, folder, "update", keys=keys)
    return sinks.read_latest(spark, folder, keys)


@query
def stream_flow_windows(spark, d):
    """Every window aligned to the epoch, those that are open at the end too."""
    windows = st.flow_windows(_in_time_order(spark, I.flows(spark, d), "ts"), late=LATE)
    return _current(spark, windows, "flow-windows", ["window_start", "window_end", "agent_id", *rollup.FIVE_TUPLE])


@query
def stream_hhh(spark, d):
    latest = _current(spark, st.heavy_prefix_sums(_event_stream(spark, d), THRESHOLD), "hhh", ["mask_len", "network"])
    return prefixes.name_prefixes(latest).drop("mask_len")


@query
def stream_sketches(spark, d):
    """The three Count-Min sketches and the five cardinality sketches of everything seen so far."""
    f = _event_stream(spark, d)
    cells = _current(spark, st.sketch_metric_cells(f), "cms", ["metric", "row_i", "col_j"])
    registers = _current(spark, st.sketch_dimension_registers(f), "hll", ["dimension", "register"])
    return cells.select(F.col("metric").alias("sketch"), "row_i", "col_j", F.col("cnt").alias("value")).unionByName(
        registers.select(F.col("dimension").alias("sketch"), F.lit(0).alias("row_i"), F.col("register").alias("col_j"),
                         F.col("rho").cast("bigint").alias("value"))
    )


@query
def stream_rate(spark, d):
    messages = I.flows(spark, d).select(F.col("live_ts").alias("ts"), "bytes")
    rates = st.sliding_rate(_in_time_order(spark, messages, "ts"), late=LATE)
    return _current(spark, rates, "rate", ["window_start", "window_end"])


@query
def stream_agent_state(spark, d):
    f = _event_stream(spark, d).select(
        "agent_id", F.struct("ts", "event_id").alias("at"), (F.col("k") + 0.5).cast("double").alias("cpu"), "bytes"
    )
    state = _current(spark, st.agent_state(f, ts="at", values=("cpu", "bytes")), "agents", ["agent_id"])
    return state.select("agent_id", "cpu", "bytes", F.col("last_ts.ts").alias("last_ts"))


@query
def stream_gauges(spark, d):
    """Payloads arrive as a stream; the newest value of each gauge and agent stays."""
    source = shared_folder(spark, "payloads")
    rows = I.payloads(spark, d).select("agent_id", "poll_id", "agent_cpu", "unique_flows", "unique_src_ips")
    rows.repartition(FILES, "poll_id").write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    state = st.agent_state(stream, ts="poll_id", values=("agent_cpu", "unique_flows", "unique_src_ips"))
    latest = _current(spark, state, "gauges", ["agent_id"])
    return report.gauge_rows(latest, ts="last_ts").drop("ts")


@query
def stream_counters(spark, d):
    return _current(spark, st.counters(_event_stream(spark, d)), "counters", ["metric", "label"])


@query
def stream_policy(spark, d):
    """Rules are appended by one stream; traffic micro-batches are matched against that table."""
    rules_at, out = shared_folder(spark, "rules"), shared_folder(spark, "policy")
    events = _event_stream(spark, d)
    rules = policy.normalize_policy_events(events.where(I.POLICY_CHOICE).selectExpr(*I.POLICY_EVENTS))
    sinks.run_available(st.sliced_rules(rules), rules_at, "append", partition_by=["rule_day"])
    traffic = events.select("event_id", "ts", "src_ip", "bytes")
    sinks.run_available(traffic, out, "append", st.policy_batch(rules_at, rules.schema))
    return sinks.read_all(spark, out).select("event_id", "dropped")


@query
def stream_dedup(spark, d):
    """Documents arrive in several files, some twice; whole documents are dropped, then flows exploded."""
    folder = shared_folder(spark, "dedup")
    timed = lambda lines: flow_batches.parse_flow_batches(lines).withColumn(
        "at", F.timestamp_seconds(F.col("timestamp") + 86400)
    )
    lines = I.flow_documents(spark, d)
    stamp = F.regexp_extract("value", '"timestamp":([0-9]+)', 1).cast("bigint")
    arrived = _in_time_order(spark, lines.withColumn("sent", F.timestamp_seconds(stamp)), "sent").drop("sent")
    docs = timed(arrived)
    sinks.run_available(flow_batches.explode_batches(st.new_batches(docs, "at", late=LATE)), folder, "append")
    return sinks.read_all(spark, folder).select("agent", "batch_ts", "src_ip", "dst_ip", "bytes")


@query
def stream_deltas(spark, d):
    """Snapshots of a poll arrive over three days, mixed with those of the polls around it."""
    folder, day = shared_folder(spark, "deltas"), 86400
    polled = I.snapshots(spark, d).withColumn("polled", F.timestamp_seconds(F.col("poll_id") * day))
    sent = F.timestamp_seconds((F.col("poll_id") + F.pmod(F.hash("src_ip"), F.lit(3))) * day)
    arrived = _in_time_order(spark, polled.withColumn("sent", sent), "sent")
    deltas = stream_deltas_op.stream_deltas(arrived, "polled", late="4 days", keep_ms=2 * day * 1000, polls=40)
    sinks.run_available(deltas, folder, "update", keys=[*stream_deltas_op.KEYS, "poll_id"])
    return stream_deltas_op.read_deltas(spark, folder)


@query
def stream_rule_expiry(spark, d):
    """Rules that have ended by the time the stream has reached: the newest event less the lateness."""
    folder = shared_folder(spark, "rule-ends")
    rules = policy.normalize_policy_events(I.policy_events(spark, d))
    sinks.run_available(rule_state.rule_ends(_in_time_order(spark, rules, "ts"), late=LATE), folder, "append")
    return sinks.read_all(spark, folder)


@query
def flow_windows_anchored(spark, d):
    return anchors.anchored_windows(I.flows(spark, d), ts="live_ts")


@query
def stream_flow_windows_anchored(spark, d):
    """In time order; a window that spans micro-batches is carried over, those open at the end are flushed."""
    folder = shared_folder(spark, "anchored")
    flows = _in_time_order(spark, I.flows(spark, d), "live_ts")
    sinks.run_available(flows, folder, "append", anchored.anchored_batch(folder, ts="live_ts"))
    return anchored.read_anchored(spark, folder)


@query
def stream_reports(spark, d):
    """A report after each of the micro-batches, and the final one."""
    folder = shared_folder(spark, "reports")
    sinks.run_available(_in_time_order(spark, I.flows(spark, d), "ts"), folder, "append", reports.report_batch(folder))
    return reports.read_reports(spark, folder)


@query
def stream_counter_dumps(spark, d):
    """Dumps dropped into a folder; the stream stops, more come (some again under new names), and it goes on."""
    folder, inbox = shared_folder(spark, "dump-entries"), shared_folder(spark, "dumps")
    sinks.use_rocksdb(spark)
    dumps = I.counter_dumps(spark, d).select(F.col("dump").alias("value"), "agent_id", "poll_id", (F.col("poll_id") * 86400).alias("polled"), "part")
    for arrived in ("poll_id <= 15", "poll_id >= 13"):
        dumps.where(arrived).write.mode("append").partitionBy("agent_id", "poll_id", "polled", "part").text(inbox)
        entries = dump_stream.stream_counter_dumps(spark, inbox, per_trigger=40, late="20 days")
        sinks.run_available(entries, folder, "append")
    return sinks.read_all(spark, folder)


@query
def stream_metric_sink(spark, d):
    """Rates over the steps that the stream has written: all buckets closed by the end."""
    folder, keys = shared_folder(spark, "metric-steps"), ("metric", "label", "run")
    usable = I.flows(spark, d).where("dst_ip <> '' AND bytes > 0").withColumn("run", F.col("poll_id") >= I.RESTART_POLL)
    arrived = _in_time_order(spark, usable, "ts")
    steps = metric_sink.counter_steps(rollup.counter_rows(arrived, "ts", "run"), LATE, keys)
    metric_sink.append_steps(steps, folder, keys).awaitTermination()
    return series.metric_rate(metric_sink.read_counters(spark, folder, epoch=("run",)), 60)


@query
def stream_push(spark, d):
    """Each payload is pushed as a document of its own."""
    folder, source = shared_folder(spark, "push"), shared_folder(spark, "pushed-payloads")
    rows = I.payloads(spark, d)
    rows.repartition(FILES, "poll_id").write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    push.push(report.payload_documents(stream), folder).awaitTermination()
    return push.read_pushed(spark, folder).select(F.lit("payload").alias("part"), "document")


LOSSY_COUNTERS, HEAVY_SHARE = 200, 50


@query
def stream_hhh_bounded(spark, d):
    """Exact prefixes with a fiftieth of all bytes beside what 200 counters per level know of them."""
    folder, flows = shared_folder(spark, "lossy"), I.flows(spark, d)
    sinks.run_available(_in_time_order(spark, flows, "ts"), folder, "append", lossy.lossy_batch(folder, LOSSY_COUNTERS))
    total = flows.where("bytes > 0").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first().n
    known = lossy.read_counters(spark, folder).withColumn("bytes", F.struct("low", "high"))
    known = prefixes.name_prefixes(known).select("prefix", "bytes.low", "bytes.high")
    exact = prefixes.hhh_prefixes(flows, -(-total // HEAVY_SHARE))
    small = (F.col("high") - F.col("low")) * (LOSSY_COUNTERS + 1) <= total
    return exact.join(known, "prefix", "left").select(
        "prefix", "bytes", F.col("low").isNotNull().alias("found"), F.col("bytes").between(F.col("low"), F.col("high")).alias("bounded"), small.alias("small_error"))
