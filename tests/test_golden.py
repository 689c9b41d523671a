"""Hand-worked fixtures and published example values."""

import datetime as dt
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from flowscope.functions import hashing, net
from flowscope.functions.frames import ipv6_text
from flowscope.functions.hashing import CmsSpec, HllSpec
from flowscope.operators import countmin as cm
from flowscope.operators import detect, peers, policy, prefixes, report, rollup, scenario, series
from flowscope.operators import loglog as ll
from flowscope.sources import flow_batches, frames, snapshots, summaries, telemetry

FLOW_COLS = "src_ip string, dst_ip string, src_port int, dst_port int, proto string, packets bigint, bytes bigint"
NOISE = [("192.168.1.1", "10.0.0.1", 500000000), ("192.168.1.2", "10.0.0.2", 100), ("192.168.1.3", "10.0.0.3", 100),
         ("192.168.1.4", "10.0.0.4", 100), ("192.168.1.5", "172.16.0.1", 500)]


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def three_flows(spark):
    return spark.createDataFrame(
        [("192.168.1.10", "8.8.8.8", 54321, 443, "TCP", 100, 50000), ("192.168.1.10", "1.1.1.1", 54322, 443, "TCP", 50, 25000),
         ("192.168.1.20", "8.8.8.8", 60000, 53, "UDP", 10, 1000)], FLOW_COLS)


@pytest.fixture(scope="module")
def scan(spark):
    normal = [(f"192.168.1.{10 + i % 20}", f"8.8.8.{i % 10}", 50000 + i, 443, "TCP", 50, 25000) for i in range(100)]
    probe = [("10.0.0.66", "192.168.1.100", 60000, port, "TCP", 1, 64) for port in range(1, 101)]
    return spark.createDataFrame(normal + probe, FLOW_COLS)


def test_one_heavy_hitter(spark):
    flows = spark.createDataFrame(NOISE, "src_ip string, dst_ip string, bytes bigint")
    got = rows(prefixes.hhh_prefixes(flows, 5000), "prefix", "parent", "bytes")
    assert got == sorted([
        ("0.0.0.0/0", "", 500000800), ("10.0.0.0/8", "0.0.0.0/0", 500000300), ("10.0.0.0/16", "10.0.0.0/8", 500000300),
        ("10.0.0.0/24", "10.0.0.0/16", 500000300), ("10.0.0.1/32", "10.0.0.0/24", 500000000)])


def test_invalid_addresses_are_left_out_of_prefixes(spark):
    bad = [("a", ip, 9000) for ip in ("10.0.0.256", "10.1", "0x0a.0.0.1", "010.0.0.1", "", "::1")]
    flows = spark.createDataFrame(NOISE + bad, "src_ip string, dst_ip string, bytes bigint")
    assert prefixes.hhh_prefixes(flows, 5000).count() == 5


def test_count_min_example(three_flows):
    sketch = cm.cms_build_metrics(three_flows)
    top = cm.cms_heavy_hitters(three_flows, sketch, 3)
    assert [r.estimate for r in top.collect()] == [50000, 25000, 1000]
    stats = {r.ip: r for r in cm.ip_statistics(three_flows, sketch).collect()}
    assert stats["192.168.1.10"].bytes_estimate == stats["192.168.1.10"].bytes == 75000
    assert (stats["192.168.1.10"].packets, stats["192.168.1.10"].flows) == (150, 2)
    assert cm.cms_mass(cm.metric_sketch(sketch, "bytes")).first().mass == 228000
    assert ll.sketch_memory(three_flows).first().cms_bytes == 245760


def test_both_ways_of_a_point_query_agree(spark, three_flows):
    sketch = cm.cms_build(three_flows, net.flow_key(), "bytes", CmsSpec(64, 3))
    keys = three_flows.select(net.flow_key().alias("flow"))
    odd = spark.createDataFrame([(None,), (None,), ("missing",), ("",)], "flow string")
    keys = keys.union(keys).union(odd)
    near = sorted(map(repr, cm.cms_estimate(sketch, keys, "flow").select("flow", "estimate").collect()))
    joined = sorted(map(repr, cm.cms_estimate(sketch, keys, "flow", dense=False).select("flow", "estimate").collect()))
    assert joined == near and len(near) == keys.count()


def test_sketch_invariants(scan):
    spec = CmsSpec(16, 4)
    sketch = cm.cms_build(scan, net.flow_key(), "bytes", spec)
    total = scan.agg(F.sum("bytes")).first()[0]
    sums = {r[1] for r in sketch.cells.groupBy("row_i").sum("cnt").select("row_i", "sum(cnt)").collect()}
    assert sums == {total}
    est = cm.cms_estimate(sketch, cm.flow_truth(scan), "flow")
    assert est.where("estimate < bytes").count() == 0


def test_merging(scan):
    a, b = scan.where("dst_port < 50"), scan.where("dst_port >= 50")
    whole = cm.cms_build(scan, net.flow_key(), "bytes").cells
    merged = cm.cms_merge(*[cm.cms_build(x, net.flow_key(), "bytes") for x in (a, b)]).cells
    assert rows(whole, *whole.columns) == rows(merged, *whole.columns)
    regs = ll.hll_build(scan, net.flow_key())
    united = ll.hll_merge(*[ll.hll_build(x, net.flow_key()) for x in (a, b)])
    assert rows(regs.table, "register", "rho") == rows(united.table, "register", "rho")
    with pytest.raises(ValueError):
        cm.cms_merge(cm.cms_build(a, "src_ip", "bytes"), cm.cms_build(b, "src_ip", "bytes", CmsSpec(1024)))
    with pytest.raises(ValueError):
        ll.hll_merge(ll.hll_build(a, "src_ip"), ll.hll_build(b, "src_ip", HllSpec(12)))
    with pytest.raises(ValueError):
        ll.hll_build(a, "src_ip", HllSpec(3))


def test_loading_a_sketch_of_another_shape_fails(spark, scan, tmp_path):
    cm.save_cms(cm.cms_build(scan, net.flow_key(), "bytes"), str(tmp_path), "x")
    with pytest.raises(Exception, match="another shape"):
        cm.load_cms(spark, str(tmp_path), "x", CmsSpec(1024)).cells.agg(F.sum("cnt")).collect()


def test_port_scan(scan):
    cards = ll.diversity_score(ll.cardinalities(ll.dimension_registers(scan))).first()
    assert (cards.unique_src_ips, cards.unique_dst_ips, cards.unique_src_ports, cards.unique_dst_ports, cards.unique_flows) == (
        21, 11, 101, 101, 200)
    assert cards.diversity_score == pytest.approx(0.08)
    assert rows(detect.port_scanners(scan, 20), "src_ip", "unique_ports") == [("10.0.0.66", 100)]
    assert rows(detect.port_scanners_hll(scan, 20), "src_ip", "unique_ports") == [("10.0.0.66", 101)]
    assert tuple(detect.popular_services_hll(scan, 1).first()) == (443, 20)
    assert ll.sketch_memory(scan).first().hll_bytes == 581632
    assert ll.hll_count(ll.hll_build(scan.limit(0), "src_ip")).first().estimate == 0


def test_hash_positions(spark):
    keys = ["a", "src:10.0.0.1", "k9"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    out = df.select("k", hashing.cms_column(F.col("k"), 2, CmsSpec(1000)).alias("odd"),
                    hashing.cms_column(F.col("k"), 2, CmsSpec(2048)).alias("two"),
                    hashing.cms_column(F.col("k"), 2, CmsSpec(2048, 5, "B")).alias("b"),
                    hashing.hll_word(F.col("k"), HllSpec(12, "B")).alias("w")).collect()
    for r in out:
        wide = int(hashlib.md5(f"{r.k}2".encode()).hexdigest(), 16)
        assert (r.odd, r.two) == (wide % 1000, wide % 2048)
        assert r.b == int.from_bytes(hashlib.md5(f"{r.k}202".encode()).digest()[:4], "little") % 2048
        assert r.w % 2**64 == int.from_bytes(hashlib.sha1(r.k.encode()).digest()[:8], "little")


def test_anonymisation_equals_hmac(spark):
    ips = ["10.0.0.1", "2001:db8::1", ""]
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    for key in ("k", "x" * 100):
        got = {r.ip: r.h for r in df.select("ip", net.anonymize_ip(F.col("ip"), key).alias("h")).collect()}
        assert got == {i: hmac.new(key.encode(), i.encode(), hashlib.sha256).hexdigest()[:16] for i in ips}
    assert df.select(net.anonymize_ip(F.lit("10.0.0.1"), "k")).first()[0] == "eec09bde120b24cb"
    with pytest.raises(ValueError):
        net.anonymize_ip(F.col("ip"), "")


def test_ipv6_text(spark):
    import ipaddress

    cases = ["::", "::1", "2001:db8::1", "2001:db8:0:1:1:1:1:1", "1:0:0:2::3", "1::2:0:0:3:4", "1:0:2::3:4:5", "fe80::a:b:c:d", "1:2:3:4:5:6:7:8"]
    data = [(ipaddress.IPv6Address(c).packed.hex(), c) for c in cases]
    data += [("0" * 20 + "ffff0a000001", "::ffff:10.0.0.1"), ("0" * 24 + "0a000001", "::10.0.0.1")]
    df = spark.createDataFrame(data, "d string, want string")
    for r in df.select("want", ipv6_text(F.col("d")).alias("got")).collect():
        assert r.got == r.want


def test_counter_delta_cases(spark):
    key = ("a", "1.1.1.1", "2.2.2.2", "TCP", 1, 2)
    polls = [(1, 100, 10), (2, 150, 12), (3, 150, 13), (4, 40, 4), (6, 90, 9)]
    flows = [(*key, p, b, n) for p, b, n in polls] + [("b", *key[1:], p, b, n) for p, b, n in [(511, 10, 1), (512, 15, 2)]]
    snaps = spark.createDataFrame(flows, "agent_id string, src_ip string, dst_ip string, proto string, src_port int, dst_port int, "
                                         "poll_id bigint, total_bytes bigint, total_packets bigint")
    got = rows(series.counter_deltas(snaps), "agent_id", "poll_id", "bytes", "packets")
    assert got == [("a", 1, 100, 10), ("a", 2, 50, 2), ("a", 4, 40, 4), ("a", 6, 90, 9), ("b", 511, 10, 1), ("b", 512, 5, 1)]


def test_encoded_counters(spark):
    key = ["0a", "0x00", "00", "01", "AC", "10", "00", "02", "35", "d4", "bb", "01", "06", "00", "00", "00"]
    val = ["e8", "03"] + ["00"] * 6 + ["05"] + ["00"] * 7
    import json

    docs = [json.dumps([{"key": key, "value": val}, {"key": key[:15], "value": val}, {"key": key, "value": val[:3]},
                        {"key": ["zz"] + key[1:], "value": val}]),
            json.dumps([{"key": [int(k, 16) for k in key], "value": " ".join(val)}]), "not json"]
    df = snapshots.decode_counter_dumps(spark.createDataFrame([(d,) for d in docs], "dump string"))
    ok = ("10.0.0.1", "172.16.0.2", 54325, 443, "TCP")
    assert rows(df, *df.columns) == sorted([(*ok, 1000, 5), (*ok, 0, 0), (*ok, 1000, 5)])


def _frame(proto=6, ihl=5, l4=b"\x1f\x90\x01\xbb" + b"\0" * 16, ethertype=b"\x08\x00"):
    head = bytes([0x40 + ihl]) + b"\0" * 8 + bytes([proto]) + b"\0\0" + bytes([10, 0, 0, 1, 10, 0, 0, 2]) + b"\0" * (4 * max(ihl - 5, 0))
    return b"\0" * 12 + ethertype + head + l4


def test_frames(spark):
    v6 = b"\0" * 12 + b"\x86\xdd" + b"\x60" + b"\0" * 5 + b"\x11\x40" + bytes(15) + b"\1" + bytes(15) + b"\2" + b"\0\x35\0\x36" + b"\0" * 4
    cases = {1: _frame(), 2: _frame(17, l4=b"\0\x35\0\x36" + b"\0" * 4), 3: _frame(1), 4: _frame(ihl=6), 5: _frame(l4=b"\0\1\0\2"),
             6: v6, 7: _frame(ethertype=b"\x08\x06"), 8: _frame(ihl=4), 9: b"\0" * 20}
    df = spark.createDataFrame([(i, bytearray(f)) for i, f in cases.items()], "id int, frame binary")
    got = {r.id: tuple(r)[1:] for r in frames.decode_frames(df).collect()}
    ends = ("10.0.0.1", "10.0.0.2")
    assert got == {1: (*ends, 8080, 443, "TCP"), 2: (*ends, 53, 54, "UDP"), 3: (*ends, 0, 0, "1"), 4: (*ends, 8080, 443, "TCP"),
                   5: (*ends, 0, 0, "TCP")}
    both = {r.id: tuple(r)[1:] for r in frames.decode_frames(df, "v4v6_tcpudp").collect()}
    assert set(both) == {1, 2, 4, 5, 6} and both[6] == ("::1", "::2", 53, 54, "UDP")


def test_blocklist_edges(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 10) + dt.timedelta(seconds=s)
    events = [(t(0), 1, "block", "src_ip", "1.1.1.1", 60), (t(100), 2, "block", None, "1.1.1.1", 0), (t(200), 3, "block", None, "2.2.2.2", 9999),
              (t(300), 4, "unblock", None, "2.2.2.2", None), (t(0), 5, "block", "dst_ip", "3.3.3.3", 60), (t(0), 6, "block", None, "bad", 60),
              (t(0), 7, "block", None, "4.4.4.4", None), (t(10), 8, "block", None, "4.4.4.4", 3600), (t(20), 9, "block", None, "4.4.4.4", 5)]
    rules = policy.normalize_policy_events(
        spark.createDataFrame(events, "ts timestamp_ntz, seq bigint, action string, match string, ip string, ttl_s bigint"))
    assert {r.seq: r.ttl_s for r in rules.collect()} == {1: 60, 2: 1, 3: 3600, 4: None, 7: 60, 8: 3600, 9: 5}
    hits = [("1.1.1.1", -1, False), ("1.1.1.1", 0, True), ("1.1.1.1", 60, True), ("1.1.1.1", 61, False), ("1.1.1.1", 101, True),
            ("1.1.1.1", 102, False), ("2.2.2.2", 299, True), ("2.2.2.2", 300, False), ("3.3.3.3", 1, False), ("5.5.5.5", 1, False),
            ("4.4.4.4", 22, True), ("4.4.4.4", 26, False), ("4.4.4.4", 15, True)]
    traffic = spark.createDataFrame([(ip, t(s), want) for ip, s, want in hits], "src_ip string, ts timestamp_ntz, want boolean")
    out = policy.policy_apply(traffic, rules)
    assert out.count() == len(hits) and out.where("dropped <> want").count() == 0
    assert policy.policy_drops_total(out).first()[0] == sum(w for *_, w in hits)
    live = policy.active_rules(rules, "2024-01-01 10:00:22.04")
    assert rows(live, "ip", "expires_in_s") == [("1.1.1.1", 38.0), ("4.4.4.4", 3.0)]
    assert policy.active_rules(rules, "2024-01-01 10:01:00").where("ip = '1.1.1.1'").count() == 0


def test_blocklist_with_a_hot_source_equals_brute_force(spark):
    base = dt.datetime(2024, 1, 1)
    events = [(base + dt.timedelta(seconds=97 * i), i, "unblock" if i % 5 == 4 else "block", None, "1.1.1.1" if i % 3 else "2.2.2.2", (i * 131) % 4000)
              for i in range(300)]
    rules = policy.normalize_policy_events(
        spark.createDataFrame(events, "ts timestamp_ntz, seq bigint, action string, match string, ip string, ttl_s bigint"))
    traffic = [(i, "1.1.1.1" if i % 4 else "2.2.2.2", base + dt.timedelta(seconds=13 * i)) for i in range(2500)]
    got = {r.id: r.dropped for r in policy.policy_apply(
        spark.createDataFrame(traffic, "id int, src_ip string, ts timestamp_ntz"), rules).collect()}
    want = {}
    for i, ip, at in traffic:
        known = [e for e in events if e[4] == ip and e[0] <= at]
        want[i] = bool(known) and known[-1][2] == "block" and at <= known[-1][0] + dt.timedelta(seconds=min(max(known[-1][5], 1), 3600))
    assert got == want


def test_flow_batch_documents(spark, tmp_path):
    flow = '{"src_ip":"1.1.1.1","dst_ip":"2.2.2.2","src_port":1,"dst_port":2,"protocol":"TCP","packet_count":3,"byte_count":4,"first_seen":5,"last_seen":6}'
    (tmp_path / "a.json").write_text('{\n "timestamp": 7,\n "flow_count": 1,\n "flows": [' + flow + "]\n}\n")
    (tmp_path / "b.json").write_text('{"timestamp": 8, "flow_count": 0, "flows": []}')
    (tmp_path / "c.json").write_text('{"timestamp": 9, "flows": [')
    got = flow_batches.explode_batches(flow_batches.read_flow_batches(spark, str(tmp_path), multi_line=True))
    assert rows(got, "batch_ts", "src_ip", "packets", "bytes") == [(7, "1.1.1.1", 3, 4)]


def test_documents_are_deduplicated_with_all_their_flows(spark):
    flow = '{"src_ip":"1.1.1.%d","dst_ip":"2.2.2.2","src_port":1,"dst_port":2,"protocol":"TCP","packet_count":3,"byte_count":4}'
    doc = '{"agent":"a","timestamp":7,"flow_count":3,"flows":[' + ",".join(flow % i for i in range(3)) + "]}"
    docs = flow_batches.parse_flow_batches(spark.createDataFrame([(doc,), (doc,), (doc.replace(":7", ":8"),)], "value string"))
    got = flow_batches.explode_batches(flow_batches.dedup_batches(docs))
    assert rows(got, "batch_ts", "src_ip") == [(t, f"1.1.1.{i}") for t in (7, 8) for i in range(3)]


def test_telemetry_defaults(spark):
    lines = ['{"agent_ip":"a","agent_cpu":10.5,"cms":{"heavy_hitters_bytes":[{"dst_ip":"10.0.0.1","bytes":5},{"bytes":3}]}}', "{}", '{"agent_ip":']
    payloads = telemetry.parse_telemetry(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert rows(payloads.na.fill(""), "agent_ip", "agent_cpu", "unique_flows") == [("", 0.0, 0), ("a", 10.5, 0)]
    flows = telemetry.heavy_flow_rows(payloads)
    assert rows(flows.na.fill("-"), "dst_ip", "proto", "dst_port", "bytes") == [("-", "UNKNOWN", 0, 3), ("10.0.0.1", "UNKNOWN", 0, 5)]
    assert telemetry.usable_destinations(flows).count() == 1
    assert telemetry.heavy_flow_rows(payloads, keep_idle=True).count() == 3


def test_peer_summaries(spark, tmp_path):
    import os

    def doc(peer, ts, mass, hits):
        return ('{"peer":"%s","timestamp":"%s","cms":{"total_bytes":%d,"total_packets":1,"heavy_hitters_bytes":[%s]},"hll":{"cardinalities":'
                '{"unique_flows":2},"port_scanners":[{"ip":"9.9.9.9","unique_ports":30}]}}') % (
            peer, ts, mass, ",".join('{"flow":"%s:1->%s:2/TCP","bytes":%d}' % h for h in hits))

    files = [("p1old", doc("p1", "t1", 5, [("1.1.1.9", "7.7.7.7", 1)])), ("p1new", doc("p1", "t2", 10, [("1.1.1.1", "7.7.7.7", 9), ("1.1.1.2", "7.7.7.7", 8)])),
             ("p2", doc("p2", "t1", 20, [("1.1.1.3", "7.7.7.7", 9), ("1.1.1.1", "6.6.6.6", 7)])), ("bad", "{")]
    for i, (name, text) in enumerate(files):
        (tmp_path / f"{name}.json").write_text(text)
        os.utime(tmp_path / f"{name}.json", (1000 + i, 1000 + i))
    docs = summaries.latest_per_peer(summaries.read_peer_summaries(spark, str(tmp_path)))
    assert tuple(peers.peer_consolidation(docs).first()) == (2, 30, 2, 4)
    victims = peers.ddos_victims(summaries.heavy_hitter_rows(docs))
    assert rows(victims, "victim", "attackers_count", "attacker") == [("7.7.7.7", 3, f"1.1.1.{i}") for i in (1, 2, 3)]
    assert [r.bytes for r in peers.top_flows_across_peers(summaries.heavy_hitter_rows(docs), 2).collect()] == [9, 9]
    assert rows(peers.scanner_rollcall(docs), "origin_peer", "distinct_scanners") == [("p1", 1), ("p2", 1)]


def test_scenarios(spark):
    cpu = [("Baseline", "cpu", i, v) for i, v in enumerate([90.0, 110.0])] + [("Kernel", "cpu", 0, 50.0)]
    gbps = [("Baseline", "gbps", 0, 100.0), ("Kernel", "gbps", 0, 95.0), ("Quiet", "gbps", 0, 0.0)]
    stats = scenario.scenario_stats(spark.createDataFrame(cpu + gbps, "scenario string, metric string, idx int, value double"))
    got = {r.scenario: tuple(r)[1:] for r in scenario.scenario_compare(stats, "Baseline").collect()}
    assert got["Baseline"] == (100.0, 110.0, 100.0, 0.0, 1.0)
    assert got["Kernel"] == (50.0, 50.0, 95.0, 5.0, 1.9)
    assert got["Quiet"] == (0.0, 0.0, 0.0, 100.0, 0.0)


def test_payload_heartbeat(spark):
    flows = spark.createDataFrame([("a", 1, *f[:5], f[5], f[6]) for f in [("1.1.1.1", "2.2.2.2", 1, 2, "TCP", 3, 4)]],
                                  "agent_id string, poll_id int, " + FLOW_COLS).withColumn("flow_id", net.flow_id())
    cpu = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 6.0)], "agent_id string, poll_id int, agent_cpu double")
    got = {r.poll_id: r for r in report.agent_payload(flows, cpu).collect()}
    assert len(got[1].heavy_flows) == 1 and got[1].unique_flows == 1 and got[1].diversity_score == 1.0
    assert got[2].heavy_flows == [] and got[2].flows_processed == 0 and got[2].agent_cpu == 6.0


def test_top_flows_tie_order(spark):
    flows = spark.createDataFrame([("a", 1, "1.1.1.1", d, 1, 2, "TCP", 1, 10) for d in ("3.3.3.3", "2.2.2.2", "4.4.4.4")],
                                  "agent_id string, poll_id int, " + FLOW_COLS)
    assert rows(rollup.top_flows_per_batch(flows, 2), "rank", "dst_ip") == [(1, "2.2.2.2"), (2, "3.3.3.3")]
