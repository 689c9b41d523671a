"""Network inputs derived from the driver's tables.

Each derivation is written once as column expressions that mean the same in Spark SQL and in DuckDB, so a query and its
check read identical inputs.  ``{k}`` and ``{live_ts}`` stand for the two expressions the engines spell differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowscope.functions.net import flow_id, flow_key
from flowscope.operators.report import agent_payload, payload_json
from flowscope.operators.rollup import counter_rows
from flowscope.operators.series import counter_series

SPARK_DIALECT = {
    "k": "CAST(get_json_object(props, '$.k') AS BIGINT)",
    "live_ts": "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, event_id * 0.3)",
}
DUCKDB_DIALECT = {
    "k": "CAST(json_extract_string(props, '$.k') AS BIGINT)",
    "live_ts": "TIMESTAMP '2024-01-01 00:00:00' + to_milliseconds(event_id * 300)",
}

EVENT_FLOWS = {
    "event_id": "event_id",
    "ts": "ts",
    "user_id": "user_id",
    "event_type": "event_type",
    "agent_id": "concat('agent-', CAST(user_id % 4 AS STRING))",
    "poll_id": "CAST(day(ts) AS INTEGER)",
    "src_ip": "concat('10.', CAST(user_id % 4 AS STRING), '.', CAST(CAST(floor(user_id / 8) AS BIGINT) % 256 AS STRING),"
              " '.', CAST(user_id % 256 AS STRING))",
    "dst_ip": "concat('172.', CAST(16 + event_id % 3 AS STRING), '.', CAST((event_id * 7) % 5 AS STRING), '.',"
              " CAST((event_id * 31) % 50 AS STRING))",
    "src_port": "CAST(50000 + event_id % 4 AS INTEGER)",
    "dst_port": "CAST(CASE event_type WHEN 'click' THEN 443 WHEN 'view' THEN 80 WHEN 'purchase' THEN 8443"
                " WHEN 'signup' THEN 53 ELSE 1 + event_id % 1000 END AS INTEGER)",
    "proto": "CASE WHEN event_type = 'signup' THEN 'UDP' ELSE 'TCP' END",
    "bytes": "CAST(round(value * 100) AS BIGINT)",
    "packets": "1 + CAST(floor(round(value * 100) / 1500) AS BIGINT)",
    "k": "{k}",
    "live_ts": "{live_ts}",
}

LINEITEM_FLOWS = {
    "ts": "l_shipdate",
    "src_ip": "concat('10.', CAST(l_suppkey % 4 AS STRING), '.', CAST(CAST(floor(l_suppkey / 8) AS BIGINT) % 256 AS STRING),"
              " '.', CAST(l_suppkey % 256 AS STRING))",
    "dst_ip": "concat('172.', CAST(16 + l_partkey % 3 AS STRING), '.', CAST(CAST(floor(l_partkey / 256) AS BIGINT) % 256"
              " AS STRING), '.', CAST(l_partkey % 256 AS STRING))",
    "src_port": "CAST(1024 + l_orderkey % 50000 AS INTEGER)",
    "dst_port": "CAST(CASE WHEN l_returnflag = 'R' THEN 443 WHEN l_returnflag = 'A' THEN 80 ELSE 1 + l_partkey % 1000 END"
                " AS INTEGER)",
    "proto": "CASE WHEN l_linestatus = 'O' THEN 'UDP' ELSE 'TCP' END",
    "bytes": "CAST(round(l_extendedprice) AS BIGINT)",
    "packets": "CAST(l_quantity AS BIGINT)",
}

SERVICE_PORT = "CASE WHEN event_type = 'error' THEN 22 ELSE dst_port END"
RESTART_POLL = 15
PEER = "concat('peer', CAST(1 + user_id % 5 AS STRING))"
PEER_CUTS = ("2024-01-15 00:00:00", "2024-01-31 00:00:00")
STARTED, ASOF = "2024-01-01 00:00:00", "2024-02-01 00:00:00"


def columns(spec: dict[str, str], dialect: dict[str, str]) -> list[str]:
    filled = {}
    for name, text in spec.items():
        for mark, value in dialect.items():
            text = text.replace("{" + mark + "}", value)
        filled[name] = text
    return [f"{text} AS {name}" for name, text in filled.items()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_flows(events: DataFrame) -> DataFrame:
    return events.selectExpr(*columns(EVENT_FLOWS, SPARK_DIALECT))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_flows(table(spark, sf_dir, "events"))


def volume_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*columns(LINEITEM_FLOWS, SPARK_DIALECT))


def with_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("flow_id", flow_id())


def batch_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).withColumn("batch_ts", F.date_trunc("hour", "ts"))


SNAPSHOT_KEY = ["agent_id", "src_ip", "dst_ip", "src_port", "dst_port", "proto"]


def snapshot_increments(f: DataFrame) -> DataFrame:
    """Traffic per counter key and poll; at most one row per key and day."""
    return f.selectExpr(
        "agent_id", "src_ip", "'172.16.0.1' AS dst_ip", "50000 AS src_port", f"{SERVICE_PORT} AS dst_port", "proto",
        "poll_id", "bytes", "packets",
    ).groupBy(*SNAPSHOT_KEY, "poll_id").agg(
        F.sum("bytes").cast("bigint").alias("b"), F.sum("packets").cast("bigint").alias("p")
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative counters per key and daily poll, restarting at poll 15."""
    w = W.partitionBy(*SNAPSHOT_KEY, F.col("poll_id") >= RESTART_POLL).orderBy("poll_id")
    return snapshot_increments(flows(spark, sf_dir)).select(
        *SNAPSHOT_KEY, "poll_id",
        F.sum("b").over(w).cast("bigint").alias("total_bytes"),
        F.sum("p").over(w).cast("bigint").alias("total_packets"),
    )


def _encoded(hex_text, style):
    """Bytes of a hex text in one of the three encodings: hex strings, numbers, or one hex string with blanks."""
    each = F.transform(F.sequence(F.lit(1), F.length(hex_text) - 1, F.lit(2)), lambda i: F.substr(hex_text, i, F.lit(2)))
    texts = F.concat(F.lit('["0x'), F.array_join(each, '","0x'), F.lit('"]'))
    numbers = F.concat(F.lit("["), F.array_join(F.transform(each, lambda b: F.conv(b, 16, 10)), ","), F.lit("]"))
    blanks = F.concat(F.lit('"'), F.array_join(each, " "), F.lit('"'))
    return F.when(style == 0, texts).when(style == 1, numbers).otherwise(blanks)


def _le_hex(value, n_bytes: int):
    digits = F.lower(F.lpad(F.hex(value.cast("bigint")), 2 * n_bytes, "0"))
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n_bytes))])


def _be_hex(value, n_bytes: int):
    return F.lower(F.lpad(F.hex(value.cast("bigint")), 2 * n_bytes, "0"))


def _ip_hex(ip):
    parts = F.split(ip, r"\.")
    return F.concat(*[_be_hex(F.get(parts, F.lit(i)).cast("bigint"), 1) for i in range(4)])


DUMP_ENTRIES = 1000


def counter_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots as encoded dump text ``agent_id, poll_id, part, dump``; a part holds about ``DUMP_ENTRIES`` entries.

    Entries use the three byte encodings in turn.  A short key is added to every seventh entry and the value of every
    eleventh is cut (by total bytes).
    """
    s = snapshots(spark, sf_dir)
    proto = F.when(F.col("proto") == "UDP", F.lit(17)).otherwise(F.lit(6))
    key = F.concat(
        _ip_hex(F.col("src_ip")), _ip_hex(F.col("dst_ip")), _le_hex(F.col("src_port"), 2), _le_hex(F.col("dst_port"), 2),
        _be_hex(proto, 1), F.lit("000000"),
    )
    whole = F.concat(_le_hex(F.col("total_bytes"), 8), _le_hex(F.col("total_packets"), 8))
    value = F.when(F.col("total_bytes") % 11 == 0, F.substring(whole, 1, 30)).otherwise(whole)
    coded = s.select("agent_id", "poll_id", "total_bytes", key.alias("key"), value.alias("value"))
    style = F.col("total_bytes") % 3
    entry = F.concat(F.lit('{"key":'), _encoded(F.col("key"), style), F.lit(',"value":'), _encoded(F.col("value"), style), F.lit("}"))
    short = F.when(F.col("total_bytes") % 7 == 0, F.lit(',{"key":["0x0a","0x00"],"value":["0x01"]}')).otherwise(F.lit(""))
    parts = s.groupBy("agent_id", "poll_id").agg(F.ceil(F.count("*") / DUMP_ENTRIES).cast("int").alias("parts"))
    entries = coded.join(parts, ["agent_id", "poll_id"]).select(
        "agent_id", "poll_id", F.pmod(F.hash("key"), "parts").alias("part"), F.concat(entry, short).alias("entry"))
    listed = F.array_join(F.sort_array(F.collect_list("entry")), ",")
    return entries.groupBy("agent_id", "poll_id", "part").agg(F.concat(F.lit("["), listed, F.lit("]")).alias("dump"))


BATCH_EVENTS = 40


def flow_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow-batch documents as JSON lines in ``value``: the flows of one agent in a batch of forty events.

    Of the batch numbers every twentieth (% 20 = 3) is cut short, every tenth (% 10 = 7) has no flows, and every
    fiftieth (% 50 = 1) is exported twice.
    """
    f = flows(spark, sf_dir).withColumn("batch", F.floor(F.col("event_id") / BATCH_EVENTS).cast("bigint"))
    us = F.unix_seconds(F.col("ts").cast("timestamp"))
    record = F.struct(
        "event_id", "src_ip", "dst_ip", "src_port", "dst_port", F.col("proto").alias("protocol"),
        F.col("packets").alias("packet_count"), F.col("bytes").alias("byte_count"),
        us.alias("first_seen"), (us + F.col("packets")).alias("last_seen"),
    )
    grouped = f.groupBy("agent_id", "batch").agg(F.sort_array(F.collect_list(record)).alias("records"))
    every = F.transform("records", lambda r: r.dropFields("event_id"))
    listed = F.when(F.col("batch") % 10 == 7, F.slice(every, 1, 0)).otherwise(every)
    text = F.to_json(
        F.struct(F.col("agent_id").alias("agent"), F.col("batch").alias("timestamp"),
                 F.size(listed).alias("flow_count"), listed.alias("flows"))
    )
    text = F.when(F.col("batch") % 20 == 3, F.substring(text, 1, 40)).otherwise(text)
    copies = F.when(F.col("batch") % 50 == 1, F.array(text, text)).otherwise(F.array(text))
    return grouped.select(F.explode(copies).alias("value"))


def poll_cpu(f: DataFrame) -> DataFrame:
    """Agent CPU per poll: the largest ``k`` plus a half; an extra agent only sends heartbeats."""
    busy = f.groupBy("agent_id", "poll_id").agg((F.max("k") + 0.5).alias("agent_cpu"))
    idle = f.select(F.lit("agent-idle").alias("agent_id"), "poll_id", F.lit(1.5).alias("agent_cpu")).distinct()
    return busy.unionByName(idle)


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = with_ids(flows(spark, sf_dir))
    rows = agent_payload(f, poll_cpu(f))
    stamp = F.concat(F.lit("2024-01-"), F.lpad(F.col("poll_id").cast("string"), 2, "0"))
    return rows.withColumn("timestamp", stamp)


def telemetry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry JSON lines; those of every tenth poll are cut short."""
    p = payloads(spark, sf_dir)
    lines = payload_json(p.where(F.col("poll_id") % 10 != 0))
    broken = payload_json(p.where(F.col("poll_id") % 10 == 0)).select(F.substring("value", 1, 60).alias("value"))
    return lines.unionByName(broken)


def peer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peer summary documents ``peer, file_ts, value``: two files per peer."""
    f = flows(spark, sf_dir).withColumn("peer", F.expr(PEER))
    older, newer = [F.lit(c).cast("timestamp_ntz") for c in PEER_CUTS]
    cut = f.withColumn(
        "file_ts",
        F.explode(
            F.when(F.col("ts") < older, F.array(older, newer)).otherwise(F.array(newer))
        ),
    )
    by = ["peer", "file_ts"]
    head = cut.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (F.sum("bytes") * 3).cast("bigint").alias("mass"),
        F.sum("packets").cast("bigint").alias("pk"),
        F.countDistinct(flow_key()).alias("uf"),
    )
    sums = cut.groupBy(*by, flow_key().alias("flow")).agg(F.sum("bytes").cast("bigint").alias("bytes"))
    order = W.partitionBy(*by).orderBy(F.desc("bytes"), "flow")
    top = sums.withColumn("rank", F.row_number().over(order)).where("rank <= 20").groupBy(*by).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "flow", "bytes"))),
            lambda x: F.struct(x["flow"].alias("flow"), x["bytes"].alias("bytes")),
        ).alias("hh")
    )
    stamp = F.col("file_ts").cast("string").alias("timestamp")
    heads = head.join(top, by).select(
        *by,
        F.to_json(
            F.struct(
                "peer", stamp, F.col("n").alias("flows_processed"), F.lit(False).alias("privacy_enabled"),
                F.struct(F.col("mass").alias("total_bytes"), F.col("pk").alias("total_packets"),
                         F.col("hh").alias("heavy_hitters_bytes")).alias("cms"),
                F.struct(F.struct(F.col("uf").alias("unique_flows")).alias("cardinalities")).alias("hll"),
            )
        ).alias("value"),
    )
    scanners = cut.groupBy(*by, "src_ip").agg(F.countDistinct("dst_port").alias("unique_ports")).where("unique_ports >= 10")
    parts = scanners.select(
        *by,
        F.to_json(
            F.struct(
                "peer", stamp,
                F.struct(F.array(F.struct(F.col("src_ip").alias("ip"), "unique_ports")).alias("port_scanners")).alias("hll"),
            )
        ).alias("value"),
    )
    return heads.unionByName(parts)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One captured frame per event.

    By event_id % 12: 0 a 24-byte IP header, 1 a cut transport header, 2 ICMP, 3 IPv6, 4 ARP, 5 a header length
    below 20 (inadmissible), otherwise plain TCP or UDP.
    """
    f = flows(spark, sf_dir)
    kind = F.col("event_id") % 12
    ports = F.concat(_be_hex(F.col("src_port"), 2), _be_hex(F.col("dst_port"), 2))
    number = F.when(kind == 2, F.lit(1)).when(F.col("proto") == "UDP", F.lit(17)).otherwise(F.lit(6))
    transport = F.when(kind == 1, ports).otherwise(F.concat(ports, F.lit("00" * 16)))
    words = F.when(kind == 0, F.lit("46")).when(kind == 5, F.lit("44")).otherwise(F.lit("45"))
    options = F.when(kind == 0, F.lit("01010101")).otherwise(F.lit(""))
    v4 = F.concat(
        F.lit("0800"), words, F.lit("00" * 8), _be_hex(number, 1), F.lit("0000"),
        _ip_hex(F.col("src_ip")), _ip_hex(F.col("dst_ip")), options, transport,
    )
    v6 = F.concat(
        F.lit("86dd60000000" + "0000"), _be_hex(number, 1), F.lit("40"),
        F.lit("20010db8" + "00" * 10), _be_hex(F.col("user_id") % 65536, 2),
        F.lit("20010db8" + "0000" * 2 + "0001" + "0000" * 2), _be_hex(F.col("event_id") % 65536, 2), transport,
    )
    body = F.when(kind == 3, v6).when(kind == 4, F.lit("0806" + "00" * 28)).otherwise(v4)
    wire = (F.lit(60) + F.col("bytes") % 1400).cast("bigint")
    # behind a generator the frame is built once, not again in every field and filter that is read from it
    frame = F.explode(F.array(F.unhex(F.concat(F.lit("ff" * 6 + "02" * 6), body))))
    return f.select("event_id", "ts", wire.alias("wire_len"), frame.alias("frame"))


def policy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocklist events from every error (block) and signup (unblock); some are inadmissible on purpose."""
    f = flows(spark, sf_dir)
    chosen = f.where(POLICY_CHOICE)
    return chosen.selectExpr(*POLICY_EVENTS)


POLICY_EVENTS = [
    "ts",
    "event_id AS seq",
    "CASE WHEN event_type = 'signup' THEN 'unblock' ELSE 'block' END AS action",
    "CASE WHEN event_id % 13 = 0 THEN 'dst_ip' WHEN event_id % 2 = 0 THEN 'src_ip' END AS match",
    "CASE WHEN event_id % 11 = 0 THEN '10.0.0.256' ELSE src_ip END AS ip",
    "CASE WHEN event_id % 3 <> 0 THEN k * 600 END AS ttl_s",
]
POLICY_CHOICE = "event_type IN ('error', 'signup')"


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tick per agent (tenant) and hour with its rates and exact counts."""
    f = flows(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return f.groupBy(F.col("agent_id").alias("tenant"), F.col("hour").alias("ts")).agg(
        (F.sum("bytes") * 8 / F.lit(1e4)).alias("mbps"),
        F.count(F.lit(1)).cast("double").alias("unique_flows"),
        F.countDistinct("src_ip").cast("double").alias("unique_src"),
        (F.countDistinct("dst_ip") / F.count(F.lit(1))).alias("diversity"),
        F.when(F.count(F.lit(1)) > 1, 1 - F.max("bytes") / F.when(F.sum("bytes") > 0, F.sum("bytes"))).alias("spray"),
    )


def counter_samples(spark: SparkSession, sf_dir: str, metrics=None) -> DataFrame:
    """Scraped counters of all four kinds, restarting with poll 15."""
    f = flows(spark, sf_dir).where("dst_ip <> '' AND bytes > 0")
    rows = counter_rows(f.withColumn("epoch", F.col("poll_id") >= RESTART_POLL), "ts", "epoch")
    if metrics:
        rows = rows.where(F.col("metric").isin(*metrics))
    return counter_series(rows, epoch=("epoch",))


SCENARIO = ("CASE event_id % 4 WHEN 0 THEN 'Baseline' WHEN 1 THEN 'Capture' WHEN 2 THEN 'Kernel' ELSE 'Idle' END")


def scenario_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with a dense index per scenario; the idle scenario has no CPU samples."""
    return flows(spark, sf_dir).selectExpr(
        f"{SCENARIO} AS scenario",
        "CASE WHEN event_id % 4 = 3 OR floor(event_id / 4) % 2 = 0 THEN 'gbps' ELSE 'cpu' END AS metric",
        "CAST(floor(event_id / 4) AS BIGINT) AS idx",
        "k + 0.5 AS value",
    ).withColumn("value", F.col("value").cast("double"))


