"""The SQL each named query is checked against, for DuckDB on the same tables.

``CTES`` are the building blocks; a check lists its output columns with their types and a final SELECT, and gets the
blocks it mentions.  Types: s text, l BIGINT, d DOUBLE rounded to six places, b boolean, t timestamp.
"""

from __future__ import annotations

import hashlib
import re

from flowscope.functions.hashing import CmsSpec, HllSpec, hll_alpha
from flowscope.plans import inputs as I

CTES: dict[str, str] = {}
CHECKS: dict[str, str] = {}
_CAST = {
    "s": "CAST({c} AS VARCHAR)", "l": "CAST({c} AS BIGINT)", "d": "round(CAST({c} AS DOUBLE), 6)",
    "b": "CAST({c} AS BOOLEAN)", "t": "CAST({c} AS TIMESTAMP)",
}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def _needed(sql: str) -> list[str]:
    found: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"[a-z_][a-z0-9_]*", text):
            if name in CTES and name not in found:
                visit(CTES[name])
                if name not in found:
                    found.append(name)

    visit(sql)
    return found


def check(name: str, columns: str, sql: str) -> None:
    parts = [f"{n} AS ({CTES[n]})" for n in _needed(sql)]
    body = (f"WITH {', '.join(parts)} " if parts else "") + sql
    casts = ", ".join(_CAST[t].format(c=c) + f" AS {c}" for c, t in (p.split(":") for p in columns.split()))
    CHECKS[name] = f"SELECT {casts} FROM ({body}) AS q"


# --- building blocks --------------------------------------------------------------------------------------------

cte("flows", "SELECT " + ", ".join(I.columns(I.EVENT_FLOWS, I.DUCKDB_DIALECT)) + " FROM events")
cte("vflows", "SELECT " + ", ".join(I.columns(I.LINEITEM_FLOWS, I.DUCKDB_DIALECT)) + " FROM lineitem")
_KEY = "concat(src_ip, ':', src_port, '->', dst_ip, ':', dst_port, '/', proto)"
_ID = "concat_ws('|', src_ip, dst_ip, proto, src_port, dst_port)"
cte("keyed", f"SELECT *, {_KEY} AS flow, {_ID} AS flow_id FROM flows")
cte("vkeyed", f"SELECT *, {_KEY} AS flow FROM vflows")
FIVE = "src_ip, dst_ip, src_port, dst_port, proto"


def prefix_sql(source: str, threshold: int, levels=(0, 8, 16, 24, 32)) -> str:
    octet = [f"split_part(dst_ip, '.', {i})" for i in range(1, 5)]

    def name(k: int) -> str:
        n = k // 8
        return " || '.' || ".join(octet[:n] + ["'0'"] * (4 - n)) + f" || '/{k}'"

    parts = []
    for above, k in zip([None, *levels], levels):
        parent = "''" if above is None else name(above)
        parts.append(f"SELECT {name(k)} AS prefix, {parent} AS parent, {k} AS mask_len, sum(bytes) AS bytes "
                     f"FROM {source} WHERE bytes > 0 GROUP BY 1, 2, 3 HAVING sum(bytes) >= {threshold}")
    return " UNION ALL ".join(parts)


cte("prefixes", prefix_sql("flows", 5000))


def cms_position(key: str, row: str, spec: CmsSpec) -> str:
    if spec.family == "B":
        h = f"md5({key} || CAST({row} * 101 AS VARCHAR))"
        swapped = f"substr({h},7,2) || substr({h},5,2) || substr({h},3,2) || substr({h},1,2)"
        return f"CAST('0x' || {swapped} AS BIGINT) % {spec.width}"
    h = f"md5({key} || CAST({row} AS VARCHAR))"
    if spec.width & (spec.width - 1) == 0:
        return f"CAST('0x' || substr({h},25,8) AS BIGINT) % {spec.width}"
    rest = "CAST(0 AS BIGINT)"
    for c in range(4):
        rest = f"(({rest} * 4294967296 + CAST('0x' || substr({h},{8 * c + 1},8) AS BIGINT)) % {spec.width})"
    return rest


def cells_sql(source: str, key: str, value: str, spec: CmsSpec = CmsSpec()) -> str:
    return (f"SELECT i AS row_i, {cms_position('k', 'i', spec)} AS col_j, sum(v) AS cnt FROM "
            f"(SELECT {key} AS k, {value} AS v FROM {source}) AS r, range({spec.depth}) AS t(i) GROUP BY 1, 2")


def estimate_sql(cells: str, keys: str, key: str, spec: CmsSpec = CmsSpec(), where: str = "true") -> str:
    """Keys of a relation with their estimate."""
    return (f"SELECT c.{key}, min(coalesce(cnt, 0)) AS estimate FROM "
            f"(SELECT {key}, i, {cms_position(key, 'i', spec)} AS j FROM {keys}, range({spec.depth}) AS t(i)) AS c "
            f"LEFT JOIN (SELECT * FROM {cells} WHERE {where}) AS s ON c.i = s.row_i AND c.j = s.col_j GROUP BY 1")


def registers_sql(source: str, value: str, spec: HllSpec, by: str = "") -> str:
    by = f"{by}, " if by else ""
    p = spec.precision
    if spec.family == "A":
        word = f"CAST('0x' || substr(sha256({value}),1,16) AS UBIGINT)"
        rho = f"CASE WHEN w = 0 THEN {64 - p + 1} ELSE {64 - p + 1} - length(bin(w)) END"
    else:
        h = f"sha1({value})"
        word = "CAST('0x' || " + " || ".join(f"substr({h},{2 * i + 1},2)" for i in reversed(range(8))) + " AS UBIGINT)"
        rho = "CASE WHEN w = 0 THEN 64 ELSE length(bin(w & -w)) END"
    return (f"SELECT {by}register, max({rho}) AS rho FROM (SELECT {by}CAST(x & {spec.registers - 1} AS BIGINT) AS register, "
            f"CAST(x >> {p} AS BIGINT) AS w FROM (SELECT {by}{word} AS x FROM {source}) AS h0) AS h1 GROUP BY {by}register")


def count_sql(registers: str, spec: HllSpec, by: str = "", name: str = "estimate") -> str:
    m = spec.registers
    select = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    raw = f"({hll_alpha(spec)!r}::DOUBLE * {float(m)!r}::DOUBLE * {float(m)!r}::DOUBLE / (inv + {m} - n))"
    return (f"SELECT {select}CAST(floor(CASE WHEN {raw} <= {2.5 * m} AND n < {m} THEN {m}::DOUBLE * ln({float(m)!r}::DOUBLE / ({m} - n)) "
            f"ELSE {raw} END) AS BIGINT) AS {name} FROM (SELECT {select}coalesce(sum(pow(2.0, -rho)), 0) AS inv, "
            f"count(*) AS n FROM ({registers}) AS r{group}) AS e")


A14, A12, B12 = HllSpec(), HllSpec(12, "A"), HllSpec(12, "B")
B_SPEC = CmsSpec(family="B")

cte("dims", " UNION ALL ".join(
    f"SELECT agent_id, poll_id, '{n}' AS dimension, CAST({c} AS VARCHAR) AS value FROM keyed"
    for n, c in (("src_ips", "src_ip"), ("dst_ips", "dst_ip"), ("src_ports", "src_port"), ("dst_ports", "dst_port"), ("flows", "flow"))
))
cte("dim_counts", count_sql(registers_sql("dims", "value", A14, "dimension"), A14, "dimension"))
cte("cards", "SELECT " + ", ".join(
    f"coalesce(max(estimate) FILTER (WHERE dimension = '{n}'), 0) AS unique_{n}"
    for n in ("src_ips", "dst_ips", "src_ports", "dst_ports", "flows")) + " FROM dim_counts")
cte("metric_cells", " UNION ALL ".join(
    f"SELECT '{m}' AS metric, * FROM ({sql}) AS c WHERE cnt <> 0"
    for m, sql in (
        ("bytes", cells_sql("(SELECT flow AS k0, bytes FROM keyed UNION ALL SELECT 'src:' || src_ip, bytes FROM keyed "
                            "UNION ALL SELECT 'dst:' || dst_ip, bytes FROM keyed) AS u", "k0", "bytes")),
        ("packets", cells_sql("keyed", "flow", "packets")),
        ("flows", cells_sql("keyed", "flow", "1")),
    )))
cte("flow_cells", cells_sql("keyed", "flow", "bytes"))
cte("distinct_flows", "SELECT DISTINCT flow FROM keyed")
cte("batch_unique", count_sql(registers_sql("keyed", "flow_id", B12, "agent_id, poll_id"), B12, "agent_id, poll_id", "unique_flows"))
cte("per_batch_flow", f"SELECT agent_id, poll_id, {FIVE}, sum(bytes) AS bytes FROM flows GROUP BY ALL")
cte("batch_top", "SELECT *, row_number() OVER (PARTITION BY agent_id, poll_id ORDER BY bytes DESC, src_ip, dst_ip, src_port, "
                 "dst_port, proto) AS rank FROM per_batch_flow QUALIFY rank <= 20")
cte("poll_cpu", "SELECT agent_id, poll_id, max(k) + 0.5 AS agent_cpu FROM flows GROUP BY ALL UNION ALL "
                "SELECT DISTINCT 'agent-idle', poll_id, 1.5 FROM flows")
cte("payload_rows", "SELECT c.agent_id, c.poll_id, agent_cpu, coalesce(n, 0) AS flows_processed, coalesce(b, 0) AS total_bytes, "
    "coalesce(p, 0) AS total_packets, coalesce(us, 0) AS unique_src_ips, coalesce(up, 0) AS unique_src_ports, "
    "coalesce(ud, 0) AS unique_dst_ports, coalesce(unique_flows, 0) AS unique_flows FROM poll_cpu AS c LEFT JOIN "
    "(SELECT agent_id, poll_id, count(*) AS n, sum(bytes) AS b, sum(packets) AS p, count(DISTINCT src_ip) AS us, "
    "count(DISTINCT src_port) AS up, count(DISTINCT dst_port) AS ud FROM flows GROUP BY ALL) AS t USING (agent_id, poll_id) "
    "LEFT JOIN batch_unique USING (agent_id, poll_id)")
cte("snaps", f"SELECT agent_id, src_ip, dst_ip, src_port, dst_port, proto, poll_id, sum(b) OVER w AS total_bytes, "
    f"sum(p) OVER w AS total_packets FROM (SELECT agent_id, src_ip, '172.16.0.1' AS dst_ip, 50000 AS src_port, "
    f"{I.SERVICE_PORT} AS dst_port, proto, poll_id, sum(bytes) AS b, sum(packets) AS p FROM flows GROUP BY ALL) AS s "
    f"WINDOW w AS (PARTITION BY agent_id, src_ip, dst_port, proto, poll_id >= {I.RESTART_POLL} ORDER BY poll_id)")
cte("tick_rows", "SELECT agent_id AS tenant, date_trunc('hour', ts) AS ts, sum(bytes) * 8 / 1e4 AS mbps, "
    "CAST(count(*) AS DOUBLE) AS unique_flows, CAST(count(DISTINCT src_ip) AS DOUBLE) AS unique_src, "
    "count(DISTINCT dst_ip) / count(*) AS diversity, "
    "CASE WHEN count(*) > 1 THEN 1 - max(bytes) / nullif(sum(bytes), 0) END AS spray FROM flows GROUP BY 1, 2")
cte("dense_ticks", "SELECT *, unique_flows / greatest(mbps, 0.1) AS flow_density, unique_src / greatest(mbps, 0.1) AS src_density "
                   "FROM tick_rows")


def _p95(col: str) -> str:
    return f"CASE WHEN count({col}) OVER w >= 10 THEN quantile_cont({col}, 0.95) OVER w END AS {col}_p95"


_BASE_WINDOW = "WINDOW w AS (PARTITION BY tenant ORDER BY ts ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)"
_SIGNALS = {"flow_density": 40.0, "src_density": 25.0, "spray": 20.0, "diversity": 15.0}
cte("based_ticks", f"SELECT *, {', '.join(_p95(c) for c in _SIGNALS)} FROM dense_ticks {_BASE_WINDOW}")

cte("increments", " UNION ALL ".join(
    f"SELECT ts, poll_id >= {I.RESTART_POLL} AS epoch, '{m}' AS metric, {label} AS label, bytes FROM flows WHERE bytes > 0"
    for m, label in (("throughput_bytes", "''"), ("protocol_bytes", "proto"), ("port_bytes", "CAST(dst_port AS VARCHAR)"), ("dest_bytes", "dst_ip"))))
cte("counter_rows", "SELECT metric, label, ts, sum(inc) OVER (PARTITION BY metric, label, epoch ORDER BY ts) AS value FROM "
    "(SELECT metric, label, epoch, time_bucket(INTERVAL '5 seconds', ts) + INTERVAL '5 seconds' AS ts, sum(bytes) AS inc "
    "FROM increments GROUP BY ALL) AS b")
cte("counter_steps", "SELECT *, CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END AS inc FROM "
    "(SELECT *, lag(value) OVER (PARTITION BY metric, label ORDER BY ts) AS prev FROM counter_rows) AS l")


def step_rates_sql(metric: str, seconds: int, step: int) -> str:
    unit = step * 1_000_000
    return (f"SELECT metric, label, make_timestamp(us) AS step_ts, sum(inc) / {float(seconds)!r} AS rate FROM "
            f"(SELECT metric, label, inc, CAST(ceil(epoch_us(ts) / {float(unit)!r}) AS BIGINT) * {unit} + i * {unit} AS us "
            f"FROM counter_steps, range({seconds // step}) AS t(i) WHERE metric = '{metric}' ) AS e GROUP BY 1, 2, 3")


cte("rules", "SELECT *, ts + to_seconds(ttl_s) AS expiry FROM (SELECT ts, seq, action, ip, CASE WHEN action = 'block' THEN "
    "least(greatest(coalesce(ttl_s, 60), 1), 3600) END AS ttl_s FROM (SELECT " + ", ".join(I.POLICY_EVENTS) +
    f" FROM flows WHERE {I.POLICY_CHOICE}) AS p WHERE (action = 'unblock' OR coalesce(match, 'src_ip') = 'src_ip') "
    "AND ip <> '10.0.0.256') AS n")
cte("applied", "SELECT f.event_id, f.ts, f.src_ip, f.bytes, coalesce(r.action = 'block' AND f.ts <= r.expiry, false) AS dropped "
               "FROM flows AS f ASOF LEFT JOIN rules AS r ON f.src_ip = r.ip AND f.ts >= r.ts")
cte("samples", f"SELECT {I.SCENARIO} AS scenario, CASE WHEN event_id % 4 = 3 OR floor(event_id / 4) % 2 = 0 THEN 'gbps' ELSE 'cpu' "
               "END AS metric, CAST(floor(event_id / 4) AS BIGINT) AS idx, k + 0.5 AS value FROM flows")
_NEW = f"TIMESTAMP '{I.PEER_CUTS[1]}'"
cte("peer_flows", f"SELECT {I.PEER} AS peer, {_NEW} AS file_ts, * FROM keyed")
cte("peer_hitters", "SELECT peer AS detected_by, flow, bytes FROM (SELECT peer, flow, sum(bytes) AS bytes FROM peer_flows GROUP BY ALL) AS s "
                    "QUALIFY row_number() OVER (PARTITION BY peer ORDER BY bytes DESC, flow) <= 20")
cte("peer_scanners", "SELECT peer AS origin_peer, src_ip AS ip, count(DISTINCT dst_port) AS unique_ports FROM peer_flows GROUP BY ALL "
                     "HAVING count(DISTINCT dst_port) >= 10")
cte("peer_heads", "SELECT peer, max(file_ts) AS file_ts, count(*) AS n, sum(bytes) * 3 AS mass, sum(packets) AS pk, "
                  "count(DISTINCT flow) AS uf FROM peer_flows GROUP BY ALL")

# --- flows, totals, counters ------------------------------------------------------------------------------------

_FIVE = "src_ip:s dst_ip:s src_port:l dst_port:l proto:s"
_ROLL = (f"SELECT {FIVE}, sum(bytes) AS bytes, sum(packets) AS packets, count(*) AS observations, min(ts) AS first_seen, "
         "max(ts) AS last_seen FROM {0} GROUP BY ALL")
_ROLL_COLS = _FIVE + " bytes:l packets:l observations:l first_seen:t last_seen:t"
check("flow_rollup", _ROLL_COLS, _ROLL.format("flows"))
check("flow_rollup_volume", _ROLL_COLS, _ROLL.format("vflows"))
check("flow_listing", _FIVE + " bytes:l packets:l duration_us:l",
      f"SELECT {FIVE}, sum(bytes) AS bytes, sum(packets) AS packets, epoch_us(TIMESTAMP '{I.ASOF}') - epoch_us(min(ts)) AS duration_us "
      "FROM flows GROUP BY ALL")
check("flow_keys", "event_id:l flow_key:s flow_id:s", "SELECT event_id, flow AS flow_key, flow_id FROM keyed")
check("traffic_totals", "flows_processed:l total_bytes:l total_packets:l batches_processed:l",
      "SELECT count(*) AS flows_processed, sum(bytes) AS total_bytes, sum(packets) AS total_packets, "
      "count(DISTINCT date_trunc('hour', ts)) AS batches_processed FROM flows")
_COUNTERS = ("SELECT 'throughput_bytes' AS metric, '' AS label, sum(bytes) AS value FROM {0} WHERE bytes > 0 UNION ALL "
             "SELECT 'protocol_bytes', proto, sum(bytes) FROM {0} WHERE bytes > 0 GROUP BY 2 UNION ALL "
             "SELECT 'port_bytes', CAST(dst_port AS VARCHAR), sum(bytes) FROM {0} WHERE bytes > 0 GROUP BY 2 UNION ALL "
             "SELECT 'dest_bytes', dst_ip, sum(bytes) FROM {0} WHERE bytes > 0 GROUP BY 2")
check("traffic_counters", "metric:s label:s value:l", _COUNTERS.format("flows"))
check("traffic_counters_volume", "metric:s label:s value:l", _COUNTERS.format("vflows"))
check("top_flows_per_batch", "agent_id:s poll_id:l " + _FIVE + " bytes:l rank:l", "SELECT * FROM batch_top")
check("batch_cardinalities", "agent_id:s poll_id:l n_flows:l unique_src_ips:l unique_src_ports:l unique_dst_ports:l",
      "SELECT agent_id, poll_id, count(*) AS n_flows, count(DISTINCT src_ip) AS unique_src_ips, "
      "count(DISTINCT src_port) AS unique_src_ports, count(DISTINCT dst_port) AS unique_dst_ports FROM flows GROUP BY ALL")
check("agent_health", "agent_id:s last_cpu:d max_agent_cpu:d active_agents:l",
      "SELECT agent_id, last_cpu, max(last_cpu) OVER () AS max_agent_cpu, count(*) OVER () AS active_agents FROM "
      "(SELECT agent_id, arg_max(k + 0.5, (ts, event_id)) AS last_cpu FROM flows GROUP BY 1) AS l")
check("distinct_flow_keys", "flow:s", "SELECT DISTINCT flow FROM keyed")

# --- prefixes ---------------------------------------------------------------------------------------------------

_PREFIX = "prefix:s parent:s bytes:l"
check("hhh_prefixes", _PREFIX, "SELECT prefix, parent, bytes FROM prefixes")
check("hhh_prefixes_volume", _PREFIX, prefix_sql("vflows", 1_000_000))
check("hhh_prefixes_truncated", _PREFIX, prefix_sql("batch_top", 5000))
check("stream_hhh", _PREFIX, "SELECT prefix, parent, bytes FROM prefixes")
check("hhh_parent_check", _PREFIX + " parent_bytes:l parent_ok:b",
      "SELECT c.prefix, c.parent, c.bytes, p.bytes AS parent_bytes, c.parent = '' OR coalesce(p.bytes >= c.bytes, false) AS parent_ok "
      "FROM prefixes AS c LEFT JOIN prefixes AS p ON c.parent = p.prefix")
check("top_prefixes", "prefix:s bytes:l", "SELECT prefix, bytes FROM prefixes ORDER BY bytes DESC, prefix LIMIT 10")
check("top_subnets24", "prefix:s bytes:l", "SELECT prefix, bytes FROM prefixes WHERE mask_len = 24 ORDER BY bytes DESC, prefix LIMIT 15")
check("spray_index", "scope:s spray_index:d", " UNION ALL ".join(
    f"SELECT '{s}' AS scope, 1 - max(bytes) / sum(bytes) AS spray_index FROM "
    f"(SELECT bytes FROM prefixes WHERE bytes > 0 AND {c} ORDER BY bytes DESC, prefix LIMIT 20) AS t{i}"
    for i, (s, c) in enumerate((("nested", "true"), ("/32", "mask_len = 32")))))

# --- Count-Min --------------------------------------------------------------------------------------------------

_CELLS = "row_i:l col_j:l cnt:l"
check("cms_build", _CELLS, "SELECT * FROM flow_cells")
check("cms_merge", _CELLS, "SELECT * FROM flow_cells")
check("cms_build_odd_width", _CELLS, cells_sql("keyed", "flow", "bytes", CmsSpec(1000, 3)))
check("cms_build_volume", _CELLS, cells_sql("vkeyed", "flow", "bytes"))
check("cms_build_b", _CELLS, cells_sql("keyed", "flow_id", "bytes", B_SPEC))
check("cms_build_metrics", "metric:s " + _CELLS, "SELECT * FROM metric_cells")
check("cms_estimate", "flow:s bytes:l packets:l flows:l estimate:l",
      "SELECT flow, bytes, packets, n AS flows, estimate FROM (SELECT flow, sum(bytes) AS bytes, sum(packets) AS packets, count(*) AS n "
      f"FROM keyed GROUP BY 1) AS t JOIN ({estimate_sql('flow_cells', 'distinct_flows', 'flow')}) AS e USING (flow)")
check("cms_heavy_hitters", "metric:s flow:s estimate:l", " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{m}' AS metric, flow, estimate FROM "
    f"({estimate_sql('metric_cells', 'distinct_flows', 'flow', where=repr(m) + ' = metric')}) AS e "
    "ORDER BY estimate DESC, flow LIMIT 10) AS top" for m in ("bytes", "packets", "flows")))
cte("id_cells", cells_sql("keyed", "flow_id", "bytes", B_SPEC))
cte("distinct_ids", "SELECT DISTINCT flow_id FROM keyed")
check("cms_heavy_hitters_b", "flow_id:s estimate:l",
      f"SELECT * FROM ({estimate_sql('id_cells', 'distinct_ids', 'flow_id', B_SPEC)}) AS e ORDER BY estimate DESC, flow_id DESC LIMIT 20")
cte("ip_sums", " UNION ALL ".join(
    f"SELECT {d}_ip AS ip, '{d}' AS direction, '{d}:' || {d}_ip AS k, sum(bytes) AS bytes, sum(packets) AS packets, count(*) AS n "
    "FROM flows GROUP BY ALL" for d in ("src", "dst")))
check("ip_statistics", "ip:s direction:s bytes_estimate:l bytes:l packets:l flows:l",
      "SELECT ip, direction, estimate AS bytes_estimate, bytes, packets, n AS flows FROM ip_sums JOIN "
      f"({estimate_sql('metric_cells', 'ip_sums', 'k', where=repr('bytes') + ' = metric')}) AS e USING (k)")

# --- HyperLogLog ------------------------------------------------------------------------------------------------

check("hll_registers", "register:l rho:l", registers_sql("keyed", "flow", A14))
_FLOW_COUNT = count_sql(registers_sql("keyed", "flow", A14), A14)
check("hll_count", "estimate:l", _FLOW_COUNT)
check("hll_merge", "estimate:l", _FLOW_COUNT)
check("hll_count_volume", "estimate:l", count_sql(registers_sql("vkeyed", "flow", A14), A14))
check("hll_count_b", "estimate:l", count_sql(registers_sql("keyed", "flow_id", B12), B12))
_CARDS = "unique_src_ips:l unique_dst_ips:l unique_src_ports:l unique_dst_ports:l unique_flows:l"
check("cardinalities", _CARDS, "SELECT * FROM cards")
_DIV = "CASE WHEN unique_flows = 0 THEN 0 ELSE least(1.0, (unique_src_ips + unique_dst_ips) / (2 * unique_flows)) END"
check("diversity_score", _CARDS + " diversity_score:d", f"SELECT *, {_DIV} AS diversity_score FROM cards")
check("cardinality_unpivot", "metric:s value:s",
      "SELECT 'Unique Flows' AS metric, CAST(unique_flows AS VARCHAR) AS value FROM cards UNION ALL "
      "SELECT 'Unique Sources', CAST(unique_src_ips AS VARCHAR) FROM cards UNION ALL "
      "SELECT 'Unique Dest Ports', CAST(unique_dst_ports AS VARCHAR) FROM cards UNION ALL "
      f"SELECT 'Diversity Score', printf('%.2f', CAST({_DIV} AS DOUBLE)) FROM cards")
check("batch_diversity", "agent_id:s poll_id:l n_flows:l unique_flows:l diversity_score:d",
      "SELECT agent_id, poll_id, n_flows, unique_flows, unique_flows / greatest(1, n_flows) AS diversity_score FROM batch_unique "
      "JOIN (SELECT agent_id, poll_id, count(*) AS n_flows FROM flows GROUP BY ALL) AS n USING (agent_id, poll_id)")
check("sketch_memory", "flows_processed:l tracked_src_ips:l tracked_services:l cms_bytes:l hll_bytes:l total_bytes:l raw_bytes:l compression_ratio:d",
      "SELECT *, cms_bytes + hll_bytes AS total_bytes, flows_processed * 200 AS raw_bytes, "
      "flows_processed * 200 / (cms_bytes + hll_bytes) AS compression_ratio FROM (SELECT *, 245760 AS cms_bytes, "
      "81920 + (tracked_src_ips + tracked_services) * 4096 AS hll_bytes FROM (SELECT count(*) AS flows_processed, "
      "count(DISTINCT src_ip) AS tracked_src_ips, count(DISTINCT dst_port) AS tracked_services FROM flows) AS c) AS m")
check("sketch_roundtrip", "item:s value:l",
      "SELECT 'cms row ' || i AS item, sum(bytes) AS value FROM flows, range(5) AS t(i) GROUP BY 1 UNION ALL "
      f"SELECT 'hll flows', estimate FROM ({_FLOW_COUNT}) AS c")

check("approx_unique_flows", "exact:l approx_flows_near:b datasketch_flows_near:b",
      "SELECT count(*) AS exact, true AS approx_flows_near, true AS datasketch_flows_near FROM distinct_flows")

_KEYED_MAPS = (("src_to_dst_ports", "src_ip", "CAST(dst_port AS VARCHAR)"), ("dst_to_src_ips", "dst_port", "src_ip"))
check("state_roundtrip", "item:s value:l",
      "SELECT 'cms ' || metric || ' row ' || row_i AS item, sum(cnt) AS value FROM metric_cells GROUP BY 1 UNION ALL "
      "SELECT 'hll ' || dimension, estimate FROM dim_counts UNION ALL " + " UNION ALL ".join(
          f"SELECT '{n} ' || {by}, e FROM ({count_sql(registers_sql('flows', v, A12, by), A12, by, 'e')}) AS k" for n, by, v in _KEYED_MAPS) +
      " UNION ALL SELECT 'flows_processed', count(*) FROM flows UNION ALL SELECT 'batches_processed', count(DISTINCT date_trunc('hour', ts)) FROM flows")
check("summary_record", "timestamp:s runtime_seconds:d flows_processed:l batches_processed:l privacy_enabled:b cms_type:s cms_total_bytes:l "
      "cms_total_packets:l cms_unique_flows:l cms_memory_bytes:l width:l depth:l hll_type:s " + _CARDS + " diversity_score:d hll_total_flows:l "
      "hll_total_bytes:l hll_total_packets:l hll_memory_bytes:l tracked_src_ips:l tracked_services:l",
      f"SELECT '{I.ASOF}' AS timestamp, 2678400 AS runtime_seconds, n AS flows_processed, bt AS batches_processed, false AS privacy_enabled, "
      "'count_min_sketch' AS cms_type, 3 * b AS cms_total_bytes, p AS cms_total_packets, uf AS cms_unique_flows, 245760 AS cms_memory_bytes, "
      f"2048 AS width, 5 AS depth, 'hyperloglog' AS hll_type, cards.*, {_DIV} AS diversity_score, n AS hll_total_flows, b AS hll_total_bytes, "
      "p AS hll_total_packets, 81920 + (si + sv) * 4096 AS hll_memory_bytes, si AS tracked_src_ips, sv AS tracked_services FROM cards, "
      "(SELECT count(*) AS n, sum(bytes) AS b, sum(packets) AS p, count(DISTINCT flow) AS uf, count(DISTINCT date_trunc('hour', ts)) AS bt, "
      "count(DISTINCT src_ip) AS si, count(DISTINCT dst_port) AS sv FROM keyed) AS t")
check("peer_union", "summed:l united:l",
      "SELECT (SELECT sum(estimate) FROM (" + count_sql(registers_sql("peer_flows", "flow", A14, "peer"), A14, "peer") + f") AS p) AS summed, estimate AS united FROM ({_FLOW_COUNT}) AS u")
_GAUGES = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, agent_id AS label, arg_max({c}, poll_id) AS value FROM payload_rows GROUP BY 2"
    for m, c in (("agent_cpu", "agent_cpu"), ("hll_unique_flows", "unique_flows"), ("hll_unique_src_ips", "unique_src_ips")))
check("agent_gauges", "metric:s label:s value:d", _GAUGES)
check("stream_gauges", "metric:s label:s value:d", _GAUGES)

# --- detectors --------------------------------------------------------------------------------------------------

check("port_scanners", "src_ip:s unique_ports:l",
      "SELECT src_ip, count(DISTINCT dst_port) AS unique_ports FROM flows GROUP BY 1 HAVING count(DISTINCT dst_port) >= 20")
check("port_scanners_volume", "src_ip:s unique_ports:l",
      "SELECT src_ip, count(DISTINCT dst_port) AS unique_ports FROM vflows GROUP BY 1 HAVING count(DISTINCT dst_port) >= 50")
check("port_scanners_hll", "src_ip:s unique_ports:l",
      "SELECT * FROM (" + count_sql(registers_sql("flows", "CAST(dst_port AS VARCHAR)", A12, "src_ip"), A12, "src_ip", "unique_ports") +
      ") AS c WHERE unique_ports >= 20")
check("popular_services", "dst_port:l unique_clients:l",
      "SELECT dst_port, count(DISTINCT src_ip) AS unique_clients FROM flows GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
check("popular_services_hll", "dst_port:l unique_clients:l",
      "SELECT * FROM (" + count_sql(registers_sql("flows", "src_ip", A12, "dst_port"), A12, "dst_port", "unique_clients") +
      ") AS c ORDER BY unique_clients DESC, dst_port LIMIT 10")

# --- sources ----------------------------------------------------------------------------------------------------

cte("good_docs", f"SELECT * FROM (SELECT *, CAST(floor(event_id / {I.BATCH_EVENTS}) AS BIGINT) AS batch FROM flows) AS b "
                 "WHERE batch % 20 <> 3 AND batch % 10 <> 7")
check("src_flow_batches", "agent:s batch_ts:l " + _FIVE + " packets:l bytes:l first_seen:t last_seen:t",
      f"SELECT agent_id AS agent, batch AS batch_ts, {FIVE}, packets, bytes, date_trunc('second', ts) AS first_seen, "
      "date_trunc('second', ts) + to_seconds(packets) AS last_seen FROM "
      "(SELECT * FROM good_docs UNION ALL SELECT * FROM good_docs WHERE batch % 50 = 1) AS g")
check("dedup_batches", "agent:s batch_ts:l src_ip:s dst_ip:s bytes:l",
      "SELECT agent_id AS agent, batch AS batch_ts, src_ip, dst_ip, bytes FROM good_docs")
CHECKS["stream_dedup"] = CHECKS["dedup_batches"]
check("src_counter_snapshots", "agent_id:s poll_id:l " + _FIVE + " total_bytes:l total_packets:l",
      f"SELECT agent_id, poll_id, {FIVE}, CASE WHEN total_bytes % 11 = 0 THEN 0 ELSE total_bytes END AS total_bytes, "
      "CASE WHEN total_bytes % 11 = 0 THEN 0 ELSE total_packets END AS total_packets FROM snaps")
check("src_telemetry", "agent_ip:s timestamp:s agent_cpu:d total_bytes:l unique_flows:l " + _FIVE + " bytes:l",
      "SELECT p.agent_id AS agent_ip, '2024-01-' || lpad(CAST(p.poll_id AS VARCHAR), 2, '0') AS timestamp, agent_cpu, total_bytes, unique_flows, "
      "src_ip, dst_ip, coalesce(src_port, 0) AS src_port, coalesce(dst_port, 0) AS dst_port, coalesce(proto, 'UNKNOWN') AS proto, "
      "coalesce(bytes, 0) AS bytes FROM payload_rows AS p LEFT JOIN batch_top AS b ON p.agent_id = b.agent_id AND p.poll_id = b.poll_id "
      "WHERE p.poll_id % 10 <> 0")
_V6 = ("CASE WHEN {0} = 0 THEN '{1}' ELSE '{2}' || lower(to_hex({0})) END")
_SRC6 = _V6.format("(user_id % 65536)", "2001:db8::", "2001:db8::")
_DST6 = _V6.format("(event_id % 65536)", "2001:db8:0:0:1::", "2001:db8::1:0:0:")
cte("frame_rows", f"SELECT *, event_id % 12 AS kind, 60 + bytes % 1400 AS wire_len FROM flows")
_FRAME = "event_id:l ts:t wire_len:l " + _FIVE
_PORTS = ("CASE WHEN kind IN (1, 2) THEN 0 ELSE src_port END AS src_port, CASE WHEN kind IN (1, 2) THEN 0 ELSE dst_port END AS dst_port")
cte("v4_frames", f"SELECT event_id, ts, wire_len, src_ip, dst_ip, {_PORTS}, CASE WHEN kind = 2 THEN '1' ELSE proto END AS proto "
                 "FROM frame_rows WHERE kind NOT IN (3, 4, 5)")
check("decode_frames", _FRAME, "SELECT * FROM v4_frames")
check("decode_frames_v6", _FRAME,
      "SELECT * FROM v4_frames WHERE proto <> '1' UNION ALL "
      f"SELECT event_id, ts, wire_len, {_SRC6}, {_DST6}, src_port, dst_port, proto FROM frame_rows WHERE kind = 3")
check("packet_rollup", _FIVE + " bytes:l packets:l first_seen:t last_seen:t",
      f"SELECT {FIVE}, sum(wire_len) AS bytes, count(*) AS packets, min(ts) AS first_seen, max(ts) AS last_seen FROM v4_frames GROUP BY ALL")
check("latest_summary_per_peer", "peer:s file_ts:t flows_processed:l total_bytes:l parts:l",
      "SELECT peer, file_ts, n AS flows_processed, mass AS total_bytes, 1 + coalesce(s, 0) AS parts FROM peer_heads LEFT JOIN "
      "(SELECT origin_peer AS peer, count(*) AS s FROM peer_scanners GROUP BY 1) AS c USING (peer)")
_CONS = ("SELECT count(*) AS active_peers, sum(mass) AS total_bytes, sum(pk) AS total_packets, sum(uf) AS flow_count FROM peer_heads")
_CONS_COLS = "active_peers:l total_bytes:l total_packets:l flow_count:l"
check("peer_consolidation", _CONS_COLS, _CONS)
check("peer_view", _CONS_COLS, _CONS + " WHERE peer = 'peer2'")
check("scanner_rollcall", "origin_peer:s ip:s unique_ports:l distinct_scanners:l",
      "SELECT *, (SELECT count(DISTINCT ip) FROM peer_scanners) AS distinct_scanners FROM peer_scanners")
check("top_flows_across_peers", "flow:s bytes:l detected_by:s",
      "SELECT flow, bytes, detected_by FROM peer_hitters ORDER BY bytes DESC, flow, detected_by LIMIT 10")
check("ddos_victims", "victim:s attackers_count:l attacker:s",
      "SELECT victim, count(*) OVER (PARTITION BY victim) AS attackers_count, attacker FROM (SELECT DISTINCT split_part(split_part(flow, '->', 2), ':', 1) "
      "AS victim, split_part(flow, ':', 1) AS attacker FROM peer_hitters) AS p QUALIFY attackers_count >= 3")

# --- expressions ------------------------------------------------------------------------------------------------


def _pads(key: str) -> tuple[str, str]:
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in raw).hex(), bytes(b ^ 0x5C for b in raw).hex()


def hmac_sql(col: str, key: str = "k") -> str:
    inner, outer = _pads(key)
    return f"substr(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || CAST({col} AS BLOB)))), 1, 16)"


check("anonymize_ips", "event_id:l src_ip:s dst_ip:s bytes:l",
      f"SELECT event_id, {hmac_sql('src_ip')} AS src_ip, {hmac_sql('dst_ip')} AS dst_ip, bytes FROM flows")
check("anonymized_totals", "src:s bytes:l", f"SELECT {hmac_sql('src_ip')} AS src, sum(bytes) AS bytes FROM flows GROUP BY 1")
check("parse_flow_key", "event_id:l flow:s src:s dst:s",
      "SELECT event_id, CASE WHEN m = 1 THEN v6 || ':443->2001:db8::1:80/TCP' WHEN m = 2 THEN src_ip ELSE flow END AS flow, "
      "CASE WHEN m = 1 THEN v6 WHEN m <> 2 THEN src_ip END AS src, CASE WHEN m = 1 THEN '2001:db8::1' WHEN m <> 2 THEN dst_ip END AS dst "
      "FROM (SELECT *, event_id % 10 AS m, '2001:db8::' || user_id AS v6 FROM keyed) AS k")
check("ip_convert", "event_id:l ip:s ip_long:l dotted:s cidr24:s cidr12:s",
      "SELECT event_id, ip, v AS ip_long, CASE WHEN v IS NOT NULL THEN ip END AS dotted, "
      "CASE WHEN v IS NOT NULL THEN o1 || '.' || o2 || '.' || o3 || '.0/24' END AS cidr24, "
      "CASE WHEN v IS NOT NULL THEN o1 || '.' || (o2 & 240) || '.0.0/12' END AS cidr12 FROM (SELECT *, CASE WHEN event_id % 9 > 1 THEN "
      "((o1 * 256 + o2) * 256 + o3) * 256 + o4 END AS v FROM (SELECT event_id, ip, " + ", ".join(
          f"CAST(split_part(ip, '.', {i}) AS BIGINT) AS o{i}" for i in range(1, 5)) +
      " FROM (SELECT event_id, CASE event_id % 9 WHEN 0 THEN dst_ip || '.9' WHEN 1 THEN '172.16.0.256' ELSE dst_ip END AS ip FROM flows) AS a) AS b) AS c")
check("format_units", "event_id:l bytes_label:s mbps_label:s",
      "SELECT event_id, CASE WHEN b > 1073741824 THEN printf('%.2f GB', b / 1073741824) WHEN b > 1048576 THEN "
      "printf('%.2f MB', b / 1048576) ELSE printf('%.2f KB', b / 1024) END AS bytes_label, CASE WHEN m > 1000 THEN "
      "printf('%.2f Gbps', m / 1000) ELSE printf('%.1f Mbps', m) END AS mbps_label FROM (SELECT event_id, bytes * CASE event_id % 3 "
      "WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1000000 END AS b, bytes / 8 AS m FROM flows) AS f")
check("cpu_ceiling", "agent_id:s poll_id:l ceiling:l",
      "SELECT agent_id, poll_id, CASE WHEN m * 1.2::DOUBLE <= 5 THEN 5 WHEN m * 1.2::DOUBLE <= 10 THEN 10 WHEN m * 1.2::DOUBLE <= 25 THEN 25 "
      "WHEN m * 1.2::DOUBLE <= 50 THEN 50 ELSE 100 END AS ceiling FROM (SELECT agent_id, poll_id, max(k * poll_id / 60) AS m FROM flows GROUP BY ALL) AS c")

# --- time series ------------------------------------------------------------------------------------------------

_DELTAS = ("SELECT agent_id, src_ip, dst_ip, proto, src_port, dst_port, poll_id, CASE WHEN total_bytes < pb THEN total_bytes ELSE total_bytes - pb END AS bytes, "
           "CASE WHEN total_packets < pp THEN total_packets ELSE total_packets - pp END AS packets FROM (SELECT *, "
           "CASE WHEN lag(poll_id) OVER w = poll_id - 1 THEN lag(total_bytes) OVER w ELSE 0 END AS pb, "
           "CASE WHEN lag(poll_id) OVER w = poll_id - 1 THEN lag(total_packets) OVER w ELSE 0 END AS pp FROM snaps "
           "WINDOW w AS (PARTITION BY agent_id, src_ip, dst_port, proto ORDER BY poll_id)) AS l "
           "WHERE CASE WHEN total_bytes < pb THEN total_bytes ELSE total_bytes - pb END > 0")
_DELTA_COLS = "agent_id:s src_ip:s dst_ip:s proto:s src_port:l dst_port:l poll_id:l bytes:l packets:l"
check("counter_deltas", _DELTA_COLS, _DELTAS)
check("stream_deltas", _DELTA_COLS, _DELTAS)
check("live_rate", "event_id:l rate:d mbps:d",
      "SELECT event_id, s / 2.0 AS rate, s / 2.0 * 8 / 1e6 AS mbps FROM (SELECT event_id, CAST(sum(bytes) OVER (ORDER BY live_ts RANGE BETWEEN "
      "INTERVAL 1999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS DOUBLE) AS s FROM flows) AS r")
cte("tick_sums", "SELECT t, sum(bytes) AS s FROM (SELECT bytes, unnest([h, h + INTERVAL 1 HOUR]) AS t FROM (SELECT bytes, CASE WHEN date_trunc('hour', ts) = ts "
    "THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS h FROM flows) AS f) AS e GROUP BY 1")
check("live_rate_ticks", "tick:t rate:d mbps:d",
      "SELECT tick, coalesce(s, 0) / 7200.0::DOUBLE AS rate, coalesce(s, 0) / 7200.0::DOUBLE * 8 / 1e6 AS mbps FROM (SELECT unnest(generate_series((SELECT min(t) FROM tick_sums), "
      "(SELECT max(t) + INTERVAL 1 HOUR FROM tick_sums), INTERVAL 1 HOUR)) AS tick) AS g LEFT JOIN tick_sums ON t = tick")
check("rolling_baseline", "tenant:s ts:t mbps_p95:d spray_p95:d",
      f"SELECT tenant, ts, {_p95('mbps')}, {_p95('spray')} FROM tick_rows {_BASE_WINDOW}")
_SCORE = " + ".join(
    f"CASE WHEN {c} > {c}_p95 THEN {w!r} * least(greatest({c} / ({c}_p95 + 1e-9) - 1, 0), 1) ELSE 0 END" for c, w in _SIGNALS.items())
check("lowslow_score", "tenant:s ts:t score:d label:s",
      "SELECT tenant, ts, score, CASE WHEN score >= 70 THEN 'likely low-and-slow' WHEN score >= 40 THEN 'anomalous' ELSE 'normal' END AS label "
      f"FROM (SELECT tenant, ts, least(greatest(CASE WHEN mbps > 200 THEN 0.6 ELSE 1 END * ({_SCORE}), 0), 100) AS score FROM based_ticks) AS s")
check("carry_forward", "event_id:l last_flow_bytes:l last_unique:l",
      "SELECT event_id, last_value(CASE WHEN event_type <> 'view' THEN bytes END IGNORE NULLS) OVER w AS last_flow_bytes, "
      "last_value(CASE WHEN k > 90 THEN k END IGNORE NULLS) OVER w AS last_unique FROM flows "
      "WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
check("carry_forward_by_agent", "event_id:l agent_id:s last_signup_bytes:l",
      "SELECT event_id, agent_id, last_value(CASE WHEN event_type = 'signup' THEN bytes END IGNORE NULLS) OVER "
      "(PARTITION BY agent_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_signup_bytes FROM flows")
check("drops_rate", "ts:t drops_total:l delta:l shown_delta:l",
      "SELECT ts, drops_total, d AS delta, CASE WHEN d > 0 THEN d END AS shown_delta FROM (SELECT *, drops_total - lag(drops_total, 1, drops_total) "
      "OVER (ORDER BY ts) AS d FROM (SELECT ts, sum(n) OVER (ORDER BY ts) AS drops_total FROM (SELECT date_trunc('hour', ts) AS ts, "
      "count(*) FILTER (WHERE dropped) AS n FROM applied GROUP BY 1) AS h) AS c) AS l")
check("bounded_history", "scope:s event_id:l bytes:l",
      "SELECT * FROM (SELECT 'all' AS scope, event_id, bytes FROM flows ORDER BY ts DESC, event_id DESC LIMIT 60) AS a UNION ALL "
      "SELECT agent_id, event_id, bytes FROM (SELECT * FROM flows QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY ts DESC, event_id DESC) "
      "<= 120) AS b")
check("metric_scrape", "metric:s label:s ts:t value:d",
      "SELECT 'agent_cpu' AS metric, agent_id AS label, time_bucket(INTERVAL '5 seconds', live_ts) + INTERVAL '5 seconds' AS ts, "
      "arg_max(k + 0.5, live_ts) AS value FROM flows GROUP BY 2, 3")
check("metric_series", "metric:s label:s ts:t value:l", "SELECT * FROM counter_rows")


def _rate(seconds: int, where: str) -> str:
    return (f"SELECT metric, label, ts, value, sum(inc) OVER (PARTITION BY metric, label ORDER BY ts RANGE BETWEEN INTERVAL "
            f"{seconds * 1_000_000 - 1} MICROSECONDS PRECEDING AND CURRENT ROW) / {float(seconds)!r} AS rate FROM counter_steps WHERE {where}")


check("metric_rate_1m", "metric:s label:s ts:t value:l rate:d", _rate(60, "true"))
check("metric_rate_1h", "metric:s label:s ts:t value:l rate:d", _rate(3600, "true"))
_TOPK = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY step_ts ORDER BY rate DESC, label) AS rank FROM ({0}) AS r) AS k WHERE rank <= {1}"
check("topk_dest_rate", "metric:s label:s step_ts:t rate:d rank:l", _TOPK.format(step_rates_sql("dest_bytes", 3600, 900), 5))
check("topk_port_rate", "metric:s label:s step_ts:t rate:d rank:l", _TOPK.format(step_rates_sql("port_bytes", 3600, 900), 10))
check("protocol_rate", "metric:s label:s step_ts:t rate:d", step_rates_sql("protocol_bytes", 60, 15))
check("resample_linear", "series:s idx:l value:d",
      "SELECT g.scenario AS series, g.k AS idx, a.value + (b.value - a.value) * (g.pos - g.lo) AS value FROM "
      "(SELECT *, CAST(least(floor(pos), last) AS BIGINT) AS lo FROM (SELECT scenario, max(idx) AS last, i AS k, i * max(idx) / 29.0::DOUBLE AS pos "
      "FROM samples, range(30) AS t(i) GROUP BY scenario, i) AS s) AS g JOIN samples AS a ON a.scenario = g.scenario AND a.idx = g.lo "
      "JOIN samples AS b ON b.scenario = g.scenario AND b.idx = least(g.lo + 1, g.last)")
check("agent_cpu_history", "tick:l tick_ts:t agent_id:s cpu:d",
      "SELECT tick, t.ts AS tick_ts, a.agent_id, arg_max(f.k + 0.5, (f.ts, f.event_id)) AS cpu FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS tick FROM "
      "(SELECT ts, event_id FROM flows ORDER BY ts DESC, event_id DESC LIMIT 60) AS r) AS t, (SELECT DISTINCT agent_id FROM flows) AS a "
      "JOIN flows AS f ON f.agent_id = a.agent_id WHERE (f.ts, f.event_id) <= (t.ts, t.event_id) GROUP BY 1, 2, 3")

# --- policy -----------------------------------------------------------------------------------------------------

check("normalize_policy_events", "ts:t seq:l action:s ip:s ttl_s:l expiry:t", "SELECT * FROM rules")
check("policy_apply", "event_id:l dropped:b", "SELECT event_id, dropped FROM applied")
check("stream_policy", "event_id:l dropped:b", "SELECT event_id, dropped FROM applied")
check("policy_dropped", "event_id:l ts:t src_ip:s bytes:l", "SELECT event_id, ts, src_ip, bytes FROM applied WHERE dropped")
check("policy_passed", "event_id:l ts:t src_ip:s bytes:l", "SELECT event_id, ts, src_ip, bytes FROM applied WHERE NOT dropped")
check("policy_drops_total", "drops_total:l", "SELECT count(*) FILTER (WHERE dropped) AS drops_total FROM applied")
check("active_rules", "moment:s match:s ip:s expires_in_s:d", " UNION ALL ".join(
    f"SELECT '{at}' AS moment, 'src_ip' AS match, ip, round_even(left_us / 1e6, 1) AS expires_in_s FROM (SELECT ip, epoch_us(arg_max(coalesce(expiry, TIMESTAMP "
    f"'1970-01-01'), (ts, seq))) - epoch_us(any_value(now)) AS left_us FROM rules, (SELECT arg_max({col}, (expiry, ts)) AS now FROM rules WHERE expiry IS NOT NULL) AS n "
    "WHERE ts <= now GROUP BY 1) AS r WHERE left_us > 0" for at, col in (("start", "ts"), ("end", "expiry"))))

# --- documents and scenarios ------------------------------------------------------------------------------------

_TEXT = "concat_ws('|', src_ip, dst_ip, proto, src_port, dst_port, bytes)"
check("agent_payload", "agent_id:s poll_id:l agent_cpu:d flows_processed:l total_bytes:l total_packets:l unique_src_ips:l unique_src_ports:l "
      "unique_dst_ports:l unique_flows:l diversity_score:d heavy_flows:s",
      "SELECT *, unique_flows / greatest(1, flows_processed) AS diversity_score, coalesce(hf, '') AS heavy_flows FROM payload_rows LEFT JOIN "
      f"(SELECT agent_id, poll_id, string_agg({_TEXT}, ' ' ORDER BY rank) AS hf FROM batch_top GROUP BY ALL) AS h USING (agent_id, poll_id)")
_HIT = ("'{\"src_ip\":\"' || src_ip || '\",\"dst_ip\":\"' || dst_ip || '\",\"src_port\":' || src_port || ',\"dst_port\":' || dst_port || "
        "',\"proto\":\"' || proto || '\",\"bytes\":' || bytes || '}'")
check("push_document", "part:s document:s",
      "SELECT 'payload' AS part, '{\"agent_ip\":\"' || p.agent_id || '\",\"agent_cpu\":' || printf('%.1f', CAST(agent_cpu AS DOUBLE)) || ',\"total_bytes_delta\":' || coalesce(d, 0) || "
      "',\"cms\":{\"summary\":{\"type\":\"count_min_sketch\",\"total_bytes\":' || total_bytes || ',\"total_packets\":' || total_packets || "
      "',\"dimensions\":{\"width\":2048,\"depth\":5}},\"heavy_hitters_bytes\":[' || coalesce(h, '') || ']},\"hll\":{\"summary\":{\"type\":\"hyperloglog\",\"cardinalities\":{' || "
      + " || ',' || ".join(f"'\"{c}\":' || {c}" for c in ("unique_src_ips", "unique_src_ports", "unique_dst_ports", "unique_flows")) +
      " || '},\"diversity_score\":' || CAST(unique_flows / greatest(1, flows_processed) AS DOUBLE) || '}}}' AS document FROM payload_rows AS p LEFT JOIN "
      f"(SELECT agent_id, poll_id, sum(bytes) AS d, string_agg({_HIT}, ',' ORDER BY rank) AS h FROM batch_top GROUP BY ALL) AS t USING (agent_id, poll_id) "
      "UNION ALL SELECT 'prefix', '{\"heavy_hitters\":[{\"prefix\":\"' || prefix || '\",\"parent\":\"' || parent || '\",\"bytes\":' || bytes || '}]}' FROM prefixes")
cte("summary_top", f"SELECT flow, estimate FROM ({estimate_sql('metric_cells', 'distinct_flows', 'flow', where=repr('bytes') + ' = metric')}) AS e "
                   "ORDER BY estimate DESC, flow LIMIT 20")
check("summary_document", "part:s document:s",
      "SELECT 'head' AS part, '{\"timestamp\":\"" + I.ASOF + "\",\"flows_processed\":' || n || ',\"privacy_enabled\":false,\"cms\":{\"total_bytes\":' "
      "|| (3 * b) || ',\"total_packets\":' || p || ',\"heavy_hitters_bytes\":[' || hh || ']},\"hll\":{\"cardinalities\":{' || "
      + " || ',' || ".join(f"'\"unique_{x}\":' || unique_{x}" for x in ("src_ips", "dst_ips", "src_ports", "dst_ports", "flows")) +
      " || '}}}' AS document FROM cards, (SELECT count(*) AS n, sum(bytes) AS b, sum(packets) AS p FROM flows) AS t, "
      "(SELECT string_agg('{\"flow\":\"' || flow || '\",\"bytes\":' || estimate || '}', ',' ORDER BY estimate DESC, flow) AS hh FROM summary_top) AS s "
      "UNION ALL SELECT 'scanner', '{\"timestamp\":\"" + I.ASOF + "\",\"hll\":{\"port_scanners\":[{\"ip\":\"' || src_ip || '\",\"unique_ports\":' || "
      "unique_ports || '}]}}' FROM (" + count_sql(registers_sql("flows", "CAST(dst_port AS VARCHAR)", A12, "src_ip"), A12, "src_ip", "unique_ports") +
      ") AS c WHERE unique_ports >= 20")
cte("stats", "SELECT scenario, coalesce(avg(value) FILTER (WHERE metric = 'cpu'), 0) AS cpu_avg, coalesce(max(value) FILTER (WHERE metric = 'cpu'), 0) AS cpu_max, "
             "coalesce(avg(value) FILTER (WHERE metric = 'gbps'), 0) AS throughput_gbps FROM samples GROUP BY 1")
check("scenario_compare", "scenario:s cpu_avg:d cpu_max:d throughput_gbps:d loss_pct:d efficiency:d",
      "SELECT s.*, (b.throughput_gbps - s.throughput_gbps) / b.throughput_gbps * 100 AS loss_pct, CASE WHEN s.cpu_avg > 0 THEN "
      "s.throughput_gbps / s.cpu_avg ELSE 0 END AS efficiency FROM stats AS s, (SELECT throughput_gbps FROM stats WHERE scenario = 'Baseline') AS b")

# --- streams ----------------------------------------------------------------------------------------------------

check("stream_flow_windows", "window_start:t window_end:t agent_id:s " + _FIVE + " bytes:l packets:l first_seen:t last_seen:t",
      f"SELECT w AS window_start, w + INTERVAL '30 seconds' AS window_end, agent_id, {FIVE}, sum(bytes) AS bytes, sum(packets) AS packets, "
      "min(ts) AS first_seen, max(ts) AS last_seen FROM (SELECT *, time_bucket(INTERVAL '30 seconds', ts) AS w FROM flows) AS f "
      f"GROUP BY w, agent_id, {FIVE}")
check("stream_sketches", "sketch:s row_i:l col_j:l value:l",
      "SELECT metric AS sketch, row_i, col_j, cnt AS value FROM metric_cells UNION ALL "
      f"SELECT dimension, 0, register, rho FROM ({registers_sql('dims', 'value', A14, 'dimension')}) AS r")
check("stream_rate", "window_start:t window_end:t rate:d mbps:d",
      "SELECT w AS window_start, w + INTERVAL '2 seconds' AS window_end, sum(bytes) / 2.0::DOUBLE AS rate, sum(bytes) / 2.0::DOUBLE * 8 / 1e6 AS mbps FROM "
      "(SELECT bytes, date_trunc('second', live_ts) - to_seconds(i) AS w FROM flows, range(2) AS t(i)) AS f GROUP BY w")
check("stream_agent_state", "agent_id:s cpu:d bytes:l last_ts:t",
      "SELECT agent_id, arg_max(k + 0.5, (ts, event_id)) AS cpu, arg_max(bytes, (ts, event_id)) AS bytes, max(ts) AS last_ts FROM flows GROUP BY 1")
check("stream_counters", "metric:s label:s value:l", _COUNTERS.format("flows"))

_ENDED = ("SELECT *, CASE WHEN nxt <= expiry THEN nxt ELSE expiry END AS end_ts FROM (SELECT *, lead(ts) OVER w AS nxt, lead(action) OVER w AS next_action FROM rules "
          "WINDOW w AS (PARTITION BY ip ORDER BY ts, seq)) AS r WHERE action = 'block'")
check("stream_rule_expiry", "ip:s from_ts:t end_ts:t reason:s",
      "SELECT ip, ts AS from_ts, end_ts, CASE WHEN nxt <= expiry THEN CASE next_action WHEN 'block' THEN 'replaced' ELSE 'deleted' END ELSE 'expired' END AS reason "
      f"FROM ({_ENDED}) AS e WHERE end_ts > ts AND end_ts <= (SELECT max(ts) FROM rules) - INTERVAL 10 SECONDS")
_ANCHORED = (
    "SELECT agent_id, make_timestamp(start * 1000000) AS window_start, make_timestamp(next * 1000000) AS window_end, "
    f"{FIVE}, sum(bytes) AS bytes, sum(packets) AS packets, min(live_ts) AS first_seen, max(live_ts) AS last_seen FROM ("
    "WITH RECURSIVE secs AS (SELECT DISTINCT agent_id, CAST(floor(epoch_us(live_ts) / 1000000) AS BIGINT) AS s FROM flows), "
    "hops AS (SELECT a.agent_id, a.s, b.s AS next FROM secs AS a ASOF LEFT JOIN (SELECT agent_id, s, s - 30 AS at FROM secs) AS b "
    "ON a.agent_id = b.agent_id AND a.s <= b.at), "
    "chain AS (SELECT agent_id, min(s) AS s FROM secs GROUP BY agent_id UNION ALL "
    "SELECT h.agent_id, h.next FROM chain AS c JOIN hops AS h ON h.agent_id = c.agent_id AND h.s = c.s WHERE h.next IS NOT NULL), "
    "spans AS (SELECT c.agent_id, c.s AS start, h.next FROM chain AS c JOIN hops AS h ON h.agent_id = c.agent_id AND h.s = c.s) "
    "SELECT f.*, start, next FROM flows AS f JOIN spans AS p ON p.agent_id = f.agent_id AND epoch_us(f.live_ts) >= start * 1000000 "
    f"AND (next IS NULL OR epoch_us(f.live_ts) < next * 1000000)) AS m GROUP BY agent_id, start, next, {FIVE}")
_ANCHORED_COLS = "agent_id:s window_start:t window_end:t " + _FIVE + " bytes:l packets:l first_seen:t last_seen:t"
check("flow_windows_anchored", _ANCHORED_COLS, _ANCHORED)
check("stream_flow_windows_anchored", _ANCHORED_COLS, _ANCHORED)
CHECKS["stream_counter_dumps"] = CHECKS["src_counter_snapshots"]
check("distinct_over_ranges", "id:l lo:l hi:l exact:l near:b few_runs:b",
      "SELECT i.id, i.lo, i.hi, count(DISTINCT k.flow) AS exact, true AS near, true AS few_runs FROM (SELECT id, lo, lo + 1 + id * 37 % 500 AS hi FROM "
      "(SELECT event_id AS id, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS lo FROM flows WHERE event_id % 29 = 0) AS e) AS i LEFT JOIN "
      "(SELECT DISTINCT flow, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS slot FROM keyed) AS k ON k.slot >= i.lo AND k.slot < i.hi GROUP BY 1, 2, 3")
cte("arrivals", "SELECT *, CAST(floor((epoch_us(ts) - lo) * 4 / (hi - lo + 1)) AS BIGINT) AS part FROM keyed, "
    "(SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM flows) AS s")
cte("reported", "SELECT report, a.* FROM arrivals AS a, (SELECT unnest([0, 1, 2, 3, NULL]) AS report) AS r WHERE coalesce(report, 3) >= part")
_REPORT_DIMS = " UNION ALL ".join(
    f"SELECT report, '{n}' AS dimension, CAST({c} AS VARCHAR) AS value FROM reported"
    for n, c in (("src_ips", "src_ip"), ("dst_ips", "dst_ip"), ("src_ports", "src_port"), ("dst_ports", "dst_port"), ("flows", "flow")))
_DIMS = ("src_ips", "dst_ips", "src_ports", "dst_ports", "flows")
check("stream_reports", "report:l total_flows:l total_bytes:l total_packets:l " + " ".join(f"unique_{n}:l" for n in _DIMS) + " diversity_score:d",
      f"SELECT *, {_DIV} AS diversity_score FROM (SELECT report, count(*) AS total_flows, sum(bytes) AS total_bytes, sum(packets) AS total_packets "
      "FROM reported GROUP BY report) AS t JOIN (SELECT report AS of_report, " + ", ".join(f"max(estimate) FILTER (WHERE dimension = '{n}') AS unique_{n}" for n in _DIMS)
      + " FROM (" + count_sql(registers_sql(f"({_REPORT_DIMS})", "value", A14, "report, dimension"), A14, "report, dimension")
      + ") AS c GROUP BY report) AS u ON t.report IS NOT DISTINCT FROM of_report")
check("stream_metric_sink", "metric:s label:s ts:t value:l rate:d",
      f"SELECT * FROM ({_rate(60, 'true')}) AS r WHERE ts <= (SELECT max(ts) - INTERVAL 10 SECONDS FROM flows)")
CHECKS["stream_push"] = f"SELECT * FROM ({CHECKS['push_document']}) AS p WHERE part = 'payload'"
check("stream_hhh_bounded", "prefix:s bytes:l found:b bounded:b small_error:b",
      "SELECT prefix, bytes, true AS found, true AS bounded, true AS small_error FROM ("
      + prefix_sql("flows", "(SELECT ceil(sum(bytes) / 50.0) FROM flows WHERE bytes > 0)") + ") AS h")
