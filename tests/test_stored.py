"""Sketches that are loaded, merged with new data and saved under the same name; readers of files."""

import os

import pytest

from flowscope.functions.hashing import CmsSpec, HllSpec
from flowscope.functions.net import flow_key
from flowscope.operators import countmin as cm
from flowscope.operators import loglog as ll
from flowscope.plans import inputs as I
from flowscope.sources import summaries, telemetry

SF = "/root/testdata/sf0.001"


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))


def test_load_merge_and_save_in_place(spark, tmp_path):
    flows, path = I.flows(spark, SF), str(tmp_path)
    for k in range(4):
        part = flows.where(f"event_id % 4 = {k}")
        cells, registers = cm.cms_build(part, flow_key(), "bytes"), ll.hll_build(part, flow_key())
        if k:
            cells = cm.cms_merge(cm.load_cms(spark, path, "bytes", CmsSpec()), cells)
            registers = ll.hll_merge(ll.load_registers(spark, path, "flows", HllSpec()), registers)
        cm.save_cms(cells, path, "bytes")
        ll.save_registers(registers, path, "flows")
    assert same(cm.cms_build(flows, flow_key(), "bytes").cells, cm.load_cms(spark, path, "bytes", CmsSpec()).cells)
    assert same(ll.hll_build(flows, flow_key()).table, ll.load_registers(spark, path, "flows", HllSpec()).table)
    assert len([f for f in os.listdir(f"{path}/sketch_id=bytes") if f.startswith("epoch=")]) == 2
    os.makedirs(f"{path}/sketch_id=bytes/epoch=9")  # an attempt that did not finish
    assert cm.load_cms(spark, path, "bytes", CmsSpec()).cells.count() > 0
    with pytest.raises(FileNotFoundError):
        cm.load_cms(spark, path, "other", CmsSpec())


def test_telemetry_is_read_from_files(spark, tmp_path):
    lines = I.telemetry_lines(spark, SF)
    lines.coalesce(2).write.text(str(tmp_path / "telemetry"))
    assert same(telemetry.parse_telemetry(lines), telemetry.read_telemetry(spark, str(tmp_path / "telemetry")))


def test_newest_summary_file_of_each_peer_is_read(spark, tmp_path):
    folder = tmp_path / "summaries"
    folder.mkdir()
    for k, (name, text) in enumerate([
        ("p1-old.json", '{"peer": "p1", "timestamp": "t0", "flows_processed": 5}'), ("p1-new.json", '{"peer": "p1", "timestamp": "t1", "flows_processed": 7}'),
        ("p2.json", '{"peer": "p2", "timestamp": "t1", "flows_processed": 1}'), ("p3.json", '{"peer": "p3", "time'),
    ]):
        (folder / name).write_text(text)
        os.utime(folder / name, (1000 + k, 1000 + k))
    newest = summaries.latest_per_peer(summaries.read_peer_summaries(spark, str(folder)).where("peer is not null"))
    assert sorted((r.peer, r.timestamp, r.flows_processed) for r in newest.collect()) == [("p1", "t1", 7), ("p2", "t1", 1)]
