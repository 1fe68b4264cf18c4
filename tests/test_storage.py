"""Readers, writers, compaction and streams over real files."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from netstate.plans import NetState
from netstate.sources import capture, read, write
from netstate.sources.migrate import migrate_generic, migrate_table, rename_legacy
from netstate.streaming import cdc, compact, stateful, stream
from tests.conftest import rows
from tests.fixture_network import NS, T0, frame

HOUR = 3_600_000


def log_rows(spark):
    """One interface per host; states change over three hours, one key is deleted."""
    records = []
    for h in ("a1", "a2", "b1"):
        ns = "dc1" if h.startswith("a") else "dc2"
        for n, (state, active) in enumerate([("up", True), ("down", True), ("up", h != "a2")]):
            if h == "b1" and n == 1:
                continue
            records.append(dict(namespace=ns, hostname=h, ifname="eth0", state=state,
                                active=active, timestamp=T0 + n * HOUR + 5, numChanges=n))
    return frame(spark, "interfaces", records)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store"))
    write.write_raw(log_rows(spark), root, "interfaces")
    return root


def test_round_trip_and_partition_pruning(spark, root):
    df = read.read_table(spark, root, "interfaces", view="all")
    assert df.count() == 8
    one = read.read_table(spark, root, "interfaces", view="all", namespace=["dc2"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "dc2" in plan.split("PartitionFilters")[1][:200]
    assert one.count() == 2
    assert read.versions(spark, read.table_path(root, "interfaces")) == ["4.0"]
    assert read.stored_tables(spark, root) == ["interfaces"]
    assert read.read_table(spark, root, "bgp").count() == 0


def answers(spark, root):
    out = {}
    for name, kw in {
        "latest": {}, "asof1": dict(end=T0 + HOUR), "asof2": dict(end=T0 + 2 * HOUR + 10),
        "changes": dict(start=T0 + 1, end=T0 + 2 * HOUR + 10),
        "all": dict(view="all"), "since": dict(start=T0 + HOUR),
    }.items():
        df = read.read_table(spark, root, "interfaces", only_active=True, **kw)
        out[name] = rows(df, "namespace", "hostname", "ifname", "state", "timestamp", "active")
    return out


def test_compaction_does_not_change_answers(spark, root):
    before = answers(spark, root)
    now = T0 + 10 * HOUR
    stats = compact.compact_all(spark, root, "1h", now)
    mine = next(s for s in stats if s["service"] == "interfaces")
    # Eight rows and one carried row: b1 has no row in the second hour.
    assert mine["recCount"] == 9
    assert answers(spark, root) == before
    path = read.table_path(root, "interfaces", compacted=True)
    done = read.read_versions(spark, path, "interfaces")
    blocks = read.list_blocks(spark, path)
    assert len(blocks) == 6
    last = read.prune_blocks(done, blocks, HOUR)
    assert len({(r.namespace, r.block_start) for r in last.collect()}) == 2
    two = read.prune_blocks(done, blocks, HOUR, end=T0 + 2 * HOUR + 10)
    assert len({(r.namespace, r.block_start) for r in two.collect()}) == 4
    again = compact.compact_all(spark, root, "1h", now + 1)
    assert next(s for s in again if s["service"] == "interfaces")["recCount"] == 0
    coalescer = read.read_table(spark, root, "sqCoalescer", view="all")
    assert coalescer.where("service = 'interfaces'").count() == 2
    # A late row of an old block becomes a further file of that block.
    late = frame(spark, "interfaces", [dict(hostname="a1", ifname="eth0", state="late",
                                            timestamp=T0 + 6)])
    write.write_raw(late, root, "interfaces")
    third = compact.compact_table(spark, root, "interfaces", "1h", now)
    assert third["recCount"] == 1


@pytest.mark.parametrize("remove", [True, False])
def test_late_rows_reach_later_blocks(spark, tmp_path, remove):
    root = str(tmp_path)
    write.write_raw(log_rows(spark), root, "interfaces")
    compact.compact_table(spark, root, "interfaces", "1h", T0 + 10 * HOUR, remove)
    late = frame(spark, "interfaces", [
        dict(namespace="dc2", hostname="b1", ifname="eth0", state="late", timestamp=T0 + 6),
        dict(namespace="dc1", hostname="c1", ifname="eth0", state="lost", timestamp=T0 + 7),
        dict(namespace="dc1", hostname="a1", ifname="eth0", state="gap", timestamp=T0 + 5 * HOUR)])
    write.write_raw(late, root, "interfaces")
    before = answers(spark, root)
    compact.compact_table(spark, root, "interfaces", "1h", T0 + 10 * HOUR, remove)
    assert bool(list((tmp_path / "interfaces").rglob("*.parquet"))) != remove
    assert answers(spark, root) == before
    states = {(h, s) for _, h, _, s, _, _ in before["latest"]}
    assert states == {("a1", "gap"), ("b1", "up"), ("c1", "lost")}
    again = compact.compact_table(spark, root, "interfaces", "1h", T0 + 10 * HOUR, remove)
    assert again["recCount"] == 0
    asof = read.read_table(spark, root, "interfaces", end=T0 + HOUR + 30)
    assert {("b1", "late"), ("c1", "lost")} <= {(r.hostname, r.state) for r in asof.collect()}


def test_open_block_is_left_out(spark, tmp_path):
    write.write_raw(log_rows(spark), str(tmp_path), "interfaces")
    stats = compact.compact_table(spark, str(tmp_path), "interfaces", "1h", T0 + HOUR + 100)
    assert stats["recCount"] == 3


def test_consumed_files_may_be_removed(spark, tmp_path):
    root = str(tmp_path)
    write.write_raw(log_rows(spark), root, "interfaces")
    before = answers(spark, root)
    compact.compact_table(spark, root, "interfaces", "1h", T0 + 10 * HOUR, remove_consumed=True)
    assert not list((tmp_path / "interfaces").rglob("*.parquet"))
    assert answers(spark, root) == before


def test_conform(spark):
    df = spark.createDataFrame([("h", "x9", ["1", "z"])], "hostname string, mtu string, vlan array<string>")
    got = write.conform_for_write(df.withColumn("ipAddressList", F.lit("1.1.1.1/32")).drop("vlan"),
                                  "interfaces").first()
    assert (got.mtu, got.ipAddressList, got.active, got.sqvers, got.state) == (
        0, ["1.1.1.1/32"], True, "4.0", "")


def test_old_versions_are_migrated(spark, tmp_path):
    root = str(tmp_path)
    write.write_raw(frame(spark, "macs", [dict(hostname="h", macaddr="m", oif="p1")]), root, "macs")
    old = spark.createDataFrame(
        [("00042", "m2", "p9", T0, True, "1.0", NS)],
        "hostname string, macaddr string, origIfname string, timestamp bigint, active boolean, "
        "sqvers string, namespace string")
    old.write.mode("append").partitionBy("sqvers", "namespace", "hostname").parquet(
        read.table_path(root, "macs"))
    got = read.read_table(spark, root, "macs", view="all")
    assert rows(got, "hostname", "oif", "sqvers") == [("00042", "p9", "2.0"), ("h", "p1", "2.0")]
    assert migrate_table(spark, root, "macs", remove_old=True) == ["1.0"]
    assert read.versions(spark, read.table_path(root, "macs")) == ["2.0"]
    assert rows(read.read_table(spark, root, "macs", view="all"), "oif") == [("p1",), ("p9",)]
    bad = spark.createDataFrame([("h", "notanumber")], "hostname string, vlan string")
    with pytest.raises(PySparkException):
        migrate_generic(bad, "macs").collect()
    assert "ifname" in rename_legacy(spark.createDataFrame([("a",)], "origIfname string"),
                                     "vlan").columns


def test_audit_finds_and_moves_broken_files(spark, root, tmp_path):
    base = tmp_path / "t"
    write.write_raw(log_rows(spark), str(base), "interfaces")
    broken = base / "interfaces" / "sqvers=4.0" / "namespace=dc1" / "hostname=a1" / "bad.parquet"
    broken.write_bytes(b"not parquet")
    bad = read.audit_parquet(spark, str(base))
    assert [r.path.split("/")[-1] for r in bad.collect()] == ["bad.parquet"]
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        read.read_table(spark, str(base), "interfaces", view="all").collect()
    assert read.read_log(spark, str(base), "interfaces", ignore_corrupt=True).count() == 8
    assert read.quarantine(spark, str(base), bad) == 1
    assert not broken.exists() and list((base / "_broken").rglob("bad.parquet"))


def test_export(spark, net, tmp_path):
    write.export(net.get("interfaces"), str(tmp_path / "csv"), "csv")
    write.export(net.get("interfaces"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == net.get("interfaces").count()
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() > 0
    write.export(net.summarize("interfaces"), str(tmp_path / "sum"), "csv", summary=True)
    assert "dc1" in spark.read.option("header", True).csv(str(tmp_path / "sum")).columns
    with pytest.raises(ValueError):
        write.export(net.get("interfaces"), str(tmp_path / "x"), "xml")


def record(host, ts, data, status=0):
    return dict(status=status, timestamp=ts, cmd_timestamp=ts, cmd="show", devtype="eos",
                namespace=NS, hostname=host, address="1.1.1.1", version="4.20", data=data)


def test_capture_files(spark, tmp_path):
    first = json.dumps([record("h1", 1, 'a "]" b\n[c'), record("h2", 1, "x")], indent=2)
    second = json.dumps([record("h3", 1, "y", 2011)])
    (tmp_path / "vlan.output").write_text(first + "\n" + second + "\n" + second)
    got = capture.read_capture(spark, str(tmp_path))
    assert rows(got, "hostname", "data") == [
        ("h1", 'a "]" b\n[c'), ("h2", "x"), ("h3", "y"), ("h3", "y")]


def vlans(spark, ts, pairs, host="h1"):
    return frame(spark, "vlan", [
        dict(hostname=host, vlanName=f"vlan{v}", vlan=v, interfaces=ports, state="active",
             timestamp=ts) for v, ports in pairs])


def test_change_capture_appends_only_changes(spark, tmp_path):
    root = str(tmp_path)
    cdc.store_changes(spark, root, "vlan", vlans(spark, 10, [(1, ["a", "b"]), (2, ["a"])]))
    same = cdc.store_changes(spark, root, "vlan", vlans(spark, 20, [(1, ["b", "a"]), (2, ["a"])]))
    assert same.count() == 0
    new = cdc.store_changes(spark, root, "vlan", vlans(spark, 30, [(1, ["c"]), (3, ["a"])]))
    assert rows(new, "vlan", "active", "timestamp") == [(1, True, 30), (2, False, 30),
                                                        (3, True, 30)]
    gone = cdc.store_changes(spark, root, "vlan", vlans(spark, 40, [])[["namespace", "hostname"]],
                             polled=vlans(spark, 40, [(1, [])]), deleted_at=40)
    assert rows(gone, "vlan", "active", "timestamp") == [(1, False, 40), (3, False, 40)]
    net = NetState(spark, root)
    assert net.get("vlan").count() == 0 and net.get("vlan", end=35).count() == 2
    boots = spark.createDataFrame([(NS, "h1", 99_000)], "namespace string, hostname string, boot bigint")
    cdc.store_changes(spark, root, "vlan", vlans(spark, 50, [(1, ["a"])]), boots)
    again = cdc.store_changes(spark, root, "vlan", vlans(spark, 60, [(1, ["a"])]), boots.withColumn(
        "boot", F.lit(103_000).cast("bigint")))
    assert again.count() == 0
    restarted = cdc.store_changes(spark, root, "vlan", vlans(spark, 70, [(1, ["a"])]),
                                  boots.withColumn("boot", F.lit(200_000).cast("bigint")))
    assert rows(restarted, "vlan", "deviceSession") == [(1, 200_000)]


def test_change_capture_stream(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def drop(name, ts, entries):
        body = json.dumps(entries)
        (source / name).write_text(json.dumps([record("h1", ts, body)]))

    def normalise(batch):
        ok = batch.where("status in (0, 200)")
        parsed = ok.select("namespace", "hostname", "timestamp", F.explode(F.from_json(
            "data", "array<struct<vlan:bigint,state:string>>")).alias("v"))
        return parsed.select("namespace", "hostname", "timestamp", "v.*", F.concat(
            F.lit("vlan"), "v.vlan").alias("vlanName"))

    def run():
        query = stream.cdc_stream(stream.capture_stream(spark, str(source)), root, "vlan",
                                  str(tmp_path / "cp"), normalise)
        query.awaitTermination()

    drop("1.output", 10, [{"vlan": 1, "state": "active"}, {"vlan": 2, "state": "active"}])
    run()
    drop("2.output", 20, [{"vlan": 1, "state": "active"}])
    drop("3.output", 30, [{"vlan": 1, "state": "suspended"}])
    run()
    log = read.read_table(spark, root, "vlan", view="all")
    assert rows(log, "vlan", "state", "timestamp", "active") == [
        (1, "active", 10, True), (1, "suspended", 30, True), (2, "active", 10, True),
        (2, "active", 20, False)]


def test_failed_polls_are_held_back(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def run(ts, status, entries=()):
        body = [dict(record("h1", ts, json.dumps(list(entries)), status))]
        (source / f"{ts}.output").write_text(json.dumps(body))
        stream.cdc_stream(stream.capture_stream(spark, str(source)), root, "vlan",
                          str(tmp_path / "cp"), normalise).awaitTermination()
        log = read.read_table(spark, root, "vlan", view="all", only_active=False)
        return rows(log, "vlan", "timestamp", "active")

    def normalise(batch):
        ok = batch.where("status in (0, 200)")
        parsed = ok.select("namespace", "hostname", "timestamp", F.explode(F.from_json(
            "data", "array<struct<vlan:bigint>>")).alias("v"))
        return parsed.select("namespace", "hostname", "timestamp", "v.*", F.concat(
            F.lit("vlan"), "v.vlan").alias("vlanName"))

    first = [(1, 10, True)]
    assert run(10, 0, [{"vlan": 1}]) == first
    assert run(20, 2011) == first
    assert run(30, 2011) == first
    assert run(40, 0, [{"vlan": 1}]) == first
    assert run(50, 2011) == first and run(60, 2011) == first
    assert run(70, 2011) == [*first, (1, 70, False)]


CAPTURE = ("namespace string, hostname string, timestamp long, status long, "
           "entries array<struct<vlanName:string,vlan:bigint,state:string,interfaces:array<string>>>")


def vlan(n, state="active", members=()):
    return (f"vlan{n}", n, state, list(members))


def test_stateful_change_capture(spark, tmp_path):
    """Captures of many micro-batches, or all in one, give the changes one by one gives."""
    captures = [
        ("h1", 10, 0, [vlan(1, members=["a", "b"]), vlan(2)]),
        ("h1", 20, 0, [vlan(1, members=["b", "a", "a"]), vlan(3), vlan(3, "suspended")]),
        ("h1", 30, 2011, None), ("h1", 40, 2011, [vlan(9)]), ("h1", 50, 200, [vlan(1)]),
        ("h1", 60, 2011, []), ("h1", 70, 2011, []), ("h1", 80, 2011, []), ("h1", 90, 2011, []),
        ("h1", 100, None, [vlan(1)]), ("h1", 110, 0, None),
        ("h2", 10, 2011, [vlan(5)]), ("h2", 20, 0, [vlan(5)]), ("h2", 15, 0, [vlan(6)]),
    ]
    want = [
        ("h1", 10, "vlan1", True), ("h1", 10, "vlan2", True), ("h1", 20, "vlan2", False),
        ("h1", 20, "vlan3", True), ("h1", 50, "vlan1", True), ("h1", 50, "vlan3", False),
        ("h1", 80, "vlan1", False), ("h1", 100, "vlan1", True), ("h1", 110, "vlan1", False),
        ("h2", 10, "vlan8", False), ("h2", 20, "vlan5", True)]
    for split in (1, 4, len(captures)):
        source, root = str(tmp_path / f"in{split}"), str(tmp_path / f"out{split}")
        write.write_raw(spark.createDataFrame(
            [("ns", "h2", "vlan8", 8, 1)],
            "namespace string, hostname string, vlanName string, vlan long, timestamp long"),
            root, "vlan")
        size = -(-len(captures) // split)
        for at in range(0, len(captures), size):
            spark.createDataFrame([("ns", *c) for c in captures[at:at + size]], CAPTURE).coalesce(
                1).write.mode("append").parquet(source)
            stream_in = spark.readStream.schema(CAPTURE).parquet(source)
            stateful.store_captured_changes(
                stream_in, root, "vlan", str(tmp_path / f"cp{split}")).awaitTermination()
        log = read.read_table(spark, root, "vlan", view="all", only_active=False)
        # In its own micro-batch a capture older than the last one is left out.
        late = [] if split == len(captures) else [
            ("h2", 15, "vlan6", True), ("h2", 20, "vlan6", False)]
        got = rows(log.where("timestamp > 1"), "hostname", "timestamp", "vlanName", "active")
        assert got == sorted(want + late, key=str), split


def test_state_calls_of_a_host():
    """Every call to the state is a round trip: one reads a host's rows, one writes them."""
    import pandas as pd

    calls = []

    class Value:
        now = None

        def get(self):
            calls.append("get")
            return self.now

        def update(self, value):
            calls.append("update")
            self.now = value

    class Handle:
        getValueState = staticmethod(lambda name, schema: Value())

    processor = stateful._processor(3, False, None)
    processor.init(Handle())
    held = pd.DataFrame({"keys": ["a", "b"], "hashes": [1, 2], "rows": ["ra", "rb"]})
    processor.handleInitialState(("ns", "h"), held, None)
    calls.clear()
    captures = pd.DataFrame({
        "timestamp": [20, 10, 30], "status": [0, 0, 2011],
        "keys": [["a", "c"], ["a", "b"], []], "hashes": [[5, 3], [1, 2], []],
        "rows": [["ra2", "rc"], ["ra", "rb"], []]})
    out = pd.concat(processor.handleInputRows(("ns", "h"), iter([captures]), None))
    assert calls == ["get", "update"]
    assert list(zip(out.timestamp, out.active, out.row)) == [
        (20, True, "ra2"), (20, True, "rc"), (20, False, "rb")]
    assert processor.host.now == (1, 30, ["a", "c"], [5, 3], ["ra2", "rc"])


def test_silent_hosts(spark, tmp_path):
    """A host that is not polled any more is named once the watermark has passed its time."""
    source = str(tmp_path / "in")
    minute = 60_000

    def drop(*captures):
        spark.createDataFrame([("ns", h, T0 + t * minute, 0, [vlan(1)]) for h, t in captures],
                              CAPTURE).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream_in = spark.readStream.schema(CAPTURE).parquet(source)
        changes = stateful.captured_changes(
            stream_in, ["vlanName"], silent_ms=30 * minute, delay="1 minute")
        changes.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "cp")).trigger(
            availableNow=True).start().awaitTermination()

    drop(("gone", 0), ("there", 0))
    run()
    drop(("there", 20))
    run()
    drop(("there", 45))
    run()
    got = spark.read.parquet(str(tmp_path / "out")).where("silent")
    assert [r.hostname for r in got.collect()] == ["gone"]


POLL = ("namespace string, hostname string, service string, timestamp bigint, status bigint, "
        "totalTime bigint, gatherTime bigint")


def polls(spark):
    seq = [0, 2011, 2011, 2011, 0, 2011, 0]
    return spark.createDataFrame(
        [(NS, "h", "bgp", T0 + n * 60_000, s, 10 * n, n) for n, s in enumerate(seq)], POLL)


def test_failure_hysteresis_batch_and_stream(spark, tmp_path):
    want = [True, False, False, True, True, False, True]
    got = [r.commit for r in cdc.failure_streaks(polls(spark)).orderBy("timestamp").collect()]
    assert got == want
    polls(spark).write.parquet(str(tmp_path / "p"))
    source = spark.readStream.schema(POLL).parquet(str(tmp_path / "p"))
    table = stream.run_now(stream.hysteresis_stream(source), "hysteresis")
    assert [r.commit for r in table.orderBy("timestamp").collect()] == want


def test_poll_stats_stream_and_dedup_stream(spark, tmp_path):
    polls(spark).write.parquet(str(tmp_path / "p"))
    source = spark.readStream.schema(POLL).parquet(str(tmp_path / "p"))
    stats = stream.run_now(stream.poll_stats_stream(source), "pollstats", "complete",)
    first = stats.orderBy("window").first()
    assert first.totalTime[0] == 0.0 and first.totalTime[2] < first.totalTime[1]
    spark.read.parquet(str(tmp_path / "p")).write.mode("append").parquet(str(tmp_path / "p"))
    twice = spark.readStream.schema(POLL).parquet(str(tmp_path / "p"))
    once = stream.run_now(stream.dedup_stream(twice, ["namespace", "hostname", "service"]), "dd")
    assert once.count() == 7


def test_raw_stream_sink(spark, tmp_path):
    log_rows(spark).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(log_rows(spark).schema).parquet(str(tmp_path / "in"))
    path = read.table_path(str(tmp_path / "out"), "interfaces")
    stream.raw_stream_sink(source, path, str(tmp_path / "cp")).awaitTermination()
    assert read.read_table(spark, str(tmp_path / "out"), "interfaces", view="all").count() == 8
