import os

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators.networks import memberships, star_edges
from ledgerlake.sources.segments import HeadMoved, Ledger
from ledgerlake.sources.tables import DeviceTable
from ledgerlake.streaming.streams import arriving_in_order, run_available

SCHEMA = "device string, version long, path string, value int"


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.startswith("part-")}


def test_a_delivery_replaces_its_devices_and_touches_no_other_bucket(spark, tmp_path):
    path = f"{tmp_path}/facts"
    of = lambda rows: spark.createDataFrame(rows, SCHEMA)
    heads = lambda rows: spark.createDataFrame(rows, "device string, version long")
    t = DeviceTable(spark, path, of([]).schema, "device", "version", 16)
    assert t.read().count() == 0
    t.replace(heads([(f"d{i}", 1) for i in range(20)]), of([(f"d{i}", 1, p, i) for i in range(20) for p in "ab"]))
    before = files(path)
    second = heads([("d3", 2), ("d5", 2), ("d5", 2), ("new", 1), (None, 9)]), of([("d3", 2, "c", 9), ("d3", 1, "old", 0), ("new", 1, "x", None), ("other", 1, "x", 1), (None, 9, "x", 1)])
    t.replace(*second)
    want = {(f"d{i}", 1, p, i) for i in range(20) if i not in (3, 5) for p in "ab"} | {("d3", 2, "c", 9), ("new", 1, "x", None)}
    assert {tuple(r) for r in t.read().collect()} == want
    assert {tuple(r) for r in t.devices().collect()} == {(f"d{i}", 1) for i in range(20) if i not in (3, 5)} | {("d3", 2), ("d5", 2), ("new", 1)}
    bucket = lambda d: spark.range(1).select(F.pmod(F.xxhash64(F.lit(d)), F.lit(16))).first()[0]
    changed = {f"__bucket={bucket(d)}" for d in ("d3", "d5", "new")}
    after = files(path)
    assert {f for f in before if f not in after or after[f] != before[f]} == {f for f in before if f.split("/")[-2] in changed}
    for again in (second, (heads([("d3", 1)]), of([("d3", 1, "late", 1)])), (heads([]), of([]))):
        t.replace(*again)
        assert sorted(map(str, t.read().collect())) == sorted(map(str, {r for r in t.read().collect()})) and {tuple(r) for r in t.read().collect()} == want


def test_two_writers_make_one_chain(spark, tmp_path):
    a, b = Ledger(spark, f"{tmp_path}/ledger"), Ledger(spark, f"{tmp_path}/ledger")
    rows = lambda n, m: spark.range(n, m).select("id", (F.col("id") % 3).alias("kind"), F.when(F.col("id") % 2 == 0, "x").alias("note"))
    assert a.head() == (0, "") and a.broken() == []
    one = a.append(rows(0, 10), ["id"], "")
    with pytest.raises(HeadMoved):
        b.append(rows(10, 20), ["id"], "")  # it saw the empty ledger
    two = b.append_retrying(rows(10, 20), ["id"])
    assert [c["parent"] for c in a.commits()] == ["", one] and a.head() == (2, two)
    # both write under one head: the second to create the commit loses, and nothing of it is read
    class Late(Ledger):
        def _create(self, path, data):
            if not getattr(self, "beaten", False):
                self.beaten = True
                a.append(rows(30, 31), ["id"], two)
            return super()._create(path, data)

    Late(spark, f"{tmp_path}/ledger").append_retrying(rows(40, 45), ["id"])
    assert [c["number"] for c in a.commits()] == [1, 2, 3, 4] and a.broken() == []
    got = a.read().orderBy("commit", "seq").collect()
    assert [r.id for r in got] == [*range(20), 30, *range(40, 45)] and [r.seq for r in got] == [*range(10), *range(10), 0, *range(5)]


def test_changed_records_show(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/ledger")
    head = ledger.append(spark.range(9000), ["id"], "")
    ledger.append(spark.range(3), ["id"], head)
    assert ledger.broken() == []
    first = ledger.commits()[0]["segment"]
    kept = spark.createDataFrame([tuple(r) for r in spark.read.parquet(f"{tmp_path}/ledger/segments/{first}").collect()], "id long, seq long")
    kept.withColumn("id", F.when(F.col("seq") == 5000, -1).otherwise(F.col("id"))).write.mode("overwrite").parquet(f"{tmp_path}/ledger/segments/{first}")
    assert ledger.broken() == [1]


def test_state_of_a_stream_ends_after_its_horizon(spark, tmp_path):
    day = 86_400_000_000
    rows = spark.range(4000).select("id", F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 40 * day // 4000).alias("ts"))
    twice = arriving_in_order(rows, "ts", f"{tmp_path}/in", 20, again=1)
    once = twice.withWatermark("ts", "5 days").dropDuplicatesWithinWatermark(["id"])
    held = run_available(once, lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}"), f"{tmp_path}/checkpoint")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(4000))
    assert len(held) >= 20 and max(held) < 1500  # of 4,000 keys


def test_networks_are_stars(spark):
    rows = [(d, f"10.0.0.{d}", "255.255.255.0") for d in range(1, 200)] + [(5, "10.9.9.5", "255.255.0.0"), (6, "10.9.1.6", "255.255.0.0"), (7, "nonsense", "255.255.0.0"), (8, None, None), (None, "10.0.0.3", "255.255.255.0"), (5, "10.0.0.5", "255.255.255.0")]
    m = memberships(spark.createDataFrame(rows, "d int, a string, m string"), "d", "a", "m")
    got = {tuple(r) for r in star_edges(m).collect()}
    assert got == {("10.0.0.0/24", 1, d) for d in range(2, 200)} | {("10.9.0.0/16", 5, 6)}


def test_a_delivery_that_changes_nothing_writes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i}", 2, "a", i) for i in range(20)], SCHEMA)
    t = DeviceTable(spark, f"{tmp_path}/facts", rows.schema, "device", "version", 4)
    t.replace(rows.select("device", "version"), rows)
    before = files(t.path)
    for version in (1, 2):
        late = rows.withColumn("version", F.lit(version).cast("long"))
        t.replace(late.select("device", "version"), late)
    assert files(t.path) == before and t.read().count() == 20
