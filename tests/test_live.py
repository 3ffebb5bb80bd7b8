"""Tables in versions, batches of decisions against one loop, and summaries of a live stream."""

import datetime as dt
import json
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import decisions as dec
from sparkloom.plans import live
from sparkloom.sources import shared
from sparkloom.sources.versions import VersionedTable
from sparkloom.streaming.summaries import due_turns

SCHEMA = "point_id int, source_path string, t string"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_a_change_writes_the_buckets_of_its_sources_only(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "point_id", "source_path", buckets=16)
    first = [(i, f"s{i % 40}", "old") for i in range(400)]
    assert table.read() is None
    assert len(table.apply(spark.createDataFrame(first, SCHEMA), 0)) > 8
    before = table.manifest()["buckets"]
    touched = table.apply(spark.createDataFrame([(7, "s7", "new"), (7, "s7", "new"), (1000, "s7", "more")], SCHEMA), 1)
    after = table.manifest()["buckets"]
    assert len(touched) == 1 and {b for b in after if after[b] != before.get(b)} == {str(touched[0])}
    want = [r for r in first if r[1] != "s7"] + [(7, "s7", "new"), (1000, "s7", "more")]
    assert rows_of(table.read()) == sorted(want)
    assert rows_of(table.read(manifest=table.manifest(table.versions()[0]))) == sorted(first)  # the version before stays readable


def test_replays_and_dead_writers_change_nothing(spark, tmp_path):
    at = str(tmp_path / "t")
    table = VersionedTable(spark, at, "point_id", "source_path", buckets=4, keep=1)
    table.apply(spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], SCHEMA), 0)
    assert table.apply(spark.createDataFrame([(1, "a", "other")], SCHEMA), 0) is None
    assert rows_of(table.read()) == [(1, "a", "x"), (2, "b", "y")]
    # a writer of epoch 1 that died before its manifest: readers see nothing of it, and the next one replaces it
    spark.createDataFrame([(9, "z", "junk", 0)], SCHEMA + ", bucket int").write.partitionBy("bucket").parquet(f"{at}/data/e1")
    assert rows_of(table.read()) == [(1, "a", "x"), (2, "b", "y")]
    table.apply(spark.createDataFrame([(3, "b", "z")], SCHEMA), 1)
    assert rows_of(table.read()) == [(1, "a", "x"), (3, "b", "z")]
    assert len(table.versions()) == 1
    # a source whose rows all went, a null source, an empty batch
    table.apply(spark.createDataFrame([(4, None, "n")], SCHEMA), 2)
    table.apply(spark.createDataFrame([], SCHEMA), 3)
    assert rows_of(table.read().where("source_path IS NOT NULL")) == [(1, "a", "x"), (3, "b", "z")] and table.read().count() == 3
    named = set(table.manifest()["buckets"].values())
    assert set(shared.names(spark, f"{at}/data")) == named


def test_two_writers_of_one_version(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "point_id", "source_path", buckets=4)
    table.apply(spark.createDataFrame([(1, "a", "x")], SCHEMA), 0)
    shared.publish(spark, f"{table.path}/manifest/{1:012d}.json", json.dumps({**table.manifest(), "version": 0}))  # another was first
    assert table.apply(spark.createDataFrame([(1, "a", "y")], SCHEMA), 1) is None


def brute_decisions(apps, stock, strict=False):
    taken, qty, out = defaultdict(list), Counter(), {}
    for item, size, n in stock:
        qty[item, size] += n or 0
    meets = lambda s, e, b, f: s <= b <= e or s <= f <= e or strict and s <= f and e >= b
    for a in apps:
        if a["status"] == "accepted" and None not in (a["host"], a["starts"], a["ends"]):
            taken[a["host"]].append((a["starts"], a["ends"]))
    for a in sorted(apps, key=lambda a: (a["at"], a["id"])):
        status, role, when, refused = a["status"], None, None, None
        timed = None not in (a["host"], a["starts"], a["ends"])
        if a["decision"] is None:
            pass
        elif a["status"] != "pending":
            refused = "already decided"
        elif a["decision"] not in ("accepted", "rejected"):
            refused = "unknown decision"
        elif a["decision"] == "accepted" and timed and any(meets(s, e, a["starts"], a["ends"]) for s, e in taken[a["host"]]):
            refused = "overlapping assignment"
        elif a["decision"] == "accepted" and None not in (a["item"], a["size"]) and qty[a["item"], a["size"]] <= 0:
            refused = "insufficient stock"
        else:
            status, when = a["decision"], a["as_of"]
            if status == "accepted":
                given = a["role"] if a["role"] is not None else a["requested_role"]
                role = given.lower() if given is not None else None
                if timed:
                    taken[a["host"]].append((a["starts"], a["ends"]))
                if None not in (a["item"], a["size"]):
                    qty[a["item"], a["size"]] -= 1
        out[a["id"]] = status, role, when, refused
    return out, qty


COLUMNS = "id long, host long, event long, at timestamp, starts timestamp, ends timestamp, status string, decision string, requested_role string, role string, item string, size int, as_of timestamp"


def made_applications(n, hosts, seed):
    rng = np.random.default_rng(seed)
    day = lambda lo, hi: dt.datetime(2024, 1, 1) + dt.timedelta(hours=int(rng.integers(lo, hi)))
    pick = lambda *x: x[int(rng.integers(0, len(x)))]
    apps = []
    for i in rng.permutation(n):
        begin = day(0, 2000)
        host = None if rng.random() < 0.02 else int(0 if rng.random() < 0.4 else rng.integers(0, hosts))
        apps.append(dict(
            id=int(i), host=host, event=int(rng.integers(0, 20)), at=day(0, 200), starts=None if rng.random() < 0.02 else begin, ends=begin + dt.timedelta(hours=int(rng.choice([0, 1, 5, 30, 400]))),
            status=pick("pending", "pending", "pending", "pending", "accepted" if rng.random() < 0.3 else "pending", "rejected"), decision=pick("accepted", "accepted", "accepted", "rejected", "later", None),
            requested_role=pick("Host", None), role=pick("Team_Leader", None, None), item=pick("dress", "coat", None), size=pick(1, 2, None), as_of=dt.datetime(2025, 1, 1),
        ))
    return apps, [("dress", 1, 5), ("dress", 1, 3), ("dress", 2, 0), ("coat", 1, 40), ("coat", 2, None)]


@pytest.mark.parametrize(("n", "hosts", "strict"), [(300, 12, False), (300, 12, True), (2000, 3, False)])
def test_decisions_are_those_of_one_loop(spark, n, hosts, strict):
    apps, stock = made_applications(n, hosts, n + hosts)
    frame = spark.createDataFrame([tuple(a[c.split()[0]] for c in COLUMNS.split(", ")) for a in apps], COLUMNS).repartition(3)
    stocks = spark.createDataFrame(stock, "item string, size int, qty int")
    got = dec.decided(spark, frame, stocks, strict)
    want, qty = brute_decisions(apps, stock, strict)
    rows = got.collect()
    assert {r["id"]: (r["status"], r["assigned_role"], r["decided_at"], r["refused"]) for r in rows} == want
    assert {"overlapping assignment", "insufficient stock", "already decided", "unknown decision", None} == {r["refused"] for r in rows}
    first = {}
    for a in sorted(apps, key=lambda a: (a["at"], a["id"])):
        if want[a["id"]][0] == "accepted" and want[a["id"]][2] and want[a["id"]][1] == "team_leader":
            first[a["event"]] = a["host"]
    assert {r["event"]: r["leader"] for r in dec.leaders(got).collect()} == first
    left = Counter()
    taken = Counter((a["item"], a["size"]) for a in apps if want[a["id"]][0] == "accepted" and want[a["id"]][2] and None not in (a["item"], a["size"]))
    for r in dec.stock_left(frame, got, stocks.groupBy("item", "size").agg(F.sum("qty").alias("qty"))).collect():
        left[r["item"], r["size"]] = r["qty"]
        assert r["qty"] == sum(q or 0 for i, s, q in stock if (i, s) == (r["item"], r["size"])) - taken[r["item"], r["size"]]
    assert all(left[k] == v for k, v in qty.items())


def test_a_refusal_for_stock_leaves_the_host_free(spark):
    """A chain in which each refusal turns the next decision: the two rules alternate once for each link."""
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    apps, stock = [], []
    for i in range(12):  # the first of a host fails for stock, so the second gets the time and the piece that the next host's first wanted
        for j in range(2):
            apps.append(dict(id=2 * i + j, host=i, event=i, at=day(2 * i + j), starts=day(0), ends=day(1), status="pending", decision="accepted", requested_role=None, role=None, item=f"c{i + j}", size=1, as_of=day(99)))
        stock.append((f"c{i + 1}", 1, 1))
    frame = spark.createDataFrame([tuple(a[c.split()[0]] for c in COLUMNS.split(", ")) for a in apps], COLUMNS)
    stocks = spark.createDataFrame(stock, "item string, size int, qty int")
    got = {r["id"]: (r["status"], r["assigned_role"], r["decided_at"], r["refused"]) for r in dec.decided(spark, frame, stocks).collect()}
    assert got == brute_decisions(apps, stock)[0]
    with pytest.raises(RuntimeError, match="still change"):
        dec.decided(spark, frame, stocks, rounds=2)


def test_turns_take_only_what_is_not_settled(spark, monkeypatch):
    """A chain of turns, among many rows that hang on nothing: these are not written again in each turn."""
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    common = dict(starts=day(0), ends=day(1), status="pending", decision="accepted", requested_role=None, role=None, size=1, as_of=day(99))
    apps = [dict(id=2 * i + j, host=i, event=i, at=day(2 * i + j), item=f"c{i + j}", **common) for i in range(4) for j in range(2)]
    apps += [dict(id=100 + i, host=100 + i // 2, event=i, at=day(i % 9), item=None, **common) for i in range(400)]
    stock = [(f"c{i + 1}", 1, 1) for i in range(4)]
    frame = spark.createDataFrame([tuple(a[c.split()[0]] for c in COLUMNS.split(", ")) for a in apps], COLUMNS)
    written, keep = [], dec.kept

    def counting(df, name):
        written.append(keep(df, name))
        return written[-1]

    monkeypatch.setattr(dec, "kept", counting)
    got = {r["id"]: (r["status"], r["assigned_role"], r["decided_at"], r["refused"]) for r in dec.decided(spark, frame, spark.createDataFrame(stock, "item string, size int, qty int")).collect()}
    assert got == brute_decisions(apps, stock)[0]
    assert sum(w.count() for w in written) < 3 * len(apps)  # once as they are, once walked; the chain has more turns


def test_decisions_of_nothing(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert not dec.decided(spark, none, spark.createDataFrame([], "item string, size int, qty int")).collect()


def test_decisions_on_whole_tables(spark, sf_dir):
    applications, stock = live._applications(spark, sf_dir)
    apps = [r.asDict() for r in applications.collect()]
    assert len(apps) == len({a["id"] for a in apps}) > 4000
    want, _ = brute_decisions(apps, [tuple(r) for r in stock.select("item", "size", "qty").collect()])
    got = {r["id"]: (r["status"], r["assigned_role"], r["decided_at"], r["refused"]) for r in live.application_decisions(spark, sf_dir).collect()}
    assert got == want and len({w[3] for w in want.values()}) == 5


def test_turns_that_come_late_or_again(spark, tmp_path):
    schema, home = "conv_id long, turn long, role string", str(tmp_path)
    said = lambda turns, conv=1: [(conv, t, "user" if t % 2 == 0 else "assistant") for t in turns]
    waves = [
        said([0, 1, 2, 1, 1]) + said([0, 1], 2) + [(None, 1, "user"), (3, None, "user")],
        said([2, 3, 3]),  # four turns: not more than the trigger
        said([4, 1]) + [(2, 7, "system"), (2, 8, "user"), (2, 9, "user"), (2, 10, "user")],  # five: all but the last two are due; 1 came again
        said([2, 6, 7]),  # 2 is late: its summary is written
        said([5]),  # late too, after 4 and before 6, which are open
    ]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        for wave in waves:
            spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").parquet(f"{home}/in")
            due = due_turns(spark.readStream.schema(schema).parquet(f"{home}/in"), 2, 4)
            query = due.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/ck").trigger(availableNow=True).start()
            assert query.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = sorted((r["conv_id"], r["turn"], r["part"]) for r in spark.read.parquet(f"{home}/out").collect())
    assert got == [(1, 0, 1), (1, 1, 1), (1, 2, 1), (1, 3, 2), (1, 4, 2), (1, 5, 3), (2, 0, 1), (2, 1, 1), (2, 8, 1)]
