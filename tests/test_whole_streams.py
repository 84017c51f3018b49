"""Streams that stop and start again, against the batch over all their rows."""

import json
import random

import pytest

from emberglass.operators import causal
from emberglass.sources import live, pages
from emberglass.streaming import ledger, state

SCANS = "cell long, scan_s long, available_s long, flag int"


def day_of_features(path):
    """Ten features an hour, from the question alone."""
    ask = dict(x.split("=") for x in path.split("?")[1].split("&"))
    a, b, at = int(ask["from_s"]), int(ask["to_s"]), int(ask["startIndex"])
    every = [{"id": f"{t}", "properties": {"at_s": t}} for t in range(-(-a // 360) * 360, b, 360)]
    return json.dumps({"type": "FeatureCollection", "features": every[at : at + int(ask["limit"])]})


def broken(path):
    raise ValueError("no such collection")


def clock():
    return int(open("/tmp/emberglass-test-clock").read())


@pytest.fixture
def stored(spark):
    before = {k: spark.conf.get(k, None) for k in state.STORE}
    state.with_store(spark)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("seed", [1, 2])
def test_state_in_any_order_and_over_restarts(stored, tmp_path, seed):
    spark, rng = stored, random.Random(seed)
    scans = [(c, 600 * k, 600 * k + 1020, rng.choice([0, 1, 2, 3, 4, 5, None])) for c in range(3) for k in range(30)]
    order = sorted(scans, key=lambda r: r[1] + rng.uniform(0, 7200))  # up to two hours late
    files = [order[k : k + 12] for k in range(0, len(order), 12)]
    said = []
    for part, some in enumerate((files[:3], files[3:])):  # the second run finds the first one's state
        for k, rows in enumerate(some):
            spark.createDataFrame(rows + [(None, 5, 5, 1), rows[0]], SCANS).coalesce(1).write.parquet(f"{tmp_path}/in/{part}-{k:03d}")
        stream = spark.readStream.schema(SCANS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        q = state.carried(stream, keep_s=14_400, delay="3 hours").writeStream.foreachBatch(lambda df, n: said.extend(map(tuple, df.collect()))).outputMode("update")
        q = q.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
    got = {(r["cell"], r["scan_s"]): (r["flag"], r["state"]) for r in state.latest(spark.createDataFrame(said, state.OUT)).collect()}
    want = causal.carry_state(spark.createDataFrame(scans, SCANS), ["cell"], "scan_s").collect()
    assert got == {(r["cell"], r["scan_s"]): (r["flag"], r["state"]) for r in want}
    assert len(said) > len(scans)  # some were told again


def test_scans_beyond_the_kept_time(stored, tmp_path):
    spark = stored
    batches = [[(1, 0, 10, 1)], [(1, 600, 610, 3)], [(1, 90_000, 90_000, 3)], [(1, 100_000, 100_000, 3)], [(1, 300, 100_100, 0)], [(1, 100_600, 100_600, 4)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCANS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(SCANS).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        said = []
        q = state.carried(stream, keep_s=3600, delay="0 seconds").writeStream.foreachBatch(lambda df, n, said=said: said.extend(map(tuple, df.collect()))).outputMode("update").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
        batches[k] = said
    assert [b[0][1:4] for b in batches[:4]] == [(0, 1, True), (600, 3, True), (90_000, 3, True), (100_000, 3, True)]
    assert [x[-1] for x in batches[4]] == [True]  # its place was let go; what was said stays
    assert batches[5][0][3] is True  # the state came through the scans that went


def test_source_gives_the_batch_readers_rows_after_a_restart(spark, tmp_path):
    pages.register(spark)
    options = dict(collection="hotspots", from_s=50_000, transport="tests.test_whole_streams:day_of_features", wait=0, step_s=3600, lag_s=1020)
    for now in (50_000, 130_000, 130_100, 300_000):
        open("/tmp/emberglass-test-clock", "w").write(str(now))
        stream = spark.readStream.format("features").options(**options, clock="tests.test_whole_streams:clock").load()
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
        got = [r["at_s"] for r in spark.read.schema("id string, at_s long").parquet(f"{tmp_path}/out").collect()]
        to = max(50_000, (now - 1020) // 3600 * 3600)
        want = [r["at_s"] for r in spark.read.format("features").options(**options, to_s=to).load().collect()]
        assert sorted(got) == sorted(want) and len(set(got)) == len(got)
    assert len(got) > 600


def test_offsets_never_go_back():
    reader = pages.FeatureStreamReader({"collection": "c", "from_s": "7200", "to_s": "20000", "transport": "t", "clock": "tests.test_whole_streams:clock"})
    for now, at in ((0, 7200), (11_000, 10_800), (9000, 10_800), (10**9, 20_000)):
        open("/tmp/emberglass-test-clock", "w").write(str(now))
        assert reader.latestOffset() == {"at_s": at}
    again = pages.FeatureStreamReader({"collection": "c", "from_s": "7200", "transport": "t", "clock": "tests.test_whole_streams:clock"})
    assert [(d.start, d.end) for d in again.partitions({"at_s": 80_000}, {"at_s": 180_000})] == [(80_000, 86_400), (86_400, 172_800), (172_800, 180_000)]
    open("/tmp/emberglass-test-clock", "w").write("0")
    assert again.latestOffset() == {"at_s": 180_000}


ENTRY = "seq long, cursor_s long, fingerprint string, pocket string, payload string"


def test_ledger_takes_each_entry_once(spark, tmp_path):
    book = ledger.Ledger(spark, f"file://{tmp_path}/ledger")
    rows = lambda *x: spark.createDataFrame([(s, c, f, "p", None) for s, c, f in x], ENTRY)
    assert book.append(rows((1, 10, "a"), (2, 10, "a"), (3, 11, "a")), 0) and not book.append(rows((9, 99, "z")), 0)
    # an attempt that wrote but did not commit leaves nothing
    rows((50, 50, "torn")).write.json(f"file://{tmp_path}/ledger/segments/segment=1-lost")
    assert book.append(rows((4, 10, "a"), (5, 12, "b"), (None, 1, "x"), (6, None, "x")), 1)
    assert sorted((r["seq"], r["cursor_s"]) for r in book.entries().collect()) == [(1, 10), (3, 11), (5, 12)]
    assert book.unreadable().first()[0] == 0 and sorted(r["batch"] for r in book.commits().collect()) == [0, 1]
    segment = book.commits().filter("batch = 1").first()["segment"]
    (tmp_path / "ledger/segments" / f"segment={segment}" / "torn.json").write_text('{"seq":7,"cursor')
    assert book.unreadable().first()[0] == 1 and book.entries().count() == 3
    full = ledger.Ledger(spark, f"file://{tmp_path}/ledger", most_bytes=10)
    with pytest.raises(ledger.LedgerFull):
        full.append(rows((8, 8, "n")), 2)
    assert not full.append(rows((8, 8, "n")), 1)  # what is there is there


def test_ledger_stream_over_a_failed_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    feed = lambda k, rows: spark.createDataFrame(rows, ENTRY).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    book = ledger.Ledger(spark, f"file://{tmp_path}/ledger")
    stream = lambda: spark.readStream.schema(ENTRY).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    feed(0, [(1, 1, "a", "p", "x"), (2, 1, "a", "p", "y")])
    book.sink(stream(), f"{tmp_path}/check").awaitTermination(300)
    feed(1, [(3, 1, "a", "p", "z"), (4, 2, "a", "p", None)])
    lost = ledger.Ledger(spark, f"file://{tmp_path}/ledger")
    lost._commit = lambda *_: (_ for _ in ()).throw(OSError("gone"))
    with pytest.raises(Exception, match="gone"):
        lost.sink(stream(), f"{tmp_path}/check").awaitTermination(300)
    assert sorted(r["seq"] for r in book.entries().collect()) == [1]
    book.sink(stream(), f"{tmp_path}/check").awaitTermination(300)
    feed(2, [(5, 2, "a", "p", None), (6, 3, "a", "q", None)])
    book.sink(stream(), f"{tmp_path}/check").awaitTermination(300)
    assert sorted(r["seq"] for r in book.entries().collect()) == [1, 4, 6]


def test_live_or_replay(spark):
    ok = lambda: live.live(spark, 0, 90_000, "tests.test_whole_streams:day_of_features", wait=0)
    bad = lambda: live.live(spark, 0, 90_000, "tests.test_whole_streams:broken", wait=0)
    got = live.chosen(spark, ok, bad)
    assert got.groupBy("collection").count().filter("count = 250").count() == 3
    assert {(r["source_used"], r["fallback_reason"]) for r in got.select("source_used", "fallback_reason").distinct().collect()} == {("live", None)}
    pinned = live.chosen(spark, bad, ok).select("source_used", "fallback_reason").distinct().collect()
    assert len(pinned) == 1 and pinned[0]["source_used"] == "replay" and pinned[0]["fallback_reason"]
    with pytest.raises(Exception, match="no such collection"):
        live.chosen(spark, bad, bad)
    late = live.live(spark, 0, 3600, "tests.test_whole_streams:day_of_features", wait=0, deadline_s=-1)
    with pytest.raises(Exception, match="longer than"):
        late.collect()
