"""Store round trips, intermediate tables, and streams fed in several batches."""

import pytest
from conftest import day
from pyspark.sql import functions as F

from tapeflow.operators import book
from tapeflow.plans.ranges import RANGE, number_ranged, ranged
from tapeflow.plans.tables import keep, scratch
from tapeflow.sources import bars, payloads, snapshots, store, upsert
from tapeflow.streaming import backfill
from tapeflow.streaming import bars as bar_stream
from tapeflow.streaming import books as book_stream


@pytest.fixture
def some_bars(frame):
    rows = [(s, day(i), 1.0, 2.0, 0.5, 1.5, 10.0) for s in ("BTC/USDT", "ETH/USDT") for i in range(5)]
    return frame(rows, bars.BAR_SCHEMA)


def test_store_keeps_kinds_and_symbols_apart(spark, some_bars, tmp_path):
    path = str(tmp_path / "store")
    at = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    assert store.load(spark, path, "price") is None
    store.save(some_bars, path, "price", at)
    store.save(some_bars.where("symbol = 'BTC/USDT'").withColumn("close", F.lit(9.0)), path, "dataset", at)
    # Saving one symbol again leaves the other in place.
    store.save(some_bars.where("symbol = 'BTC/USDT'").limit(2), path, "price", at)
    assert store.load(spark, path, "price", "BTC/USDT").count() == 2
    assert store.load(spark, path, "price", "ETH/USDT").count() == 5
    assert store.load(spark, path, "dataset").count() == 5
    cat = {(r["symbol"], r["kind"]): r["rows"] for r in store.catalog(spark.read.parquet(path)).collect()}
    assert cat == {("BTC/USDT", "price"): 2, ("ETH/USDT", "price"): 5, ("BTC/USDT", "dataset"): 5}
    assert store.delete(spark, path, "BTC/USDT", "price") == 1
    assert store.load(spark, path, "price", "BTC/USDT") is None
    assert store.delete(spark, path, "BTC/USDT") == 1
    with pytest.raises(ValueError):
        store.save(some_bars, path, "other", at)


def test_partition_filter_reaches_the_scan(spark, some_bars, tmp_path):
    path = str(tmp_path / "store")
    store.save(some_bars, path, "price", F.lit("2024-02-01").cast("timestamp_ntz"))
    df = store.load(spark, path, "price", "BTC/USDT").select("ts", "close").where("close > 1")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan and "PushedFilters: [IsNotNull(close)" in plan
    assert "open" not in plan.split("ReadSchema")[1]


def test_keep_lies_under_the_checkpoint_folder(spark, some_bars):
    kept = keep(some_bars)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert all(base.replace("file:", "").rstrip("/") in f for f in kept.inputFiles())
    assert kept.schema == some_bars.schema and kept.count() == 10


def test_first_page_wins(frame):
    rows = [("s", 1, 1000, 2.0), ("s", 0, 1000, 1.0), ("s", 1, 2000, 3.0)]
    raw = frame([(s, p, ms, c, c, c, c, c) for s, p, ms, c in rows], bars.RAW_BAR_SCHEMA)
    got = sorted((r["ts"].second, r["close"]) for r in bars.merge_pages(raw).collect())
    assert got == [(1, 1.0), (2, 3.0)]


def test_payload_records_that_do_not_parse_are_skipped(frame):
    docs = ['{"data":[{"timestamp":"1704067200","value":"55"},{"timestamp":"x","value":"1"}]}',
            '{"data":[{"timestamp":"1704070800","value":"60"},{"timestamp":"1704153600","value":"n/a"}]}', "not json", "{}"]
    out = payloads.parse_fear_greed(frame(list(enumerate(docs)), "seq int, payload string"))
    assert [(str(r["d"]), r["value"]) for r in out.collect()] == [("2024-01-01", 60.0)]


def some_books(n):
    rows = []
    for i in range(n):
        size = 5.0 if i % 4 else 1.0
        deep = 6 if i % 5 else 2
        rows.append(("s", day(0, i), [(100.0 - j, size) for j in range(deep)], [(101.0 + j, 2.0) for j in range(6)]))
    return rows


def test_tracker_state_survives_restarts(spark, frame, tmp_path):
    """Two runs over the same checkpoint equal one batch over everything."""
    rows = some_books(40)
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    for part in (rows[:17], rows[17:]):
        frame(part, book_stream.BOOK_SCHEMA, 2).write.mode("append").parquet(src)
        q = book_stream.track(book_stream.read_books(spark, src), out, ckpt, available_now=True)
        q.awaitTermination()
    got = {r["ts"]: (r["state"], round(r["smoothed"], 9)) for r in book_stream.read_tracked(spark, out).collect()}
    batch = book.track(book.signals(frame(rows, book_stream.BOOK_SCHEMA)))
    assert got == {r["ts"]: (r["state"], round(r["smoothed"], 9)) for r in batch.collect()}
    assert {s for s, _ in got.values()} >= {"THIN BOOK", "BUY PRESSURE"}


def test_repeated_snapshots_are_recorded_once(spark, frame, tmp_path):
    rows = some_books(6)
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    frame(rows + rows[:3], book_stream.BOOK_SCHEMA, 2).write.parquet(src)
    book_stream.record(book_stream.read_books(spark, src), out, ckpt, available_now=True).awaitTermination()
    assert spark.read.parquet(out).count() == 6


def test_streamed_bars_close_with_the_watermark(spark, frame, tmp_path):
    ticks = [("s", day(0, i // 4), i, float(i), 1.0) for i in range(12)]
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    frame(ticks, bar_stream.TICK_SCHEMA, 2).write.parquet(src)
    b = bar_stream.stream_bars(bar_stream.read_ticks(spark, src))
    bar_stream.write_bars(b, out, ckpt, available_now=True).awaitTermination()
    got = sorted((r["ts"], r["open"], r["close"], r["volume"]) for r in spark.read.parquet(out).collect())
    # The newest tick is at two o'clock, two minutes short of closing the second bar.
    assert got == [(day(0, 0), 0.0, 3.0, 4.0)]


def test_depth_of_a_book_is_bounded(frame):
    rows = [("s", day(0), "bid", float(i), 1.0, i) for i in range(80)]
    levels = frame(rows, "symbol string, ts timestamp_ntz, side string, price double, size double, seq int")
    r = snapshots.assemble_books(levels).first()
    assert len(r["bids"]) == 50 and r["bids"][0]["price"] == 79.0 and r["asks"] == []


def test_history_reader(spark, frame, tmp_path):
    path = str(tmp_path / "h")
    row = ("s", 1704067200000, 1.0, 1.0, 0.0, 0.1, 0.01, 1, 2, 10.0)
    frame([row], snapshots.SNAPSHOT_SCHEMA, 1).write.parquet(path)
    assert snapshots.read_history(spark, path).first()["ts"] == day(0)


def test_streams_keep_every_row_however_many_files(spark, frame, tmp_path):
    """The same input in 1 and in 70 shuffled files gives the same rows."""
    books = some_books(70)
    ticks = [("s", day(i // 8, i % 8), i, float(i), 1.0) for i in range(240)]
    seen = []
    for files in (1, 70):
        p = {x: str(tmp_path / f"{x}{files}") for x in ("b", "t", "o1", "c1", "o2", "c2", "o3", "c3")}
        frame(books, book_stream.BOOK_SCHEMA, files).write.parquet(p["b"])
        frame(ticks, bar_stream.TICK_SCHEMA, files).write.parquet(p["t"])
        stream = book_stream.read_books(spark, p["b"])
        qs = [book_stream.track(stream, p["o1"], p["c1"], available_now=True),
              book_stream.record(stream, p["o2"], p["c2"], available_now=True),
              bar_stream.write_bars(bar_stream.stream_bars(bar_stream.read_ticks(spark, p["t"])), p["o3"], p["c3"], available_now=True)]
        for q in qs:
            q.awaitTermination()
            assert book_stream.late_rows(q) == 0
        read = [book_stream.read_tracked(spark, p["o1"]), spark.read.parquet(p["o2"]), spark.read.parquet(p["o3"])]
        seen.append([sorted(map(str, df.collect())) for df in read])
    assert seen[0] == seen[1]
    assert len(seen[0][0]) == 70 and len(seen[0][1]) == 70 and len(seen[0][2]) == 238


def test_ranges_count_rows_whatever_the_skew(frame):
    """Nine tenths of the rows belong to one symbol and one hour: positions hold, ranges stay short."""
    rows = [("hot", day(0), i) for i in range(1800)] + [(f"s{i % 20}", day(i), i) for i in range(200)]
    df = ranged(keep(frame(rows, "symbol string, ts timestamp_ntz, seq bigint")), ["symbol"], ["ts", "seq"], rows=100)
    assert df.groupBy(RANGE).count().agg(F.max("count")).first()[0] < 250
    got = number_ranged(df, ["symbol"], total="n").collect()
    want = {}
    for s, t, i in sorted(rows):
        want.setdefault(s, []).append((t, i))
    assert {(r["symbol"], r["ts"], r["seq"]): (r["rn"], r["n"]) for r in got} == {
        (s, t, i): (k, len(v)) for s, v in want.items() for k, (t, i) in enumerate(v)}


def test_scratch_tables_go_and_results_stay(spark, some_bars):
    with scratch() as last:
        inner = keep(some_bars)
        kept = last(keep(inner.where("ts is not null")))
        folder = inner.inputFiles()[0]
    assert kept.count() == 10
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(folder).count()


@pytest.mark.parametrize("files", [1, 300])
def test_backfill_admits_shuffled_files_in_order_of_time(spark, frame, tmp_path, files):
    """Whatever the files hold, ten at once leave the rows of the batch operators; none is late."""
    books = [(f"s{k}", *b[1:]) for k in (1, 2) for b in some_books(60)] + [("late", *b[1:]) for b in some_books(60)[50:]]
    ticks = [(f"s{i % 2}", day(i // 40, i // 2 % 20), i, float(i), 1.0) for i in range(400)]
    p = {x: str(tmp_path / x) for x in ("b", "t", "o1", "r1", "o2", "r2", "o3", "r3")}
    frame(books + books[:9], book_stream.BOOK_SCHEMA, files).write.parquet(p["b"])
    frame(ticks, bar_stream.TICK_SCHEMA, files).write.parquet(p["t"])
    runs = [(backfill.backfill_tracker(spark, p["b"], p["o1"], p["r1"], per_step=10, rows=16), "b", book_stream.BOOK_SCHEMA, "r1"),
            (backfill.backfill_records(spark, p["b"], p["o2"], p["r2"], per_step=50), "b", book_stream.BOOK_SCHEMA, "r2"),
            (backfill.backfill_bars(spark, p["t"], p["o3"], p["r3"], per_step=50), "t", bar_stream.TICK_SCHEMA, "r3")]
    for q, source, schema, root in runs:
        q.awaitTermination()
        assert q.exception() is None
        assert backfill.lost_rows(spark, p[source], schema, p[root]) == 0
    row = lambda r: (r["symbol"], r["ts"], r["state"], round(r["smoothed"], 9), r["confidence"], r["reliable"])
    whole = book.track(keep(book.signals(frame(books, book_stream.BOOK_SCHEMA))))
    assert sorted(map(row, book_stream.read_tracked(spark, p["o1"]).collect())) == sorted(map(row, whole.collect()))
    assert spark.read.parquet(p["o2"]).count() == len(books)
    closed = bars.ticks_to_bars(frame(ticks, bar_stream.TICK_SCHEMA), "1 hour").where(F.col("ts") < F.lit(day(9, 18)))
    assert sorted(map(str, spark.read.parquet(p["o3"]).drop("batch").collect())) == sorted(map(str, closed.collect()))


def test_backfill_goes_on_where_it_stopped(spark, frame, tmp_path):
    """A step that fails leaves the earlier ones done; a second start runs the rest once."""
    src, root = str(tmp_path / "src"), str(tmp_path / "root")
    for i in (5, 1, 6, 3, 0, 7, 2, 4):
        frame([("s", day(i), [], [])], book_stream.BOOK_SCHEMA, 1).write.mode("append").parquet(src)
    done, broken = [], [3]

    def process(rows, step):
        if step in broken:
            raise ValueError("stop")
        done.append((step, rows.count()))

    q = backfill.backfill(spark, src, book_stream.BOOK_SCHEMA, root, process, per_step=2)
    with pytest.raises(Exception, match="stop"):
        q.awaitTermination()
    broken.clear()
    backfill.backfill(spark, src, book_stream.BOOK_SCHEMA, root, process, per_step=2).awaitTermination()
    assert done == [(0, 2), (1, 2), (2, 2), (3, 2)]
    assert backfill.lost_rows(spark, src, book_stream.BOOK_SCHEMA, root) == 0


def test_upsert_rewrites_touched_partitions_only(spark, frame, tmp_path):
    path, schema = str(tmp_path / "t"), "part string, id bigint, v double"
    rows = [(p, i, float(i)) for p in ("a", "b=c", "d") for i in range(4)] + [(None, 9, 9.0)]
    key = ["part", "id"]
    assert upsert.upsert(spark, path, frame(rows, schema), key, "part", "1")
    before = {f for f in spark.read.parquet(path).inputFiles() if "part=d" in f}
    changes = frame([("a", 1, 10.0, False), ("a", 7, 7.0, False), ("a", 2, None, True), *(("b=c", i, None, True) for i in range(4))],
                    schema + ", gone boolean")
    for first in (True, False):  # a version counts once
        assert upsert.upsert(spark, path, changes, key, "part", "2") == first
    stored = spark.read.schema(schema).parquet(path)
    got = {tuple(r) for r in stored.select("part", "id", "v").collect()}
    assert got == {("a", 0, 0.0), ("a", 1, 10.0), ("a", 3, 3.0), ("a", 7, 7.0), *(("d", i, float(i)) for i in range(4)), (None, 9, 9.0)}
    assert {f for f in spark.read.parquet(path).inputFiles() if "part=d" in f} == before
    assert {(r["version"], r["rows"], r["partitions"]) for r in upsert.versions(spark, path).collect()} == {("1", 13, 4), ("2", 7, 2)}
    with pytest.raises(ValueError):
        upsert.upsert(spark, path, changes, ["id"], "part", "3")


def test_upsert_cuts_a_large_partition_into_files(spark, frame, tmp_path):
    path, schema = str(tmp_path / "t"), "part string, id bigint, v double"
    rows = [("a", i, 0.0) for i in range(900)] + [("b", i, 0.0) for i in range(100)]
    for version, v in (("1", 0.0), ("2", 1.0)):
        changes = frame([(p, i, v) for p, i, _ in rows], schema)
        assert upsert.upsert(spark, path, changes, ["part", "id"], "part", version, file_rows=100)
        stored = spark.read.schema(schema).parquet(path)
        assert stored.groupBy("_metadata.file_path").count().agg({"count": "max"}).first()[0] < 260
        assert sorted(tuple(r) for r in stored.select("part", "id", "v").collect()) == [(p, i, v) for p, i, _ in rows]
