import json
import time
from pathlib import Path

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfwise import schemas
from shelfwise.plans.batch import run_batch
from shelfwise.registry.files import written
from shelfwise.sources import files, messages, pages, tables
from shelfwise.operators.snapshots import merged_view
from shelfwise.plans.versions import VersionedViews, folder_names
from shelfwise.streaming import realtime as R
from shelfwise.streaming import streams as S

EVENTS = [("u1", "p1", "view", "2024-01-01 00:00:00"), ("u1", "p1", "purchase", "2024-01-02 00:00:00"),
          ("u2", "p2", "add_to_cart", None)]


def write_lines(path, records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))
    return str(path)


def test_raw_scan_falls_back_and_keeps_bad_lines(spark, tmp_path):
    path = write_lines(tmp_path / "in" / "a.json", [{"product_id": "1", "rating": 4}, "{broken"])
    got = files.scan_raw_products(spark, str(tmp_path / "absent"), path).collect()
    assert (got[0].product_id, got[0].rating, got[0]._corrupt_record) == ("1", 4.0, None)
    assert got[1]._corrupt_record == "{broken"
    with pytest.raises(FileNotFoundError):
        files.scan_raw_reviews(spark, str(tmp_path / "absent"))
    with pytest.raises(ValueError):
        files.scan_raw(spark, "orders", path)


def test_runs(spark, tmp_path):
    base = str(tmp_path)
    for run, n in (("20240101_0900", 3), ("20240102_0900", 5)):
        files.write_run(spark.range(n), base, "products", run, "2024-01-01")
    files.write_run(spark.range(4), base, "products", "20240102_0900", "2024-01-02")
    assert files.scan_processed(spark, base, "products").count() == 4
    assert files.scan_processed(spark, base, "products", newest_only=False).count() == 7
    newest = files.scan_processed(spark, base, "products")
    assert newest.columns[-1] == "run_ts" and {r.run_ts for r in newest.collect()} == {"20240102_0900"}
    (tmp_path / "products" / "run_ts=20240103_0900" / "_temporary").mkdir(parents=True)  # a run that is being written
    assert files.scan_processed(spark, base, "products").count() == 4
    assert all("run_ts=20240102_0900" in f for f in newest.inputFiles())
    with pytest.raises(ValueError):
        files.scan_processed(spark, base, "orders")


def test_json_arrays_directories_and_exports(spark, tmp_path):
    folder = tmp_path / "in"
    record = dict(zip(("user_id", "product_id", "action", "timestamp"), EVENTS[0]))
    write_lines(folder / "behavior_1.json", [json.dumps([record, record], indent=1)])
    write_lines(folder / "behavior_2.json", [json.dumps(record)])
    write_lines(folder / "other.txt", ["[]"])
    loaded = files.scan_directory(spark, str(folder), "behavior_*.json", schemas.RAW_EVENT)
    assert rows(files.rows_per_file(loaded)) == [("behavior_1.json", 2), ("behavior_2.json", 1)]
    files.export_csv(spark, str(folder / "behavior_1.json"), str(tmp_path / "csv"), schemas.RAW_EVENT)
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == list(record) and back.count() == 2
    for fmt in files.FORMATS:
        files.save_result(loaded, str(tmp_path / fmt), fmt)
    with pytest.raises(ValueError):
        files.save_result(loaded, str(tmp_path / "x"), "xml")
    assert spark.read.json(files.write_zone(loaded, str(tmp_path), "raw", "b", "json")).count() == 3
    with pytest.raises(ValueError):
        files.write_zone(loaded, str(tmp_path), "elsewhere", "b")


def test_catalog_tables_and_parameters(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "name string, n int")
    tables.materialize_tables(spark, "shop_test", {"things": df})
    tables.materialize_tables(spark, "shop_test", {"things": df.where("n = 1")})
    assert spark.table("shop_test.things").count() == 1
    tables.register_views({"things": df})
    hostile = tables.run_sql(spark, "SELECT * FROM things WHERE name = :name", {"name": "a' OR '1'='1"})
    assert hostile.count() == 0
    assert tables.run_sql(spark, "SELECT * FROM things WHERE name = :name", {"name": "b"}).first().n == 2
    full = tables.create_index(spark, "catalog", df.schema, "pre_")
    tables.create_index(spark, "catalog", df.schema, "pre_")
    assert spark.table(full).columns == ["doc_id", "name", "n"]
    tables.delete_index(spark, "catalog", "pre_")
    tables.delete_index(spark, "catalog", "pre_")
    with_gap = df.unionByName(spark.createDataFrame([(None, 3)], df.schema))
    assert tables.bulk_load_index(with_gap, "loaded_by_name", "name") == (2, 3)
    assert tables.bulk_load_index(df, "loaded_by_place", order=["n"]) == (2, 2)
    assert rows(spark.table("loaded_by_place"), "doc_id", "name") == [("0", "a"), ("1", "b")]


def test_publish_route_and_drain(spark, tmp_path):
    bus = messages.Bus.files(str(tmp_path / "bus"))
    source = write_lines(tmp_path / "user_1.json", [json.dumps([
        dict(zip(("user_id", "product_id", "action", "timestamp"), e)) for e in EVENTS])])
    sent = messages.publish_file(spark, bus, source, schemas.RAW_EVENT, key="user_id", as_of=F.lit("now"))
    assert sent == 3
    got = bus.batch(spark, ("user_behavior",)).collect()
    assert sorted(r.key for r in got) == ["u1", "u1", "u2"]
    assert json.loads(next(r.value for r in got if r.key == "u2"))["timestamp"] == "now"
    assert bus.batch(spark, ("products",)).count() == 0
    messages.drain_topics(spark, bus, str(tmp_path / "out"), ("user_behavior",), "csv", max_messages=2)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    broker = messages.Bus.broker("host:9092")
    assert broker._selection(("a", "b"), "latest")["subscribe"] == "a,b"
    assert messages.PRODUCER_OPTIONS["kafka.acks"] == "all"


def event_file(path, events):
    return write_lines(path, [dict(zip(("user_id", "product_id", "action", "timestamp"), e)) for e in events])


def test_streams_restart_without_loss_or_repeats(spark, tmp_path):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        stream = S.behavior_stream(S.file_stream(spark, "user_behavior", str(source)), as_of=F.lit("now"))
        S.start_append(stream, out, checkpoint, available_now=True).awaitTermination()
        return spark.read.json(out)

    event_file(source / "a.json", EVENTS)
    assert sorted(r.action_weight for r in run().collect()) == [1.0, 3.0, 5.0]
    event_file(source / "b.json", EVENTS[:1])
    assert run().count() == 4
    assert run().where("timestamp = 'now'").count() == 1


def test_live_interactions_equal_the_batch(spark, tmp_path):
    source, live = tmp_path / "in", str(tmp_path / "live")
    schema = "event_id int, user_id string, product_id string, action string, ts timestamp"

    def run(name, events):
        write_lines(source / name, [dict(zip(("event_id", "user_id", "product_id", "action", "ts"), e)) for e in events])
        stream = spark.readStream.schema(schema).json(str(source))
        R.live_interactions(stream, live, str(tmp_path / "check"), event_id="event_id",
                            availableNow=True).awaitTermination()
        return rows(R.read_live(spark, live))

    first = [(1, "u", "p", "view", "2024-01-01T00:00:00Z"), (2, "u", "q", "purchase", "2024-01-01T00:00:01Z")]
    assert run("a.json", first) == [("u", "p", 1, 1.0), ("u", "q", 1, 5.0)]
    again = [first[0], (3, "u", "p", "add_to_cart", "2024-01-01T00:00:02Z")]
    expected = [("u", "p", 2, 4.0), ("u", "q", 1, 5.0)]
    assert run("b.json", again) == expected
    folded = VersionedViews(spark, str(tmp_path / "folded"))
    R.compact_live(spark, live, folded)
    assert rows(R.read_live(spark, live, folded=folded)) == expected
    later = [("u", "p", 3, 5.0), ("u", "q", 1, 5.0), ("v", "p", 1, 5.0)]
    assert run("c.json", [(4, "u", "p", "view", "2024-01-01T00:00:03Z"), (5, "v", "p", "purchase", "2024-01-01T00:00:04Z")]) == later
    held = R.read_live(spark, live, folded=folded)
    assert rows(held) == later
    R.compact_live(spark, live, folded)
    assert rows(R.read_live(spark, live, folded=folded)) == later
    assert rows(held) == later  # a reader of the version before is not disturbed
    assert len(folder_names(spark, live)) == 1  # what the last version but one held is gone


def test_live_state_is_bounded(spark, tmp_path):
    """Ids leave the state once the lateness has passed: it holds no more after ten days than after three."""
    source, live = tmp_path / "in", str(tmp_path / "live")
    schema = "event_id int, user_id string, product_id string, action string, ts timestamp"
    held = []
    for day in range(1, 6):
        write_lines(source / f"{day}.json", [
            {"event_id": 100 * day + k, "user_id": f"u{day}{k}", "product_id": "p", "action": "view", "ts": f"2024-01-{day * 2:02d}T00:00:{k:02d}Z"} for k in range(20)])
        stream = spark.readStream.schema(schema).json(str(source))
        query = R.live_interactions(stream, live, str(tmp_path / "check"), availableNow=True)
        query.awaitTermination()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        assert "rocksdb" in str(query.lastProgress["stateOperators"][0]["customMetrics"]).lower()
    assert len(held) == 5 and max(held) <= 40 and rows(R.read_live(spark, live), F.sum("action_frequency")) == [(100,)]


def test_refresh_while_a_reader_holds_the_old_version(spark, tmp_path):
    source, path, checkpoint = tmp_path / "in", str(tmp_path / "speed"), str(tmp_path / "check")
    views = VersionedViews(spark, str(tmp_path / "views"))
    assert views.current() is None
    with pytest.raises(LookupError):
        views.read("table")
    batch = spark.createDataFrame([(1, "old", 1), (2, "old", 1)], "id int, v string, ts int")
    views.publish({"table": batch}, -1)

    def arrive(name, *rows_):
        write_lines(source / name, [dict(zip(("id", "v", "ts"), r)) for r in rows_])
        stream = spark.readStream.schema("id int, v string, ts int").json(str(source))
        R.start_speed_layer(stream, path, checkpoint, availableNow=True).awaitTermination()

    def build(fresh):
        return {"table": merged_view(views.read("table"), fresh, ["id"], [F.col("ts")])}

    arrive("a.json", (2, "new", 2), (3, "new", 2))
    held = views.current()
    before = R.refreshed_table(spark, views, "table", path, ["id"], "ts", held)
    seen = [(1, "old"), (2, "new"), (3, "new")]
    assert rows(before, "id", "v") == seen
    done = []
    clock = R.schedule(spark, lambda: done.append(R.refresh(spark, views, path, build)), str(tmp_path / "clock"), "1 second")
    for _ in range(60):
        time.sleep(0.5)
        if done:
            break
    clock.stop()
    assert done and done[0].upto == 0 and views.current().number >= 2
    assert rows(before, "id", "v") == seen  # still the old version
    arrive("b.json", (1, "newest", 3))
    after = R.refreshed_table(spark, views, "table", path, ["id"], "ts")
    assert rows(after, "id", "v") == [(1, "newest"), (2, "new"), (3, "new")]
    # A version that was never finished is passed over and its number not used again.
    batch.write.parquet(f"{views.base}/data/version=90/table")
    assert views.current().number < 90 and R.refresh(spark, views, path, build).number == 91
    assert rows(views.read("table"), "id", "v") == [(1, "newest"), (2, "new"), (3, "new")]


def test_realtime_table_overlays_batch(spark, tmp_path):
    source = tmp_path / "in"
    write_lines(source / "a.json", [{"id": 2, "v": "new", "ts": 2}, {"id": 3, "v": "new", "ts": 2}])
    stream = spark.readStream.schema("id int, v string, ts int").json(str(source))
    R.start_speed_layer(stream, str(tmp_path / "speed"), str(tmp_path / "check"), availableNow=True).awaitTermination()
    batch = spark.createDataFrame([(1, "old", 1), (2, "old", 1)], "id int, v string, ts int")
    merged = R.realtime_table(spark, batch, str(tmp_path / "speed"), ["id"], "ts")
    assert rows(merged, "id", "v") == [(1, "old"), (2, "new"), (3, "new")]


def test_stream_settings():
    settings = S.StreamSettings()
    assert settings.broker_limits(3) == {"maxOffsetsPerTrigger": "3000"}
    assert settings.trigger() == {"processingTime": "10 seconds"}


def test_batch_run(spark, tmp_path):
    products = [{"product_id": p, "name": p, "price": "15.990.000đ", "rating": r, "sold": s, "category": "c"}
                for p, r, s in (("p1", 4.8, "1k2"), ("p2", 4.9, "2k5"))]
    reviews = [{"review_id": "r", "product_id": "p1", "rating": 5, "comment": "x" * 101}, "{broken"]
    raw = {
        "products": write_lines(tmp_path / "raw" / "products.json", products),
        "reviews": write_lines(tmp_path / "raw" / "reviews.json", reviews),
        "user_behavior": event_file(tmp_path / "raw" / "events.json", EVENTS),
    }
    out = run_batch(spark, raw, str(tmp_path / "base"), "20240131", "2024-01-31")
    assert out["reviews"].first().review_weight == 2.0
    got = {(r.user_id, r.product_id): r.recommendation_score for r in out["recommendations"].collect()}
    assert got == pytest.approx({("u1", "p1"): 6 * 5.76, ("u2", "p2"): 3 * 12.25})
    views = files.load_views(spark, str(tmp_path / "base" / "views"), ("top_products", "algorithm_comparison", "none"))
    assert sorted(views) == ["algorithm_comparison", "top_products"]
    assert views["top_products"].orderBy(F.desc("popularity_score")).first().product_id == "p2"


CARD = """<div class="product-card"><a class="link" href="/lamp-i.1.2?sp=1">go</a><span class="product-name big"> Lamp </span>
<span class="product-price">15.000đ</span><i class="star-active"></i><i class="star-active"></i><i class="star"></i></div>"""
DETAIL = """<h1 class="product-title">Lamp</h1><b class="product-price">15.000đ</b><i class="rating-score">4.5</i>
<a class="breadcrumb" href="/">Home</a><a class="breadcrumb" href="/l"> Lamps </a><p class="product-description"></p>"""
REVIEW = """<li class="review"><b class="review-author">ann</b><p class="review-content">fine</p>
<i class="star-active"></i></li>"""


def test_page_extraction(spark):
    page = spark.createDataFrame([(1, "u", CARD * 2 + DETAIL + REVIEW * 60)], "page_id int, url string, html string")
    cards = pages.extract_product_listing(page, base_url="https://x").collect()
    assert len(cards) == 2
    first = cards[0]
    assert (first.name, first.price, first.sold, first.location, first.url, first.rating) == (
        "Lamp", "15.000đ", "N/A", "N/A", "https://x/lamp-i.1.2?sp=1", 2)
    detail = pages.extract_product_detail(page).first()
    assert (detail.name, detail.rating, detail.rating_count, detail.description) == ("Lamp", "4.5", "N/A", "N/A")
    assert detail.categories == ["Home", "Lamps"]
    found = pages.extract_reviews(page).collect()
    assert len(found) == 60 and pages.extract_reviews(page, per_page=50).count() == 50
    assert (found[0].username, found[0].comment, found[0].time, found[0].rating) == ("ann", "fine", "N/A", 1)


def test_raw_reviews_store_a_shared_comment_about_once(spark, tmp_path):
    """Many reviews carry the same long text; their files must not grow with it."""
    rng = np.random.default_rng(1)
    data = tmp_path / "sf"
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 26, 2000)) for _ in range(20)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{data}/documents.parquet")
    spark.range(4000).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey").write.parquet(f"{data}/orders.parquet")
    spark.range(4000).repartition(4).selectExpr(
        "id AS l_orderkey", "id % 9 AS l_partkey", "1 AS l_linenumber", "CAST(id % 50 AS double) AS l_quantity",
        "timestamp_ntz'2024-01-01 00:00:00' AS l_shipdate").write.parquet(f"{data}/lineitem.parquet")
    path = written(spark, str(data), "reviews")
    found = files.scan_raw_reviews(spark, path)
    assert found.groupBy("comment").count().select("count").distinct().collect() == [(200,)]
    assert {r.comment for r in found.select("comment").distinct().collect()} == set(texts)
    stored = sum(f.stat().st_size for f in Path(path.removeprefix("file:")).iterdir())
    assert stored < 4000 * 2000 / 20


def test_processed_reviews_store_a_shared_comment_about_once(spark, tmp_path):
    """More distinct comments than a small dictionary holds, each in many rows; raw tables are compressed."""
    rng = np.random.default_rng(2)
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6000)) for _ in range(500)]
    comments = spark.createDataFrame(list(enumerate(texts)), "n int, comment string").repartition(1)
    rows_of = comments.selectExpr("n", "comment", "explode(sequence(1, 25)) AS copy")
    files.write_run(rows_of, str(tmp_path), "reviews", "20240131", "2024-01-31")
    found = files.scan_processed(spark, str(tmp_path), "reviews")
    assert found.groupBy("comment").count().select("count").distinct().collect() == [(25,)] and found.count() == 12500
    stored = sum(f.stat().st_size for f in (tmp_path / "reviews").rglob("*.parquet"))
    assert stored < 500 * 6000


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="test tables are not here")
def test_all_raw_tables_are_compressed(spark):
    for data_type in ("products", "user_behavior"):
        path = Path(written(spark, "/root/testdata/sf0.001", data_type).removeprefix("file:"))
        assert {f.suffix for f in path.glob("part-*")} == {".gz"}


def test_raw_reviews_with_comments_beyond_the_reach_of_gzip(spark, tmp_path):
    """A comment of 40 KB is not stored with every review; null and short comments stay beside it."""
    rng = np.random.default_rng(4)
    data = tmp_path / "sf"
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in (40_000, 40_000, 300)] + [None, "", "é" * 15_001]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{data}/documents.parquet")
    spark.range(300).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey").write.parquet(f"{data}/orders.parquet")
    spark.range(300).selectExpr(
        "id AS l_orderkey", "id % 9 AS l_partkey", "1 AS l_linenumber", "CAST(id % 50 AS double) AS l_quantity",
        "timestamp_ntz'2024-01-01 00:00:00' AS l_shipdate").write.parquet(f"{data}/lineitem.parquet")
    path = written(spark, str(data), "reviews")
    found = files.scan_raw_reviews(spark, path)
    assert {r.comment: r["count"] for r in found.groupBy("comment").count().collect()} == dict.fromkeys(texts, 50)
    stored = sum(f.stat().st_size for f in Path(path.removeprefix("file:")).iterdir())
    assert stored < 100 * 40_000 / 3
