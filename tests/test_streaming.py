from shelfmark import schemas
from shelfmark.streaming import pages


def record(url, at, status="ok"):
    return (url, 0, None, status, None, float(at), 0.1, 1, "h", "p", None)


def test_new_files_are_processed_once(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    add = lambda *rows: spark.createDataFrame(list(rows), schemas.CRAWL_META).coalesce(1).write.mode("append").json(source)
    add(record("a", 1000), record("a", 1001), record("b", 1002))
    pages.run_available(pages.first_visits(pages.new_records(spark, source, schemas.CRAWL_META)), out, checkpoint)
    add(record("a", 1003), record("c", 1004))
    pages.run_available(pages.first_visits(pages.new_records(spark, source, schemas.CRAWL_META)), out, checkpoint)
    assert sorted(r["url"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_windows_close_behind_the_watermark(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame([record("a", 0), record("b", 30, "error"), record("c", 100_000)], schemas.CRAWL_META).coalesce(1).write.json(source)
    pages.run_available(pages.visits_per_window(pages.new_records(spark, source, schemas.CRAWL_META), "1 minute", "1 hour"), out, checkpoint)
    got = [(r["visits"], r["failed"]) for r in spark.read.parquet(out).collect()]
    assert got == [(2, 1)]


def test_products_of_a_stream_of_pages(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [("p1", "<body><h1>A</h1>\n<p>£2</p></body>"), ("p2", "<body>denied</body>")]
    spark.createDataFrame(rows, schemas.HTML_PAGES).write.json(source)
    pages.run_available(pages.extracted(pages.new_records(spark, source, schemas.HTML_PAGES)), out, checkpoint)
    assert [r["name"] for r in spark.read.parquet(out).collect()] == ["A"]
