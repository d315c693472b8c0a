"""Readers, writers and streams on small folders."""

import json

from pyspark.sql import functions as F

from narrata.operators import corpus, windows
from narrata.operators.functors import lexical_entropy
from narrata.sources import readers
from narrata.streaming import streams


def test_json_texts(spark, tmp_path):
    for name, body in {"a": {"id": "1", "text": "one two"}, "b": {"id": "2", "content": "three"}, "c": {"id": "3", "windows": ["four", "five"]}, "d": {"id": "4"}, "manifest": {"id": "5", "text": "no"}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    (tmp_path / "broken.json").write_text("{")
    assert {(r.id, r.text) for r in readers.json_texts(spark, str(tmp_path)).collect()} == {("1", "one two"), ("2", "three"), ("3", "four five")}


def test_plain_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("word " * 300)
    (tmp_path / "b.html").write_text("<html><script>x</script><p>" + "Text " * 300 + "</p></html>")
    (tmp_path / "short.txt").write_text("short")
    rows = {r.title: r for r in readers.plain_texts(spark, str(tmp_path)).collect()}
    assert rows.keys() == {"a", "b"} and "<" not in rows["b"].text and all(len(r.id) == 12 for r in rows.values())


def test_catalog(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Text#,Type,Issued,Title,Language,Authors,Subjects,LoCC,Bookshelves\n7,Text,2000,"A, B",en,"Doe, J., 1812-1870","Sea; Ships",PR; PS,x\n8,Text,2000,C,fr,Roe,Sea,,x\n')
    books = readers.catalog(spark, str(tmp_path / "c.csv"))
    one = readers.select_books(books, language="en", years=(1800, 1900), subject="ships", class_="PR").collect()
    assert [(r.id, r.title, r.year, r.subjects, r["class"]) for r in one] == [("7", "A, B", 1812, ["Sea", "Ships"], "PR")]


def test_series_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e f g h i"), (2, None)], "doc_id long, text string")
    scored = windows.series(windows.windowed(docs, 4, 2), {"lexical": lexical_entropy})
    long = windows.long_form(scored, ["lexical"])
    readers.write_series(long, str(tmp_path / "s"))
    back = readers.read_series(spark, str(tmp_path / "s"), "lexical")
    key = lambda df: sorted((r.doc_id, r.win_idx, r.t, r.value) for r in df.collect())
    assert key(back) == key(long) and back.where("doc_id = 1").count() == 4
    assert [(r.functor, r.texts) for r in readers.manifest(back).collect()] == [("lexical", 2)]


def test_new_only(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "a"), (3, "c")], "id long, t string")
    assert {(r.id, r.t) for r in corpus.new_only(df, df.where("id = 3"), "id").collect()} == {(1, "a"), (2, "a")}


def test_streams_like_batches(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a b c d " * (i + 1), "en", "s", 8) for i in range(6)], streams.DOCUMENTS)
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    arriving = streams.scored_arrivals(streams.arrivals(spark, str(tmp_path / "in"), streams.DOCUMENTS), 4, 2)
    run = arriving.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    key = lambda df: sorted((r.doc_id, r.series) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(streams.scored_arrivals(docs, 4, 2))


def test_event_windows(spark):
    rows = [(i, f"2024-01-0{1 + i % 2} 10:00:00", 1, "click", 1.0, None) for i in range(4)]
    events = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("t"))
    assert sorted((r.start.day, r.n, r.total) for r in streams.event_windows(events).collect()) == [(1, 2, 2.0), (2, 2, 2.0)]
    assert [(r.n, r.total) for r in streams.sessions(events.where("event_id % 2 = 0")).collect()] == [(2, 2.0)]
