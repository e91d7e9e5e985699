"""File sources and sinks, and streams, on folders of their own."""

import json

import pytest
from pyspark.sql import functions as F

from paperloom.caching import Cache
from paperloom.settings import Question, Settings
from paperloom.sources import files, store
from paperloom.streaming import cycles, streams


def test_discover_and_extract(spark, tmp_path):
    for name, data in {"법률_UU/a.pdf": b"satu\fdua", "법률_UU/sub/b.pdf": b"\xff\xfe", "__x/c.pdf": b"no", ".y/d.pdf": b"no", "e.pdf": b"no", "법률_UU/f.txt": b"no"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    found = files.discover(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a.pdf", "b.pdf"]
    assert {r.collection for r in found.collect()} == {"indonesia_uu"}
    assert "content" not in found._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    pages = files.extract_pages(files.contents(spark, found, str(tmp_path)), [files.plain_text_parser])
    got = sorted((r.path.rsplit("/", 1)[1], r.page, r.text, r.error is None) for r in pages.collect() if r.error is None)
    assert got == [("a.pdf", 1, "satu", True), ("a.pdf", 2, "dua", True)]
    assert pages.where("error IS NOT NULL").count() == 1
    assert files.write_chunks(pages, str(tmp_path / "out")) == {"chunks": 2, "failed": 1}


def test_manifest_versions(spark, tmp_path):
    at = str(tmp_path / "m")
    assert files.newest_manifest(spark, at).count() == 0
    df = spark.createDataFrame([("p", "c", "k", "s", 1, 1.0, ["x"], 1, "2024-01-01")], files.MANIFEST)
    files.save_manifest(df, at, 1)
    files.save_manifest(df.unionByName(df.withColumn("path", F.lit("q"))), at, 2)
    assert files.newest_manifest(spark, at).count() == 2
    (tmp_path / "bad.json").write_text('{"path": "p"}\nnot json\n{"size": 3}\n')
    assert [r.path for r in files.read_manifest(spark, str(tmp_path / "bad.json")).collect()] == ["p"]
    assert files.read_manifest(spark, str(tmp_path / "none.json")).count() == 0


def test_chunk_lines(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id":"a","text":"t","metadata":{"source":"s","page":1}}\n\n{"text":"u"}\n')
    assert [(r.id, r.source, r.article) for r in files.read_chunks(spark, str(tmp_path / "c.jsonl")).collect()] == [("a", "s", None)]


def test_usage_report(spark, tmp_path):
    (tmp_path / "page-.json").write_text(json.dumps({"data": [{"starting_at": "2024-01-01", "results": [{"amount": 1}]}], "has_more": True, "next_page": "b"}))
    (tmp_path / "page-b.json").write_text(json.dumps({"data": [{"starting_at": "2024-01-02", "results": []}], "has_more": False}))
    spark.dataSource.register(files.UsageReport)
    got = spark.read.format("usage_report").option("url", f"file:{tmp_path}").load()
    assert [(r.starting_at, r.results) for r in got.orderBy("starting_at").collect()] == [("2024-01-01", '[{"amount": 1}]'), ("2024-01-02", "[]")]


def test_stream_ingest_over_batches(spark, tmp_path):
    src, target = str(tmp_path / "in"), str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "id string, line_no long, text string").coalesce(1).write.mode("append").parquet(src)
    make([("a", 1, "old"), ("b", 2, "x"), ("a", 3, "new")])
    like = spark.read.parquet(src)
    streams.ingest_stream(streams.file_stream(spark, src, like), target, ["id"]).awaitTermination()
    make([("a", 2, "late"), ("c", 4, "y")])
    streams.ingest_stream(streams.file_stream(spark, src, like), target, ["id"]).awaitTermination()
    assert sorted((r.id, r.text) for r in streams.read_versioned(spark, target, ["id"]).collect()) == [("a", "new"), ("b", "x"), ("c", "y")]


def test_conversation_state(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(1, t, "user" if t % 2 else "assistant", f"m{t}") for t in range(1, 16)]
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame(rows[:6], schema).coalesce(1).write.mode("append").parquet(src)
    like = spark.read.parquet(src)
    seen = []
    for part in (None, rows[6:]):
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        out = streams.conversations(streams.file_stream(spark, src, like))
        seen.append([])
        q = out.writeStream.outputMode("update").foreachBatch(lambda df, no: seen[-1].extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "p")).trigger(once=True).start()
        assert q.awaitTermination(60)  # with a timer on its state, a query over all that is there wouldn't end by itself
    assert sorted(seen[0]) == [(1, t, t, "user" if t % 2 else "assistant", f"m{t}") for t in range(1, 7)]
    assert [r[1:] for r in sorted(seen[1])] == [(k, t, "user" if t % 2 else "assistant", f"m{t}") for k, t in enumerate(range(7, 16), 1)]


def test_stream_compacts(spark, tmp_path):
    src, target = str(tmp_path / "in"), str(tmp_path / "t")
    for i in range(5):
        spark.createDataFrame([(f"k{i % 2}", i, str(i))], "id string, line_no long, text string").coalesce(1).write.mode("append").parquet(src)
    like = spark.read.parquet(src)
    streams.ingest_stream(streams.file_stream(spark, src, like, files_per_trigger=1), target, ["id"], compact=2).awaitTermination()
    assert sorted(p.name for p in (tmp_path / "t" / "bases").iterdir()) == ["version=1", "version=3"]
    assert sorted((r.id, r.text) for r in streams.read_versioned(spark, target, ["id"]).collect()) == [("k0", "4"), ("k1", "3")]


def test_cycles_by_the_clock(spark, tmp_path):
    disk = spark.createDataFrame([("a", 1, 1.0, "x"), ("b", 2, 1.0, "y")], "path string, size long, mtime double, sha256 string")
    calls = []

    def work(pending):
        calls.append(1)
        bad = F.col("path") == "b"
        return pending.select("path", F.when(~bad, F.col("path")).alias("id"), F.when(bad, "no").alias("error"))

    cycles.run(spark, str(tmp_path), lambda: disk, work, interval="1 second", duration=8)
    assert len(calls) >= 2 and [tuple(r) for r in cycles.chunks(spark, str(tmp_path)).collect()] == [("a", "a")]
    assert cycles.failures(spark, str(tmp_path)).first().tries == len(calls)
    n = cycles.newest_version(spark, f"{tmp_path}/manifest")
    assert cycles.cycle(spark, str(tmp_path), disk, work, number=n) == n and len(calls) == n  # a finished cycle isn't repeated


def test_manifest_counts_survive_a_broken_version(spark, tmp_path):
    counts = files.DocumentCounts(spark, str(tmp_path / "none"))
    assert counts() == {}
    with pytest.raises(ValueError):
        store.Catalog(spark, "http", str(tmp_path))
    with pytest.raises(FileNotFoundError):
        store.Catalog(spark, None, str(tmp_path / "none"))


def test_cache(spark):
    now, made = [0.0], []
    c = Cache(most=2, seconds=10, clock=lambda: now[0])
    make = lambda k: lambda: made.append(k) or k
    assert [c.get(k, make(k)) for k in "abab"] == list("abab") and made == ["a", "b"]
    c.get("c", make("c"))
    c.get("a", make("a"))  # the longest unused went
    assert made == ["a", "b", "c", "a"]
    now[0] = 11
    c.get("c", make("c"))
    c.get("c", make("c"), fingerprint=2)
    assert made[4:] == ["c", "c"]
    df = c.get("df", lambda: spark.range(3))
    assert df.is_cached
    c.drop("df")
    assert not df.is_cached


def test_settings():
    assert Settings.read({}) == Settings()
    s = Settings.read({"PAPERLOOM_CROSS_STAGE": "off", "PAPERLOOM_SECOND_OPINION": "YES", "PAPERLOOM_RERANK_CUT": "7"})
    assert (s.cross_stage, s.second_opinion, s.rerank_cut) == (False, True, 7)
    with pytest.raises(ValueError):
        Settings.read({"PAPERLOOM_RERANK_CUT": "0"})
    for bad in (("", 5), ("x", 0), ("x", 21)):
        with pytest.raises(ValueError):
            Question(*bad)


def test_stream_equals_batch(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "e"))
    s = streams.run_once(streams.windowed_counts(streams.file_stream(spark, str(tmp_path / "e"), e, 1), "1 day"))
    assert sorted(s.collect()) == sorted(streams.windowed_counts(e, "1 day").collect())
