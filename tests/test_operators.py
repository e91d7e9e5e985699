"""Keyed results, fusion, chunkers, ingest, reports, models."""

import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import chunking, dense, fusion, ingest, keyed, lexical, reports

ENTRY = "path string, category string, collection string, sha256 string, size long, mtime double, chunk_ids array<string>, chunk_count int, indexed_at string"


def manifest(spark, rows):
    return spark.createDataFrame([(p, "x", c, s, 1, 0.0, [], n, at) for p, c, s, n, at in rows], ENTRY)


def test_top_files_edges(spark):
    rows = [("b", "k", "s", 3, "2024-01-01T00:00:00"), ("a", "k", "s", 3, "2024-01-01T00:00:00.5"), ("a", "k", "s", 3, "2024-01-01T00:00:00.5"), ("c", "k", "s", 9, "2024-01-01T00:00:00"),
            ("c", "k", "s", 1, "2024-01-01T00:00:00.000001"), ("d", None, "s", 5, "2024-01-01T00:00:00"), ("e", "k", "s", None, "2024-01-02T00:00:00"), ("f", "k", "s", 0, "2024-01-02T00:00:00"),
            (None, "k", "s", 7, "2024-01-02T00:00:00"), ("g", "k", "s", 2, None), ("h", "k", "s", 2, "no date"), ("é", "k", "s", 3, "2024-01-01T00:00:00Z"), ("Z", "k", "s", 3, "2024-01-01T00:00:00")]
    got = [(r.path, r.chunk_count) for r in keyed.largest_files(manifest(spark, rows)).orderBy("rank_no").collect()]
    assert got == [("Z", 3), ("a", 3), ("b", 3), ("é", 3), ("g", 2), ("h", 2), ("c", 1)]
    assert keyed.largest_files(manifest(spark, [])).count() == 0


def test_top_files_hot_key(spark):
    rng = random.Random(1)
    rows = [(f"p{i:05d}", "hot" if i % 3 else f"c{i % 50}", "s", rng.choice([1, 2, 3, 50]), "2024-01-01T00:00:00") for i in range(3000)]
    got = {(r.collection, r.path) for r in keyed.largest_files(manifest(spark, rows).repartition(7), 20).collect()}
    by: dict = {}
    for p, c, _, n, _ in rows:
        by.setdefault(c, []).append((-n, p))
    assert got == {(c, p) for c, v in by.items() for _, p in sorted(v)[:20]}


def test_top_rows_cuts_before_the_shuffle(spark):
    df = keyed.top_rows(spark.range(100).select((F.col("id") % 2).alias("k"), "id"), "k", [F.desc("id")], 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") != plan.rindex("WindowGroupLimit")


def test_key_totals(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 5)], "k string, v int")
    assert keyed.key_totals(df, "k", n=F.count("v"), s=F.sum("v")).collect() == [("a", 1, 1)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n。", max_size=400), st.integers(20, 60), st.integers(0, 15))
def test_windows_cover(text, size, overlap):
    out = chunking.windows(text, size, overlap)
    assert all(len(c) <= size for c in out)
    seen = "".join(out)
    assert all(seen.count(ch) >= text.count(ch) for ch in "ab")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["Pasal 1\nabc def. ", "kata panjang sekali. ", "\n\n", "x" * 70 + " ", "BAB IV\n"]), max_size=40))
def test_structured_bounds(parts):
    out = chunking.structured("".join(parts), target=100, most=150, least=10, overlap=20)
    assert all(10 <= len(c) <= 150 for c in out)


def test_chunkers_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  \n "), (4, "kalimat. " * 5000)], "k int, text string")
    assert {r.k for r in chunking.fixed_chunks(df, "k").collect()} == {4}
    assert {r.k for r in chunking.structured_chunks(df, "k").collect()} == {4}


def test_merge_pages(spark):
    rows = [("f", 1, 0, "Ini belum"), ("f", 2, 1, "selesai."), ("f", 3, 2, "Baru"), ("f", 4, 3, " "), ("f", 5, 4, "2 lagi"), ("f", None, 5, "x"), ("g", 1, 0, None)]
    got = [(r.page, r.text) for r in chunking.merge_pages(spark.createDataFrame(rows, "file string, page int, idx int, text string")).orderBy("island").collect()]
    assert got == [(1, "Ini belum selesai."), (3, "Baru 2 lagi")]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", ""]), st.sampled_from(["1", "2", ""]), st.floats(0, 1)), min_size=1, max_size=25), st.integers(1, 12))
def test_mmr_against_plain_greedy(rows, size):
    pool = pd.DataFrame([(f"i{k:03d}", s, a, round(r, 6)) for k, (s, a, r) in enumerate(rows)], columns=["id", "source", "article", "rrf"]).sort_values(["rrf", "id"], ascending=[False, True])
    got = fusion.mmr(pool, size)
    assert len(got) == min(size, len(pool)) and set(got["id"]) <= set(pool["id"])
    if len(pool) <= size:
        return
    left, chosen, top = pool.to_dict("records"), [], pool["rrf"].max() or 1.0

    def like(x, y):
        return 0 if not x["source"] or x["source"] != y["source"] else 1 if x["article"] and x["article"] == y["article"] else 0.5

    while len(chosen) < size:
        best = max(left, key=lambda x: round(round(0.7 * x["rrf"] / top, 9) - 0.3 * max([like(x, y) for y in chosen], default=0), 9))
        chosen.append(best)
        left.remove(best)
    assert got["id"].tolist() == [x["id"] for x in chosen]


def test_quota_pick():
    pool = pd.DataFrame([("i%d" % i, c, s, 1, "", 0.1 * i) for i, (c, s) in enumerate([("perda", "a"), ("uu", "b"), ("perda", "c"), ("constitution", "d"), ("uu", "b"), ("pp", "e"), ("perda", "f")])],
                        columns=["id", "plain", "source", "page", "article", "eff"])
    assert fusion.quota_pick(pool, 4, {"constitution": 1, "uu": 2, "pp": 1})["id"].tolist() == ["i0", "i1", "i3", "i5"]
    assert fusion.quota_pick(pool, 2, {"constitution": 1, "uu": 2, "pp": 1})["id"].tolist() == ["i1", "i3"]
    assert fusion.quota_pick(pool, 3, {})["id"].tolist() == ["i0", "i1", "i2"]


def test_rerank_small_pool_keeps_order(spark):
    c = spark.createDataFrame([(1, f"i{k}", k + 1, "general", "s", 0.5 - k / 100) for k in range(5)], "query_id int, id string, pick int, intent string, source string, eff double")
    got = fusion.rerank(c, spark.createDataFrame([(1, "i3", 9.0)], "query_id int, id string, score double")).orderBy("place").collect()
    assert [r.id for r in got] == [f"i{k}" for k in range(5)] and [r.score for r in got] == [5.0, 5.0, 5.0, 9.0, 5.0]


def test_detect_changes(spark):
    big = 70 * 1024 * 1024
    disk = [("new", 1, 1.0, "a"), ("same", 1, 1.5, "a"), ("moved", 1, 9.0, "a"), ("edit", 2, 9.0, "b"), ("again", 1, 1.0, "a"), ("huge", big, 1.0, "z"), ("lost", 1, 9.0, None), ("newhuge", big, 1.0, "q")]
    man = [("same", 1, 1.0, "a", 3), ("moved", 1, 1.0, "a", 3), ("edit", 1, 1.0, "a", 3), ("again", 1, 1.0, "a", 0), ("huge", 1, 1.0, "a", None), ("lost", 1, 1.0, "a", 2), ("gone", 1, 1.0, "a", 1)]
    d = spark.createDataFrame(disk, "path string, size long, mtime double, sha256 string")
    m = spark.createDataFrame(man, "path string, size long, mtime double, sha256 string, chunk_count int")
    ch = ingest.detect_changes(d, m)
    assert {r.path: r.status for r in ch.collect()} == {"new": "added", "same": "unchanged", "moved": "touched", "edit": "modified", "again": "retried", "huge": "skipped", "lost": "unreadable", "newhuge": "added", "gone": "deleted"}
    assert [r.path for r in ingest.work_order(ch).orderBy("place").collect()] == ["new", "newhuge", "again", "edit"]
    new = ingest.apply_changes(m, d.withColumn("chunk_count", F.lit(1)), ch)
    assert {r.path for r in new.collect()} == {"new", "newhuge", "same", "moved", "edit", "again", "huge", "lost"}


def test_upsert_is_idempotent(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "id int, v string")
    once = ingest.upsert(a, b, ["id"])
    assert sorted(ingest.upsert(once, b, ["id"]).collect()) == sorted(once.collect()) == [(1, "x"), (2, "z"), (3, "w")]


def test_search_edges(spark):
    docs = spark.createDataFrame([("a", "satu dua"), ("b", None), ("c", ""), ("d", "dua tiga 13/2003")], "id string, text string")
    q = spark.createDataFrame([(1, "DUA 13/2003"), (2, None), (3, "")], "query_id int, text string")
    got = lexical.search(q, lexical.computed(docs)).collect()
    assert {r.query_id for r in got} == {1} and got[0].id in "ad"
    assert lexical.search(q, lexical.computed(docs.limit(0))).count() == 0


def test_nearest_edges(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [1.0, 0.0])], "id string, embedding array<float>")
    q = spark.createDataFrame([(7, [3.0, 0.0])], "query_id int, embedding array<float>")
    got = dense.nearest(q, v.repartition(3), 2).orderBy("rank").collect()
    assert [(r.id, r.dist) for r in got] == [("a", 0.0), ("c", 0.0)]
    assert dense.nearest(q.limit(0), v, 2).count() == 0 and dense.nearest(q, v.limit(0), 2).count() == 0
    bad = spark.createDataFrame([(None,), ([1.0],), ([1.0, None],), ([float("nan"), 1.0],), ([0.0, 0.0],), ([1.0, 2.0],)], "e array<float>")
    assert [r[0] for r in bad.select(dense.valid(F.col("e"), 2)).collect()] == [False] * 5 + [True]


def test_text_functions(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]

    assert one(T.clean_chunk(F.lit(" a­​  b\t c "))) == "a b c"
    assert one(T.clean_chunk(F.lit("ﬁ"), compose=True)) == "fi"
    assert one(T.clean_page(F.lit("a\nHalaman 3 dari 9\n- 4 -\n12\n\n\n\nb"))) == "a\n\nb"
    assert one(T.article(F.lit("Pasal 7 dan BAB II"))) == "BAB II" and one(T.article_old(F.lit("Pasal 7 dan BAB II"))) == "Pasal 7"
    assert one(T.duration_seconds(F.lit("1h30m"))) == 5400 and one(T.duration_seconds(F.lit("90"))) == 90 and one(T.duration_seconds(F.lit("soon"))) is None
    assert one(T.source_category(F.lit("UU_7-1950_UUDS.pdf"))) == "constitution" and one(T.source_category(F.lit("x"))) is None
    assert one(T.folder_collection(F.lit("법률_UU"))) == "indonesia_uu" and one(T.folder_collection(F.lit("헌법"))) == "indonesia_constitution"
    assert one(T.highlight(F.lit("a.b A.B axb"), "a.b")) == "<mark>a.b</mark> <mark>A.B</mark> axb"
    assert one(T.tokens(F.lit(None).cast("string"))) == []


def test_reports(spark):
    s = spark.createDataFrame([(1, "event: token\ndata: {\"a\":1}\n\nevent: x\ndata: not json\n\nevent: token\ndata: {}"), (2, None), (3, "")], "k int, t string")
    assert [(r.k, r.seq, r.event) for r in reports.sse_parse(s, "k", "t").collect()] == [(1, 0, "token")]
    e = spark.createDataFrame([(1, 0, "token", "a"), (1, 1, "regenerating", ""), (1, 3, "token", "c"), (1, 2, "token", "b"), (2, 0, "rate_limited", ""), (3, 0, "error", ""), (3, 1, "token", "z")], "conv_id int, seq int, event string, data string")
    assert {(r.conv_id, r.answer, r.failed) for r in reports.fold_events(e).collect()} == {(1, "bc", False), (2, "", True), (3, "z", True)}
    m = spark.createDataFrame([(1, t, "user" if t % 2 else "assistant") for t in range(1, 14)], "conv_id int, turn int, role string")
    assert sorted(r.turn for r in reports.last_messages(m).collect()) == list(range(5, 14))


@pytest.mark.parametrize("texts", [[], ["satu", None, ""]])
def test_embedding_fallback(spark, texts):
    from paperloom.models import embed

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(abs(sum(x * x for x in r[0]) - 1) < 1e-5 for r in df.select(embed(F.col("t"))).collect())
