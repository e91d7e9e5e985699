"""Every query of a dealt problem on odd tables: empty, all null, ties and repeats, very long texts, extra columns of clashing names."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from paperloom.llm.queries import REGISTRY

META = pa.struct([("source", pa.string()), ("page", pa.int32()), ("article", pa.string()), ("category", pa.string()), ("collection", pa.string())])
SCHEMAS = {
    "chunks": pa.schema([("line_no", pa.int64()), ("id", pa.string()), ("text", pa.string()), ("metadata", META), ("extracted_at", pa.timestamp("us"))]),
    "chunk_vectors": pa.schema([("row_no", pa.int64()), ("id", pa.string()), ("embedding", pa.list_(pa.float32()))]),
    "documents": pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("doc_kind", pa.string()), ("declared_chars", pa.int64()), ("received_at", pa.timestamp("us"))]),
    "eval_items": pa.schema([("item_id", pa.int64()), ("suite", pa.string()), ("lang", pa.string()), ("text", pa.string())]),
}
CLASH = ["n", "kind", "score", "key", "file", "rank", "rn", "copy", "source_", "word", "__newest", "__key", "part", "list", "total", "a", "b", "piece", "size", "block"]
T0 = dt.datetime(2024, 1, 1)
LONG = "Pasal 1\n" + "Setiap orang wajib melapor paling lambat 20 hari kerja. " * 4000


def write(folder, rows, clash=False):
    for name, schema in SCHEMAS.items():
        data = [dict(zip(schema.names, r)) for r in rows.get(name, [])]
        t = pa.Table.from_pylist(data, schema=schema)
        if clash:
            for c in CLASH:
                t = t.append_column(c, pa.array(["x"] * len(data), pa.string()))
        pq.write_table(t, f"{folder}/{name}.parquet")
    return str(folder)


def odd():
    m = {"source": "s", "page": 1, "article": "Pasal 9", "category": "k", "collection": "c"}
    vec = [1.0] + [0.0] * 63
    return {
        "chunks": [(1, "f1-p1-0", "old " * 30, m, T0), (2, "f1-p1-0", LONG, m, T0), (2, "f1-p1-0", LONG, m, T0), (3, "f2-p1-0", None, m, T0), (4, "f3-p1-0", "", None, None), (5, None, "x", m, T0),
                   (None, "f4-p1-0", "x", m, T0), (6, "f5-p1-0", LONG, {k: None for k in m}, T0), (7, "no dashes", "kata-\nkata", m, T0), (8, "f6-p2-0", "a b", m, T0), (9, "f7-p2-0", "😀" * 2000, m, T0)],
        "chunk_vectors": [(1, "a", vec), (1, "a", vec), (2, "b", vec), (3, None, None), (4, "c", [0.0] * 64), (5, "d", [1.0]), (6, "e", [float("nan")] * 64), (None, "f", vec), (7, "g", [-1.0] + [0.0] * 63), (8, "h", [])],
        "documents": [(1, None, None, None, None, None, None, None), (2, "", "id", "s", 0, "k", 0, T0), (3, LONG, "id", "s", len(LONG), "k", len(LONG), T0), (3, LONG, "id", "s", len(LONG), "k", None, T0), (None, "x y z", "id", None, 5, "k", 9, T0), (4, "😀" * 1500, None, None, 1500, None, None, T0)],
        "eval_items": [(1, "s", "id", LONG[:600]), (2, "s", "id", None), (3, "s", "id", ""), (4, "s", "id", "satu dua"), (None, "s", "id", LONG[:600])],
    }


@pytest.mark.parametrize("name", sorted(REGISTRY.queries))
def test_empty_tables(spark, tmp_path, name):
    assert REGISTRY.queries[name](spark, write(tmp_path, {})).count() == 0


@pytest.mark.parametrize("name", sorted(REGISTRY.queries))
def test_null_rows(spark, tmp_path, name):
    rows = {n: [tuple([None] * len(s))] * 3 for n, s in SCHEMAS.items()}
    assert REGISTRY.queries[name](spark, write(tmp_path, rows)).count() <= 3


EXPECT = {
    "p2_found": {("f1-p1-0", "Pasal 1"), ("f5-p1-0", "Pasal 1"), ("f7-p2-0", "")},
    "p3_found": {(1, 2)},
    "p4_found": set(),
    "p5_found": {("f1-p1-0", "f5-p1-0")},
    "p7_found": {(3,), (4,)},
    "p8_found": {(3, 1), (3, None)},
}


@pytest.mark.parametrize("name", sorted(REGISTRY.queries))
def test_odd_rows(spark, tmp_path, name):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    plain = REGISTRY.queries[name](spark, write(tmp_path / "a", odd()))
    got = {str(tuple(r)) for r in plain.collect()}
    if name in EXPECT:
        assert {tuple(r) for r in plain.collect()} == EXPECT[name]
    more = REGISTRY.queries[name](spark, write(tmp_path / "b", odd(), clash=True))
    assert more.columns == plain.columns and {str(tuple(r)) for r in more.collect()} == got
