"""Operators against brute force, round trips and held-out accuracy."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.llm import boilerplate, leakage, neardup, neighbours, packing, scans, splitting, truncation
from paperloom.llm.common import words

WORDS = [a + b + c for a in ("ba", "ke", "mi", "so", "tu") for b in ("lan", "ri", "da", "no") for c in ("", "ng", "kan", "s")]


def sentence(rng, n=12):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


# ---- problem 2

PARTS = st.lists(st.sampled_from(["Pasal 5\n", "\n  PASAL 7b.\n", "\nPasal 8 – Umum\n", "\nPasal 9 ayat (1) jo. ", "kata ", "akhir. ", "\n\n", "\n(2) isi ", "z" * 90]), max_size=60)


@settings(max_examples=100, deadline=None)
@given(PARTS, st.integers(40, 120), st.integers(0, 30))
def test_pieces_tile_the_text(parts, limit, overlap):
    text = "".join(parts)
    got = list(splitting.split_text(text, "Pasal 1", limit, overlap))
    assert "".join(text[p[3] : p[4]] for p in got) == text
    for k, (_, article, opens, start, stop, back, piece) in enumerate(got):
        assert len(piece) <= limit and piece == text[start - back : stop]
        if k and not opens and got[k - 1][1] == article:
            assert back == min(overlap, start - max(p[3] for p in got[: k + 1] if p[2] or p[3] == 0))
    assert [p[1] for p in got if p[2]] == [a for _, a in splitting.headings(text)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["Pasal 5\n", "kata ", "akhir. ", "법률 ", "é", "😀", "\n\n"]), max_size=60), st.integers(20, 60), st.integers(0, 15))
def test_pieces_in_bytes(parts, limit, overlap):
    text = "".join(parts)
    got = list(splitting.split_text(text, None, limit, overlap, "bytes"))
    assert "".join(text[p[3] : p[4]] for p in got) == text
    assert all(len(p[6].encode()) <= limit and len(text[p[3] - p[5] : p[3]].encode()) <= overlap for p in got)
    sums = splitting.prefix_sums(text, "bytes")
    assert list(sums) == [len(text[:k].encode()) for k in range(len(text) + 1)]


def test_pieces_in_tokens(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no tokenizer files")
    text = "Pasal 1\n" + "Setiap orang wajib melapor paling lambat 20 hari kerja. " * 60
    df = spark.createDataFrame([(1, text, None), (2, "pendek", "Pasal 3"), (3, None, None)], "id int, text string, article string")
    rows = splitting.split_oversized(df, limit=100, overlap=20, unit=splitting.token_unit(path)).orderBy("id", "piece_no").collect()
    count = splitting.token_unit(path)
    assert "".join(r.piece[r.overlap :] for r in rows if r.id == 1) == text and len(rows) > 5
    assert all(len(count(r.piece)) <= 101 for r in rows) and [r.article for r in rows if r.id == 2] == ["Pasal 3"]  # a piece may begin within what was one token


def test_headings():
    text = "Pasal 1\n pasal 2a.\nPASAL 3 - Judul\nPasal 4 (1) isi\nPasal 5 ayat (2).\nPasal 6 huruf a\nPasal 7 Peraturan\nlihat Pasal 8\nPasal​ 9 \nPasal10\nPasal 11 juncto Pasal 12"
    assert [a for _, a in splitting.headings(text)] == ["Pasal 1", "Pasal 2A", "Pasal 3", "Pasal 4", "Pasal 9"]


# ---- problem 3

def test_neighbours_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(300, 16))
    x = np.repeat(centres, 5, axis=0) + rng.normal(scale=0.15, size=(1500, 16))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_no long, embedding array<float>")
    got: dict = {}
    for r in neighbours.most_similar(df, k=4, dim=16, subspaces=8, codes=64, probes=8).collect():
        got.setdefault(r.row_no, set()).add(r.other)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    true = {i: set(np.argsort(-s[i])[:4].tolist()) for i in range(len(x))}
    assert sum(len(true[i] & got[i]) for i in true) / (4 * len(true)) >= 0.95
    hot = neighbours.most_similar(df, k=4, dim=16, subspaces=8, codes=64, probes=8, part=20)  # lists cut into parts
    assert {(r.row_no, r.other) for r in hot.collect()} >= {(i, j) for i in (0, 700) for j in true[i] if s[i, j] > 0.9}


def test_neighbours_of_copies_and_dense_clusters(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 16))
    x[rng.permutation(900)[:300]] = x[0]  # a third of all rows are one vector
    x[5] = x[0] * 2
    x[600:800] = x[1] + rng.normal(scale=1e-4, size=(200, 16))  # closer together than their codes tell
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_no long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -2)
    true = {(i, j, n + 1) for i in range(len(x)) for n, j in enumerate(np.argsort(-s[i], kind="stable")[:5].tolist())}
    every = dict(k=5, dim=16, subspaces=4, codes=8, probes=10_000)
    got = neighbours.most_similar(df, **every).collect()
    assert {(r.row_no, r.other, r["rank"]) for r in got} == true
    near = neighbours.most_similar(df, floor=0.85, part=50, **every).collect()
    assert {(r.row_no, r.other, r["rank"]) for r in near} == {t for t in true if s[t[0], t[1]] >= 0.85}
    some = neighbours.most_similar(df, queries=F.col("row_no") % 50 == 0, **every).collect()
    assert {(r.row_no, r.other, r["rank"]) for r in some} == {t for t in true if t[0] % 50 == 0}


def test_hot_lists_are_dealt(spark):
    """Half of all rows near one centroid, cut into parts and blocks: nothing is lost, and no task holds more than about a part."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1200, 16))
    x[::2] = x[0] + rng.normal(scale=0.05, size=(600, 16))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_no long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    true = {(i, j) for i in range(0, 1200, 7) for j in np.argsort(-s[i], kind="stable")[:3].tolist()}
    got = neighbours.most_similar(df, k=3, dim=16, subspaces=4, codes=16, sample=48, probes=3, part=40, queries=F.col("row_no") % 7 == 0).collect()
    assert {(r.row_no, r.other) for r in got} == true  # 3 lists, all visited


def test_tables_and_decoded_rows_give_the_same_sums():
    rng = np.random.default_rng(7)
    x = neighbours.unit(rng.normal(size=(500, 16)))
    m = neighbours.Quantiser(x, 6, 4, 16, 1)
    of = neighbours.nearest(x, m.centroids)
    rows = np.flatnonzero(of == 2)
    codes = m.encode(x[rows], of[rows])
    q = x[:50].astype(np.float32)
    assert np.allclose(m.scores(q, codes, 2), m.scores(q, codes, 2, m.decode(2, codes)), atol=1e-5)


def test_probes_follow_the_data():
    rng = np.random.default_rng(8)
    loose = neighbours.unit(rng.normal(size=(4000, 32)))
    tight = neighbours.unit(np.repeat(rng.normal(size=(400, 32)), 10, axis=0) + rng.normal(scale=0.1, size=(4000, 32)))
    need = {n: neighbours.needed_probes(neighbours.Quantiser(x, 128, 8, 64, 1), x, 5, -1.0, 0.98, 1) for n, x in (("loose", loose), ("tight", tight))}
    assert need["tight"] <= 4 < need["loose"] <= 128


# ---- problem 4

def test_scan_page():
    m = scans.LineModel()
    file = {scans.line_key("Kota Mekin Nomor 44 Tahun 1992", None): 4}
    text = "Kota Mekin Nomor 44 Tahun 1992\nSetiap orang wajib melin-\nHal 3\ndungi hutan dan sekurang-\nkurangnya\nlaut tiap tahun.\n\n745\n- 3 -"
    y = scans.label([(text, 3, file)], m)[0]
    got = set(scans.items(text, y, frozenset(words("setiap orang wajib hutan dan laut tiap tahun"))))
    assert {("header", "Kota Mekin Nomor 44 Tahun 1992", ""), ("page_number", "3", ""), ("halves", "melin", "dungi"), ("halves", "sekurang", "kurangnya")} == {x for x in got if x[0] != "word"}
    out = scans.paragraphs(y, {"melin dungi": "melindungi"}, {})
    assert out.split("\n")[0] == "Setiap orang wajib melindungi hutan dan sekurang-kurangnya laut tiap tahun." and "Mekin" not in out


def test_scan_corrections(spark):
    w = [("pemilihan", 900), ("pernilihan", 2), ("hari", 800), ("han", 3), ("dan", 5000), ("dari", 900), ("6ahan", 4), ("bahan", 60), ("maliri", 90), ("malin", 2), ("rp730", 3), ("25a", 2), ("x1y2", 9), ("kedaluwarsa", 99), ("kedaliiwarsa", 1), ("zzz", 1)]
    df = spark.createDataFrame(w, "word string, n long")
    assert {tuple(r) for r in scans.corrections(df).collect()} == {("pernilihan", "pemilihan"), ("6ahan", "bahan"), ("kedaliiwarsa", "kedaluwarsa")}


def test_scan_at_signs(spark):
    good = "Peraturan daerah ini mengatur retribusi parkir dan angkutan kota."
    bad = "Peraturan d@erah ini mengatur retribusi parkir dan @ngkutan kot@."
    broken = "Ketentuan mengenai retri-\nbusi p@r-\nkir dan ang-\nkut@n."
    texts = [good] * 30 + [bad, bad + " Tarif 5 @ orang, surat ke dinas@kota.go.id \u2014 hal ini.", broken]
    rows = spark.createDataFrame([(f"f-p{i}", "f", i, x) for i, x in enumerate(texts)], "id string, file string, page int, text string")
    repair = scans.Repair(rows)
    items: dict = {}
    for r in repair.items().collect():
        items.setdefault(r.id, set()).add((r.kind, r.item))
    meant = {("misread", w) for w in ("daerah", "angkutan", "kota")}
    assert items == {"f-p30": meant, "f-p31": meant, "f-p32": {("misread", "parkir"), ("misread", "angkutan"), *(("hyphenation", w) for w in ("retribusi", "parkir", "angkutan"))}}
    texts = {r.id: r.text for r in repair.texts().collect()}
    assert texts["f-p30"] == good
    assert texts["f-p31"] == good + " Tarif 5 @ orang, surat ke dinas@kota.go.id \u2014 hal ini."
    assert texts["f-p32"].split() == "Ketentuan mengenai retribusi parkir dan angkutan .".split()


def test_scan_words_of_two_characters(spark):
    good = "Perda no 45 berlaku di kota dan ke desa sesuai surat se gubernur."
    texts = [good] * 40 + ["Perda N0 45 berlaku d1 kota dan ké desa. Pasal 6A dan Pasal 5C dan 0a."] + ["Perda n0 tetap berlaku."] * 8
    rows = spark.createDataFrame([(f"f-p{i}", "f", i, x) for i, x in enumerate(texts)], "id string, file string, page int, text string")
    repair = scans.Repair(rows)
    items = {(r.id, r.kind, r.item) for r in repair.items().collect()}
    assert items == {("f-p40", "misread", w) for w in ("no", "di", "ke")} | {(f"f-p{i}", "misread", "no") for i in range(41, 49)}
    fixed = {r.id: r.text for r in repair.texts().where("id = 'f-p40'").collect()}
    assert fixed["f-p40"] == "Perda NO 45 berlaku di kota dan ke desa. Pasal 6A dan Pasal 5C dan 0a."


@pytest.mark.parametrize("most", [2_000, 0])  # by file, by text
def test_scan_headers_with_a_final_stop(spark, monkeypatch, most):
    monkeypatch.setattr(scans, "FILE_LINES", most)
    rng = random.Random(12)
    header = "Lembaran Daerah Kota Mekin No. 4."
    body = lambda: "\n".join([sentence(rng, 9) for _ in range(5)] + ["berlaku pula ketentuan Pasal 4 ayat", "(3)."])
    texts = [f"{header}\n{body()}" if i != 2 else f"{header}\n{body()}\nhal. 3" for i in range(6)]
    rows = spark.createDataFrame([(f"f-p{i + 1}", "f", i + 1, x) for i, x in enumerate(texts)] + [("g-p1", "g", 1, sentence(rng))], "id string, file string, page int, text string")
    got = {(r.id, r.item) for r in scans.Repair(rows).items().where("kind IN ('header', 'page_number')").collect()}
    assert got == {(f"f-p{i}", header) for i in range(1, 7)} | {("f-p3", "3")}


def test_scan_systematic_misreadings(spark):
    w = [("sistem", 50_000), ("sisfem", 200), ("tarif", 900), ("larif", 400), ("daerah", 90_000), ("claerah", 9), ("wajib", 30_000), ("vvajib", 3), ("lainnya", 1_000_000)]
    df = spark.createDataFrame(w, "word string, n long")
    assert {tuple(r) for r in scans.corrections(df).collect()} == {("sisfem", "sistem"), ("claerah", "daerah"), ("vvajib", "wajib")}


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="abcdehiklmnorstuvwy", min_size=1, max_size=12), st.randoms())
def test_skeleton_is_blind_to_confusions(word, rng):
    seen = "".join(rng.choice([c, *scans.CONFUSIONS.get(c, [])]) for c in word)
    assert scans.skeleton(seen) == scans.skeleton(word) and scans.misreading(seen, word) is not None


def test_skeleton_column(spark):
    ws = ["internasional", "Kebun ke-7", "9bz@áé", "m", ""]
    df = spark.createDataFrame([(w,) for w in ws], "w string")
    assert [r[0] for r in df.select(scans.skeleton_column(F.col("w"))).collect()] == [scans.skeleton(w) for w in ws]


def test_paths_equal_single_paths():
    m, rng = scans.LineModel(), random.Random(2)
    texts = [[rng.randrange(len(scans.SYMBOLS)) for _ in range(rng.randrange(0, 30))] for _ in range(60)]
    assert m.paths(texts) == [m.paths([t])[0] for t in texts]


# ---- problem 5

def near_texts(rng):
    base = [[rng.choice(WORDS) for _ in range(rng.randrange(4, 160))] for _ in range(60)]
    out = []
    for b in base:
        for _ in range(rng.randrange(1, 6)):
            t = list(b)
            for _ in range(rng.randrange(0, 1 + len(t) // 14)):
                t[rng.randrange(len(t))] = rng.choice(WORDS)
            out.append(" ".join(t))
    return out + ["satu dua", "satu dua", "", "A,b c", "a b  C"]


def brute(texts, t, n):
    sets = []
    for x in texts:
        w = words(x)
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)})
    return {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-9}


@pytest.mark.parametrize("block", [1_000, 3])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = near_texts(random.Random(5))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(999, None)], "id int, text string")
    s = neardup.Similar(df, 0.7, 3)
    got, want = {tuple(r) for r in neardup.id_pairs(s).collect()}, brute(texts, 0.7, 3)
    assert got <= want and len(got) >= 0.995 * len(want)
    rows = neardup.groups(s).collect()
    assert sum(r.links for r in rows) == 2 * len(got)
    label = {r.id: r.group_id for r in rows}
    assert all(label[a] == label[b] for a, b in got)
    few = neardup.Similar(df, 0.7, 3, every=False)
    assert {tuple(r) for r in neardup.groups(few).collect()} == {(r.id, r.class_id, r.group_id) for r in rows}


@pytest.mark.parametrize("every", [True, False])
def test_forms_in_one_bucket(spark, monkeypatch, every):
    """Many variants of one form, and some that are similar to each other but not to the form, in buckets larger than a task takes."""
    monkeypatch.setattr(neardup, "BLOCK", 20)
    rng = random.Random(15)
    form = [rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(80)]
    texts = []
    for i in range(150):
        t = list(form)
        for _ in range(2 if i % 30 else 12):
            t[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(t))
        if i % 10 == 0:
            t[rng.randrange(80)] = "lain"
            texts.append(" ".join(t))
    s = neardup.Similar(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), 0.7, 3, every=every)
    want = brute(texts, 0.7, 3)
    if every:
        got = {tuple(r) for r in neardup.id_pairs(s).collect()}
        assert got <= want and len(got) >= 0.995 * len(want)
    else:
        assert s.pairs.count() < len(want) / 2  # stars, and what is not similar to their centres
    label = list(range(len(texts)))
    for _ in texts:
        for a, b in want:
            label[a] = label[b] = min(label[a], label[b])
    assert sum(r.group_id == label[r.id] for r in neardup.groups(s).collect()) >= len(texts) - 1


def test_groups_of_short_texts(spark):
    texts = ["", "satu dua", "Satu, dua!", "satu", None, "satu dua tiga empat", "  "]
    s = neardup.Similar(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), 0.7, 3)
    assert neardup.id_pairs(s).count() == 0
    assert {tuple(r) for r in neardup.groups(s).collect()} == {(0, 0, 0, 0), (6, 0, 0, 0), (1, 1, 1, 0), (2, 1, 1, 0), (3, 3, 3, 0), (5, 5, 5, 0)}


def test_hot_copies_stay_linear(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.lit("satu dua tiga empat lima enam")).otherwise(F.concat(F.lit("kata "), "id", F.lit(" lagi dan lagi"))).alias("text"))
    s = neardup.Similar(df, 0.8, 5)
    assert s.pairs.count() == 0
    assert neardup.groups(s).groupBy("class_id").count().agg(F.max("count")).first()[0] == 2000


# ---- problem 6

def test_line_counts_by_deltas(spark):
    rng = random.Random(6)
    notice, fresh = "Dokumen ini diunduh dari jaringan arsip", "Lihat juga peraturan terkait di beranda"
    make = lambda lo, hi, extra: [(f"f{i % 9}-p{i}-0", f"f{i % 9}", "k" if i % 5 else None, "\n".join([sentence(rng), f"* {extra.upper() if i % 2 else extra} {i}", sentence(rng)])) for i in range(lo, hi)]
    schema = "id string, file string, source string, text string"
    one, two = spark.createDataFrame(make(0, 60, notice), schema), spark.createDataFrame(make(60, 140, fresh), schema)
    before = boilerplate.delta(one)
    after = boilerplate.merge(before, boilerplate.delta(two))
    whole = boilerplate.delta(one.unionByName(two))
    assert sorted(after.lines.collect()) == sorted(whole.lines.collect())
    back = boilerplate.merge(after, boilerplate.delta(two, sign=-1))
    assert sorted(back.lines.collect()) == sorted(before.lines.collect()) and sorted(back.totals.collect()) == sorted(before.totals.collect())
    cross = boilerplate.crossings(boilerplate.frequent(before), boilerplate.frequent(after))
    assert [r.crossed for r in cross.collect()] == ["up"]
    todo = boilerplate.affected(one.unionByName(two), cross)
    assert todo.count() == sum(1 for i in range(60, 140) if i % 5)
    gone, lines = boilerplate.removed_lines(todo, after)
    clean = boilerplate.strip_lines(todo, gone)
    assert lines.count() == 1 and clean.where(F.lower("text").contains("beranda")).count() == 0 and clean.where(F.size(F.split("text", "\n")) == 2).count() == clean.count()


def test_lines_removed_by_parts(spark):
    rng = random.Random(7)
    fifth, old, late = "Salinan sesuai dengan aslinya menurut arsip", "Dokumen ini diunduh dari jaringan lama", "Lihat juga peraturan terkait di beranda"

    def rows(lo, hi, line):
        return [(f"f{f}-p{i}-0", f"f{f}", "k", "\n".join([sentence(rng), *([x] if (x := line(i, f)) else [])])) for i in range(lo, hi) for f in [i % 10]]

    one = rows(0, 100, lambda i, f: fifth if f < 4 else old if i < 20 and f > 4 else None)  # fifth: 4 files; old: 10 rows of 100
    two = rows(100, 400, lambda i, f: fifth if i == 109 else late if i % 2 else None)  # one row of a fifth file; old falls under 3 per cent
    two.append(two[-1])  # a row that comes twice
    schema = "id string, file string, source string, text string"
    one, two = spark.createDataFrame(one, schema), spark.createDataFrame(two, schema)
    lines = lambda got: {tuple(r) for r in got[1].collect()}
    removed = lambda got: {tuple(r) for r in got[0].collect()}
    alone, whole, parts = boilerplate.removed_lines(one), boilerplate.removed_lines(one.unionByName(two)), boilerplate.removed_by_parts([one, two])
    assert lines(parts) == lines(whole) and removed(parts) == removed(whole)
    fixed = {r[1]: (r[2], r[3]) for r in lines(whole)}
    assert fixed == {fifth.lower(): (41, 5), late.lower(): (149, 5)}
    assert {r[1] for r in lines(alone)} == {old.lower()}
    # A file more is a crossing though the rows were enough before, and the counts of the state decide on any rows.
    state = boilerplate.merge(boilerplate.delta(one), boilerplate.delta(two))
    cross = boilerplate.crossings(boilerplate.frequent(boilerplate.delta(one)), boilerplate.frequent(state))
    todo = boilerplate.affected(one, cross)
    assert todo.where(F.col("text").contains(fifth)).count() == 40
    assert {r.id for r in boilerplate.removed_lines(todo.limit(3), state)[0].collect()} == {r.id for r in todo.limit(3).where(F.col("text").contains(fifth)).collect()}


# ---- problem 7

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=200), st.booleans())
def test_fill(sizes, top_up):
    x = np.array(sizes, dtype=np.int64)
    no = packing.fill(x, 100, top_up)
    assert (no >= 0).all() and (not len(x) or np.bincount(no, weights=x).max() <= 100)


def test_pack(spark):
    rng = random.Random(7)
    sizes = [rng.randrange(1, 9000) for _ in range(3000)] + [4096, 4097, None, 0]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id int, size long")
    rows = packing.pack(df, F.col("size"), 4096, share=1000).collect()
    room: dict = {}
    per: dict = {}
    for r in rows:
        room[r.container] = room.get(r.container, 0) + r["size"]
        per.setdefault(r.doc_id, []).append((r.start, r["size"]))
    assert max(room.values()) <= 4096
    for i, n in enumerate(sizes):
        parts = sorted(per.get(i, []))
        assert sum(s for _, s in parts) == (n or 0) and (len(parts) <= 1 or n > 4096)
        assert [a for a, _ in parts] == [sum(s for _, s in parts[:k]) for k in range(len(parts))]
    assert sum(room.values()) / (4096 * len(room)) > 0.98


# ---- problem 8

def leaked(docs, items, n=13):
    out = set()
    for d, t in docs:
        w = words(t or "")
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for i, u in items:
            v = words(u or "")
            if any(tuple(v[k : k + n]) in grams for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize(("block", "slice_"), [(200_000, 400_000), (50, 30)])
def test_leaks(spark, monkeypatch, block, slice_):
    rng = random.Random(8)
    items = [(i, " ".join(sentence(rng, rng.randrange(5, 15)) for _ in range(4))) for i in range(12)] + [(50, "pendek"), (51, None)]
    docs = []
    for d in range(120):
        t = [sentence(rng) for _ in range(rng.randrange(0, 8))]
        if d % 3 == 0:
            w = items[d % 12][1].split()
            k, n = rng.randrange(0, 10), rng.randrange(11, 16)
            t.insert(rng.randrange(0, len(t) + 1), " ".join(w[k : k + n]).upper())
        docs.append((d, " -- ".join(t)))
    docs += [(500, None), (501, ""), (502, items[3][1])]
    monkeypatch.setattr(leakage, "BLOCK", block)
    monkeypatch.setattr(leakage, "SLICE", slice_)
    D, T = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    got = {tuple(r) for r in leakage.leaks(D, T).select("doc_id", "item_id").distinct().collect()}
    assert got == leaked(docs, items)


def edits(w, kind, rng):
    at = rng.randrange(13)
    return {"replaced": w[:at] + ["lain"] + w[at + 1 :], "put in": w[:at] + ["lain"] + w[at:], "left out": w[:at] + w[at + 1 :]}[kind]


@pytest.mark.parametrize(("block", "slice_"), [(200_000, 400_000), (50, 40)])
def test_leaks_with_edits_reach_their_recall(spark, monkeypatch, block, slice_):
    monkeypatch.setattr(leakage, "BLOCK", block)  # the smaller one takes the join
    monkeypatch.setattr(leakage, "SLICE", slice_)
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(13))) for i in range(300)]
    docs = []
    for k, kind in enumerate(("replaced", "put in", "left out")):
        for i, t in items:
            w = edits(t.split(), kind, rng)
            docs.append((k * 1000 + i, " ".join(w) if i % 3 == 0 else sentence(rng) + " " + " ".join(w) + " " + sentence(rng)))
    D, T = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    got = leakage.leaks(D, T, max_edits=1, recall=0.95).collect()
    for k in range(3):
        assert sum(r.doc_id == k * 1000 + r.item_id for r in got) >= 0.95 * len(items)
    assert all(r.distance <= 1 and r.doc_id % 1000 == r.item_id and r.item_pos == 0 for r in got)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=5, max_size=5), st.lists(st.integers(1, 4), max_size=9), st.integers(0, 2))
def test_distances_against_the_plain_matrix(item, span, most):
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    wide = np.full((1, 5 + most), 9, dtype=np.uint64)
    wide[0, : min(len(span), 5 + most)] = span[: 5 + most]
    near, size = leakage.distances(np.array([item], dtype=np.uint64), wide, np.array([len(span)]), most)
    lengths = [n for n in range(5 - most, 5 + most + 1) if n <= len(span)]
    want = min((plain(item, span[:n]) for n in lengths), default=99)
    assert near[0] == (want if want <= most else leakage.FAR)
    assert near[0] > most or plain(item, span[: size[0]]) == want


def test_repetitions_that_never_reach_the_recall():
    with pytest.raises(ValueError):
        leakage.repetitions(13, 6, 7, 0.99999)


# ---- problem 9

def test_truncation_on_held_out_cuts(spark):
    rng = random.Random(10)
    rows = []
    for i in range(3000):
        t = " ".join(sentence(rng, rng.randrange(6, 14)) for _ in range(rng.randrange(4, 40)))
        cut, source = i % 10 == 0, "limited" if i % 4 == 0 else "free"
        n = len(t)
        if cut:
            t = t[:400] if source == "limited" and n > 420 else t[: rng.randrange(120, max(121, n - 20))]
            cut = not t.rstrip().endswith(".")
        elif i % 7 == 0:
            t += "\nttd.\nCAMAT " + rng.choice(WORDS).upper()
            n = len(t)
        rows.append((i, t, source, n if i % 2 else None, cut))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, declared_chars long, cut boolean")
    got = {r.doc_id for r in truncation.scores(df).where("score > 0.5").collect()}
    true = {r[0] for r in rows if r[4]}
    assert len(got & true) / len(true) > 0.95 and len(got & true) / len(got) > 0.9
    assert [list(r.char_limits) for r in truncation.limits(df).collect() if r.source == "limited"] == [[400]]
