"""Golden cases of citation checks and retry decisions."""

import pytest
from pyspark.sql import functions as F

from paperloom.operators import references as R

MAIN = [("UU_5_Tahun_1967.pdf", 3, "Pasal 3", "..."), ("UU_5_Tahun_1967.pdf", 5, "Pasal 6", "..."), ("PP_19_Tahun_2024.pdf", 12, "Pasal 1", "...")]
BODY = [("UU_12_Tahun_2011.pdf", 1, "BAB II", "Pasal 7 ayat (1) Jenis dan hierarki")]
BOUND = [("UU_12_Tahun_2011.pdf", 1, "BAB X", "Pasal 71 tentang")]
CASES = [
    (MAIN, "x (Pasal 3, 출처: UU_5_Tahun_1967.pdf, p.3).", ["verified"], ["ok"]),
    (MAIN, "x (Pasal 3, 출처: UU_5_Tahun_1967.pdf, p.7)", ["page_mismatch"], ["page_mismatch"]),
    (MAIN, "x (Pasal 1, 출처: UU_99_Fake.pdf, p.1)", ["unverified"], ["source_not_in_context"]),
    (MAIN, "x (Pasal 99, 출처: UU_5_Tahun_1967.pdf, p.3)", ["article_mismatch"], ["article_mismatch"]),
    (MAIN, "x (Pasal 6 ayat (1), 출처: UU_5_Tahun_1967.pdf, p.5)", ["verified"], ["ok"]),
    (MAIN, "(Pasal 3, 출처: UU_5_Tahun_1967.pdf, p.3) (Pasal 6，출처：UU_5_Tahun_1967.pdf，p.5) (Pasal 1, 출처: PP_19_Tahun_2024.pdf, p. 12)", ["verified"] * 3, ["ok"] * 3),
    (BODY, "x (Pasal 7 ayat (1), 출처: UU_12_Tahun_2011.pdf, p.1)", ["verified"], ["body_fallback"]),
    (BOUND, "x (Pasal 7, 출처: UU_12_Tahun_2011.pdf, p.1)", ["article_mismatch"], ["article_mismatch"]),
    (MAIN, "x (Pasal 3, 출처: uu_5_tahun_1967_salinan.pdf, p.3)", ["unverified"], ["source_not_in_context"]),
    ([("PP_19_Tahun_2024.pdf.bak", 2, "Pasal 4", "")], "x (Pasal 4, 출처: PP_19_Tahun_2024.pdf, p.2)", ["verified"], ["ok"]),
    ([("PP_19_Tahun_2024.pdf", None, None, None), (None, 1, "Pasal 4", "t")], "x (Pasal 4, 출처: PP_19_Tahun_2024.pdf, p.2)", ["article_mismatch"], ["article_mismatch"]),
    (MAIN, "no citation", [], []),
]


def test_citations(spark):
    answers = spark.createDataFrame([(i, c[1]) for i, c in enumerate(CASES)] + [(99, None)], "answer_id int, answer string")
    ctx = spark.createDataFrame([(i, p, *m) for i, c in enumerate(CASES) for p, m in enumerate(c[0])], "answer_id int, pos int, source string, page int, article string, text string")
    got = R.verify(R.citations(answers), ctx).orderBy("answer_id", "pos").collect()
    for i, c in enumerate(CASES):
        assert [r.status for r in got if r.answer_id == i] == c[2], c
        assert [r.reason for r in got if r.answer_id == i] == c[3], c
    totals = {r.answer_id: (r.total, r.verified, r.unverified) for r in R.citation_totals(R.verify(R.citations(answers), ctx)).collect()}
    assert totals[5] == (3, 3, 0) and totals[1] == (1, 0, 1) and 99 not in totals


def test_sources_at_once_equal_each_answer(spark):
    """What the sets of a source say is what its chunks say for every answer."""
    import itertools
    import random

    rng = random.Random(3)
    arts, bodies = ["Pasal 3", "Pasal 3A", "Pasal 30", "BAB I", "", None], ["lihat Pasal 3 dan pasal 7A.", "Pasal 30x; PASAL  3", "tanpa", None]
    rows = [(i, rng.choice(["A.pdf", "b.PDF", " c.pdf ", None, ""]), rng.choice([1, 2, 0, None]), rng.choice(arts), rng.choice(bodies)) for i in range(60)]
    cites = [(k, 0, "x", p, s, n) for k, (p, s, n) in enumerate(itertools.product(["Pasal 3", "Pasal 3 ayat (2)", "Pasal 7A", "Pasal 30", "Pasal  3"], ["a.pdf", "B.pdf", "c.pdf", "d.pdf"], [1, 2, 3, None]))]
    C = spark.createDataFrame(cites, "answer_id int, pos int, raw string, pasal string, source string, page int")
    R_ = spark.createDataFrame(rows, "pos int, source string, page int, article string, text string")
    every = C.select("answer_id", F.lower("source").alias("s")).join(R_, F.lower(F.trim(R_["source"])) == F.col("s")).drop("s")
    want = {tuple(r) for r in R.verify(C, every).where("reason <> 'source_not_in_context'").collect()}
    got = {tuple(r) for r in R.verify_in_sources(C, R_).collect()}
    assert got == want and {r[6] for r in got} == {"verified", "page_mismatch", "article_mismatch"}


@pytest.mark.parametrize(("confidence", "issues", "unverified", "retry", "reason"), [
    ("unknown", [], None, False, "ok"), ("high", [], 2, True, "verifier_unverified=2"), ("low", [], 0, True, "confidence=low"),
    ("medium", ["hallucination"], 0, True, "serious_issues=1"), ("medium", ["missing"] * 2, 0, True, "medium+issues=2"), ("high", ["missing"], 0, False, "ok")])
def test_retry(spark, confidence, issues, unverified, retry, reason):
    df = spark.createDataFrame([(confidence, [(t, "") for t in issues], unverified)], "c string, i array<struct<type:string,description:string>>, u int")
    yes, why = R.retry(F.col("c"), F.col("i"), F.col("u"))
    assert df.select(yes, why).first() == (retry, reason)
    off = R.retry(F.col("c"), F.col("i"), F.col("u"), max_retries=0)
    assert df.select(*off).first()[0] is False


def test_retry_message(spark):
    issues = F.array(F.struct(F.lit("hallucination").alias("type"), F.lit("made up").alias("description")))
    failed = F.array(F.struct(F.lit("(Pasal 3, p.7)").alias("raw"), F.lit("page_mismatch").alias("status")))
    t = spark.range(1).select(R.retry_message(F.lit("the question"), F.lit("ctx"), F.lit("the answer"), issues, failed)).first()[0]
    assert all(x in t for x in ("hallucination", "(Pasal 3, p.7)", "the question", "the answer"))
    assert t.index("(Pasal 3, p.7)") < t.index("hallucination")


def test_resolve(spark):
    refs = spark.createDataFrame([(1, "Pasal 3 UU Nomor 5 Tahun 1967"), (2, "PP 019/2024"), (3, "UUD 1945"), (4, "Undang"), (5, ""), (6, None), (7, "Perda Nomor 7"), (8, "UUD 1900"), (9, "Inpres No. 3-2001")], "ref_id int, reference string")
    src = spark.createDataFrame([("UU_05_Tahun_1967_x.pdf", "uu"), ("UU_5_Tahun_1967.pdf", "uu"), ("Salinan_UU_5_Tahun_1967.pdf", "uu"), ("X_PP_19_Tahun_2024.pdf", "pp"),
                                 ("UUD_1945.pdf", "constitution"), ("UUD_2002.pdf", "constitution"), ("Inpres_13_Tahun_2001.pdf", "lainnya")], "source string, collection string")
    p = R.parse_reference(refs)
    assert {r.ref_id: r.error for r in p.collect()} == {1: None, 2: None, 3: None, 4: "type", 5: "empty", 6: "empty", 7: "number", 8: None, 9: None}
    got = {r.ref_id: r.matched_source for r in R.resolve(p, src).collect()}
    assert got == {1: "UU_05_Tahun_1967_x.pdf", 2: "X_PP_19_Tahun_2024.pdf", 3: "UUD_1945.pdf", 8: "UUD_1945.pdf"}


def test_lookup_prefix(spark):
    rows = spark.createDataFrame([(f"c{i}", "a.pdf", i, i, a, "t") for i, a in enumerate(["Pasal 7", "Pasal 71", None, "", "BAB I"])], "id string, source string, page int, idx int, article string, text string")
    req = spark.createDataFrame([(1, "a.pdf", "Pasal 7"), (2, "a.pdf", None), (3, "b.pdf", None)], "request_id int, source string, pasal string")
    got = R.article_lookup(req, rows).collect()
    assert {r.id for r in got if r.request_id == 1} == {"c0", "c1"} and len([r for r in got if r.request_id == 2]) == 5 and not [r for r in got if r.request_id == 3]
    assert {r.id for r in R.article_lookup(req, rows, strict=True).collect() if r.request_id == 1} == {"c0"}
