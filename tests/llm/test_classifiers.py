"""Co-training and ordinal regression: held-out accuracy, and defined results on odd rows."""

import random
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import cotraining, queries, secret_ledger, simhash_bk, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_holds_on_documents_it_has_not_seen(tables):
    docs, labels = tables
    found = {r.doc_id: r for r in cotraining.report(docs, labels.where("doc_id % 4 <> 1")).collect()}
    held = labels.where("doc_id % 4 = 1").collect()
    assert np.mean([found[r.doc_id].keep == bool(r.quality) for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 and 0 <= r.text_score <= 1 and 0 <= r.meta_score <= 1 for r in found.values()) and len(found) == docs.count()


def test_toxicity_holds_on_documents_it_has_not_seen(tables):
    docs, labels = tables
    found = {r.doc_id: r for r in toxicity.severity(docs, labels.where("doc_id % 4 <> 1")).collect()}
    held = labels.where("doc_id % 4 = 1").collect()
    assert np.mean([found[r.doc_id].toxic == bool(r.toxic) for r in held]) >= 0.93
    assert all(1 >= r.p_1 >= r.p_2 >= r.p_3 >= 0 and r.severity == pytest.approx(r.p_1 + r.p_2 + r.p_3) for r in found.values())
    bad = np.mean([found[r.doc_id].severity for r in held if r.toxic])
    assert bad > 5 * np.mean([found[r.doc_id].severity for r in held if not r.toxic])


def test_views_teach_each_other():
    """The text view learns a word that only documents show whose source gives their quality away, and no label."""
    rng = np.random.default_rng(5)
    n = 1_200
    truth = rng.integers(0, 2, n)
    meta = np.stack([truth * 2.0 - 1 + rng.normal(0, 0.05, n), rng.normal(0, 1, n)], axis=1)
    known = np.zeros(n, dtype=bool)
    known[:240] = True
    strong = np.where(known, (truth * 2 - 1) * (rng.random(n) < 0.8), 0.0)
    fresh = np.where(known, 0.0, truth * 2.0 - 1)
    text = np.stack([strong, fresh], axis=1)
    y = np.where(known, truth, -1)
    model = cotraining.cotrain([text, meta], y)
    given = model["given"].reshape(2, -1)
    assert given[0, -1] > 100 and model["text"][1] > 1.0
    assert (np.diff(given[0]) > 0).all() and np.diff(given[0]).sum() > 0.5 * (y < 0).sum()  # every round gives rows that no round gave before
    assert np.mean((cotraining.score(model, text, meta)[2] >= 0.5) == truth) > 0.99
    alone = cotraining.cotrain([text, meta], y, rounds=0)
    assert alone["text"][1] == pytest.approx(0, abs=1e-6)


def test_ordinal_recovers_weights_and_thresholds():
    rng = np.random.default_rng(2)
    n, d = 4_000, 3
    x = rng.normal(0, 1, (n, d))
    w, thetas = np.array([1.5, -1.0, 0.0]), np.array([-0.5, 0.8, 2.0])
    noise = rng.logistic(0, 1, n)
    grades = ((x @ w + noise)[:, None] >= thetas[None, :]).sum(axis=1)
    rows, cols = np.repeat(np.arange(n), d), np.tile(np.arange(d), n)
    model = toxicity.Ordinal.fit(rows, cols, x.ravel(), grades, d, l2=0.0)
    assert np.abs(model.weights - w).max() < 0.15 and np.abs(model.thetas - thetas).max() < 0.15
    assert all(a < b for a, b in pairwise(model.thetas))
    assert model.at_least(np.array([0.3])).sum() == pytest.approx((1 / (1 + np.exp(model.thetas - 0.3))).sum())


def test_grades_are_thirds():
    grades = toxicity.severity_grades(np.array([0, 1, 1, 1, 0, 1, 1, 1]), np.array([9, 1, 2, 3, 0, 4, 5, 6.0]))
    assert grades.tolist() == [0, 1, 1, 2, 0, 2, 3, 3]


def test_odd_rows(spark, docs_of, odd_rows):
    labels = spark.createDataFrame([(1, 0, 1, 9), (4, 1, 0, 9), (4, 1, 0, 9), (6, 0, 1, 9), (7, 1, None, 9), (999, 1, 0, 9), (None, 1, 1, 9), (9, None, 0, 9), (8, 0, 1, 9), (8, 1, 0, 9)],
                                   "doc_id long, quality int, toxic int, text int")
    table = docs_of(odd_rows)
    for few in (labels, labels.limit(0), labels.where("quality = 1")):
        got = cotraining.report(table, few).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in odd_rows) and all(0 <= r.score <= 1 for r in got)
        kept = cotraining.reject_low_quality(table, few)
        assert kept.columns == table.columns and kept.count() == sum(r.keep for r in got)
        worst = toxicity.severity(table, few).collect()
        assert sorted(str(r.doc_id) for r in worst) == sorted(str(r[0]) for r in odd_rows) and all(0 <= r.severity <= 3 for r in worst)
    assert all(r.keep and r.score == 1 for r in cotraining.report(table, labels.limit(0)).collect())
    assert all(r.severity == 0 and not r.toxic for r in toxicity.severity(table, labels.limit(0)).collect())
    assert cotraining.report(docs_of([]), labels).count() == 0 and toxicity.severity(docs_of([]), labels).count() == 0


def test_fits_do_not_depend_on_the_order_of_rows(tables):
    docs, labels = tables
    some = docs.where("doc_id < 300")
    one, two = (fit(some, labels) for fit in (cotraining.fit, toxicity.fit)), (fit(some.repartition(7).orderBy("source"), labels) for fit in (cotraining.fit, toxicity.fit))
    for a, b in zip(one, two, strict=True):
        assert a.keys() == b.keys() and all((a[k] == b[k]).all() for k in a)


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    """Many rows under one labelled id, and labels of documents that are not there."""
    monkeypatch.setattr(toxicity, "_fit", _count_rows)
    docs = spark.range(4_000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(100_000).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS toxic")
    near = lambda got, want: 0.75 * want < got < 1.25 * want
    assert near(toxicity.fit(docs, labels, labelled=400)["rows"][0], 400)
    for content in ("id", "1"):
        odd = docs.union(spark.range(5_000).selectExpr("7L", f"concat('text ', {content})"))
        assert near(toxicity.fit(odd, labels, labelled=400)["rows"][0], 400)


def test_clashing_names(tables):
    """Columns named like the helpers of the operators are carried along untouched."""
    docs, labels = tables
    names = ("_id", "_text", "_spans", "_blob", "_label", "_key", "id", "blob", "spans", "new", "key", "cq_bytes", "cq_text", "cq_lang", "_copies", "_k")
    some, marks = docs.where("doc_id < 200"), labels.withColumns({n: F.lit(1) for n in ("_id", "_label", "n")})
    odd = some.withColumns({n: F.lit(k) for k, n in enumerate(names)})
    assert {tuple(r) for r in toxicity.severity(odd, marks).collect()} == {tuple(r) for r in toxicity.severity(some, labels).collect()}
    for step in (lambda d: cotraining.reject_low_quality(d, marks), simhash_bk.keep_one, secret_ledger.redact):
        got, want = step(odd), step(some)
        assert got.columns == odd.columns
        assert {tuple(r[: len(some.columns)]) for r in got.collect()} == {tuple(r) for r in want.collect()}
        assert got.where(" OR ".join(f"{n} <> {k}" for k, n in enumerate(names) if n != "cq_text")).count() == 0


def test_queries_cover_all_documents(spark):
    for query in (queries.op5_cotraining_quality, queries.op9_ordinal_toxicity):
        assert query(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_any_text_has_a_view():
    rng = random.Random(1)
    for text in (b"", b" ", b"\n\n", b"\xff\xfe", bytes(rng.randrange(256) for _ in range(5_000)), b"a" * 100_000):
        view = cotraining.text_view(text)
        assert np.isfinite(view).all() and len(view) == cotraining.STATS + cotraining.SHAPES + cotraining.WORDS


def _count_rows(options):
    """In place of the fit: how many rows with and without a label reach it."""
    def run(batches):
        labels = [v for b in batches for v in b.column(1).to_pylist()]
        n = [float(sum(v is not None for v in labels)), float(sum(v is None for v in labels))]
        yield pa.RecordBatch.from_arrays([pa.array(["rows"]), pa.array([n], pa.list_(pa.float64()))], names=["name", "weights"])

    return run


def test_sample_of_the_fit_is_bounded(spark, monkeypatch):
    """Few labels, labels on many rows, and many rows with one id or none: each share is drawn from its own rows."""
    monkeypatch.setattr(cotraining, "_fit", _count_rows)
    rows = lambda n, doc, content: spark.range(n).selectExpr(f"{doc} AS doc_id", f"concat('text ', {content}) AS text", "'en' AS lang", "'s' AS source", "9L AS n_chars")
    docs = rows(4_000, "id", "id")
    labels = lambda n: spark.range(n).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality")
    near = lambda got, want: 0.75 * want < got < 1.25 * want
    few = cotraining.fit(docs, labels(50), labelled=400, pool=400)["rows"]
    assert few[0] == 50 and near(few[1], 400)
    many = cotraining.fit(docs, labels(1_600), labelled=400, pool=400)["rows"]
    assert near(many[0], 400) and near(many[1], 400)
    for one_id in ("CAST(NULL AS bigint)", "-1L"):
        for content in ("id", "1"):
            odd = docs.union(rows(2_000, one_id, content))
            got = cotraining.fit(odd, labels(50), labelled=400, pool=400)["rows"]
            assert got[0] == 50 and near(got[1], 400)
    assert cotraining.fit(docs, labels(50), labelled=9_000, pool=9_000)["rows"].tolist() == [50, 3_950]
