"""The pipeline's stages, each on its own input, against plain versions."""

import hashlib
import importlib.util
import random
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from test_pairs_and_mix import plain_report
from test_secrets_and_fingerprints import plain_spans

import corpus_pipeline
from barloom.llm import cotraining, mixing, simhash_bk
from barloom.llm._common import staged

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def redacted(text):
    spans = [tuple(map(int, s.split(":")[1:])) for s in plain_spans(text).split(",") if s]
    out, at = "", 0
    for start, end in spans:
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], SF), "step"))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_follow_each_other(spark, steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "secrets", "mix"]
    assert all(step.columns == steps[0].columns for step in steps[:-1])
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, steps[-1].collect()))


def test_quality_drops_what_the_classifier_rejects(spark, steps):
    kept = {r.doc_id for r in cotraining.report(steps[0], spark.read.parquet(f"{SF}/labels.parquet")).where("keep").collect()}
    before, after = rows(steps[0]), rows(steps[1])
    assert set(after) == kept and 0 < len(kept) < len(before) and all(after[i] == before[i] for i in after)
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(good - kept) <= 0.01 * len(good)


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(texts):
    """Smallest id of each group of texts that hang together by a share of 0.8 of their five-word shingles; (id, text) rows."""
    sets, up = [shingles(t) for _, t in texts], list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (len(a & b) >= 0.8 * len(a | b)) and root(i) != root(j):
                up[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i, (doc, _) in enumerate(texts):
        groups.setdefault(root(i), []).append(doc)
    return {min(g) for g in groups.values()}


def test_near_duplicates_keep_one_of_each_group(steps):
    before, after = rows(steps[1]), rows(steps[2])
    assert set(after) == plain_groups([(i, r.text) for i, r in before.items()]) and all(after[i] == before[i] for i in after)
    assert len(after) < len(before)


def test_planted_near_copies_go(spark):
    """Copies of 120 documents with one to many words changed, up to the likeness of 0.8."""
    rng = random.Random(8)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 400 AND lang = 'en' AND doc_id % 7 = 1").orderBy("doc_id").limit(120).collect()
    planted = []
    for k, r in enumerate(docs):
        for edits in (1, 2, 4, 8, 16):
            words = r.text.split()
            for at in rng.sample(range(len(words)), min(edits, len(words))):
                words[at] = f"changed{rng.randrange(10**9)}"
            copy = " ".join(words)
            a, b = shingles(r.text), shingles(copy)
            if len(a & b) >= 0.8 * len(a | b):
                planted.append((r.doc_id, 10_000 + 10 * k + edits, copy))
    table = spark.createDataFrame([(r.doc_id, r.text) for r in docs] + [(i, t) for _, i, t in planted], "doc_id long, text string")
    group = {r.doc_id: r.group for r in simhash_bk.near_copies(table).collect()}
    caught = [group[of] == group[i] for of, i, _ in planted]
    assert len(planted) > 250 and sum(caught) >= 0.98 * len(caught)
    kept = {r.doc_id for r in simhash_bk.keep_one(table).collect()}
    assert kept == {min(i for i, g in group.items() if g == mine) for mine in group.values()}
    assert simhash_bk.near_copies(table, tree_nodes=3).select("group").distinct().count() == len(kept)


def test_copies_with_clashing_names_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    data = [(1, text, 5, {"a": 1}), (1, text, 6, {"b": 1}), (1, text + " x", 7, None), (None, text, 8, None), (2, "other words", 9, None), (None, None, 1, None), (3, "", 2, None), (4, " \t", 3, None)]
    table = spark.createDataFrame(data, "doc_id long, text string, _id int, extra map<string,int>").withColumnsRenamed({"extra": "key"}).withColumn("id", F.lit(1))
    kept = simhash_bk.keep_one(table)
    assert kept.columns == table.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    md5 = lambda t: hashlib.md5(t.encode()).digest()
    assert got == sorted([(1, min((text, text + " x"), key=md5)), (2, "other words"), (3, "")], key=str)
    assert simhash_bk.keep_one(table.limit(0)).count() == 0


def test_contaminated_documents_go(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = rows(steps[2]), rows(steps[3])
    assert set(after) == {i for i, *_, bad in plain_report([(i, r.text) for i, r in before.items()], items) if not bad}
    assert all(after[i] == before[i] for i in after)


def test_secrets_are_replaced_and_nothing_else(steps):
    before, after = rows(steps[3]), rows(steps[4])
    assert set(before) == set(after)
    for i, r in before.items():
        assert after[i].text == redacted(r.text) and after[i].n_chars == (r.n_chars if r.text == after[i].text else len(after[i].text))
        assert (after[i].lang, after[i].source) == (r.lang, r.source)


def test_mix_equals_its_sql(steps):
    con = duckdb.connect()
    documents = steps[4].toPandas()  # noqa: F841
    want = con.execute(mixing.ORACLE).fetchdf()[["doc_id", "source", "size", "source_size", "target", "taken"]]
    got = steps[5].toPandas()
    assert got.sort_values("doc_id").values.tolist() == want.sort_values("doc_id").values.tolist()


def test_stages_take_odd_tables(spark, docs_of, odd_rows, tmp_path):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs_of(odd_rows), docs_of([])):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = staged(stage(spark, docs, str(tmp_path)), "odd")
            assert docs.columns == table.columns
        assert corpus_pipeline.mix(spark, docs, str(tmp_path)).count() == docs.count()


def test_entry_works_without_the_subpackage(tmp_path):
    """The driver removes these folders: the entry module then registers the other queries only."""
    for name in ("barloom", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    (tmp_path / "barloom").mkdir()
    for part in (ROOT / "barloom").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (tmp_path / "barloom" / part.name).symlink_to(part)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']; print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout) > 150, done.stderr[-2000:]
    assert importlib.util.find_spec("corpus_pipeline") is not None
