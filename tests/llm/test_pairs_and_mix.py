"""Mixing, decontamination and SimHash against plain versions of themselves."""

import hashlib
import random
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash

from barloom.llm import decontamination, mixing, queries, simhash_bk
from barloom.llm._graph import components

SF = "/root/testdata/sf0.001"


def plain_simhash(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs, radius=2):
    """Smallest id reachable over links of at most ``radius`` bits, for (id, fp) pairs."""
    up = list(range(len(pairs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(pairs)), 2):
        if (pairs[i][1] ^ pairs[j][1]).bit_count() <= radius:
            up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return [low.get(root(i)) for i in range(len(pairs))]


def key(rows):
    return sorted(map(str, rows))


def test_simhash_query_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    fps = [plain_simhash(t) for _, t in docs]
    want = [(d, f"{fp:016x}", c) for (d, _), fp, c in zip(docs, fps, plain_components([(d, fp) for (d, _), fp in zip(docs, fps, strict=True)]), strict=True)]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in queries.op6_simhash_bk_trees(spark, SF).collect()]
    assert key(got) == key(want)


def test_simhash_odd_rows(spark, docs_of, odd_rows):
    fps = [plain_simhash(t) for _, t, _ in odd_rows]
    want = [(d, fp, c) for (d, _, _), fp, c in zip(odd_rows, fps, plain_components([(r[0], fp) for r, fp in zip(odd_rows, fps, strict=True)]), strict=True)]
    found = simhash_bk.near_duplicates(docs_of(odd_rows))
    assert key((r.doc_id, r.fp % 2**64, r.component) for r in found.collect()) == key(want)
    kept = simhash_bk.keep_one(docs_of(odd_rows))
    assert kept.columns == docs_of(odd_rows).columns
    assert key(r.doc_id for r in kept.collect()) == key([1, None, 4, 6, 8, 9, 11, 12])
    assert simhash_bk.near_duplicates(docs_of([])).count() == 0 and simhash_bk.keep_one(docs_of([])).count() == 0


@pytest.mark.parametrize("tree_nodes", [16, 16_384])
def test_dense_shards_lose_no_link(spark, tree_nodes):
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(8)]
    numbers = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(60)} | {rng.getrandbits(64) for _ in range(300)})
    signed = np.array(numbers, dtype=np.uint64).view(np.int64).tolist()
    links = simhash_bk.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), tree_nodes=tree_nodes)
    assert all((r.a ^ r.b).bit_count() <= 2 for r in links.selectExpr("a", "b").collect() if (r.a >= 0) == (r.b >= 0))
    root = {r.node: r.root for r in components(links, "a", "b").collect()}
    want = plain_components(list(zip(signed, numbers, strict=True)))
    assert [root.get(x, x) for x in signed] == want


def test_bk_tree_equals_one_by_one_insertion():
    rng = np.random.default_rng(3)
    numbers = np.unique(rng.integers(0, 2**12, 400, dtype=np.uint64))
    tree = simhash_bk.BKTree(numbers)
    child = {}
    for i in range(1, len(numbers)):
        at = 0
        while (slot := (at, int(numbers[i] ^ numbers[at]).bit_count())) in child:
            at = child[slot]
        child[slot] = i
    assert {(n, d): int(tree.child[n, d]) for n, d in zip(*np.nonzero(tree.child >= 0), strict=True)} == child
    got = {(int(a), int(b)) for q, n in tree.within(numbers, 2) for a, b in zip(q, n, strict=True)}
    assert got == {(i, j) for i in range(len(numbers)) for j in range(len(numbers)) if int(numbers[i] ^ numbers[j]).bit_count() <= 2}


def plain_words(text):
    out, word = [], ""
    for c in text or "":
        if c.isascii() and not c.isalnum():
            out, word = out + [word] * bool(word), ""
        else:
            word += c.lower() if c.isascii() else c
    return out + [word] * bool(word)


def plain_report(docs, items, n=13):
    owners = {}
    for item, body in items:
        own = plain_words(body)
        width = min(n, len(own))
        for i in range(len(own) - width + 1) if width else ():
            owners.setdefault(width, {}).setdefault(tuple(own[i : i + width]), set()).add(str(item))
    for doc_id, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for width, windows in owners.items():
            for i in range(len(words) - width + 1):
                if tuple(words[i : i + width]) in windows:
                    hit.update(range(i, i + width))
                    found |= windows[tuple(words[i : i + width])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        yield doc_id, len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)


ITEMS = [(1, "Alpha beta GAMMA"), (2, ""), (3, None), (4, " ".join(f"q{i}" for i in range(20))), (5, "é")]
TEXTS = [(1, "x alpha, beta-gamma! y"), (2, None), (3, ""), (4, "zz " * 100 + " ".join(f"Q{i}" for i in range(3, 18))), (5, "É é"), (6, " ".join(f"q{i}" for i in range(12))),
         (7, "alpha beta alpha beta gamma alpha beta gamma"), (None, "alpha beta gamma"), (7, "a" * 100_000)]


@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_decontamination_matches_brute_force(spark, docs_of, limit):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontamination.report(docs_of([(i, t, "s") for i, t in TEXTS]), items, broadcast_bytes=limit).collect()
    assert key(tuple(r) for r in got) == key(plain_report(TEXTS, ITEMS))


def test_decontamination_query_and_modes(spark, docs_of):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: tuple(r) for r in queries.op8_benchmark_decontamination(spark, SF).collect()}
    assert [got[d[0]] for d in docs] == list(plain_report(docs, items))
    table, bench = docs_of([(i, t, "s") for i, t in TEXTS]), spark.createDataFrame(ITEMS, "item_id long, text string")
    dropped = decontamination.decontaminate(table, bench)
    assert dropped.columns == table.columns and key(r.doc_id for r in dropped.collect()) == key(d for d, *_, bad in plain_report(TEXTS, ITEMS) if not bad)
    cut = {(r.doc_id, len(r.text or "")): r.text for r in decontamination.decontaminate(table, bench, mode="cut").collect()}
    assert cut[(1, len("x ! y"))] == "x ! y" and cut[(2, 0)] is None and (7, 100_000) in cut
    assert decontamination.report(table.limit(0), bench).count() == 0 and decontamination.report(table, bench.limit(0)).count() == len(TEXTS)


def test_long_and_repeated_items_are_scanned_in_even_parts(spark, docs_of):
    """A benchmark of one very long item many times over: pieces hold the same windows, repeats count once, parts stay small."""
    long = " ".join(f"v{i}" for i in range(9_000))
    items = [(1, long)] * 20 + [(2, long.upper() + " tail")]
    texts = [(k, " ".join(f"v{i}" for i in range(at, at + 15)) + " other" * 5) for k, at in enumerate((0, 4090, 4095, 8980, 8990))]
    table = spark.createDataFrame(items, "item_id long, text string")
    made = table.selectExpr("cast(item_id as string) AS item", "cast(text as binary) AS data").mapInArrow(decontamination.pieces(13), "item string, data binary")
    assert made.distinct().count() == 6 and max(len(bytes(r.data).split()) for r in made.collect()) == 4096 + 12
    for limit in (8 << 20, 30_000):
        got = decontamination.report(docs_of([(i, t, "s") for i, t in texts]), table, broadcast_bytes=limit).collect()
        assert key(tuple(r) for r in got) == key(plain_report(texts, items))


def rows(pdf):
    return sorted(tuple(None if v != v else v for v in r) for r in pdf[sorted(pdf.columns)].astype(object).itertuples(index=False)) if len(pdf) else []


def test_mix_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert rows(queries.op3_mix_to_weights(spark, SF).toPandas()) == rows(con.execute(mixing.ORACLE).fetchdf())


@pytest.mark.parametrize("bin_rows", [1, 50_000])
def test_mix_hits_every_target(spark, docs_of, odd_rows, bin_rows):
    got = mixing.mix(docs_of(odd_rows), bin_rows=bin_rows).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    size = {s: sum(r.size for r in rs) for s, rs in by.items()}
    names = sorted((s for s in by if s is not None)) + [None] * (None in by)
    left, share, weight = float(total), {}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    while True:
        now = {s: left * weight[s] / sum(weight[x] for x in names if x not in share) for s in names if s not in share}
        over = [s for s in now if now[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            share[s] = 3 * size[s]
            left -= share[s]
    share |= now
    for s, rs in by.items():
        assert rs[0].target == pytest.approx(share[s]) and abs(sum(r.taken for r in rs) - share[s]) <= 0.5 and rs[0].source_size == size[s]
    assert mixing.mix(docs_of([])).count() == 0
    assert [r.taken for r in mixing.mix(docs_of([(1, "", "a"), (2, None, None)])).collect()] == [0, 0]


@pytest.mark.parametrize("bin_rows", [1, 7, 50_000])
def test_mix_splits_rows_of_one_id_and_size(spark, docs_of, bin_rows):
    """A third of the rows are alike and the cut falls among them; the others share few ids."""
    rng = random.Random(3)
    table = [(None, "a b c", "s")] * 60 + [(5, "w " * rng.randrange(5), "s") for _ in range(60)] + [(i, "x y", "s") for i in range(60)] + [(i, "z " * 40, "t") for i in range(60)]
    con = duckdb.connect()
    docs = docs_of(table).repartition(9)
    con.register("documents", docs.select("doc_id", "source", "text").toPandas().astype({"doc_id": "Int64"}))
    assert rows(mixing.mix(docs, bin_rows=bin_rows).toPandas().fillna(-1)) == rows(con.execute(mixing.ORACLE).fetchdf().fillna(-1))
    for seed in range(6):
        got = mixing.mix(docs, bin_rows=bin_rows, seed=f"s{seed}", weights=(1, 3)).collect()
        for source in "st":
            own = [r for r in got if r.source == source]
            assert sum(r.taken for r in own) == int(own[0].target + 0.5) and len({r.taken - r.epochs_full * r.size for r in own} - {0, *{r.size for r in own}}) <= 1
