"""Reversed search, conversation repair and language identification against brute force, SQL and held-out documents."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import pairwise

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import language_id, lexical_search, queries, structure_repair

SF = "/root/testdata/sf0.001"


def test_search_equals_sql_however_the_items_are_dealt(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = sorted(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({lexical_search.ORACLE})").fetchall())
    assert sorted(map(tuple, queries.op11_ranked_search(spark, SF).collect())) == want and len(want) > 100
    docs, items = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "benchmark"))
    assert sorted(map(tuple, lexical_search.search(docs.repartition(7), items, pairs=300).collect())) == want


def ranked(docs, items, top=10):
    """Plain ranking of one list of (id, text) for another."""
    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))

    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counts:
            m = 25 + 75 * c.total() * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def test_search_on_odd_rows(spark, docs_of, odd_rows):
    rows = [*odd_rows, *[(100 + i, "same words in every copy", "z") for i in range(30)], (None, "same words in every copy", "z")]
    items = [(1, "One two Ünïcode"), (1, "null id here"), (2, None), (2, ""), (3, "!?"), (None, "same words"), (4, "t1 t1 t1 W5X5"), (5, "nowhere"), (4, "t1 t1 t1 W5X5")]
    table = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in items], "item_id long, text string, no long, doc long, score long, item long")
    docs = docs_of(rows).withColumns({"rank": F.lit(1), "n": F.lit(2), "terms": F.lit(3), "score": F.lit("x")})
    want = ranked([(i, t) for i, t, _ in rows], items)
    for pairs in (lexical_search.PAIRS, 1):
        got = lexical_search.search(docs, table, pairs=pairs)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert [r.doc_id for r in lexical_search.search(docs, table.where("item_id IS NULL")).orderBy("rank").collect()] == list(range(100, 110))
    assert lexical_search.search(docs.limit(0), table).count() == 0 and lexical_search.search(docs, table.limit(0)).count() == 0
    assert lexical_search.search(docs.where("text IS NULL"), table).count() == 0


def test_heaps_keep_the_best_with_ties():
    rng = np.random.default_rng(3)
    docs, scores = rng.permutation(400), rng.integers(0, 4, (400, 5))
    heaps = lexical_search.Heaps(5, 7)
    for at in range(0, 400, 33):
        heaps.update(docs[at : at + 33], scores[at : at + 33])
    got = sorted(heaps.rows())
    want = sorted((i, int(d), int(s)) for i in range(5) for s, d in sorted(((-scores[k, i], docs[k]) for k in range(400) if scores[k, i]))[:7] for s in [-s])
    assert got == want


def plain_repair(codes):
    """Cheapest edits by dynamic programming from the end, whole strings compared."""
    far = (10**9, "")

    def inserts(best):
        for _ in range(4):
            for q in range(4):
                cost, rest = best[3 if q == 2 else 2]
                best[q] = min(best[q], (cost + 2, "I" + rest))
        return best

    later = inserts({0: (0, ""), 1: far, 2: far, 3: (0, "")})
    for row in reversed(codes):
        now = {}
        for q in range(4):
            to, extra = 3 if q == 2 else 2, bool(row & 4)
            ways = [(later[q][0] + 3, "D" + later[q][1])]
            if not row & 8:
                ways.append((later[to][0] + 2 + extra, "R" + later[to][1]))
                if row & 3 == 0 and q == 0:
                    ways.append((later[1][0] + extra, "K" + later[1][1]))
                if row & 3 == to - 1:
                    ways.append((later[to][0] + extra, "K" + later[to][1]))
            now[q] = min(ways)
        later = inserts(now)
    return later[0]


def test_bidirectional_search_equals_dynamic_programming():
    rng = random.Random(4)
    for length in [*range(14)] * 60 + [300, 1500]:
        codes = [rng.choice([0, 1, 1, 2, 2, 3]) + 4 * (rng.random() < 0.25) + 8 * (rng.random() < 0.15) for _ in range(length)]
        assert structure_repair.cheapest(codes) == plain_repair(codes)


def plain_report(rows):
    """Per conversation from (conv_id, turn, role, text) rows as they stand, in order."""
    out = {}
    for conv in dict.fromkeys(r[0] for r in rows):
        own = sorted((r for r in rows if r[0] == conv and r[1] != "gone"), key=lambda r: (r[1] is not None, r[1] or 0))
        codes, seen, faults = [], set(), Counter()
        for _, _, role, text in own:
            bare = text.strip(" \t\n\x0b\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            faults[fault] += 1
            seen.add((role, text))
            codes.append("sua".find(role[:1] or "?") % 4 + {"truncated": 4, "": 0}.get(fault, 8))
        turns = {r[1] for r in own} - {None}
        cost, audit = plain_repair(codes)
        lines, left = [], iter(own)
        for edit in audit:
            wanted = "assistant" if lines and lines[-1][0] == "u" else "user"
            if edit == "I":
                lines.append(f"{wanted}:")
                continue
            _, _, role, text = next(left)
            if edit != "D":
                lines.append(f"{role if edit == 'K' else wanted}:{text}")
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in pairwise(initials))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest)
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, "gone" if kind == 0 else turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def test_repair_of_damaged_conversations_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in queries.op12_structure_repair(spark, SF).collect()}
    assert got == plain_report(damaged(rows)) and len(got) > 10


def test_repair_of_odd_conversations(spark):
    rows = [
        (1, None, "user", "first."), (1, 5, "assistant", "then　."), (1, 5, "assistant", "then　."), (2, 1, None, None), (2, 2, "", "no role."), (3, 9, "other", "x! \n"),
        (None, 1, "user", "null id."), (None, 2, "user", None), (None, 7, "system", "late"), (4, None, "system", "alone"), (5, 1, "user", " \t\n"),
        *[(6, t, ("user", "assistant")[t % 2], "long " * 20_000 + f"{t}.") for t in range(30)], (7, 1, "assistant", "a."), (7, 2, "user", "b"), (7, 3, "system", "c."),
    ]
    full = [(*r, "x", 5, "y", "z", 7, 1) for r in rows]
    names = "conv_id long, turn long, role string, text string, conv string, copies long, hash string, edits string, nth long, position long"
    table = spark.createDataFrame(full, names)
    filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert {r[0]: tuple(r[1:]) for r in structure_repair.report(table).collect()} == plain_report(filled)
    damage = structure_repair.report(structure_repair.damage(table), copies="copies")
    assert {r[0]: tuple(r[1:]) for r in damage.collect()} == plain_report(damaged(rows))
    repaired = structure_repair.repair(table).where("conv_id = 6").orderBy("position").collect()
    assert [(r.role, r.edit) for r in repaired] == [(("user", "assistant")[t % 2], "K") for t in range(30)] and repaired[7].text.endswith(" 7.")
    assert structure_repair.report(table.limit(0)).count() == 0 and structure_repair.repair(table.limit(0)).count() == 0
    none = structure_repair.report(table.where("conv_id = 1").withColumn("copies", F.lit(0)), copies="copies").first()
    assert tuple(none) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_texts_as_ids(spark):
    table = spark.createDataFrame([("a", 1, "user", "one."), ("a", 2, "user", "two"), ("b", 1, "assistant", "x.")], "conv_id string, turn int, role string, text string")
    got = {r.conv_id: (r.cost, r.audit) for r in structure_repair.report(table).collect()}
    assert got == {"a": (3, "KR"), "b": (2, "IK")}


@pytest.fixture(scope="module")
def languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, {r.doc_id: r for r in language_id.report(docs).collect()}


def test_language_holds_on_documents_it_has_not_seen(languages):
    docs, found = languages
    rows = docs.select("doc_id", "lang").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(found) == len(rows) and {r.doc_id for r in held} == {i for i, r in found.items() if r.held_out}
    assert np.mean([found[r.doc_id].lang_pred == r.lang for r in held]) >= 0.97
    accepted = [found[r.doc_id].lang_pred == r.lang for r in held if found[r.doc_id].accepted]
    assert np.mean(accepted) >= 0.98 and len(accepted) > 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values()) and {r.lang_pred for r in found.values()} <= {r.lang for r in rows}


def test_language_learns_from_allowed_rows_only(languages):
    """Other languages, sources and order of the held-out rows change nothing, and reruns agree."""
    docs, found = languages
    spoiled = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string")).repartition(5)
    assert {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language_id.report(spoiled).collect()} == {i: (r.lang_pred, round(r.score, 9)) for i, r in found.items()}


def test_language_on_odd_rows(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows).withColumns({name: F.lit("x") for name in ("id", "key", "held_out", "lang_pred", "score", "order", "least")})
    got = language_id.report(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "accepted"] and got.count() == len(odd_rows)
    by = [(r.doc_id, r.lang_pred, r.score) for r in got.collect()]
    assert [p for i, p, _ in by if i in (1, 2, 3)] == ["und"] * 3 and all(p == "en" and 0 < s <= 1 for i, p, s in by if i not in (1, 2, 3))
    nothing = language_id.report(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score, r.accepted) for r in nothing.collect()} == {("und", 0.0, False)}
    assert language_id.report(docs.limit(0)).count() == 0


def test_subwords_of_blocks(monkeypatch):
    """A text cut into blocks at words has the same subwords; letters of any plane count, marks and digits separate."""
    text = " ".join(["Straße", "ñandú", "日本語", "𝒳𝒴z", "a", "x2y"] * 50)
    whole = language_id.whole(text)
    monkeypatch.setattr(language_id, "BLOCK", 40)
    cut = language_id.whole(text)
    assert len(list(language_id.blocks(text))) > 10 and whole[2] == cut[2] == 350
    assert np.array_equal(whole[0], cut[0]) and np.allclose(whole[1], cut[1])
    bins, words = language_id.subwords(next(language_id.blocks("ab")))
    assert words == 1 and len(bins) == 2 + 3 + 2 + 1 + 1  # a b, <a ab b>, <ab ab>, <ab>, the word
    assert not len(language_id.subwords(next(language_id.blocks("12 .")))[0])


def test_sampled_languages_are_shared_evenly(spark):
    rows = [(i, f"wort {i} und satz", "de") for i in range(3_000)] + [(5_000 + i, f"mot {i} avec phrase", "fr") for i in range(60)] + [(9_000, "same text", "de")] * 3_000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    learn = language_id._learn

    def spy(names, expected):
        seen["expected"] = expected
        return learn(names, expected)

    language_id._learn = spy
    try:
        got = {r.lang_pred for r in language_id.identify(docs, F.lit(True), sample=400).where("doc_id >= 5000 and doc_id < 5060").collect()}
    finally:
        language_id._learn = learn
    assert got == {"fr"} and 800 <= seen["expected"] <= 900
