"""Removal of repeated strings against a table of all windows."""

import hashlib
import random

import pytest

from barloom.llm import queries, suffix_dedup

SF = "/root/testdata/sf0.001"


def plain_repeats(rows, length):
    """Per row: bytes, removed bytes, spans and the digest of the rest."""
    first, none = {}, -(1 << 63)
    texts = [(none if i is None else i, (t or "").encode()) for i, t in rows]
    for i, data in texts:
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            first[w] = min(first.get(w, (i, p)), (i, p))
    for (i, _), (k, data) in zip(rows, texts, strict=True):
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] < (k, p):
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(data)) if gone[p] and not (p and gone[p - 1]))
        yield i, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()


def key(rows):
    return sorted(str(tuple(r)) for r in rows)


def test_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert key(queries.op10_suffix_dedup(spark, SF).collect()) == key(plain_repeats(rows, 100))


def mutated(rng, text, letters):
    chars = list(text)
    for _ in range(rng.randint(0, 4)):
        chars[rng.randrange(len(chars))] = rng.choice(letters)
    return "".join(chars)


@pytest.mark.parametrize(("letters", "seed"), [("ab", 1), ("abcdefgh", 2), ("a", 3), ("é𝒳xyz", 4)])
@pytest.mark.parametrize("small", [False, True])
def test_hard_texts_match_brute_force(spark, docs_of, monkeypatch, letters, seed, small):
    """Few letters give ties and overlapping repeats; small gatherings and segments put every hand-over to the test."""
    if small:
        monkeypatch.setattr(suffix_dedup, "SEGMENT", 37)
        monkeypatch.setattr(suffix_dedup, "GATHER", 150)
        monkeypatch.setattr(suffix_dedup, "HOT", 2)
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [word(rng.randint(15, 80)) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [rng.choice([word(rng.randint(1, 40)), rng.choice(passages), mutated(rng, rng.choice(passages), letters)]) for _ in range(rng.randint(1, 5))]
        rows.append((i, "".join(parts), "s"))
    rows += [(5, rows[5][1], "s"), (5, rows[6][1], "s"), (7, rows[8][1], "s"), (None, rows[9][1], "s"), (None, rows[9][1], "s"), (80, None, "s"), (81, "", "s")]
    got = suffix_dedup.remove_repeats(docs_of(rows).repartition(5), length=20, gram=6).collect()
    assert key(got) == key(plain_repeats([r[:2] for r in rows], 20))


def test_odd_rows(spark, docs_of, odd_rows):
    rows = [r for r in odd_rows if len(r[1] or "") < 50_000] + [(30, "z" * 300_000, "s"), (31, "z" * 150, "s"), (29, "z" * 99, "s")]
    got = suffix_dedup.remove_repeats(docs_of(rows), with_bytes=True).collect()
    assert key(r[:5] for r in got) == key(plain_repeats([r[:2] for r in rows], 100))
    for r in got:
        text = next((t or "").encode() for i, t, _ in rows if i == r.doc_id and len((t or "").encode()) == r.n_bytes)
        cut = [0, *r.spans, len(text)]
        assert b"".join(text[a:b] for a, b in zip(cut[::2], cut[1::2], strict=True)) == bytes(r.kept)
    assert suffix_dedup.remove_repeats(docs_of([])).count() == 0
    with pytest.raises(ValueError, match="shorter"):
        suffix_dedup.remove_repeats(docs_of([]), length=300)


def test_phrases_around_one_gram_are_told_apart(spark, docs_of):
    """Two texts whose sampled gram is equal and whose phrase hashes agree in the upper 38 bits, found by search."""
    tail = "mzgdpa mntyyawoixzhsdkaaauramvgnxaqhyoprhlhvhyojan rudfuxjdxkxwqnq vgjjspqmsbphxzmnvflrw"
    rows = [(1, "000000014103" + tail, "s"), (2, "000000421262" + tail, "s")]
    got = suffix_dedup.remove_repeats(docs_of(rows)).collect()
    assert key(got) == key(plain_repeats([r[:2] for r in rows], 100)) and all(r.n_removed == 0 for r in got)


@pytest.mark.parametrize("one_id", [None, 7])
def test_many_texts_under_one_id_keep_their_own_spans(spark, docs_of, one_id):
    """Many texts with a repeat inside, each at a place of its own: 16 bits of a hash mix up some of them."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = [(one_id, (w := word(rng.randint(20, 60))) + word(rng.randint(1, 30)) + w, "s") for _ in range(1_500)] + [(i, word(50), "s") for i in (1, 2, 9)]
    got = suffix_dedup.remove_repeats(docs_of(rows).repartition(5), length=20, gram=6).collect()
    assert key(got) == key(plain_repeats([r[:2] for r in rows], 20))
