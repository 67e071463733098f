"""The corpus pipeline, stage by stage, against brute force and on awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import common, mixing, pieces, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, id long, x long, no long, part long, text_ string"
STAGES = dict(corpus_pipeline.STAGES)


def table(spark, rows):
    """Documents with further columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", s, 1, "d", 5, 6, 7, 8, "t") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(31)
    return lambda n: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def kept(spark, sf, stage, rows):
    """Rows (id, text) that a stage lets through, sorted; their columns are those of the input."""
    docs = table(spark, rows)
    out = STAGES[stage](spark, docs, sf)
    assert out.columns == docs.columns
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return len(a & b) / len(a | b) >= 0.8


def brute_groups(sets):
    group = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and sets[j] and alike(sets[i], sets[j]):
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    return group


def brute_near(rows):
    """Of each group the least id (null last), of equal ids the least digest; word-less rows stay."""
    group = brute_groups([shingles(t) for _, t in rows])
    rank = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest())
    best = {}
    for g, r in zip(group, rows):
        best[g] = min(best.get(g, r), r, key=rank)
    return sorted(list(best.values()), key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))


AWKWARD = [(1, None, "a"), (2, "", None), (3, "the the the cat sat on the mat " * 3000, "a"), (4, "der Hund und die Katze", "b"), (4, "der Hund und die Katze", "b"), (5, "the cat sat on the mat", None), (6, "the cat sat on the mat", None), (None, "no id here", "b"), (7, "\x00 ▁ \U0001f600 \n\t ---", "c")]


@pytest.mark.parametrize("stage", list(STAGES))
def test_awkward_rows_and_empty_tables(spark, sf, stage):
    docs = table(spark, AWKWARD)
    out = STAGES[stage](spark, docs, sf)
    n = out.count()
    want = {"toxicity": 9, "exact_dedup": 6, "simhash_near_dedup": 7, "piece_encoding": 9}
    assert n == want.get(stage, n) and STAGES[stage](spark, docs.limit(0), sf).isEmpty()
    if stage != "piece_encoding":
        assert out.columns == docs.columns


def test_rows_that_share_an_id_are_kept(spark, sf):
    assert kept(spark, sf, "exact_dedup", [(4, "A text here", "s"), (4, "B other text", "s"), (9, "A text here", "s")]) == [(4, "B other text"), (9, "A text here")]
    assert kept(spark, sf, "exact_dedup", [(None, "x y", "s"), (12, "x y", "s"), (None, "lone", "s"), (None, "lone", "s")]) == [(12, "x y"), (None, "lone")]


def test_near_copies_that_share_an_id(spark, sf, words):
    x = words(200)
    near = [*x[:100], "other", *x[101:]]
    a, b, c = " ".join(x), " ".join(near), " ".join(words(200))
    assert kept(spark, sf, "simhash_near_dedup", [(1, a, "s"), (2, b, "s"), (2, c, "s")]) == [(1, a), (2, c)]
    assert kept(spark, sf, "simhash_near_dedup", [(None, a, "s"), (None, b, "s"), (None, c, "s")]) == brute_near([(None, a), (None, b), (None, c)])
    assert kept(spark, sf, "simhash_near_dedup", [(5, a, "s"), (5, a, "s"), (6, b, "s")]) == [(5, a)]


def test_exact_copies_against_brute_force(spark, sf, words):
    rng = random.Random(4)
    texts = [None, "", *(" ".join(words(rng.randrange(1, 9))) for _ in range(30))]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), "s") for _ in range(300)]
    best = {}
    for i, t, _ in rows:
        best[t or ""] = max(best.get(t or "", i), i, key=lambda v: -1 if v is None else v)
    got = kept(spark, sf, "exact_dedup", rows)
    # of null and empty texts of the same id either may be the one that stays
    assert sorted((-1 if i is None else i, t or "") for i, t in got) == sorted((-1 if i is None else i, t) for t, i in best.items())


def test_near_copies_against_brute_force(spark, sf, words):
    rng = random.Random(9)
    rows = []
    for k in range(50):
        base = words(rng.choice([3, 12, 60, 300, 700]))
        rows.append((rng.choice([None, 3 * k]), " ".join(base), "s"))
        for copy in range(rng.randrange(4)):
            t = list(base)
            for _ in range(rng.randrange(1, 2 + len(t) // 40)):
                t[rng.randrange(len(t))] = words(1)[0]
            rows.append((3 * k + copy % 2, " ".join(t) if copy < 3 else "  ".join(t).upper(), "s"))
    rows += [(900, None, "s"), (901, " \t", "s"), (902, "", "s")]
    got = kept(spark, sf, "simhash_near_dedup", rows)
    worded = brute_near([(i, t) for i, t, _ in rows if (t or "").split()])
    want = sorted([*worded, (900, None), (901, " \t"), (902, "")], key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    assert got == want


def test_near_copies_at_the_border(spark, sf, words):
    """Pairs of a similarity of 0.8 to 0.85 are found, ones below 0.8 never are."""
    rng = random.Random(17)
    rows, pairs = [], []
    for k in range(300):
        base = words(240)
        t = list(base)
        for at in rng.sample(range(0, 240, 6), rng.randrange(4, 8)):  # five shingles each
            t[at] = words(1)[0]
        a, b = " ".join(base), " ".join(t)
        pairs.append((2 * k, len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))))
        rows += [(2 * k, a, "s"), (2 * k + 1, b, "s")]
    left = {i for i, _ in kept(spark, sf, "simhash_near_dedup", rows)}
    border = [i for i, s in pairs if 0.8 <= s < 0.86]
    assert len(border) > 50 and sum(i + 1 not in left for i in border) >= 0.97 * len(border)
    assert all(i + 1 in left for i, s in pairs if s < 0.8) and any(s < 0.8 for _, s in pairs)
    assert {i for i, _ in pairs} <= left


def test_toxic_documents_go_by_their_score(spark, sf01):
    docs = common.read_table(spark, sf01, "documents")
    model = toxicity.fit_toxicity(docs, common.read_table(spark, sf01, "labels"))
    got = {(r["doc_id"], r["text"]) for r in STAGES["toxicity"](spark, docs, sf01).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    clean = {r for r in rows if model.probability(model.features(r[1])[1]) < toxicity.THRESHOLD}
    assert got == clean and 0 < len(clean) < len(set(rows))


def test_mix_takes_what_the_operator_says(spark, sf):
    docs = common.read_table(spark, sf, "documents")
    want = {(r["doc_id"], r["source"]): r["copies"] for r in mixing.entropy_mix(docs).collect() if r["copies"]}
    got = {}
    for r in STAGES["mixing"](spark, docs, sf).collect():
        got[r["doc_id"], r["source"]] = got.get((r["doc_id"], r["source"]), 0) + 1
    assert got == want


def test_run(spark, sf):
    """The stages one after the other, and the same by run(): every document comes out as its pieces."""
    docs = common.read_table(spark, sf, "documents")
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = common.materialize(stage(spark, held, sf), name)
        assert held.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = corpus_pipeline.run(spark, sf).collect()
    model = pieces.PieceModel.load()
    assert out and all(model.decode(np.array(r["ids"])) == texts[r["doc_id"]] and r["exact"] for r in out)
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in held.collect())
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
