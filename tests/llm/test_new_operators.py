"""Periodic runs, filter interactions and repeated passages against brute force and awkward inputs."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from tidemark.llm import filters, periodic, queries, repeats
from tidemark.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, size int, n long, part string, id long, chunk long, found int, h long, w string"
AWKWARD = [
    (1, None, "a"),
    (2, "", None),
    (3, "the the the cat sat on the mat " * 3000, "a"),
    (4, "der Hund und die Katze sind im Haus " * 5, "b"),
    (4, "der Hund und die Katze sind im Haus " * 5, "b"),
    (5, "x" * 99, ""),
    (6, "der Hund und die Katze sind im Haus " * 5, None),
    (None, "no id here, but a text that is far longer than one hundred bytes, so that its copy under an id is a copy", "b"),
    (7, "no id here, but a text that is far longer than one hundred bytes, so that its copy under an id is a copy", "b"),
    (8, "\x00 ▁ \U0001f600 \n\t ---", "c"),
    (9, " \t\n ", "c"),
    (9, "same id, another text " + "é" * 120, "c"),
]


def table(spark, rows):
    """Documents with further columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", s, 1, 2, "p", 3, 4, 5, 6, "w") for i, t, s in rows], SCHEMA)


def with_labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# ---- periodic runs ----


def brute_runs(words):
    out = {}
    for q in range(1, len(words) // 4 + 1):
        at = 0
        while at + q < len(words):
            end = at
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end - at + q >= max(6, 4 * q):
                out.setdefault((at, end - at + q), q)
            at = end + 1
    return sorted(((a, n, q) for (a, n), q in out.items()), key=lambda r: (r[0], r[2]))


def brute_row(i, text):
    """The contract read word by word."""
    words = (text or "").encode().split()
    n = len(words)
    if i is not None and n:
        h = zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
    runs = brute_runs(words)
    gone = {j for a, k, q in runs for j in range(a + q, a + k)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (i, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{a},{k},{q}\n" for a, k, q in runs).encode()), sha(b" ".join(w for j, w in enumerate(words) if j not in gone)))


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_runs_of_random_words():
    rnd = random.Random(3)
    for _ in range(300):
        texts = []
        for _ in range(rnd.randint(0, 5)):
            n, letters = rnd.randint(0, 70), "abcdefg"[: rnd.choice([1, 2, 3, 6])]
            words = [rnd.choice(letters) for _ in range(n)]
            if n and rnd.random() < 0.7:
                s, p = rnd.randrange(n), rnd.randint(1, 9)
                words = [words[i] if i < s else words[s + (i - s) % p] for i in range(n)] + [rnd.choice("ab") for _ in range(rnd.randint(0, 4))]
            texts.append(" ".join(words))
        for text, found in zip(texts, periodic.described(texts)):
            assert [tuple(r.values()) for r in found["runs"]] == brute_runs(text.split())


def test_names_are_equal_where_stretches_are():
    rnd = np.random.default_rng(1)
    words = rnd.integers(0, 3, 200)
    for k, level in enumerate(periodic.naming(words)):
        at = {}
        for i in range(200 - (1 << k) + 1):
            at.setdefault(tuple(words[i : i + (1 << k)]), []).append(i)
        for places in at.values():
            assert len(set(level[places])) == 1
            assert (level[places[0]] >= 0) == (len(places) > 1)
        assert len({int(level[p[0]]) for p in at.values()}) == len(at)


def test_runs_query(spark, sf):
    got = queries.op11_periodic_runs(spark, sf).collect()
    want = [brute_row(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert order(got) == order(want)
    assert any(zlib.crc32(str(r.doc_id).encode()) % 10 == 0 and r.n_runs for r in got)


def test_runs_awkward(spark, tmp_path):
    table(spark, AWKWARD).write.parquet(f"{tmp_path}/documents.parquet")
    assert order(queries.op11_periodic_runs(spark, str(tmp_path)).collect()) == order(brute_row(i, t) for i, t, _ in AWKWARD)


def test_runs_keep_other_columns(spark):
    docs = table(spark, AWKWARD)
    out = periodic.with_runs(docs, "runs_found")
    assert out.columns == [*docs.columns, "runs_found"] and out.count() == len(AWKWARD)
    assert periodic.with_runs(table(spark, []), "x").count() == 0


# ---- filter interactions ----


def brute_audit(docs, labels, letters="ABCDE"):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, source in docs:
        text = text or ""
        words = text.encode().split()
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        }
        rows.append((source or "", fails, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own, worth, steps = [r for r in rows if r[0] == part], dict.fromkeys(letters, 0), []
        for chain in itertools.permutations(letters):
            left = own
            for step, f in enumerate(chain, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                worth[f] += len(gone)
                steps.append([part, "".join(chain), step, len(left), len(gone), sum(r[1][f] for r in own) - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f])
        out += [(*s[:-1], worth[s[-1]]) for s in steps]
    return out


def test_audit_awkward(spark):
    rows = [*AWKWARD, (20, "ALL CAPITALS $ here", "a"), (21, "ALL CAPITALS $ here", "b"), (None, "ALL CAPITALS $ here", "b")]
    labels = [(20, 1, 0), (20, 0, 1), (4, None, 1), (6, 1, None), (None, 1, 1), (99, 1, 1)]
    got = filters.filter_audit(table(spark, rows), with_labels(spark, labels))
    assert order(got.collect()) == order(brute_audit(rows, labels))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_of_nothing(spark):
    assert filters.filter_audit(table(spark, []), with_labels(spark, [])).count() == 0


def test_audit_of_other_filters(spark):
    """Any flags: three filters at random."""
    rnd = random.Random(2)
    flags = [tuple(rnd.random() < 0.4 for _ in range(3)) for _ in range(200)]
    rows = spark.createDataFrame([("all", *f, 1) for f in flags], "p string, X boolean, Y boolean, Z boolean, n long")
    with Scratch(spark, "test") as scratch:
        joint = filters.joint_failures(rows, ["X", "Y", "Z"], "p", {"n": "n"})
        assert joint.first().n == [sum(all(f[i] for i in range(3) if s >> i & 1) for f in flags) for s in range(8)]
        got = {(r.filter_order, r.step): (r.kept, r.removed) for r in filters.interactions(joint, ["X", "Y", "Z"], "p", {}, scratch).collect()}
    for chain in itertools.permutations("XYZ"):
        left = flags
        for step, f in enumerate(chain, 1):
            after = [r for r in left if not r["XYZ".index(f)]]
            assert got["".join(chain), step] == (len(after), len(left) - len(after))
            left = after
    with pytest.raises(ValueError):
        filters.joint_failures(rows, list("ABCDEFG"), "p", {"n": "n"})


def test_audit_against_sql(spark, sf):
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = queries.op12_filter_interactions(spark, sf)
    want = db.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL['op12_filter_interactions']})").fetchall()
    assert order(got.collect()) == order(want)


# ---- repeated passages ----


def brute_passages(rows, length=100):
    """Rows in the order that the operator documents: id (none first), checksum of the text, then as they come."""
    seen, out = set(), []
    for i, text in sorted(((i, (t or "").encode()) for i, t, *_ in rows), key=lambda r: (-(2**63) if r[0] is None else r[0], zlib.crc32(r[1]))):
        gone = np.zeros(len(text), bool)
        for s in range(len(text) - length + 1):
            w = text[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(text, np.uint8)[~gone])
        out.append((i, len(text), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def planted(rnd, n=60):
    """Random texts that share passages, near copies, a line in nearly all, and copies."""
    letters = "abcdef ghij\n"
    passage = ["".join(rnd.choice(letters) for _ in range(rnd.randint(90, 700))) for _ in range(6)]
    rows = []
    for i in range(n):
        text = "".join(rnd.choice([rnd.choice(passage), "the line that stands in nearly all of the texts, of some 70 bytes in all\n", "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 200)))]) for _ in range(rnd.randint(0, 7)))
        if text and rnd.random() < 0.5:
            at = rnd.randrange(len(text))
            text = text[:at] + rnd.choice("é#") + text[at + 1 :]
        rows.append((i, text, "a"))
    return rows + [(i + 1000, t, "a") for i, t, _ in rows[:10]]


@pytest.mark.parametrize("seed", [1, 2])
def test_passages(spark, seed, monkeypatch):
    """Also where texts lie across blocks and chunks, where merges are small and where anchors are crowded."""
    rows = planted(random.Random(seed))
    want = order(brute_passages(rows))
    assert order(repeats.passage_digests(table(spark, rows)).collect()) == want
    for name, value in {"BLOCK": 300, "CHUNK": 2_000, "MERGE_BYTES": 2_000, "BUCKET_STRETCHES": 20}.items():
        monkeypatch.setattr(repeats, name, value)
    if seed == 2:
        monkeypatch.setattr(repeats, "CROWD", 64)
        monkeypatch.setattr(repeats, "COUNTED", 1)
        monkeypatch.setattr(repeats, "CROWD", 3)
    assert order(repeats.passage_digests(table(spark, rows).repartition(3)).collect()) == want


def test_passages_awkward(spark):
    got = repeats.passage_digests(table(spark, AWKWARD))
    assert order(got.collect()) == order(brute_passages(AWKWARD))
    assert repeats.passage_digests(table(spark, [])).count() == 0


def test_passage_spans(spark):
    rows = planted(random.Random(9), 20)
    texts = {i: t.encode() for i, t, _ in rows}
    with Scratch(spark, "test") as scratch:
        for r in repeats.repeated_passages(table(spark, rows), scratch).collect():
            left, at = b"", 0
            for s in r.spans:
                assert s.end - s.start >= 100
                left, at = left + texts[r.id][at : s.start], s.end
            assert bytes(r.kept) == left + texts[r.id][at:]


def test_merge_of_shards(monkeypatch):
    """Blocks of the merged interleave against a dictionary of windows, in any number of shards, all byte values included."""
    rnd = random.Random(5)
    for trial in range(60):
        monkeypatch.setattr(repeats, "SHARDS", rnd.choice([1, 2, 4]))
        letters = bytes(range(256)) if trial % 10 == 0 else b"ab\x00\xff"
        source = [bytes(rnd.choice(letters) for _ in range(400)) for _ in range(3)]
        texts = []
        for _ in range(rnd.randint(1, 12)):
            s, a = bytearray(rnd.choice(source)), rnd.randint(0, 30)
            s[rnd.randrange(400)] = rnd.choice(b"abc")
            texts.append(bytes(s[a : a + rnd.randint(100, 350)]))
        key, first = [rnd.randint(0, 5) for _ in texts], [1000 * i for i in range(len(texts))]
        best = {}
        windows = [(t, i, x[i : i + 100], (key[t], first[t] + i)) for t, x in enumerate(texts) for i in range(len(x) - 99)]
        for *_, w, rank in windows:
            best[w] = min(best.get(w, rank), rank)
        text, place = repeats.repeated_windows(texts, np.array(key), np.array(first), 100)
        assert sorted(zip(text.tolist(), place.tolist())) == [(t, i) for t, i, w, rank in windows if best[w] < rank]


def test_stretches_hold_each_window_once(monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 1000)
    rnd = random.Random(6)
    for _ in range(20):
        docs = [bytes(rnd.choice(b"abcd") for _ in range(rnd.choice([0, 1, 50, 99, 100, 101, 300, 2500]))) for _ in range(8)]
        firsts = np.cumsum([0, *map(len, docs)])
        found = repeats.Stretches(b"".join(docs), firsts, 100)
        assert [x for a, b in zip(found.s0, found.s1) for x in range(a, b + 1)] == [int(firsts[i]) + j for i, d in enumerate(docs) for j in range(len(d) - 99)]
