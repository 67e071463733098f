"""Toxicity by maximum-scoring segments.

Token log-odds between toxic and other documents are estimated with Dirichlet
priors along a chain: a word's prior is its stem's estimate, a stem's prior
that of the shorter stem, the shortest one's the share of toxic documents.
A linear-time scan (Ruzzo and Tompa's) finds all maximal-scoring segments of a
text; extreme-value statistics of the best segment of clean texts turn segment
scores into p-values, and these into one calibrated probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back_memory, held_out, text_digest, without_rows

#: Labelled documents that the model is fitted on, at most; near copies count once.
MAX_LABELLED = 24_000
#: Lengths of the stems between the share of toxic documents and the whole word.
STEMS = (3, 4, 5, 6, 7)
#: Documents a token must occur in, the strength of a token's prior in documents, and the significance it needs
#: to differ from its prior: twice the log of the number of tokens, plus MARGIN.
LEAST_DOCUMENTS = 4
PRIOR = 1.0
MARGIN = 2.0
#: What each word costs a segment.
DRIFT = 0.1
#: A segment with a p-value of at most this is significant.
SIGNIFICANT = 0.05
#: Documents with at least this probability are toxic.
THRESHOLD = 0.3
#: Logistic calibration: strength of the ridge.
RIDGE = 0.05
#: Tokens after which a training task sends its counts on, so that its memory is bounded.
FLUSH = 150_000

WORD = re.compile(r"[^\W\d_]+")
END = "\n"


def tokens_of(word: str) -> list[str]:
    """The stems of a word, shortest first, then the word itself (marked by its end)."""
    return [word[:n] for n in STEMS if len(word) > n or len(word) == n] + [word + END]


@dataclass
class ToxicityModel:
    """``scores``: log-odds of the tokens that differ from their prior; the rest is the calibration."""

    scores: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0
    scale: float = 1.0
    weights: tuple[float, ...] = (-2.0, 0.0, 0.0)

    def __post_init__(self) -> None:
        self.heads = {t.rstrip(END)[: STEMS[0]] for t in self.scores}

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        """Places and scores of the words whose log-odds are not those of the prior."""
        heads, scores, n = self.heads, self.scores, STEMS[0]
        out = []
        for i in [i for i, w in enumerate(words) if w[:n] in heads]:
            for token in reversed(tokens_of(words[i])):
                if token in scores:
                    if scores[token]:
                        out.append((i, scores[token]))
                    break
        return out

    def p_value(self, score: float, n_words: int) -> float:
        """Chance that the best segment of a clean text of ``n_words`` scores this or more."""
        return -math.expm1(-min(self.scale * max(n_words, 1) * math.exp(-self.decay * score), 700.0))

    def features(self, text: str | None) -> tuple[list[tuple[int, int, float, float]], tuple[float, ...]]:
        """Significant segments (first and last word, score, p-value) and what the calibration reads."""
        words = WORD.findall((text or "").lower())
        if not self.heads or not words:
            return [], (1.0, 0.0, 0.0)
        found = [(a, b, s, self.p_value(s, len(words))) for a, b, s in maximal_segments(self.hits(words), DRIFT)]
        bits = [-math.log2(max(p, 1e-30)) for *_, p in found]
        kept = [x for x in found if x[3] <= SIGNIFICANT]
        best = max(bits, default=0.0)
        total = sum(b for b, x in zip(bits, found) if x[3] <= SIGNIFICANT)
        return kept, (1.0, math.log1p(best), math.log1p(total))

    def probability(self, features: tuple[float, ...]) -> float:
        z = sum(w * x for w, x in zip(self.weights, features))
        return 1.0 / (1.0 + math.exp(-z)) if z > -700 else 0.0


def maximal_segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments ``(first, last, score)`` of a sequence of words.

    A word scores its hit, if it has one, less ``drift``.  Only positive words
    open a segment, so the scan runs over them and takes what lies between as
    one negative stretch; it is linear in the number of hits.
    """
    segments: list[tuple[int, int, float, float]] = []  # first, last, total before it, total with it
    total, place = 0.0, 0
    for i, score in hits:
        total -= drift * (i - place)
        place = i + 1
        value = score - drift
        if value <= 0:
            total += value
            continue
        first, before = i, total
        total += value
        last, after = i, total
        while segments:
            k = len(segments) - 1
            while k >= 0 and segments[k][2] >= before:
                k -= 1
            if k < 0 or segments[k][3] >= after:
                break
            first, before = segments[k][0], segments[k][2]
            del segments[k:]
        segments.append((first, last, before, after))
    return [(a, b, y - x) for a, b, x, y in segments]


def _sketch(text: str) -> int:
    """Least hash of the five-word shingles: near copies mostly share it."""
    words = text.lower().split()
    joined = (" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
    return min(xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) for s in joined) >> 1


def _labelled(docs: DataFrame, labels: DataFrame, bound: int, scratch: Scratch) -> DataFrame:
    """``text, toxic`` of at most ``bound`` labelled documents outside the held-out quarter, near copies once."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_toxic")).dropna()
    known = known.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    known = scratch.write(known.orderBy(F.xxhash64("_id"), "_id").limit(bound), "labelled")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(known), "_id").where("text is not null")  # at most bound rows of two numbers

    @F.arrow_udf("long")
    def sketch(texts: pa.Array) -> pa.Array:
        return pa.array([_sketch(t.as_py()) for t in texts], pa.int64())

    rows = scratch.write(rows.select("_id", F.col("_toxic").alias("toxic"), "text", sketch("text").alias("sketch")), "sample")
    once = scratch.write(rows.groupBy("sketch").agg(F.min("_id").alias("_id")), "once").select("_id").distinct()
    return scratch.write(rows.join(F.broadcast(once), "_id", "left_semi").select("text", "toxic"), "training")


def token_scores(counts: list[tuple[str, int, int]], toxic: int, total: int) -> dict[str, float]:
    """Log-odds of tokens against the share of toxic documents, by chained Dirichlet priors.

    ``counts``: token, documents with it, toxic ones among them.  A token whose
    counts do not differ significantly (likelihood ratio) from what its prior
    expects has its prior's estimate and is left out.
    """
    share = min(max(toxic / max(total, 1), 1e-3), 1 - 1e-3)
    need = 2 * math.log(max(len(counts), 2)) + MARGIN
    rate: dict[str, float] = {}
    for token, n, k in sorted(counts, key=lambda c: (len(c[0].rstrip(END)), c[0].endswith(END), c[0])):
        chain = tokens_of(token.rstrip(END)) if token.endswith(END) else [token[:m] for m in STEMS if m <= len(token)]
        above = next((rate[t] for t in reversed(chain[:-1]) if t in rate), share)
        ratio = 2 * ((k * math.log(k / (n * above)) if k else 0.0) + ((n - k) * math.log((n - k) / (n * (1 - above))) if n > k else 0.0))
        if ratio > need:
            rate[token] = (k + PRIOR * above) / (n + PRIOR)
    base = math.log(share / (1 - share))
    out = {}
    for token, r in rate.items():
        r = min(max(r, 1e-4), 1 - 1e-4)
        odds = math.log(r / (1 - r)) - base
        out[token] = odds if abs(odds) > 0.5 else 0.0
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> ToxicityModel:
    """Fit on at most ``bound`` labelled rows; token counts are taken by the cluster.

    Null labels, null texts and labels without a document are left out; a
    document labelled twice is toxic if either says so.  Without a toxic or
    without a clean row the model finds nothing.
    """
    with Scratch(docs.sparkSession, "toxicity") as scratch:
        return _fitted(_labelled(docs, labels, bound, scratch))


def _fitted(sample: DataFrame) -> ToxicityModel:
    """Fit on a written table ``text, toxic``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, with_toxic = Counter(), Counter()

        def out() -> pa.RecordBatch:
            columns = [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.array([with_toxic[t] for t in seen], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["token", "n", "k"])

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                tokens = {t for w in set(WORD.findall(text.as_py().lower())) for t in tokens_of(w)}
                seen.update(tokens)
                if toxic.as_py() > 0:
                    with_toxic.update(tokens)
                if len(seen) >= FLUSH:
                    yield out()
                    seen.clear()
                    with_toxic.clear()
                    give_back_memory()
        yield out()
        seen.clear()
        with_toxic.clear()
        give_back_memory()

    totals = sample.agg(F.count("*").alias("n"), F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("k")).first()
    if not totals["k"] or totals["k"] == totals["n"]:
        return ToxicityModel()
    counted = sample.mapInArrow(count, "token string, n long, k long").groupBy("token").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    counts = [(r["token"], r["n"], r["k"]) for r in counted.where(F.col("n") >= LEAST_DOCUMENTS).collect()]
    model = ToxicityModel(token_scores(counts, totals["k"], totals["n"]))
    return _calibrate(model, sample)


def _calibrate(model: ToxicityModel, sample: DataFrame) -> ToxicityModel:
    """Extreme-value parameters from the clean rows, then the logistic map from all rows of the sample."""

    @F.arrow_udf("struct<words:long,best:double,scores:array<double>>")
    def measure(texts: pa.Array) -> pa.Array:
        rows = []
        for value in texts:
            words = WORD.findall(value.as_py().lower())
            hits = model.hits(words)
            best = max((s for *_, s in maximal_segments(hits, DRIFT)), default=0.0)
            rows.append({"words": len(words), "best": best, "scores": [s - DRIFT for _, s in hits]})
        return pa.array(rows, pa.struct([("words", pa.int64()), ("best", pa.float64()), ("scores", pa.list_(pa.float64()))]))

    # a filter on what Python measures would measure twice, in two workers a task
    rows = [r for r in sample.select("toxic", measure("text").alias("m")).select("toxic", "m.*").collect() if r["words"]]
    clean = [r for r in rows if r["toxic"] <= 0]
    n_words = sum(r["words"] for r in clean)
    # the decay solves sum p(s) exp(decay * s) = 1 over the clean texts' word scores, with one more hit of each kind seen
    histogram = Counter(round(s, 2) for r in clean for s in r["scores"])
    positive = [s - DRIFT for s in model.scores.values() if s > DRIFT]
    if not positive:
        return model
    histogram.update([round(float(np.median(positive)), 2)])
    rest = n_words + 1 - sum(histogram.values())

    def excess(decay: float) -> float:
        return (sum(n * math.exp(min(decay * s, 600.0)) for s, n in histogram.items()) + rest * math.exp(-decay * DRIFT)) / (n_words + 1) - 1.0

    low, high = 1e-4, 20.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    model.decay = low
    model.scale = len(clean) / max(sum(r["words"] * math.exp(-model.decay * r["best"]) for r in clean), 1e-9)

    @F.arrow_udf("array<double>")
    def read(texts: pa.Array) -> pa.Array:
        return pa.array([list(model.features(t.as_py())[1]) for t in texts], pa.list_(pa.float64()))

    got = sample.select("toxic", read("text").alias("x")).collect()
    x = np.array([r["x"] for r in got], dtype=float).reshape(-1, 3)
    y = np.array([float(r["toxic"] > 0) for r in got])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = RIDGE * np.array([1e-3, 1.0, 1.0])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    model.weights = tuple(float(v) for v in w)
    return model


def with_toxicity(docs: DataFrame, model: ToxicityModel, name: str, text_col: str = "text") -> DataFrame:
    """Add the column ``name``: struct of ``score double`` and the significant ``passages``.

    A passage has ``start`` and ``end`` in code points of the text, its segment
    score and its p-value.  Null, empty and word-less texts have the score of a
    text without any passage.  Other columns are carried along untouched.
    """
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())])
    kind = pa.struct([("score", pa.float64()), ("passages", pa.list_(passage))])

    @F.arrow_udf("struct<score:double,passages:array<struct<start:long,end:long,score:double,p_value:double>>>")
    def judge(texts: pa.Array) -> pa.Array:
        rows = []
        for value in texts:
            text = value.as_py()
            segments, x = model.features(text)
            rows.append({"score": model.probability(x), "passages": _in_text(text, segments) if segments else []})
        give_back_memory()
        return pa.array(rows, kind)

    return docs.withColumn(name, judge(F.col(text_col).cast("string")))


def _in_text(text: str, segments: list[tuple[int, int, float, float]]) -> list[dict]:
    """Word numbers become positions; lower-casing may lengthen a text, so words are found again as written."""
    places = [m.span() for m in WORD.finditer(text)]
    if len(places) != len(WORD.findall(text.lower())):  # a letter whose lower case is more than a letter
        return [{"start": 0, "end": len(text), "score": s, "p_value": p} for _, _, s, p in segments]
    return [{"start": places[a][0], "end": places[b][1], "score": s, "p_value": p} for a, b, s, p in segments]


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose toxicity probability reaches ``threshold``; all columns, nothing else.

    The model is fitted on the labelled rows of ``docs`` themselves.  Rows go
    by id and text.  Null and empty texts stay.
    """
    model = fit_toxicity(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels)
    with Scratch(docs.sparkSession, "toxic") as scratch:
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        scored = with_toxicity(texts, model, "found").where(F.col("found.score") >= threshold)
        gone = scratch.write(scored.select("id", text_digest(F.col("text")).alias("digest")).distinct(), "gone", keep=True)
        return without_rows(docs, gone, None, id_col, text_col)
