"""Language identification of mixed-language text.

Words are runs of letters.  The script of a word narrows its candidate
languages; character trigrams score it in each; a Viterbi pass with a penalty
for switching labels the words, so runs of words become spans of one language.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_out

#: Documents of each language that the model is fitted on, in expectation.
TRAIN_PER_LANGUAGE = 4_000
#: Slots of the hashed trigram table.
SLOTS = 1 << 17
#: Pseudo-count of a trigram slot.
SMOOTH = 0.2
#: What a change of language costs, in nats.
SWITCH = 8.0
#: A language is a candidate for a script that has this share of its letters.
SCRIPT_SHARE = 0.02
#: Score of a language that is no candidate.
BARRED = -60.0
#: Documents and characters that are labelled at once.
GROUP_DOCS, GROUP_CHARS = 5_000, 8_000_000
PIECE = 1 << 20
UNDETERMINED = "und"

#: Script ranges (first and last code point).
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "ethiopic": [(0x1200, 0x139F)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
}


_TABLES: dict[str, np.ndarray] = {}


def letter_scripts() -> np.ndarray:
    """For every code point: 0 if it is no letter, else the number of its script plus 2 (1: another script)."""
    if "letters" in _TABLES:
        return _TABLES["letters"]
    table = np.zeros(0x110000, np.uint8)
    table[np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)] = 1
    for i, ranges in enumerate(SCRIPTS.values()):
        for first, last in ranges:
            part = table[first : last + 1]
            part[part > 0] = i + 2
    _TABLES["letters"] = table
    return table


def _folded(text: str) -> str:
    """Lower case, code point by code point, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@dataclass
class Words:
    """Words of several texts laid end to end: places in the joint text, scripts, and each text's first word."""

    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    scripts: np.ndarray
    text_starts: np.ndarray
    first: np.ndarray


def split_words(texts: list[str]) -> Words:
    joint = "\n".join(_folded(t) for t in texts) + "\n"
    codes = np.frombuffer(joint.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = letter_scripts()[codes]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (kinds > 0).view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    text_starts = np.concatenate(([0], np.cumsum(lengths)))
    codes = np.where(kinds > 0, codes, 0)
    return Words(codes, starts, ends, kinds[starts], text_starts, np.searchsorted(starts, text_starts))


def trigram_slots(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Slot of the trigram around each letter; what is no letter is a word's edge."""
    padded = np.concatenate((np.zeros(1, np.uint32), codes, np.zeros(1, np.uint32)))
    mixed = padded[letters] * np.uint32(0x9E3779B1) ^ padded[letters + 1] * np.uint32(0x85EBCA77) ^ padded[letters + 2] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x27D4EB2F)
    return (mixed >> np.uint32(15)).astype(np.int64)


@dataclass
class LanguageModel:
    """``table``: score of each trigram slot in each language; ``allowed``: script (as in letter_scripts) by language."""

    languages: list[str] = field(default_factory=list)
    table: np.ndarray = field(default_factory=lambda: np.zeros((SLOTS, 0), np.float32))
    allowed: np.ndarray = field(default_factory=lambda: np.zeros((len(SCRIPTS) + 2, 0), bool))

    def word_scores(self, words: Words) -> np.ndarray:
        """Log-likelihood ratio of every word in every language, up to a term common to all languages."""
        out = np.zeros((len(words.starts), len(self.languages)), np.float32)
        lengths = words.ends - words.starts
        upto = np.concatenate(([0], np.cumsum(lengths)))
        lo = 0
        while lo < len(lengths):  # whole words, about PIECE letters at a time
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PIECE, "right")) - 1)
            offsets = upto[lo:hi] - upto[lo]
            letters = np.repeat(words.starts[lo:hi] - offsets, lengths[lo:hi]) + np.arange(upto[hi] - upto[lo])
            out[lo:hi] = np.add.reduceat(self.table[trigram_slots(words.codes, letters)], offsets, axis=0)
            lo = hi
        known = self.allowed[words.scripts]
        out[~known.any(axis=1)] = 0.0
        out[~known & known.any(axis=1)[:, None]] = BARRED
        return out

    def label(self, texts: list[str]) -> tuple[Words, np.ndarray]:
        """Words of the texts and the number of each one's language."""
        words = split_words(texts)
        return words, viterbi(self.word_scores(words), words.first, SWITCH)


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """Best labels of several sequences laid end to end (``first``: their bounds), each change costing ``switch``.

    All sequences advance together, longest first, so that a step is a few
    array operations over those that are still running.
    """
    if not scores.size:
        return np.zeros(len(scores), np.int16)
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    start, lengths = first[:-1][order], lengths[order]
    steps = int(lengths[0]) if len(lengths) else 0
    running = np.searchsorted(-lengths, -np.arange(steps), "left")  # sequences longer than t
    changed = np.zeros(scores.shape, bool)
    origin = np.zeros(len(scores), np.int16)
    value = np.zeros((len(lengths), scores.shape[1]), np.float64)
    for t in range(steps):
        n = running[t]
        at = start[:n] + t
        now = value[:n]
        if t:
            best = now.argmax(axis=1)
            move = now[np.arange(n), best] - switch
            origin[at] = best
            changed[at] = now < move[:, None]
            np.maximum(now, move[:, None], out=now)
        now += scores[at]
    labels = np.zeros(len(scores), np.int16)
    state = value.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        n = running[t]
        at = start[:n] + t
        labels[at] = state[:n]
        if t:
            state[:n] = np.where(changed[at, state[:n]], origin[at], state[:n])
    return labels


def fit_languages(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> LanguageModel:
    """Fit on ``docs(doc_id, text, lang)``: rows with text and language outside the held-out quarter.

    About ``per_language`` documents of each language, chosen by a hash of the
    id, are read; trigrams are counted by the cluster.  No such rows: an empty
    model, which labels everything undetermined.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel()
    languages = sorted(sizes)
    grain = 1 << 20
    cut = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(math.ceil(min(1.0, per_language / sizes[lang]) * grain)))])
    number = F.create_map(*[x for i, lang in enumerate(languages) for x in (F.lit(lang), F.lit(i))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(grain)) < cut[F.col("lang")]).select("text", number[F.col("lang")].alias("no"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[int, np.ndarray] = {}
        scripts: dict[int, np.ndarray] = {}
        for batch in batches:
            for text, no in zip(batch["text"], batch["no"]):
                words, no = split_words([text.as_py()]), no.as_py()
                letters = np.flatnonzero(words.codes)
                grams[no] = grams.get(no, 0) + np.bincount(trigram_slots(words.codes, letters), minlength=SLOTS)
                scripts[no] = scripts.get(no, 0) + np.bincount(letter_scripts()[words.codes[letters]], minlength=len(SCRIPTS) + 2)
        for no in grams:
            joint = np.concatenate((grams[no], scripts[no]))
            slots = np.flatnonzero(joint)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slots), no), pa.int32()), pa.array(slots, pa.int32()), pa.array(joint[slots], pa.int64())], names=["no", "slot", "n"])

    counts = np.zeros((SLOTS + len(SCRIPTS) + 2, len(languages)))
    with Scratch(docs.sparkSession, "languages") as scratch:
        sums = scratch.write(sample.mapInArrow(count, "no int, slot int, n long").groupBy("no", "slot").agg(F.sum("n").alias("n")), "trigrams")
        for r in sums.collect():  # at most SLOTS + the number of scripts for each language
            counts[r["slot"], r["no"]] = r["n"]
    grams, scripts = counts[:SLOTS], counts[SLOTS:]
    logs = np.log(grams + SMOOTH) - np.log(grams.sum(axis=0) + SMOOTH * np.count_nonzero(grams.any(axis=1)))
    logs[~grams.any(axis=1)] = 0.0  # a trigram that no language has says nothing
    return LanguageModel(languages, (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32), scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1))


def with_language(docs: DataFrame, model: LanguageModel, name: str, text_col: str = "text") -> DataFrame:
    """Add the column ``name``: struct of ``lang``, ``score`` and ``spans``.

    ``lang`` has most letters of the text and ``score`` is its share of them;
    a span is a run of words of one language, from its first letter to its last
    (code points, end exclusive).  Null texts and texts without a letter are
    ``und`` with score 0 and no spans.  A tie goes to the language first by
    name.  Other columns are carried along untouched.
    """
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])
    nothing = {"lang": UNDETERMINED, "score": 0.0, "spans": []}

    def judged(texts: list[str]) -> list[dict]:
        words, labels = model.label(texts)
        if not model.languages or not len(labels):
            return [nothing] * len(texts)
        count = len(model.languages)
        of = np.repeat(np.arange(len(texts)), np.diff(words.first))
        letters = np.bincount(of * count + labels, words.ends - words.starts, len(texts) * count).reshape(-1, count)
        turn = np.flatnonzero(np.diff(of, prepend=-1) | np.diff(labels, prepend=-1))
        last = np.append(turn[1:], len(labels)) - 1
        shift = words.text_starts[of[turn]]
        spans: list[list[dict]] = [[] for _ in texts]
        for i, a, b, lang in zip(of[turn].tolist(), (words.starts[turn] - shift).tolist(), (words.ends[last] - shift).tolist(), labels[turn].tolist()):
            spans[i].append({"start": a, "end": b, "lang": model.languages[lang]})
        total = letters.sum(axis=1)
        best = letters.argmax(axis=1)
        top = letters[np.arange(len(texts)), best]
        return [{"lang": model.languages[b], "score": t / n, "spans": s} if n else nothing for b, t, n, s in zip(best.tolist(), top.tolist(), total.tolist(), spans)]

    @F.arrow_udf("struct<lang:string,score:double,spans:array<struct<start:long,end:long,lang:string>>>")
    def label(column: pa.Array) -> pa.Array:
        out: list[dict] = []
        group: list[str] = []
        size = 0
        for value in column:
            group.append(value.as_py() or "")
            size += len(group[-1])
            if len(group) >= GROUP_DOCS or size >= GROUP_CHARS:
                out += judged(group)
                group, size = [], 0
        return pa.array(out + (judged(group) if group else []), kind)

    return docs.withColumn(name, label(F.col(text_col).cast("string")))
