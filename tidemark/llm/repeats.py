"""Passages of bytes that occur before, by merging the Burrows-Wheeler transforms of shards.

A window is a string of ``length`` bytes within one text.  The window's anchor
is the least hash of its 32-byte stretches, so equal windows have equal anchors
at equal places, and windows that follow each other mostly share one: they form
a *stretch*, about 135 bytes that hold some 35 windows.

1. Texts are packed into chunks of a few megabytes, in a table bucketed by
   chunk, which from then on is joined without being moved.
2. Every chunk sends the hashes of its stretches to buckets by anchor.  There,
   of equal stretches all but the earliest are found to be repeats as a whole,
   and an anchor all of whose stretches are equal is done with.
3. Stretches that share an anchor and differ are gathered by anchor.  Groups of
   them are shards, each sorted once into a transform.  The transforms are
   merged by refining their interleave, a letter of four bytes an iteration
   (Holt and McMillan): after length / 4 iterations the interleave is sorted by
   ``length`` bytes, and its blocks, whose borders appear in the iteration that
   gives the common prefix, are the repeated windows.  In each block all but
   the earliest are repeats.  No suffix is compared or sorted again.
4. Every chunk covers the bytes of its repeated windows.

Bytes are compared, not hashes, but for whole equal stretches (128 bits).  An
anchor with very many different stretches is split into its single windows, so
no group grows with a passage's fame.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batches_of, give_back_memory

#: Bytes of a repeated passage at least, of an anchor, and of a letter of the transforms.
LENGTH, ANCHOR, LETTER = 100, 32, 4
#: Bytes of a chunk (a longer text is one of its own), and bytes that are hashed at once.
CHUNK, BLOCK = 2_000_000, 1 << 18
#: Stretches that a bucket of anchors compares, bytes that a merge takes, shards that it merges.
BUCKET_STRETCHES, MERGE_BYTES, SHARDS = 1_000_000, 1_000_000, 4
#: An anchor with so many different stretches is split into windows, or with 1 / CROWDS of all stretches: there are at most CROWDS such anchors.
CROWD, CROWDS = 2_000, 200_000
#: One of so many different stretches is counted to find such anchors.
COUNTED = 64
_U = np.uint64
_LOW = (1 << 23) - 1
#: The packed columns of a bucket's questions and of a merge's stretches.
ASKED = (("anchor", np.uint64), ("whole", np.uint64), ("id", np.int64), ("tie", np.uint32), ("start", np.uint32))
HEAD = (("anchor", np.uint64), ("id", np.int64), ("tie", np.uint32), ("start", np.uint32), ("doc", np.uint32), ("pos", np.uint32), ("size", np.uint32))
CHUNK_SCHEMA = "chunk BIGINT, size BIGINT, ids ARRAY<BIGINT>, ties BINARY, firsts BINARY, texts BINARY, counted ARRAY<STRUCT<anchor: BIGINT, other: BIGINT>>"


def packed(columns: dict[str, np.ndarray], layout: tuple, at: np.ndarray) -> bytes:
    return b"".join(columns[name][at].astype(kind).tobytes() for name, kind in layout)


def unpacked(blob: bytes, layout: tuple) -> dict[str, np.ndarray]:
    n, at, out = len(blob) // sum(np.dtype(kind).itemsize for _, kind in layout), 0, {}
    for name, kind in layout:
        out[name] = np.frombuffer(blob, kind, n, at)
        at += out[name].nbytes
    return out


def anchor_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the ``ANCHOR`` bytes from each place on, by doubling."""
    h, size = (b.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15), 1
    while size < ANCHOR:
        h = (h[: len(h) - size] * _U(0xD6E8FEB86659FD93)) ^ h[size:]
        h ^= h >> _U(32)
        h *= _U(0xBF58476D1CE4E5B9)
        size *= 2
    return h ^ (h >> _U(29))


class Stretches:
    """The stretches of a chunk: windows ``s0..s1`` (places in the chunk) with their anchor, in order."""

    def __init__(self, texts: bytes, firsts: np.ndarray, length: int, crowded: np.ndarray | None = None) -> None:
        self.texts, self.firsts, self.length = texts, firsts, length
        parts = [p for a in range(0, len(texts), BLOCK) if (p := self._of_block(a)) is not None]
        self.s0, self.s1, self.anchor, self.other = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate((np.int64, np.int64, _U, _U)))
        if crowded is not None and len(crowded):
            self._split(crowded)
        self.doc = np.searchsorted(firsts, self.s0, "right") - 1

    def _of_block(self, a: int) -> tuple[np.ndarray, ...] | None:
        """Those of the windows that begin in the block at ``a``."""
        b = np.frombuffer(self.texts, np.uint8)[a : a + BLOCK + self.length - 1]
        if len(b) < self.length:
            return None
        h = anchor_hashes(b)
        least, size, width = (h & _U(~_LOW & (1 << 64) - 1)) | np.arange(len(h), dtype=_U), 1, self.length - ANCHOR + 1
        while size * 2 <= width:  # least over a power of two of places, then over the width
            least = np.minimum(least[: len(least) - size], least[size:])
            size *= 2
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        place = (least & _U(_LOW)).astype(np.int64)
        turn = np.ones(len(place) + 1, bool)
        turn[1:-1] = place[1:] != place[:-1]
        inner = self.firsts[(self.firsts > a) & (self.firsts < a + len(b))] - a
        # windows that begin fewer than ``length`` bytes before the next text belong to none
        turn[inner[inner < len(place)]] = True
        turn[np.maximum(inner[inner - self.length < len(place)] - self.length + 1, 0)] = True
        s0 = np.flatnonzero(turn[:-1])
        s1 = np.append(s0[1:], len(place)) - 1
        end = self.firsts[np.searchsorted(self.firsts, s0 + a, "right")]
        inside = s0 + a + self.length <= end
        s0, s1 = s0[inside], s1[inside]
        return s0 + a, s1 + a, h[place[s0]], h[s0] * _U(3) + h[s1 + self.length - ANCHOR] * _U(5)

    def _split(self, crowded: np.ndarray) -> None:
        """Stretches of crowded anchors become one for each window, whose anchor is a hash of it all."""
        many = np.isin(self.anchor, crowded)
        if not many.any():
            return
        times = np.where(many, self.s1 - self.s0 + 1, 1)
        before = np.repeat(np.cumsum(times) - times, times)
        single = np.repeat(many, times)
        s0 = np.repeat(self.s0, times) + (np.arange(len(single)) - before) * single
        s1 = np.where(single, s0, np.repeat(self.s1, times))
        self.anchor = np.repeat(self.anchor, times)
        self.s0, self.s1 = s0, s1
        seen = memoryview(self.texts)
        self.anchor[single] = np.fromiter((xxhash.xxh3_64_intdigest(seen[x : x + self.length], 7) for x in s0[single].tolist()), _U, int(single.sum()))

    def compared(self, ids: np.ndarray, ties: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Columns of ``ASKED`` and the places of the chunk's earliest of each equal stretches, in order."""
        seen = memoryview(self.texts)
        ends = (self.s1 + self.length).tolist()
        whole = np.fromiter((xxhash.xxh3_64_intdigest(seen[a:b]) for a, b in zip(self.s0.tolist(), ends)), _U, len(ends))
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((np.arange(len(ids)), ties, ids))] = np.arange(len(ids))
        own = {"anchor": self.anchor, "whole": whole, "id": ids[self.doc], "tie": ties[self.doc], "start": self.s0 - self.firsts[self.doc], "doc": self.doc, "pos": self.s0, "size": self.s1 - self.s0 + self.length}
        order = np.lexsort((self.s0, rank[self.doc], whole, self.anchor))
        new = np.ones(len(order), bool)
        new[1:] = (whole[order[1:]] != whole[order[:-1]]) | (self.anchor[order[1:]] != self.anchor[order[:-1]])
        return own, np.sort(order[new])


def bucket_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """Anchors are small in their high bits, as the least of many; the low ones are even."""
    return (anchor & _U((1 << 32) - 1)) % _U(buckets)


def verdicts(asked: list[tuple[int, dict[str, np.ndarray]]]) -> list[np.ndarray]:
    """For each stretch that the chunks ask about: 0 the earliest of its kind and the only kind, 1 a repeat, 2 the earliest of several kinds."""
    col = {name: np.concatenate([a[name] for _, a in asked]) for name, _ in ASKED}
    chunk = np.repeat([c for c, _ in asked], [len(a["anchor"]) for _, a in asked])
    out = np.zeros(len(chunk), np.uint8)
    order = np.argsort(col["anchor"], kind="stable")
    near = col["anchor"][order[1:]] == col["anchor"][order[:-1]]
    again = order[np.concatenate(([False], near)) | np.concatenate((near, [False]))] if len(order) else order
    order = again[np.lexsort((*(c[again] for c in (col["start"], chunk, col["tie"], col["id"], col["whole"], col["anchor"])),))]
    anchor, whole = col["anchor"][order], col["whole"][order]
    head = np.ones(len(order), bool)
    head[1:] = anchor[1:] != anchor[:-1]
    kind = head.copy()
    kind[1:] |= whole[1:] != whole[:-1]
    group = np.cumsum(head) - 1
    several = (np.bincount(group[kind]) if len(order) else np.zeros(0, int)) > 1
    out[order] = np.where(kind, np.where(several[group], 2, 0), 1) if len(order) else 0
    return np.split(out, np.cumsum([len(a["anchor"]) for _, a in asked])[:-1])


class Shard:
    """Strings of letters with an end each, their suffix order and their transform."""

    def __init__(self, letter: np.ndarray, owner_end: np.ndarray, before: np.ndarray) -> None:
        n = len(letter)
        rank, step, kinds = letter.astype(np.int64), LETTER, 0
        at = np.arange(n)
        while True:
            ahead = at + step
            behind = np.where(ahead < owner_end, rank[np.minimum(ahead, n - 1)], 0)
            found, rank = np.unique(rank * (int(rank.max()) + 1) + behind, return_inverse=True)
            if len(found) == kinds:
                break
            kinds, step = len(found), step * 2
        self.order = np.argsort(rank, kind="stable")
        self.transform = letter[before[self.order]]


def merged(shards: list[Shard], n_ends: list[int], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the shards' suffixes sorted by ``rounds`` letters, and the block of each place.

    ``turn`` says from which shard the next suffix comes.  One round reads the
    transforms in the present interleave and deals the turns to their letters
    in that order, which sorts by one letter more.  Ends stand first, shard
    after shard.
    """
    ids = np.arange(len(shards), dtype=np.uint8)
    turn = np.repeat(ids, [len(s.transform) for s in shards])
    ends = np.repeat(ids, n_ends)
    transforms = np.concatenate([s.transform for s in shards])
    block = np.zeros(len(turn), np.int32)
    letters = np.empty_like(transforms)
    blocks = 1
    for _ in range(rounds):
        letters[np.argsort(turn, kind="stable")] = transforms
        order = np.argsort(letters, kind="stable")
        turn, dealt, below = turn[order], letters[order], block[order]
        turn[: len(ends)] = ends
        border = (dealt[1:] != dealt[:-1]) | (below[1:] != below[:-1])
        border[: len(ends) - 1] = False
        block[0] = 0
        np.cumsum(border, out=block[1:])
        if block[-1] + 1 == blocks:
            break
        blocks = int(block[-1]) + 1
    return turn, block


def repeated_windows(texts: list[bytes], key: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of these texts another text or window of them holds earlier: (text, place) arrays.

    ``key`` and ``first`` order windows: by the text's key, then by its first
    place plus the place within.
    """
    sizes = np.array([len(t) for t in texts])
    width = sizes + LETTER  # an end for each of the interlaced strings of letters
    base = np.cumsum(width) - width
    n = int(width.sum())
    raw = np.zeros(n + LETTER, np.uint8)
    raw[:n] = np.frombuffer(b"".join(t + bytes(LETTER) for t in texts), np.uint8)
    wide = raw[:n].astype(np.uint32)
    for i in range(1, LETTER):
        wide = (wide << np.uint32(8)) | raw[i : n + i]
    owner = np.repeat(np.arange(len(texts)), width)
    place = np.arange(n) - base[owner]
    is_end = place >= sizes[owner]
    names, letter = np.unique(wide, return_inverse=True)
    letter = np.where(is_end, 0, letter + 1).astype(np.uint16 if len(names) < 65_535 else np.uint32)
    # before a string's first letter stands its own end: the place behind the text that is a whole number of letters off
    before = np.arange(n) - LETTER
    head = np.flatnonzero(place < LETTER)
    own = owner[head]
    before[head] = base[own] + sizes[own] + (place[head] - sizes[own]) % LETTER
    owner_end = (base + width)[owner]
    cuts = np.searchsorted(base, np.linspace(0, n, SHARDS + 1)[1:-1])
    bounds = np.unique(np.concatenate(([0], cuts, [len(texts)])))
    shards, n_ends, starts = [], [], []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        a, z = int(base[lo]), int(base[hi - 1] + width[hi - 1])
        shards.append(Shard(letter[a:z], owner_end[a:z] - a, before[a:z] - a))
        n_ends.append((hi - lo) * LETTER)
        starts.append(a)
    turn, block = merged(shards, n_ends, length // LETTER)
    suffix = np.empty(n, np.int64)
    suffix[np.argsort(turn, kind="stable")] = np.concatenate([s.order + a for s, a in zip(shards, starts)])
    whole = place[suffix] + length <= sizes[owner[suffix]]
    suffix, block = suffix[whole], block[whole]
    if not len(suffix):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = (key[owner[suffix]] << 32) | (first[owner[suffix]] + place[suffix])
    heads = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    least = np.repeat(np.minimum.reduceat(rank, heads), np.diff(np.append(heads, len(rank))))
    late = suffix[rank > least]
    return owner[late], place[late]


def _chunked(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    kind = pa.schema([("chunk", pa.int64()), ("size", pa.int64()), ("ids", pa.list_(pa.int64())), ("ties", pa.binary()), ("firsts", pa.binary()), ("texts", pa.binary()), ("counted", pa.list_(pa.struct([("anchor", pa.int64()), ("other", pa.int64())])))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId(), 0

        def chunk(ids: list, texts: list[bytes]) -> pa.RecordBatch:
            firsts = np.cumsum([0, *map(len, texts)])
            joined = b"".join(texts)
            found = Stretches(joined, firsts, length)
            some = found.other % _U(COUNTED) == 0
            counted = [{"anchor": a, "other": o} for a, o in set(zip(found.anchor[some].view(np.int64).tolist(), found.other[some].view(np.int64).tolist()))]
            ties = np.array([zlib.crc32(t) for t in texts], np.uint32).tobytes()
            return pa.RecordBatch.from_pylist([{"chunk": (part << 32) + no, "size": len(joined), "ids": ids, "ties": ties, "firsts": firsts.astype(np.int64).tobytes(), "texts": joined, "counted": counted}], kind)

        ids: list = []
        texts: list[bytes] = []
        size = 0
        for batch in batches:
            for i, t in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= CHUNK:
                    yield chunk(ids, texts)
                    ids, texts, size, no = [], [], 0, no + 1
        if texts:
            yield chunk(ids, texts)
        give_back_memory()

    return rows.mapInArrow(pack, CHUNK_SCHEMA)


class _Chunk:
    """A row of the chunk table."""

    def __init__(self, row: dict, length: int, crowded: np.ndarray) -> None:
        self.no, self.ids = row["chunk"], row["ids"]
        self.firsts, self.ties = np.frombuffer(row["firsts"], np.int64), np.frombuffer(row["ties"], np.uint32)
        self.texts = row["texts"]
        least = np.iinfo(np.int64).min  # rows without an id come before all others
        ids = np.array([least if i is None else i for i in self.ids], np.int64)
        self.found = Stretches(self.texts, self.firsts, length, crowded)
        self.columns, self.asked = self.found.compared(ids, self.ties)

    def by_bucket(self, places: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        of = bucket_of(self.columns["anchor"][places], buckets)
        order = np.argsort(of, kind="stable")
        cuts = np.flatnonzero(np.diff(of[order])) + 1
        for part in np.split(order, cuts):
            if len(part):
                yield int(of[part[0]]), places[part]

    def judged(self, answers: list[dict], buckets: int) -> np.ndarray:
        """The verdict on every stretch; copies of the chunk's own earliest are repeats."""
        out = np.ones(len(self.found.s0), np.uint8)
        codes = {a["bucket"]: np.frombuffer(a["blob"], np.uint8) for a in answers if a["bucket"] >= 0}
        for bucket, places in self.by_bucket(self.asked, buckets):
            out[places] = codes[bucket]
        return out

    def spans(self, answers: list[dict], buckets: int, length: int) -> np.ndarray:
        """Which bytes of the chunk repeated windows cover."""
        code = self.judged(answers, buckets)
        depth = np.zeros(len(self.texts) + 1, np.int32)
        late = [(self.found.s0[code == 1], self.found.s1[code == 1] + 1)]
        late += [tuple(np.frombuffer(a["blob"], np.uint32).astype(np.int64).reshape(2, -1)) for a in answers if a["bucket"] < 0]
        for a, b in late:
            np.add.at(depth, a, 1)
            np.add.at(depth, b + length - 1, -1)
        return np.cumsum(depth[:-1]) > 0


def repeated_passages(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep: bool = True) -> DataFrame:
    """Of every text the bytes that lie in a string of ``length`` bytes which starts earlier as well, and what is left of it.

    Earlier is: in a row with a smaller id, or in the same row at an earlier
    place; strings may overlap and are those of the input.  Returns ``id long,
    n_bytes long, spans array<struct<start, end>>, kept binary``, a row for
    each row: ``spans`` are the maximal removed stretches in bytes (end
    exclusive), ``kept`` the other bytes, which need not be whole characters.

    Null texts are empty; a null id comes before all others.  Rows that share
    an id go by a checksum of their text; of rows that repeat id and text one
    comes first and the others are its copies.  Texts shorter than ``length``
    are untouched, an empty table gives an empty result, other columns are not
    read.  The result reads tables of ``scratch``, which stay behind it if
    ``keep``.
    """
    if length % LETTER or length < 2 * ANCHOR:
        raise ValueError(f"length must be a multiple of {LETTER} and {2 * ANCHOR} at least")
    spark = docs.sparkSession
    name = f"chunks_{uuid.uuid4().hex}"
    with batches_of(spark, 1_000):
        chunks = _chunked(docs, id_col, text_col, length)
        # bucketed by chunk where it lies, so that no join moves a text
        cells = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.sql(f"CREATE TABLE {name} ({CHUNK_SCHEMA}) USING parquet CLUSTERED BY (chunk) INTO {cells} BUCKETS LOCATION '{scratch.own_path('chunks', keep=keep)}'")
        chunks.write.insertInto(name)
    chunks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name; the files stay until the scratch folder goes
    total = chunks.agg(F.sum("size")).first()[0] or 0
    stretches = total * 2 // (length - ANCHOR) + 1
    buckets, parts = max(16, math.ceil(stretches / BUCKET_STRETCHES)), max(16, math.ceil(total / 4 / MERGE_BYTES))
    counted = chunks.select(F.explode("counted").alias("c")).select("c.*").distinct().groupBy("anchor").agg(F.count("*").alias("n"))
    most = max(CROWD, stretches // CROWDS) // COUNTED
    crowded = np.array([r["anchor"] for r in counted.where(F.col("n") >= most).select("anchor").collect()], np.int64).view(_U)  # CROWDS at most

    def chunk_of(row: dict) -> _Chunk:
        return _Chunk(row, length, crowded)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.slice(i, 1).to_pylist()[0]
        give_back_memory()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            c = chunk_of(row)
            yield pa.RecordBatch.from_pylist([{"bucket": b, "chunk": c.no, "blob": packed(c.columns, ASKED, at)} for b, at in c.by_bucket(c.asked, buckets)], pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("blob", pa.binary())]))

    def answer(table: pa.Table) -> pa.Table:
        asked = sorted(((r["chunk"], unpacked(r["blob"], ASKED)) for r in table.to_pylist()), key=lambda x: x[0])
        codes = verdicts(asked)
        return pa.table({"chunk": [c for c, _ in asked], "bucket": [table["bucket"][0].as_py()] * len(asked), "blob": [c.tobytes() for c in codes]}, pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("blob", pa.binary())]))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            c = chunk_of(row)
            places = np.flatnonzero(c.judged(row["answers"] or [], buckets) == 2)
            out = [{"part": p, "chunk": c.no, "head": packed(c.columns, HEAD, at), "texts": b"".join(c.texts[a : a + n] for a, n in zip(c.columns["pos"][at].tolist(), c.columns["size"][at].tolist()))} for p, at in c.by_bucket(places, parts)]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("part", pa.int64()), ("chunk", pa.int64()), ("head", pa.binary()), ("texts", pa.binary())]))

    def merge(table: pa.Table) -> pa.Table:
        got = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        heads = [unpacked(r["head"], HEAD) for r in got]
        col = {name: np.concatenate([h[name] for h in heads]) for name, _ in HEAD}
        chunk = np.repeat([r["chunk"] for r in got], [len(h["pos"]) for h in heads])
        ends = np.cumsum(col["size"].astype(np.int64))
        joined = memoryview(b"".join(r["texts"] for r in got))
        rank = np.empty(len(chunk), np.int64)
        order = np.lexsort((col["doc"], chunk, col["tie"], col["id"]))
        head = np.zeros(len(order), bool)
        for c in (col["doc"], chunk, col["tie"], col["id"]):
            head[1:] |= c[order[1:]] != c[order[:-1]]
        rank[order] = np.cumsum(head)
        late: list[tuple[np.ndarray, np.ndarray]] = []

        def compare(at: np.ndarray) -> None:
            texts = [bytes(joined[ends[i] - int(col["size"][i]) : ends[i]]) for i in at.tolist()]
            text, place = repeated_windows(texts, rank[at], col["start"][at].astype(np.int64), length)
            late.append((chunk[at[text]], col["pos"][at[text]].astype(np.int64) + place))

        by_anchor = np.argsort(col["anchor"], kind="stable")
        group: list[np.ndarray] = []
        size = 0
        for some in np.split(by_anchor, np.flatnonzero(np.diff(col["anchor"][by_anchor])) + 1):
            group.append(some)
            size += int(col["size"][some].sum())
            if size >= MERGE_BYTES:
                compare(np.concatenate(group))
                group, size = [], 0
        if group:
            compare(np.concatenate(group))
        of, place = (np.concatenate(x) for x in zip(*late))
        order = np.lexsort((place, of))
        of, place = of[order], place[order]
        out = []
        for part in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1):
            if len(part):
                p = place[part]
                new = np.flatnonzero(np.concatenate(([True], np.diff(p) > 1)))
                spans = np.stack([p[new], p[np.append(new[1:], len(p)) - 1] + 1])
                out.append({"chunk": int(of[part[0]]), "bucket": -1, "blob": spans.astype(np.uint32).tobytes()})
        return pa.Table.from_pylist(out, pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("blob", pa.binary())]))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for row in rows(batches):
            c = chunk_of(row)
            gone = c.spans(row["answers"] or [], buckets, length)
            raw, out = np.frombuffer(c.texts, np.uint8), []
            for i, a, b in zip(c.ids, c.firsts[:-1].tolist(), c.firsts[1:].tolist()):
                turns = np.flatnonzero(np.diff(gone[a:b].astype(np.int8), prepend=0, append=0)).tolist()
                out.append({"id": i, "n_bytes": b - a, "spans": [{"start": x, "end": y} for x, y in zip(turns[::2], turns[1::2])], "kept": raw[a:b][~gone[a:b]].tobytes()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("spans", span), ("kept", pa.binary())]))

    def answered(answers: DataFrame) -> DataFrame:
        """Chunks with what is known of them, which is in proportion to a chunk."""
        lists = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "blob")).alias("answers"))
        return chunks.drop("counted").join(lists, "chunk", "left")

    answer_kind = "chunk long, bucket long, blob binary"
    with batches_of(spark, 4):
        asked = chunks.drop("counted").mapInArrow(ask, "bucket long, chunk long, blob binary")
        answers = scratch.write(asked.groupBy("bucket").applyInArrow(answer, answer_kind), "answers", keep)
        stretched = answered(answers).mapInArrow(gather, "part long, chunk long, head binary, texts binary")
        late = scratch.write(stretched.groupBy("part").applyInArrow(merge, answer_kind), "late", keep)
        out = answered(answers.unionByName(late)).mapInArrow(cover, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
        return out


def passage_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of :func:`repeated_passages`, written."""
    with Scratch(docs.sparkSession, "repeats") as scratch:
        found = repeated_passages(docs, scratch, id_col, text_col, length, keep=False)
        removed = F.expr("aggregate(spans, 0L, (a, s) -> a + s.end - s.start)")
        out = found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
        with batches_of(docs.sparkSession, 4):
            return scratch.write(out, "digests", keep=True)
