"""SimHash near-dedup by multi-index hashing.

A fingerprint is cut into segments.  Fingerprints that differ in few bits agree
up to a small Hamming ball in some segment, so every fingerprint looks up, in a
table keyed by segments, the ball around each of its own; what the table
returns is verified by the whole distance.  Links become groups by connected
components.

Two settings share these steps.  *Close* groups link 64-bit fingerprints at 3
or fewer differing bits: two halves, balls of radius one, no link is missed.
*Similar* groups link texts whose word shingles are alike to 0.8 or more: their
bits differ in up to 15 of 100, so the fingerprint is wider and has many
segments.  A segment's bits grow with the logarithm of the number of documents,
and the number of segments with them, so that a pair at 0.8 is met as surely at
any size.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, Scratch, batches_of, bounded, give_back_memory, text_digest, without_rows
from .components import connected_components

#: Bits in which linked fingerprints may differ; the ball of radius one around two halves covers up to 3.
MAX_BITS = 3
#: A half that more distinct fingerprints share is looked up together with an equal part of the other half.
DENSE = 256
#: Shingles whose bits are counted at once.
BLOCK = 65536


def text_fingerprint(text: str | None, width: int) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half of the shingles' XXH64 (seed 42).

    A-Z are lower-cased; words are runs of anything but ASCII white space;
    shingles are ``width`` words joined by spaces, repeats included, or the
    whole sequence if there are fewer words.  No words (or null): zero.
    """
    hashes = _shingle_hashes(text, width)
    if len(hashes) < 2:
        return int(hashes[0]) if len(hashes) else 0
    bits = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), BLOCK):
        octets = hashes[lo : lo + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def _words(text: str | None) -> list[bytes]:
    """The words of a text, with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of a text."""
    words = _words(text)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return np.array([digest(flat, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - width] + 1))
    return np.fromiter((digest(flat[s:e], 42) for s, e in zip(starts.tolist(), ends[width - 1 :].tolist())), np.uint64, n - width + 1)


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id long, fp long`` (the 64 bits as a signed number) for every row of ``docs``."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        found = np.fromiter((text_fingerprint(t.as_py(), width) for t in texts), np.uint64, len(texts))
        return pa.array(found.view(np.int64))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), run(F.col(text_col).cast("string")).alias("fp"))


def near_pairs(prints: DataFrame, scratch: Scratch, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``a, b`` of distinct fingerprints (``prints(fp long)``, no repeats) at most ``max_bits`` (0 to 3) apart.

    All pairs are found.  A half shared by more than ``DENSE`` fingerprints is
    looked up together with a part of the other half, in which at most three
    bits differ: one of its four bytes is equal, and so are five of its eight
    nibbles.  Bytes split a half 256 ways, nibbles, which serve the halves that
    are denser still, a million ways.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be 0 to {MAX_BITS}")
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    halves = prints.select("fp", F.posexplode(F.array(low, high)).alias("half", "value"))
    slot = lambda value: (F.col("half").cast("long") * (1 << 32) + value).alias("slot")
    table = halves.select(slot(F.col("value")), "half", F.col("fp").alias("b"))
    # of two halves that differ in one bit, the one without that bit looks the other one up; -1 is the half itself
    ball = "filter(sequence(-1, 31), i -> i < 0 or (value & shiftleft(1L, i)) = 0)"
    probes = halves.withColumn("bit", F.explode(F.expr(ball)))
    target = F.expr("if(bit < 0, value, value + shiftleft(1L, bit))")
    probes = probes.select(slot(target), "half", (F.col("bit") < 0).alias("same"), F.col("fp").alias("a"))
    held = table.groupBy("slot").agg(F.count("*").alias("n")).where(F.col("n") > DENSE)
    marked, n_dense = scratch.counted(held.select("slot", F.when(F.col("n") > DENSE * 256, 5).otherwise(1).alias("parts")), "dense")
    keys = ["slot"]
    if n_dense:

        def parted(side: DataFrame, fp: str) -> DataFrame:
            other = F.when(F.col("half") == 0, F.shiftrightunsigned(fp, 32)).otherwise(F.col(fp).bitwiseAND(F.lit(0xFFFFFFFF))).alias("other")
            parts = lambda bits, places: F.expr(
                f"transform(array({', '.join(f'array({', '.join(map(str, c))})' for c in places)}), (c, no) -> aggregate(c, cast(no as bigint), (acc, i) -> acc * {1 << bits} + (shiftright(other, {bits} * i) & {(1 << bits) - 1})))"
            )
            one, five = parts(8, [(i,) for i in range(4)]), parts(4, list(combinations(range(8), 5)))
            side = side.join(bounded(marked, n_dense), "slot", "left").select("*", other)
            return side.withColumn("part", F.explode(F.when(F.col("parts") == 1, one).when(F.col("parts") == 5, five).otherwise(F.array(F.lit(-1).cast("long")))))

        table, probes = scratch.write(parted(table, "b"), "table"), scratch.write(parted(probes, "a"), "probes")
        keys.append("part")
    pairs = probes.select(*keys, "same", "a").join(bounded(table.select(*keys, "b"), 2 * prints.count()), keys)
    pairs = pairs.where((~F.col("same") | (F.col("a") < F.col("b"))) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
    return pairs.select("a", "b")


def simhash_groups(docs: DataFrame, width: int = 3, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate group of every document.

    Fingerprints are linked at ``max_bits`` or fewer differing bits; equal
    fingerprints stand for one node, so copies are never paired with each other.

    Null and word-less texts have fingerprint zero and are linked like any
    other.  A null id counts as larger than any id; a group of only null ids has
    a null ``component_id``.  Repeated rows stay.  An empty table gives an empty
    result.  Columns besides the two named are neither read nor kept.

    Returns ``doc_id long, fp long, component_id long`` (the least id of the group).
    """
    with Scratch(docs.sparkSession, "simhash") as scratch:
        rows = scratch.write(fingerprints(docs, width, id_col, text_col), "fingerprints", keep=True)
        nodes, count = scratch.counted(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
        joined = scratch.write(connected_components(near_pairs(nodes.select("fp"), scratch, max_bits), scratch), "joined")
        placed = nodes.join(bounded(joined.select(F.col("node").alias("fp"), "component"), count), "fp", "left")
        placed = scratch.write(placed.select("fp", "least", F.coalesce("component", "fp").alias("component")), "placed")
        least = scratch.write(placed.groupBy("component").agg(F.min("least").alias("component_id")), "least")
        named = scratch.write(placed.join(bounded(least, count), "component").select("fp", "component_id"), "named", keep=True)
    return rows.join(bounded(named, count), "fp").select("doc_id", "fp", "component_id")


# ---- similar texts: wide fingerprints ----

#: Chance that a pair at the linking similarity is met in some segment.
MET = 0.99
#: Bits of a segment below the logarithm of the number of documents, and at least: a lookup meets some 2 ** FEWER_BITS
#: unrelated fingerprints at any size.  Their first 64 bits, which travel along, rule out all but 4 of 10,000 at once.
FEWER_BITS, LEAST_BITS = 2, 8
#: Segments at least: few short ones cost little.
LEAST_SEGMENTS = 10
#: Bits of a wide fingerprint that belong to no segment, and its least width.
APART, WIDE = 64, 256
#: Shingle hashes that are kept of a text at most, by which the similarity of a pair is estimated, and standard errors of
#: an estimate from cut sets around the linking similarity within which all shingles are read.
LOW, DOUBT = 384, 5.0
#: Standard deviations of the distance at the linking similarity within which a pair passes by its first bits (SIGHT),
#: and by all of them (LOOSE).
SIGHT, LOOSE = 3.0, 5.0
#: Members up to which the visitors of a segment's value are joined with them, if these are few too (:func:`crowd`); fuller
#: values are compared in blocks of COMPARED.
FEW, COMPARED = 16, 2_048
#: Doubtful partners of a member that a round over full slots proposes at most, until a round holds none back; None is no bound.
PROPOSED = (32, 1_024, None)
#: Texts, and pairs with their shingle hashes, that travel to Python at once.
BATCH_ROWS = 1_000


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The ``LOW`` least distinct shingle hashes, cut to 32 bits, in order: all of them for most texts."""
    return np.unique((hashes >> np.uint64(32)).astype("<u4"))[:LOW]


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets from their least hashes; exact if neither set was cut."""
    both = np.union1d(a, b)[: LOW if max(len(a), len(b)) >= LOW else None]
    return np.intersect1d(np.intersect1d(a, b, assume_unique=True), both, assume_unique=True).size / max(1, len(both))


def wide_fingerprint(hashes: np.ndarray, wide: int) -> np.ndarray:
    """``wide / 64`` words of 64 bits; a bit is 1 if set in over half of the mixed shingle hashes, which are distinct.

    One XXH64 of each shingle is stretched by odd multipliers.  No shingles:
    all bits zero.
    """
    lanes = wide // 64
    if not len(hashes):
        return np.zeros(lanes, np.uint64)
    odd = (np.arange(lanes, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    counts = np.zeros(wide, np.int64)
    for lo in range(0, len(hashes), 4_080):
        mixed = hashes[lo : lo + 4_080, None] * odd
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        bits = np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little")
        for part in range(0, len(bits), 255):
            counts += bits[part : part + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


def differing_share(similarity: float) -> float:
    """Expected share of differing bits in fingerprints of texts of a Jaccard similarity of shingles."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def differing_bits(similarity: float, deviations: float, wide: int) -> int:
    """Bits in which so wide fingerprints of texts of a similarity differ: the expectation and some deviations more."""
    share = differing_share(similarity)
    return round(wide * share + deviations * math.sqrt(wide * share * (1 - share)))


def segment_bits(count: int) -> int:
    """Bits of a segment for so many fingerprints."""
    return max(LEAST_BITS, math.ceil(math.log2(max(2, count))) - FEWER_BITS)


def segment_count(bits: int, similarity: float) -> int:
    """Segments of so many bits of which, with the chance ``MET``, one differs in at most a bit between texts of a similarity."""
    share = differing_share(similarity)
    one = (1 - share) ** bits + bits * share * (1 - share) ** (bits - 1)
    return max(LEAST_SEGMENTS, math.ceil(math.log(1 - MET) / math.log1p(-one)))


def crowd(bits: int) -> int:
    """Visitors up to which a segment's value is not full: a value with ``FEW`` / 4 members has half as many."""
    return FEW * (bits + 2) // 4


def _fingerprinted(docs: DataFrame, width: int, bits: int, n_segments: int, wide: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, digest`` (of the text), ``key`` (of its words), ``low`` (its least shingle hashes), ``wide`` (the fingerprint's words) and the ``values`` of its segments."""

    @F.arrow_udf("struct<key:binary,low:binary,wide:array<long>,values:array<long>>")
    def run(texts: pa.Array) -> pa.Array:
        keys, lows, prints = [], [], np.zeros((len(texts), wide // 64), np.uint64)
        for i, text in enumerate(texts):
            text = text.as_py()
            # similarity is one of sets: a repeated shingle weighs as much as any other
            hashes = np.unique(_shingle_hashes(text, width))
            prints[i] = wide_fingerprint(hashes, wide)
            lows.append(least_hashes(hashes).tobytes())
            keys.append(xxhash.xxh3_128_digest(b" ".join(_words(text))))
        spread = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")[:, APART : APART + bits * n_segments]
        values = spread.reshape(-1, n_segments, bits).astype(np.int64) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.int64())) for x in (prints.view(np.int64), values)]
        out = pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(lows, pa.binary()), *lists], ["key", "low", "wide", "values"])
        give_back_memory()
        return out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("digest"), run(F.col(text_col).cast("string")).alias("f"))
    return rows.select("doc_id", "digest", "f.*")


def _apart(x: str, y: str) -> Column:
    """Differing bits of two fingerprints as arrays of words."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, k: n + k)


def _met(nodes: DataFrame, bits: int, most: int) -> DataFrame:
    """What lookups of the balls of radius one find in the table of segments (``nodes(node, sig, values)``).

    ``a, b`` for a visitor and a member of a slot with at most ``FEW`` members
    and :func:`crowd` visitors, if their first 64 bits differ in at most
    ``most``; a fuller ``slot`` once.  The table is shuffled once, and so are
    the lookups.
    """
    slot = lambda value: (F.col("segment").cast("long") * (1 << bits) + value).alias("slot")
    cut = nodes.select("node", "sig", F.posexplode("values").alias("segment", "value"))
    members = cut.select(slot(F.col("value")), F.col("node").alias("b"), F.col("sig").alias("of_b"))
    here = Window.partitionBy("slot")
    members = members.withColumn("n", F.count("*").over(here)).withColumn("place", F.row_number().over(here.orderBy("b")))
    full = F.col("n") > FEW
    table = members.where(~full | (F.col("place") == 1)).select("slot", "b", "of_b", "place", full.alias("many"))
    # of two values that differ in one bit, the one without that bit looks the other one up; -1 is the value itself
    ball = f"filter(sequence(-1, {bits - 1}), i -> i < 0 or (value & shiftleft(1L, i)) = 0)"
    target = F.expr("if(bit < 0, value, value + shiftleft(1L, bit))")
    probes = cut.withColumn("bit", F.explode(F.expr(ball))).select(slot(target), F.col("node").alias("a"), F.col("sig").alias("of_a"), (F.col("bit") < 0).alias("member"))
    probes = probes.withColumn("visitors", F.count("*").over(here))
    near = F.when(F.col("member"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b")) & (F.bit_count(F.col("of_a").bitwiseXOR(F.col("of_b"))) <= most)
    full = F.col("many") | (F.col("visitors") > crowd(bits))
    once = F.col("member") & (F.col("place") == 1) & (F.col("a") == F.col("b"))
    found = probes.join(table, "slot").where((full & once) | (~full & near))
    return found.select(F.when(full, F.col("slot")).alias("slot"), F.when(~full, F.col("a")).alias("a"), F.when(~full, F.col("b")).alias("b"))


def _nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


class _Verifier:
    """Verifies pairs of nodes by the shingles of their texts."""

    def __init__(self, scratch: Scratch, docs: DataFrame, prints: DataFrame, nodes: DataFrame, wanted: DataFrame, width: int, similarity: float, text_col: str) -> None:
        """Gather the least shingle hashes and the fingerprints of the nodes in ``wanted``; no text moves."""
        self.scratch, self.docs, self.nodes, self.similarity, self.text_col = scratch, docs, nodes, similarity, text_col

        @F.arrow_udf("binary")
        def whole(texts: pa.Array) -> pa.Array:
            out = pa.array([np.unique(_shingle_hashes(t.as_py(), width)).astype("<u8").tobytes() for t in texts], pa.binary())
            give_back_memory()
            return out

        self._whole = whole
        self.error = DOUBT * math.sqrt(similarity * (1 - similarity) / LOW)
        found = prints.select("digest", "low", "wide").join(self._ids(wanted), F.col("digest") == F.col("_digest"))
        self.lows = scratch.write(found.groupBy("node").agg(F.first("low").alias("hashes"), F.first("wide").alias("wide")), "lows")

    def _ids(self, wanted: DataFrame) -> DataFrame:
        """``node, _digest`` of each node in ``wanted(node)``; few are broadcast, so that what they are joined with stays in place."""
        ids = self.nodes.join(wanted.distinct(), "node", "left_semi").select("node", F.col("digest").alias("_digest"))
        ids, n = self.scratch.counted(ids, "wanted")
        return F.broadcast(ids) if n <= BROADCAST_KEYS else ids

    def _sets(self, wanted: DataFrame) -> DataFrame:
        """``node, hashes``: all shingle hashes of a text of each node in ``wanted(node)``."""
        texts = self.docs.select(F.col(self.text_col).cast("string").alias("text"))
        found = texts.join(self._ids(wanted), text_digest(F.col("text")) == F.col("_digest")).groupBy("_digest", "node").agg(F.first("text").alias("text"))
        return self.scratch.write(found.select("node", self._whole("text").alias("hashes")), "sets")

    def _beside(self, pairs: DataFrame, hashes: DataFrame) -> DataFrame:
        side = lambda node, name: hashes.select(F.col("node").alias(node), F.col("hashes").alias(name))
        return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs(a, b)``, a written table, whose shingles are alike enough."""

        @F.arrow_udf("double")
        def alike(x: pa.Array, y: pa.Array) -> pa.Array:
            return pa.array([resemblance(np.frombuffer(a.as_py(), "<u4"), np.frombuffer(b.as_py(), "<u4")) for a, b in zip(x, y)], pa.float64())

        was_cut = F.greatest(F.length("x"), F.length("y")) >= 4 * LOW
        scored = self._beside(pairs, self.lows).select("a", "b", alike("x", "y").alias("alike"), was_cut.alias("cut"))
        doubtful = F.col("cut") & (F.abs(F.col("alike") - self.similarity) <= self.error)
        scored, unsure = self.scratch.counted(scored, "scored", doubtful)
        sure = scored.where(~doubtful & (F.col("alike") >= self.similarity)).select("a", "b")
        return sure.union(self.exact(scored.where(doubtful).select("a", "b"))) if unsure else sure

    def exact(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs(a, b)`` that are alike enough by all shingles: their texts are read again."""

        @F.arrow_udf("double")
        def jaccard(x: pa.Array, y: pa.Array) -> pa.Array:
            out = []
            for a, b in zip(x, y):
                a, b = np.frombuffer(a.as_py(), "<u8"), np.frombuffer(b.as_py(), "<u8")
                both = np.intersect1d(a, b, assume_unique=True).size
                out.append(both / max(1, len(a) + len(b) - both))
            return pa.array(out, pa.float64())

        found = self._beside(pairs, self._sets(_nodes_of(pairs))).where(jaccard("x", "y") >= self.similarity)
        return self.scratch.write(found.select("a", "b"), "exact")


def _visits(scratch: Scratch, slots: DataFrame, nodes: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Who meets in full ``slots``: ``slot, own`` for each slot whose members visit it, and the ``members(own, node, cut, cuts)`` of those.

    Members of a slot go together, in ``cuts`` parts, so a large group costs a row for each part and slot, not for each visitor.
    """
    ball = f"filter(sequence(-1, {bits - 1}), i -> i < 0 or (slot & shiftleft(1L, i)) <> 0)"
    visits = slots.withColumn("bit", F.explode(F.expr(ball))).select("slot", F.expr("if(bit < 0, slot, slot - shiftleft(1L, bit))").alias("own"))
    visits = scratch.write(visits, "visits")
    cut = nodes.select("node", F.posexplode("values").alias("segment", "value")).select("node", (F.col("segment").cast("long") * (1 << bits) + F.col("value")).alias("own"))
    members = cut.join(visits.select("own").distinct(), "own", "left_semi")
    members = members.withColumn("cuts", F.ceil(F.count("*").over(Window.partitionBy("own")) / COMPARED).cast("int"))
    members = members.withColumn("cut", (F.pmod(F.xxhash64("node"), F.lit(1 << 30)) % F.col("cuts")).cast("int"))
    return visits, scratch.write(members, "members")


def _compared(scratch: Scratch, visits: DataFrame, members: DataFrame, lows: DataFrame, labels: DataFrame | None, cap: int | None, most: int, similarity: float, error: float) -> DataFrame:
    """What a comparison of the visitors of every full slot with its members finds: ``slot, a, b, sure, held`` (see :func:`linked`)."""
    named = members.join(lows.select("node", "wide", F.col("hashes").alias("low")), "node")
    named = named.withColumn("label", F.col("node")) if labels is None else named.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node"))
    parts = named.groupBy("own", "cut").agg(F.collect_list(F.struct("node", "wide", "low", "label")).alias("part"))
    size = members.groupBy("own").agg(F.count("*").alias("n"), F.first("cuts").alias("own_cuts"))
    shape = visits.join(size, "own").groupBy("slot").agg(F.max(F.when(F.col("own") == F.col("slot"), F.col("own_cuts"))).alias("cuts"), F.ceil(F.sum("n") / COMPARED).cast("int").alias("waves"))
    met = visits.join(scratch.write(shape, "shape"), "slot").join(parts, "own")
    left = met.where("own = slot").select("slot", "cut", F.explode(F.sequence(F.lit(0), F.col("waves") - 1)).alias("wave"), F.lit(True).alias("member"), "part")
    wave = F.pmod(F.xxhash64("own", "cut"), F.col("waves").cast("long")).cast("int").alias("wave")
    right = met.select("slot", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), wave, F.lit(False).alias("member"), "part")

    def compare(block: pa.Table) -> pa.Table:
        sides = []
        for side in (False, True):
            rows = block.filter(pc.equal(block["member"], side))["part"].combine_chunks().flatten()
            words = rows.field("wide").flatten().to_numpy().reshape(len(rows), -1).view(np.uint64)
            hashes = [np.frombuffer(x.as_py(), "<u4") for x in rows.field("low")]
            sides.append((rows.field("node").to_numpy(), words, hashes, rows.field("label").to_numpy()))
        a, b, sure, held = linked(*sides, most, similarity, error, cap)
        slot = np.full(len(a), block["slot"][0].as_py(), np.int64)
        del sides
        give_back_memory()
        return pa.table({"slot": slot, "a": np.minimum(a, b), "b": np.maximum(a, b), "sure": sure, "held": held})

    return left.union(right).groupBy("slot", "cut", "wave").applyInArrow(compare, "slot long, a long, b long, sure boolean, held boolean")


def _similar(docs: DataFrame, count: int, width: int, similarity: float, id_col: str, text_col: str, scratch: Scratch, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """Written tables: ``doc_id, digest, key`` of every row (of ``count``), and for every key its ``component``, a node's number."""
    bits = segment_bits(count)
    n_segments = segment_count(bits, similarity)
    wide = 64 * math.ceil(max(WIDE, APART + bits * n_segments) / 64)
    loose = differing_bits(similarity, LOOSE, wide)
    prints = scratch.write(_fingerprinted(docs, width, bits, n_segments, wide, id_col, text_col), "prints", keep)
    rows = prints.select("doc_id", "digest", "key")
    # the numbers are fixed by being written; equal word sequences are one node, so copies are never paired
    nodes = prints.groupBy("key").agg(F.first("wide").alias("wide"), F.first("values").alias("values"), F.min("digest").alias("digest"))
    nodes = scratch.write(nodes.select(F.monotonically_increasing_id().alias("node"), "*", F.col("wide")[0].alias("sig")), "nodes")
    met = scratch.write(_met(nodes, bits, differing_bits(similarity, SIGHT, 64)), "met")
    whole = nodes.select("node", "wide")
    pairs = met.where(F.col("b").isNotNull()).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    close = pairs.join(whole.select(F.col("node").alias("a"), F.col("wide").alias("x")), "a").join(whole.select(F.col("node").alias("b"), F.col("wide").alias("y")), "b").where(_apart("x", "y") <= loose)
    close = scratch.write(close.select("a", "b"), "close")
    slots, n_full = scratch.counted(met.where(F.col("slot").isNotNull()).select("slot"), "full")
    wanted = _nodes_of(close)
    if n_full:
        visits, members = _visits(scratch, slots, nodes, bits)
        wanted = wanted.union(members.select("node"))
    verifier = _Verifier(scratch, docs, prints, nodes, wanted, width, similarity, text_col)
    links, tested, joined = verifier.links(close), close, None
    for cap in PROPOSED if n_full else ():
        found = scratch.write(_compared(scratch, visits, members, verifier.lows, joined, cap, loose, similarity, verifier.error), "found")
        links = links.union(found.where("sure").select("a", "b"))
        fresh_pairs, n = scratch.counted(found.where("not sure").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "untested")
        tested = tested.union(fresh_pairs)
        if n:
            links = links.union(verifier.exact(fresh_pairs))
        if n or joined is None:
            joined = scratch.write(connected_components(links, scratch), "joined")
        slots, n_held = scratch.counted(found.where("held").select("slot").distinct(), "held")
        if not n_held:
            break
        # only where partners were held back is compared again
        visits = scratch.write(visits.join(slots, "slot", "left_semi"), "visits")
        members = scratch.write(members.join(visits.select("own").distinct(), "own", "left_semi"), "members")
    if joined is None:
        joined = connected_components(links, scratch)
    placed = nodes.select("key", "node").join(joined, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    return rows, scratch.write(placed, "placed")


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group of every document under links between texts of ``similarity`` or more on ``width``-word shingles.

    Segments are looked up with the ball of radius one.  What is met is
    verified by the distance of the whole fingerprints and then by the shingles
    themselves: the least ``LOW`` of their hashes, and all of them where a set
    was cut and its estimate lies near ``similarity``.  Of a segment value that
    many fingerprints share or visit all pairs are compared within tasks, which
    only put out links that join something, and pairs in doubt, these in
    rounds, until none is left.  No group, tight or loose, spells out its
    pairs, and every link is verified, so groups do not depend on how full a
    slot is.  Texts of equal words are one node.

    A pair at ``similarity`` is met with the chance ``MET`` at any size; the
    lookups of a document grow with about the fourth root of their number.

    Word-less and null texts have no shingles and form one group.  A null id
    ranks above every id.  Rows that share an id but not a text are placed
    each by its text; repeated rows stay.  An empty table gives an empty
    result.  Returns ``doc_id long, component_id long``.
    """
    spark = docs.sparkSession
    with batches_of(spark, BATCH_ROWS), Scratch(spark, "similar") as scratch:
        rows, placed = _similar(docs, docs.count(), width, similarity, id_col, text_col, scratch, keep=True)
        own = rows.groupBy("key").agg(F.min("doc_id").alias("least"))
        named = scratch.write(own.join(placed, "key"), "own")
        least = scratch.write(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
        named = scratch.write(named.join(least, "component").select("key", "component_id"), "named", keep=True)
    return rows.join(named, "key").select("doc_id", "component_id")


Side = tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]


def linked(left: Side, right: Side, most: int, similarity: float, error: float, cap: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links between two blocks of nodes, each given as ids, fingerprints, least hashes and labels.

    Pairs of equal labels or more than ``most`` differing bits are passed over.
    Pairs that are alike by their least hashes join their labels, and of these
    links only those that join two labels are returned: fewer than there are
    nodes.  Pairs in doubt (a set was cut and the estimate lies within
    ``error`` of ``similarity``) whose labels stay apart are returned for
    verification: of each node of ``right`` the ``cap`` most alike.

    Returns for each pair its two ids, whether it is ``sure``, and whether a
    node's pairs were ``held`` back.
    """
    ids, first = np.unique(np.concatenate((left[0], right[0])), return_index=True)
    words = np.concatenate((left[1], right[1]))[first]
    sets = [*left[2], *right[2]]
    sets = [sets[i] for i in first]
    label = np.unique(np.concatenate((left[3], right[3]))[first], return_inverse=True)[1]
    visitors, members = np.searchsorted(ids, left[0]), np.searchsorted(ids, right[0])
    # hashes as a matrix of their ranks, which none follows in shorter rows
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    names, rank = np.unique(np.concatenate([*sets, np.zeros(0, "<u4")]), return_inverse=True)
    ranks = np.full((len(sets), max(1, sizes.max(initial=0))), len(names), np.int32)
    ranks[np.arange(ranks.shape[1]) < sizes[:, None]] = rank
    was_cut = sizes >= LOW
    top = np.where(was_cut, ranks[:, -1], len(names) - 1)  # a set is known up to here
    has = np.zeros(len(names) + 1, bool)
    none = np.zeros(0, np.int64)
    a, b, doubt = [none], [none], [(none, none, np.zeros(0))]
    for i in members.tolist():
        near = visitors[label[visitors] != label[i]]
        near = near[np.bitwise_count(words[near] ^ words[i]).sum(axis=1, dtype=np.int64) <= most]
        if not len(near):
            continue
        own = ranks[i, : sizes[i]]
        has[own] = True
        both = has[ranks[near]].sum(axis=1)
        has[own] = False
        upto = np.minimum(top[near], top[i])  # hashes up to here are known of either set
        of_i, of_near = np.searchsorted(own, upto, "right"), sizes[near]
        if was_cut[i]:
            of_near = (ranks[near] <= upto[:, None]).sum(axis=1)
        alike = both / np.maximum(1, of_i + of_near - both)
        unsure = (was_cut[near] | was_cut[i]) & (np.abs(alike - similarity) <= error)
        sure = near[~unsure & (alike >= similarity)]
        if unsure.any():
            doubt.append((np.full(unsure.sum(), i), near[unsure], alike[unsure]))
        if len(sure):
            met, one = np.unique(label[sure], return_index=True)
            a.append(np.full(len(one), i))
            b.append(sure[one])
            label[np.isin(label, met)] = label[i]
    n = sum(map(len, a))
    x, y, alike = map(np.concatenate, zip(*doubt))
    apart = label[x] != label[y]
    x, y, alike = x[apart], y[apart], alike[apart]
    order = np.lexsort((y, -alike, x))
    x, y = x[order], y[order]
    place = np.arange(len(x)) - np.searchsorted(x, x)
    more = np.zeros(len(x), bool)
    if cap is not None:
        more = np.isin(x, x[place >= cap])
        x, y, more = x[place < cap], y[place < cap], more[place < cap]
    a, b = np.concatenate((*a, x)), np.concatenate((*b, y))
    return ids[a], ids[b], np.arange(len(a)) < n, np.concatenate((np.zeros(n, bool), more))


def keep_one_of_similar(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every group of :func:`similar_groups`; all columns, nothing else.

    It is the row with the least id (a null id ranks last), of rows that share
    that id the one whose text has the least digest, and any one of rows that
    repeat both.  Rows go by id and text, so a row that merely shares its id
    with a copy stays.  Rows without a word are no copies of anything and stay.
    """
    spark = docs.sparkSession
    worded = docs.where(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
    with Scratch(spark, "near-copies") as scratch:
        with batches_of(spark, BATCH_ROWS):
            rows, placed = _similar(worded, docs.count(), width, similarity, id_col, text_col, scratch)
            order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
            size = placed.groupBy("component").agg(F.count("*").alias("keys"))
            texts = rows.groupBy("key").agg(F.min(order).alias("first"), F.count("*").alias("n"))
            texts = scratch.write(texts.join(placed, "key").join(size, "component").where("n > 1 or keys > 1"), "grouped")
            kept = scratch.write(texts.groupBy("component").agg(F.min("first").alias("kept")), "first")
            texts = scratch.write(texts.join(kept, "component").select("key", "kept"), "texts")
            ranked = scratch.write(rows.join(texts, "key").select("doc_id", "digest", "kept"), "ranked")
            is_kept = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("digest") == F.col("kept.digest"))
            key = [F.col("doc_id").alias("id"), "digest"]
            gone = scratch.write(ranked.where(~is_kept).select(*key).distinct(), "gone", keep=True)
            again = scratch.write(ranked.where(is_kept).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select("id", "digest"), "again", keep=True)
        return without_rows(docs, gone, again, id_col, text_col)
