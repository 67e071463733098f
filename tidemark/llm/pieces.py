"""SentencePiece encoding and decoding with N-best segmentation.

A text is a lattice of the vocabulary's pieces.  A forward Viterbi pass gives
every place its best score so far; these scores are exact heuristics for a
backward A-star search, which yields segmentations best first.

No piece goes on after a word's end into the next word, so the lattice falls
apart into chunks (spaces and the word after them).  Chunks are segmented
once; all distinct chunks of a batch go through the forward pass together.
The pass keeps the two best scores of a place, so a chunk's gap between its
best and its second segmentation is known, and only the chunks of the n - 1
least gaps can differ from their best in a text's n best segmentations: the
A-star search runs on those.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back_memory

#: Where the vocabulary lies unless a caller names another file; it is read on the driver only.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Segmentations of a text that are searched for.
N_BEST = 3
#: A character without a piece costs this much more than the worst piece and is spelled in bytes.
UNKNOWN_PENALTY = 10.0
#: Scores at or below this mark runs of spaces, which cost nothing.
RESERVED = -1e8
#: Chunks longer than this are cut where no piece crosses; what is longer still is segmented by itself.
LONG = 64
#: Characters of segmented chunks that a task keeps (some 40 bytes each), and of texts that are encoded together.
KEPT_CHARS = 1_600_000
GROUP_CHARS = 600_000
#: Characters of chunks that go through the forward pass together (some 150 bytes each).
TOGETHER_CHARS = 150_000
SPACE = "▁"
CHUNKS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Stands for a literal U+2581 of the text, which is spelled in bytes so that decoding tells it from a space.
LITERAL = ""
BYTES = -2


class PieceModel:
    """A vocabulary as flat arrays: a trie over characters, scores and ids of its pieces, and the bytes of every id.

    Trie transitions are one open-addressed table of (node, character), at most
    half full whatever the size of the vocabulary.
    """

    def __init__(self, pieces: list[str], ids: list[int], scores: list[float], byte_ids: list[int], by_id: list[bytes]) -> None:
        self.unknown = min(scores, default=0.0) - UNKNOWN_PENALTY
        self.longest = max(map(len, pieces), default=1)
        self.ids, self.byte_ids = np.array(ids, np.int32), np.array(byte_ids, np.int32)
        self.piece_score = np.array([*scores, self.unknown], np.float64)  # the last is that of BYTES
        self.id_bytes, self.id_ends = b"".join(by_id), np.cumsum([0, *map(len, by_id)])
        self.by_id: list[bytes] | None = None  # cut apart where it is first needed
        steps: dict[tuple[int, int], int] = {}
        piece_at = [-1]
        for k, piece in enumerate(pieces):
            node = 0
            for c in map(ord, piece):
                if (node, c) not in steps:
                    steps[node, c] = len(piece_at)
                    piece_at.append(-1)
                node = steps[node, c]
            piece_at[node] = k
        self.node_piece = np.array(piece_at, np.int32)
        self.slot_bits = max(8, (2 * len(steps)).bit_length())
        self.slot_key = np.full(1 << self.slot_bits, -1, np.int64)
        self.slot_node = np.zeros(1 << self.slot_bits, np.int32)
        for (node, c), child in steps.items():
            key = node << 21 | c
            slot = int(self._slots(np.array([key]))[0])
            while self.slot_key[slot] >= 0:
                slot = slot + 1 & len(self.slot_key) - 1
            self.slot_key[slot], self.slot_node[slot] = key, child

    @classmethod
    def load(cls, path: str = MODEL_FILE) -> PieceModel:
        """Read a SentencePiece file (any model type; its scores are the lattice's scores)."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        usable = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and names[i]]
        scores = [sp.get_score(i) if sp.get_score(i) > RESERVED else 0.0 for i in usable]
        bytes_of = {int(names[i][1:-1], 16): i for i in range(size) if sp.is_byte(i)}
        if len(bytes_of) != 256:
            raise ValueError("the vocabulary lacks byte pieces: decoding could not be exact")
        if any(re.search(f"[^{SPACE}]{SPACE}", names[i]) for i in usable):
            raise ValueError("a piece goes on after a word's end")
        by_id = [names[i].replace(SPACE, " ").encode() for i in range(size)]
        for b, i in bytes_of.items():
            by_id[i] = bytes([b])
        for i in range(size):
            if sp.is_control(i) or sp.is_unknown(i):
                by_id[i] = b""
        return cls([names[i] for i in usable], usable, scores, [bytes_of[b] for b in range(256)], by_id)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def _children(self, keys: np.ndarray) -> np.ndarray:
        """Child of each (node, character) key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        open_, slots = np.arange(len(keys)), self._slots(keys)
        while len(open_):
            found = self.slot_key[slots]
            hit = found == keys[open_]
            out[open_[hit]] = self.slot_node[slots[hit]]
            on = ~hit & (found >= 0)
            open_, slots = open_[on], slots[on] + 1 & len(self.slot_key) - 1
        return out

    def _matches(self, codes: np.ndarray, limit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """By length (from 1): places where a piece starts that ends before ``limit`` of the place, and its number.

        A character that is no piece counts as one of length 1, numbered BYTES.
        """
        spelled = np.ones(len(codes), bool)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        at, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        for d in range(self.longest):
            inside = at + d < limit[at]
            at, node = at[inside], node[inside]
            node = self._children(node << 21 | codes[at + d])
            alive = node >= 0
            at, node = at[alive], node[alive].astype(np.int64)
            k = self.node_piece[node]
            is_piece = k >= 0
            out.append((at[is_piece], k[is_piece]))
            if d == 0:
                spelled[at[is_piece]] = False
        odd = np.flatnonzero(spelled)
        out[0] = (np.concatenate((out[0][0], odd)), np.concatenate((out[0][1], np.full(len(odd), BYTES, np.int32))))
        return out

    def spell(self, chunk: str, ks: Iterable[int], lengths: Iterable[int]) -> np.ndarray:
        """Ids of a segmentation given by piece numbers; BYTES spells a character."""
        out: list[int] = []
        at = 0
        for k, n in zip(ks, lengths):
            if k == BYTES:
                out += self.byte_ids[list(chunk[at : at + n].encode("utf-8", "surrogatepass"))].tolist()
            else:
                out.append(int(self.ids[k]))
            at += n
        return np.array(out, np.int32)

    # ---- one chunk ----

    def _edges(self, chunk: str) -> list[list[tuple[int, int]]]:
        """For each place, the (length, piece number) that end there, shortest first."""
        ends: list[list[tuple[int, int]]] = [[] for _ in range(len(chunk) + 1)]
        for d, (start, k) in enumerate(self._matches(_codes(chunk), np.full(len(chunk), len(chunk)))):
            for a, piece in zip(start.tolist(), k.tolist()):
                ends[a + d + 1].append((d + 1, piece))
        return ends

    def _score(self, k: int) -> float:
        return float(self.piece_score[-1 if k == BYTES else k])

    def n_best(self, chunk: str, n: int) -> list[tuple[float, np.ndarray]]:
        """The ``n`` best segmentations of a chunk, best first: score and ids."""
        ends = self._edges(chunk)
        upto = [0.0] * (len(chunk) + 1)
        for b in range(1, len(chunk) + 1):
            upto[b] = max(upto[b - size] + self._score(k) for size, k in ends[b])
        order = 0
        agenda = [(-upto[-1], order, len(chunk), 0.0, None)]  # estimate, age, place, score of the rest, the rest
        found = []
        while agenda and len(found) < n:
            _, _, place, rest, tail = heapq.heappop(agenda)
            if place == 0:
                ks, sizes = [], []
                while tail is not None:
                    k, size, tail = tail
                    ks.append(k)
                    sizes.append(size)
                found.append((rest, self.spell(chunk, ks, sizes)))
                continue
            for size, k in ends[place]:
                order += 1
                total = rest + self._score(k)
                heapq.heappush(agenda, (-(upto[place - size] + total), order, place - size, total, (k, size, tail)))
        return found

    def _best_two(self, chunk: str) -> tuple[np.ndarray, float, float]:
        """Ids and score of a chunk's best segmentation and its gap to the second (infinite if there is none)."""
        ends = self._edges(chunk)
        one, two, back = [0.0], [-np.inf], [(0, 0)]
        for b in range(1, len(chunk) + 1):
            first, second, by = -np.inf, -np.inf, (0, 0)
            for size, k in ends[b]:
                s, r = one[b - size] + self._score(k), two[b - size] + self._score(k)
                if s > first:
                    first, second, by = s, max(first, r), (size, k)
                else:
                    second = max(second, s)
            one.append(first)
            two.append(second)
            back.append(by)
        ks, sizes, b = [], [], len(chunk)
        while b:
            sizes.append(back[b][0])
            ks.append(back[b][1])
            b -= back[b][0]
        return self.spell(chunk, ks[::-1], sizes[::-1]), one[-1], one[-1] - two[-1]

    # ---- many chunks ----

    def chunks(self, text: str) -> list[str]:
        """Parts of a text that no piece crosses: :func:`chunks_of`, of which long ones are cut further."""
        return self.split([text])[0]

    def split(self, texts: list[str]) -> list[list[str]]:
        """:meth:`chunks` of many texts; their long chunks are cut together."""
        found = [chunks_of(t) for t in texts]
        has_long = [max(map(len, chunks), default=0) > LONG for chunks in found]
        long = list({c: None for chunks, has in zip(found, has_long) if has for c in chunks if len(c) > LONG})
        parts: dict[str, list[str]] = {}
        group: list[str] = []
        size = 0
        for chunk in [*long, None]:
            if group and (chunk is None or size >= TOGETHER_CHARS):
                parts |= zip(group, self._cut(group))
                group, size = [], 0
            if chunk is not None:
                group.append(chunk)
                size += len(chunk)
        return [[part for c in chunks for part in parts.get(c, (c,))] if has else chunks for chunks, has in zip(found, has_long)]

    def _cut(self, chunks: list[str]) -> list[list[str]]:
        """Each chunk cut wherever no piece goes on; cuts that would leave short parts are left out."""
        upto = np.cumsum([0, *map(len, chunks)])
        crossed = np.zeros(upto[-1] + 1, np.int64)
        for d, (start, _) in enumerate(self._matches(_codes("".join(chunks)), np.repeat(upto[1:], np.diff(upto)))):
            if d:  # a piece of d + 1 characters crosses the d places within it
                crossed += np.bincount(start + 1, minlength=len(crossed)) - np.bincount(start + d + 1, minlength=len(crossed))
        free = np.flatnonzero(np.cumsum(crossed) == 0)
        bounds = np.searchsorted(free, [upto[:-1] + 1, upto[1:]])
        out = []
        for chunk, first, lo, hi in zip(chunks, upto.tolist(), *bounds.tolist()):
            last, cuts = 0, [0]
            for place in (free[lo:hi] - first).tolist():
                if place - last >= LONG // 2:
                    cuts.append(place)
                    last = place
            out.append([chunk[a:b] for a, b in zip(cuts, [*cuts[1:], len(chunk)])])
        return out

    def segment(self, chunks: list[str]) -> list[tuple[bytes, float, float]]:
        """For each chunk: ids of the best segmentation (as int32 bytes), its score, and the gap to the second."""
        out: list[tuple[bytes, float, float]] = [None] * len(chunks)
        short: list[int] = []
        size = 0

        def together() -> None:
            for i, result in zip(short, self._segment_short([chunks[i] for i in short])):
                out[i] = result
            short.clear()

        for i, chunk in enumerate(chunks):
            if chunk == LITERAL:
                out[i] = (self.byte_ids[list(SPACE.encode())].tobytes(), self.unknown, np.inf)
            elif len(chunk) > 4 * LONG:
                ids, score, gap = self._best_two(chunk)
                out[i] = (ids.tobytes(), score, gap)
            else:
                short.append(i)
                size += len(chunk)
                if size >= TOGETHER_CHARS:
                    together()
                    size = 0
        together()
        return out

    def _segment_short(self, chunks: list[str]) -> list[tuple[bytes, float, float]]:
        if not chunks:
            return []
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        codes = _codes("".join(chunks))
        upto = np.concatenate(([0], np.cumsum(sizes)))
        chunk_of = np.repeat(np.arange(len(chunks)), sizes)
        place = np.arange(len(codes)) - upto[chunk_of]  # within the chunk
        # edges by length; each also by the place where it ends
        edges = self._matches(codes, upto[chunk_of + 1])
        by_end = []
        for d, (start, k) in enumerate(edges):
            end = (place[start] + d + 1).astype(np.uint16)
            order = np.argsort(end, kind="stable")
            bounds = np.searchsorted(end[order], np.arange(int(sizes.max()) + 2))
            by_end.append((start[order], k[order], bounds))
        # forward pass over nodes: place p of chunk c is node upto[c] + c + p
        nodes = len(codes) + len(chunks)
        first_node = upto[:-1] + np.arange(len(chunks))
        one, two = np.full(nodes, -np.inf), np.full(nodes, -np.inf)
        one[first_node] = 0.0
        back_k, back_n = np.zeros(nodes, np.int32), np.zeros(nodes, np.int64)
        for t in range(1, int(sizes.max()) + 1):
            for d in range(min(t, self.longest)):
                start, k, bounds = by_end[d]
                start, k = start[bounds[t] : bounds[t + 1]], k[bounds[t] : bounds[t + 1]]
                if not len(start):
                    continue
                u = start + chunk_of[start]
                v = u + d + 1
                gain = self.piece_score[np.where(k == BYTES, -1, k)]
                s, r = one[u] + gain, two[u] + gain
                had, had2 = one[v], two[v]
                better = s > had
                two[v] = np.where(better, np.maximum(had, r), np.maximum(had2, s))
                one[v] = np.where(better, s, had)
                back_k[v] = np.where(better, k, back_k[v])
                back_n[v] = np.where(better, d + 1, back_n[v])
        # walk back, all chunks at once
        here = first_node + sizes
        best, gap = one[here], one[here] - two[here]
        ks = np.full((len(chunks), int(sizes.max())), -1, np.int32)
        ns = np.zeros_like(ks, np.int8)
        running, step = np.arange(len(chunks)), ks.shape[1]
        while len(running):
            step -= 1
            spot = here[running]
            ks[running, step], ns[running, step] = back_k[spot], back_n[spot]
            here[running] -= back_n[spot]
            running = running[here[running] > first_node[running]]
        ids = self.ids[np.maximum(ks, 0)]
        used = (ks != -1).sum(axis=1)
        in_bytes = (ks == BYTES).any(axis=1)
        out = []
        width = ks.shape[1]
        for i, (n, odd_one, score, g) in enumerate(zip(used.tolist(), in_bytes.tolist(), best.tolist(), gap.tolist())):
            if odd_one:
                row = self.spell(chunks[i], ks[i, width - n :].tolist(), ns[i, width - n :].tolist())
            else:
                row = ids[i, width - n :]
            out.append((row.tobytes(), score, g))
        return out

    # ---- texts ----

    def decode(self, ids: np.ndarray) -> str:
        """The text that the ids were encoded from."""
        if self.by_id is None:
            ends = self.id_ends.tolist()
            self.by_id = [self.id_bytes[a:b] for a, b in zip(ends, ends[1:])]
        return b"".join(map(self.by_id.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def chunks_of(text: str) -> list[str]:
    """Chunks of the lattice of a text: a space goes before the text, literal U+2581 stand alone."""
    if not text:
        return []
    head, *more = text.split(SPACE)
    out = CHUNKS.findall(SPACE + head.replace(" ", SPACE))
    for part in more:
        out.append(LITERAL)
        out += CHUNKS.findall(part.replace(" ", SPACE))
    return out


class Encoder:
    """Encodes texts with one model; keeps segmented chunks of up to ``KEPT_CHARS`` characters."""

    def __init__(self, model: PieceModel, n: int = N_BEST) -> None:
        self.model, self.n = model, n
        self._forget()

    def _forget(self) -> None:
        self.held = 0
        self.place: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.score_array, self.gap_array = np.zeros(0), np.zeros(0)
        self.searched: dict[str, list[tuple[float, np.ndarray]]] = {}

    def learn(self, texts: list[list[str]]) -> None:
        """Segment the chunks of the texts that are new."""
        if self.held > KEPT_CHARS:
            self._forget()
        new = list({c: None for chunks in texts for c in chunks if c not in self.place})
        found = self.model.segment(new)
        for chunk, (ids, _, _) in zip(new, found):
            self.place[chunk] = len(self.ids)
            self.ids.append(ids)
            self.held += len(chunk)
        self.score_array = np.concatenate((self.score_array, [score for _, score, _ in found]))
        self.gap_array = np.concatenate((self.gap_array, [gap for _, _, gap in found]))

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, list[float]]:
        """Ids of the best segmentation of a text and the scores of its ``n`` best, of which there may be fewer."""
        ids, ranked = self.ranked(chunks)
        return ids, [score for score, _ in ranked]

    def ranked(self, chunks: list[str]) -> tuple[np.ndarray, list[tuple[float, tuple[tuple[int, int], ...]]]]:
        """Best ids; then the ``n`` best scores, each with the (chunk place, rank) that differ from the best."""
        if not chunks:
            return np.zeros(0, np.int32), [(0.0, ())]
        at = np.fromiter(map(self.place.__getitem__, chunks), np.int64, len(chunks))
        ids = np.frombuffer(b"".join([self.ids[i] for i in at.tolist()]), np.int32)
        total = float(self.score_array[at].sum())
        gaps = self.gap_array[at]
        want = min(self.n - 1, len(gaps))
        spots = np.argpartition(gaps, want - 1)[:want] if 0 < want < len(gaps) else np.arange(want)
        choices: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
        for spot in sorted(spots.tolist()):
            if not np.isfinite(gaps[spot]):
                continue
            chunk = chunks[spot]
            if chunk not in self.searched:
                self.searched[chunk] = self.model.n_best(chunk, self.n)
            options = self.searched[chunk]
            lost = [options[0][0] - score for score, _ in options]
            choices = heapq.nsmallest(self.n, ((a + b, (*how, (spot, rank)) if rank else how) for a, how in choices for rank, b in enumerate(lost)))
        return ids, [(total - loss, how) for loss, how in choices]

    def segmentations(self, text: str) -> list[tuple[float, np.ndarray]]:
        """The ``n`` best segmentations of a text, best first: score and ids."""
        chunks = self.model.chunks(text)
        self.learn([chunks])
        _, ranked = self.ranked(chunks)
        out = []
        for score, how in ranked:
            other = dict(how)
            parts = [self.searched[c][other[i]][1].tobytes() if i in other else self.ids[self.place[c]] for i, c in enumerate(chunks)]
            out.append((score, np.frombuffer(b"".join(parts), np.int32)))
        return out


def with_pieces(docs: DataFrame, model: PieceModel, name: str, n: int = N_BEST, keep_ids: bool = True, text_col: str = "text") -> DataFrame:
    """Add the column ``name``: the encoded text.

    Struct of ``ids`` (array of int; null unless ``keep_ids``), ``n_pieces``,
    ``ids_sha256`` (of the ids as little-endian 32-bit integers), ``scores``
    (those of the ``n`` best segmentations, best first) and ``exact`` (decoding
    the ids gave the text back).  Null and empty texts have no pieces.  Other
    columns are carried along untouched.
    """
    def encoded(encoder: Encoder, texts: list[str]) -> Iterator[tuple[np.ndarray, list[float], bool]]:
        split = model.split(texts)
        encoder.learn(split)
        for text, chunks in zip(texts, split):
            ids, scores = encoder.encode(chunks)
            yield ids, scores, model.decode(ids) == text

    @F.arrow_udf("struct<ids:array<int>,n_pieces:long,ids_sha256:string,scores:array<double>,exact:boolean>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(model, n)
        for column in batches:
            kept, counts, digests, scores, exact = [np.zeros(0, np.int32)], [], [], [], []

            def take(group: list[str]) -> None:
                for ids, best, same in encoded(encoder, group):
                    if keep_ids:
                        kept.append(ids)
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest())
                    scores.append(best)
                    exact.append(same)

            group: list[str] = []
            size = 0
            for value in column:
                group.append(value.as_py() or "")
                size += len(group[-1])
                if size >= GROUP_CHARS:
                    take(group)
                    group, size = [], 0
            take(group)
            # ids lie end to end, so that they are never Python objects
            ends = np.concatenate(([0], np.cumsum(counts, dtype=np.int64))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept))) if keep_ids else pa.nulls(len(counts), pa.list_(pa.int32()))
            columns = [ids, pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(scores, pa.list_(pa.float64())), pa.array(exact, pa.bool_())]
            kept.clear()
            give_back_memory()
            yield pa.StructArray.from_arrays(columns, ["ids", "n_pieces", "ids_sha256", "scores", "exact"])
        encoder._forget()  # a worker waits for other tasks, of other stages too, and would hold the chunks meanwhile
        give_back_memory()

    return docs.withColumn(name, encode(F.col(text_col).cast("string")))
