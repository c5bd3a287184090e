"""SentencePiece encoding by forward filtering, backward sampling; lossless decoding.

A text is written as in SentencePiece: one blank in front, blanks as U+2581. Its lattice has an edge for every vocabulary
piece that matches, and byte pieces for characters the vocabulary lacks (and for a literal U+2581, so decoding stays exact).
No piece crosses the start of a run of blanks or a line end, so the lattice falls apart into *chunks* there. Filtering runs
once for each distinct chunk of a batch; every occurrence then samples its own path from the end backwards, with uniforms that
depend only on (seed, row key, chunk number, step). Equal keys and texts give equal segmentations, wherever rows are.
A chunk of more than ``PART_POSITIONS`` characters (a text without blanks) keeps one forward probability for each position, and
makes its edges window by window, once forwards and once on the way back.

A piece of frequency rank r weighs (r + 2) ** -theta, theta being the inverse temperature.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, aside, mix, pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THETA, SEED = 1.0, 17
#: Bytes of text filtered together (chunks repeat, so more text costs less each), and characters of a long text at a time.
BATCH_BYTES, STRETCH = 2 << 20, 1 << 20
#: Positions of distinct chunks whose lattices are held at once.
PART_POSITIONS = 1 << 15
#: Positions of a longer chunk whose edges are held at once.
WINDOW = 1 << 13
_BLANK, _LINE = 0x2581, 10
_B1 = U64(0x9E3779B97F4A7C15)


def vocabulary(model: str = MODEL) -> tuple[list[str], list[int]]:
    """Piece strings in id order and each id's kind: 0 a normal piece, 1 a byte, 2 a control piece."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    ids = range(m.get_piece_size())
    return [m.id_to_piece(i) for i in ids], [1 if m.is_byte(i) else 2 if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else 0 for i in ids]


class Lattice:
    """Lookup tables of one vocabulary, and batch encoding and decoding."""

    def __init__(self, names: list[str], kinds: list[int], theta: float = THETA):
        normal = [i for i, k in enumerate(kinds) if k == 0]
        self.byte_id = np.zeros(256, np.int64)
        for i, k in enumerate(kinds):
            if k == 1:
                self.byte_id[int(names[i][3:5], 16)] = i
        self.first_byte = int(self.byte_id.min())
        for i in normal:
            if "▁" in names[i].lstrip("▁") or "\n" in names[i] or (names[i][0] == "▁") and "▁" in names[i][1:] and set(names[i]) != {"▁"}:
                raise ValueError("a piece crosses a chunk border")
        self.most = max(len(names[i]) for i in normal)
        weight = {i: (r + 2.0) ** -theta for r, i in enumerate(normal)}
        total = sum(weight.values())
        self.byte_weight = min(weight.values()) / total
        keys = np.array([self._hash_text(names[i]) for i in normal], U64)
        bits = max(16, (8 * len(normal)).bit_length())
        self.mask = U64((1 << bits) - 1)
        self.slot_key, self.slot_id, self.slot_w, self.probes = np.zeros(1 << bits, U64), np.full(1 << bits, -1, np.int32), np.zeros(1 << bits), 1
        for key, i in zip(keys.tolist(), normal):
            at, n = key & int(self.mask), 1
            while self.slot_id[at] >= 0:
                at, n = (at + 1) & int(self.mask), n + 1
            self.slot_key[at], self.slot_id[at], self.slot_w[at], self.probes = key, i, weight[i] / total, max(self.probes, n)
        text = [np.frombuffer((names[i].replace("▁", " ") if k == 0 else "").encode("utf-32-le"), np.uint32) for i, k in enumerate(kinds)]
        self.piece_off = np.concatenate([[0], np.cumsum([len(t) for t in text])])
        self.piece_code = np.concatenate(text)
        self.is_byte = np.array([k == 1 for k in kinds])
        self.byte_of = np.zeros(len(kinds), np.uint8)
        self.byte_of[self.byte_id] = np.arange(256)

    @staticmethod
    def _hash_text(s: str) -> int:
        h = 0
        for c in s:
            h = (h * int(_B1) + ord(c) + 1) & (1 << 64) - 1
        return int(mix(np.array([h + len(s) * 0x632BE59BD9B4E019 & (1 << 64) - 1], U64))[0])

    def _lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, weight = np.full(len(h), -1, np.int32), np.zeros(len(h))
        at = h & self.mask
        hit = self.slot_key[at] == h
        found[hit], weight[hit] = self.slot_id[at[hit]], self.slot_w[at[hit]]
        rest = np.flatnonzero(~hit & (self.slot_id[at] >= 0))
        for n in range(1, self.probes):
            spot = (at[rest] + U64(n)) & self.mask
            hit = self.slot_key[spot] == h[rest]
            found[rest[hit]], weight[rest[hit]] = self.slot_id[spot[hit]], self.slot_w[spot[hit]]
            rest = rest[~hit & (self.slot_id[spot] >= 0)]
            if not len(rest):
                break
        return found, weight

    def _filter(self, code: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position of the distinct chunks: cumulative probabilities of the last edge's length, and edge ids.

        Positions are laid out chunk after chunk; literal blanks are marked with the code 0x110000 + U+2581.
        """
        size = end - start
        n = int(size.sum())
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        chunk = np.repeat(np.arange(len(size)), size)
        inner = np.arange(n) - first[chunk]
        text = code[start[chunk] + inner].astype(U64)
        most = min(self.most, int(size.max(initial=1)))
        weight, ids = np.zeros((n, most), np.float32), np.full((n, most), -1, np.int32)
        h = np.zeros(n, U64)
        scale = U64(0x632BE59BD9B4E019)
        # h holds the hash of the k characters from each position on; the edge ends k - 1 later
        for k in range(1, most + 1):
            ok = np.flatnonzero(inner + k <= size[chunk])
            h[ok] = h[ok] * _B1 + text[ok + k - 1] + U64(1)
            found, w = self._lookup(mix(h[ok] + U64(k * int(scale) & (1 << 64) - 1)))
            weight[ok + k - 1, k - 1], ids[ok + k - 1, k - 1] = w, found
        lone = np.flatnonzero(ids[:, 0] < 0)
        weight[lone, 0] = self._lone(text[lone])
        # alpha is kept relative to a power of ``lift`` per character, which cancels among paths of one position
        alpha = np.zeros((len(size), most))
        alpha[:, 0] = 1.0  # alpha[:, j]: j + 1 characters back from the position at hand
        order = np.argsort(-size, kind="stable")
        alive = np.searchsorted(-size[order], -np.arange(1, int(size.max(initial=0)) + 1), "right")
        first = first[order]
        for pos in range(int(size.max(initial=0))):
            m = alive[pos]
            rows = first[:m] + pos
            terms = alpha[:m] * weight[rows]
            total = terms.sum(1)
            weight[rows] = np.cumsum(terms, 1) / total[:, None]
            alpha[:m, 1:] = alpha[:m, :-1]
            alpha[:m, 0] = total
            if pos % 8 == 7:
                alpha[:m] /= alpha[:m].max(1)[:, None]
        return weight, ids

    def encode(self, texts: list[str], keys: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """Sampled piece ids of all texts, one after the other, and len(texts) + 1 offsets. keys: 64 bits per row.

        A long text is encoded in stretches that end where a chunk does; chunks keep their numbers, so nothing changes by it.
        """
        got, counts, at = [], np.zeros(len(texts), np.int64), 0
        for i in [*(i for i, t in enumerate(texts) if len(t) > STRETCH), len(texts)]:
            if at < i:
                size = np.fromiter((len(t) + 1 for t in texts[at:i]), np.int64, i - at)
                ids, n = self._encode(self._codes(texts[at:i]), np.concatenate([[0], np.cumsum(size)]), keys[at:i], seed, 0)
                got.append(ids)
                counts[at:i] = n
            if i < len(texts):
                code = self._codes(texts[i : i + 1])
                starts = np.append(np.flatnonzero(self._borders(code, np.zeros(1, np.int64))), len(code))
                lo, n = 0, len(starts) - 1
                while lo < n:
                    hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + STRETCH, "right")) - 1)
                    ids, _ = self._encode(code[starts[lo] : starts[hi]], np.array([0, starts[hi] - starts[lo]]), keys[i : i + 1], seed, lo)
                    got.append(ids)
                    counts[i] += len(ids)
                    lo = hi
            at = i + 1
        return (np.concatenate(got) if got else np.zeros(0, np.int32)), np.concatenate([[0], np.cumsum(counts)])

    @staticmethod
    def _codes(texts: list[str]) -> np.ndarray:
        """Code points of all texts, each with a blank in front; blanks are U+2581 and literal ones of these are marked."""
        code = np.frombuffer("".join([x for t in texts for x in (" ", t)]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        code[code == _BLANK] = 0x110000 + _BLANK
        code[code == 32] = _BLANK
        return code

    @staticmethod
    def _borders(code: np.ndarray, first: np.ndarray) -> np.ndarray:
        is_blank, is_line = code == _BLANK, code == _LINE
        border = np.zeros(len(code), bool)
        border[1:] = (is_blank[1:] & ~is_blank[:-1]) | is_line[1:] | is_line[:-1]
        border[first] = True
        return border

    def _encode(self, code: np.ndarray, off: np.ndarray, keys: np.ndarray, seed: int, numbered: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts code[off[i]:off[i + 1]], one after the other, and how many each has; chunks count from ``numbered``."""
        texts, empty = len(off) - 1, np.diff(off) == 1
        start = np.flatnonzero(self._borders(code, off[:-1]))
        end = np.append(start[1:], len(code))
        doc = np.searchsorted(off, start, "right") - 1
        place = np.arange(len(code)) - np.repeat(start, end - start)
        h = mix(code.astype(U64) + place.astype(U64) * U64(0xC2B2AE3D27D4EB4F))
        del place
        h = mix((np.add.reduceat(h, start) if len(start) else h) + (end - start).astype(U64))
        keep = ~(empty[doc] & (code[start] == _BLANK)) if not numbered else np.ones(len(start), bool)
        start, end, doc, h = start[keep], end[keep], doc[keep], h[keep]
        ordinal = np.arange(len(start)) - np.searchsorted(doc, doc) + numbered
        _, one, which = np.unique(h, return_index=True, return_inverse=True)
        seeds = mix(keys[doc] ^ mix(ordinal.astype(U64) + U64(seed * int(_B1) & (1 << 64) - 1)))
        pos = (end - start).astype(np.int32)
        del h, ordinal
        # distinct chunks are filtered part by part, so the tables of a part stay in the cache
        by_chunk = np.argsort(which, kind="stable")
        at_chunk = np.searchsorted(which[by_chunk], np.arange(len(one) + 1))
        width = end[one] - start[one]
        upto = np.concatenate([[0], np.cumsum(width)])
        got_chunk, got_id, got_step = [], [], []
        lo = 0
        while lo < len(one):
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PART_POSITIONS, "right")) - 1)
            live = by_chunk[at_chunk[lo] : at_chunk[hi]]
            if width[lo] > PART_POSITIONS:  # a chunk on its own: its tables are held window by window
                tables = self._long(code[start[one[lo]] : end[one[lo]]])
                for chunk in live.tolist():
                    piece = self._drawn(code[start[chunk] : end[chunk]], tables, seeds[chunk])
                    got_chunk.append(np.full(len(piece), chunk))
                    got_id.append(piece)
                    got_step.append(np.arange(len(piece), dtype=np.int32))
                lo = hi
                continue
            cum, ids = self._filter(code, start[one[lo:hi]], end[one[lo:hi]])
            base = upto[which[live]] - upto[lo]
            step = 0
            while len(live):
                at = base + pos[live] - 1
                k = np.minimum((cum[at] <= _uniform(seeds[live], step)[:, None]).sum(1), cum.shape[1] - 1)
                piece = ids[at, k]
                raw = piece < 0
                piece[raw] = -1 - (code[start[live[raw]] + pos[live[raw]] - 1] % 0x110000).astype(np.int32)
                got_chunk.append(live)
                got_id.append(piece)
                got_step.append(np.full(len(live), step, np.int32))
                pos[live] -= (k + 1).astype(np.int32)
                more = pos[live] > 0
                live, base = live[more], base[more]
                step += 1
            lo = hi
        if not got_chunk:
            return np.zeros(0, np.int32), np.zeros(texts, np.int64)
        chunk, piece, back = np.concatenate(got_chunk), np.concatenate(got_id), np.concatenate(got_step)
        del got_chunk, got_id, got_step
        n = np.bincount(chunk, minlength=len(start))
        ends = np.cumsum(n)
        out = np.empty(len(piece), np.int32)
        out[ends[chunk] - 1 - back] = piece
        per_doc = np.bincount(doc, weights=n, minlength=texts).astype(np.int64)
        where = np.flatnonzero(out < 0)
        if len(where):
            spelled = [self.byte_id[np.frombuffer(chr(-1 - c).encode("utf-8", "surrogatepass"), np.uint8)] for c in out[where].tolist()]
            more = np.array([len(s) for s in spelled])
            repeat = np.ones(len(out), np.int64)
            repeat[where] = more
            owner = np.repeat(np.arange(texts), per_doc)
            wide = np.repeat(out, repeat)
            first = np.cumsum(repeat)[where] - more
            for j in range(4):
                has = more > j
                wide[first[has] + j] = [s[j] for s in spelled if len(s) > j]
            per_doc = np.bincount(np.repeat(owner, repeat), minlength=texts)
            out = wide
        return out, per_doc

    def _edges(self, code: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights and ids of the edges that end at positions lo to hi of one chunk; column k: k + 1 characters long."""
        low = max(0, lo - self.most + 1)
        text = code[low:hi].astype(U64)
        weight, ids = np.zeros((hi - lo, self.most)), np.full((hi - lo, self.most), -1, np.int32)
        h = np.zeros(len(text), U64)
        for k in range(1, min(self.most, len(text)) + 1):
            begin = np.arange(max(0, lo - low - k + 1), len(text) - k + 1)  # those whose edge ends in the window
            h[: len(text) - k + 1] = h[: len(text) - k + 1] * _B1 + text[k - 1 :] + U64(1)
            found, w = self._lookup(mix(h[begin] + U64(k * 0x632BE59BD9B4E019 & (1 << 64) - 1)))
            at = begin + k - 1 - (lo - low)
            weight[at, k - 1], ids[at, k - 1] = w, found
        lone = np.flatnonzero(ids[:, 0] < 0)
        weight[lone, 0] = self._lone(text[lone + lo - low])
        return weight, ids

    def _lone(self, letters: np.ndarray) -> np.ndarray:
        """Weight of characters that the vocabulary lacks: a byte piece for each of their bytes."""
        letters = np.where(letters >= U64(0x110000), letters - U64(0x110000), letters)
        return self.byte_weight ** (1 + (letters > U64(0x7F)) + (letters > U64(0x7FF)) + (letters > U64(0xFFFF))).astype(float)

    def _long(self, code: np.ndarray) -> np.ndarray:
        """Forward probabilities of a long chunk's positions: log alpha, 8 bytes each; edges are made window by window."""
        n, most = len(code), self.most
        log = np.empty(n)
        near, scale = np.zeros(WINDOW + most), 0.0
        near[most - 1] = 1.0  # what stands before the window: the last ``most`` alphas, relative to exp(scale)
        for lo in range(0, n, WINDOW):
            weight = np.ascontiguousarray(self._edges(code, lo, min(n, lo + WINDOW))[0][:, ::-1])
            mark = np.zeros(len(weight))
            for i, row in enumerate(weight):
                total = near[i : i + most] @ row
                if total < 1e-150:
                    near[i : i + most] /= total
                    scale += math.log(total)
                    mark[max(0, i - most) : i] = scale
                    total = 1.0
                near[i + most] = total
                mark[i] = scale
            log[lo : lo + len(weight)] = np.log(near[most : most + len(weight)]) + mark
            near[:most] = near[len(weight) : len(weight) + most]
        return log

    def _drawn(self, code: np.ndarray, log: np.ndarray, seed: np.uint64) -> np.ndarray:
        """A long chunk's pieces from the last to the first (below zero: a character by its bytes), sampled from ``_long``."""
        pos, step, low, out, most = len(code), 0, len(code), [], self.most
        seeds = np.full(WINDOW, seed)
        while pos:
            if pos <= low:
                high, low = pos, max(0, pos - WINDOW)
                weight, ids = self._edges(code, low, high)
                # probability of each edge that ends at a position: alpha where it begins, times its weight
                back = np.arange(low, high)[:, None] - np.arange(most)[None, :] - 1
                before = np.where(back >= 0, log[np.maximum(back, 0)], 0.0)
                with np.errstate(divide="ignore"):
                    cum = np.cumsum(np.exp(before + np.log(weight) - log[low:high, None]), 1)
                cum /= cum[:, -1:]
                u, begun = _uniform(seeds, np.arange(step, step + WINDOW)), step
            k = min(int(np.searchsorted(cum[pos - 1 - low], u[step - begun], "right")), most - 1)
            piece = int(ids[pos - 1 - low, k])
            out.append(piece if piece >= 0 else -1 - int(code[pos - 1]) % 0x110000)
            pos -= k + 1
            step += 1
        return np.array(out, np.int32)

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[str]:
        """The texts that ids[off[i]:off[i + 1]] spell."""
        ids = ids.astype(np.int64)
        plain = not self.is_byte[ids].any()
        n = self.piece_off[ids + 1] - self.piece_off[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        spot = np.repeat(self.piece_off[ids] - ends[:-1], n) + np.arange(ends[-1])
        code = self.piece_code[spot]
        if plain:
            whole = code.tobytes().decode("utf-32-le", "surrogatepass")
            return [whole[a + 1 : b] for a, b in zip(ends[off[:-1]].tolist(), ends[off[1:]].tolist())]
        # byte pieces: runs of them are UTF-8; place each run's characters where it began
        byte = self.is_byte[ids]
        raw = np.zeros(len(ids) + 2, bool)
        raw[1:-1] = byte
        out: list[str] = []
        whole = code.tobytes().decode("utf-32-le", "surrogatepass")
        run_start, run_end = np.flatnonzero(raw[1:] & ~raw[:-1]), np.flatnonzero(raw[:-1] & ~raw[1:])
        values = self.byte_of[ids]
        at = 0
        for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
            parts, here = [], int(ends[a])
            at = int(np.searchsorted(run_start, a)) if at >= len(run_start) or run_start[at] < a else at
            i = at
            carried = run_end[i - 1] > a if i else False
            if carried:  # a run of bytes that began in the text before goes on here
                parts.append(values[a : min(run_end[i - 1], b)].tobytes().decode("utf-8", "surrogatepass"))
            while i < len(run_start) and run_start[i] < b:
                s, e = int(run_start[i]), min(int(run_end[i]), b)
                parts += [whole[here : int(ends[s])], values[s:e].tobytes().decode("utf-8", "surrogatepass")]
                here = int(ends[s])
                i += 1
            at = i
            parts.append(whole[here : int(ends[b])])
            out.append("".join(parts)[1:])
        return out


def _uniform(seeds: np.ndarray, step: int | np.ndarray) -> np.ndarray:
    """Uniforms in [0, 1) of (seed, step)."""
    turn = np.asarray(step).astype(U64) * U64(0xD1B54A32D192ED03)
    return (mix(seeds + turn) >> U64(11)).astype(np.float64) * 2.0**-53


@lru_cache(maxsize=2)
def _lattice(names: tuple[str, ...], kinds: tuple[int, ...], theta: float) -> Lattice:
    return Lattice(list(names), list(kinds), theta)


def _keys(col: pa.Array) -> np.ndarray:
    """64 bits of each row key; a null key counts as the empty text."""
    if pa.types.is_integer(col.type) and not col.null_count:
        return mix(col.cast(pa.int64()).to_numpy().view(U64))
    text = [("" if k is None else str(k)).encode() for k in col.to_pylist()]
    if pa.types.is_integer(col.type):
        return np.array([int(mix(np.array([int(t)], np.int64).view(U64))[0]) if t else 0 for t in text], U64)
    return np.frombuffer(b"".join(hashlib.blake2b(t, digest_size=8).digest() for t in text), U64)


def encoded(docs: DataFrame, model: str = MODEL, theta: float = THETA, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """docs with text replaced by ids array<int>; a null text has null ids, an empty one none. Other columns stay.

    A column named ids is kept as ids_input.
    """
    docs = aside(docs, "ids")
    shared = docs.sparkSession.sparkContext.broadcast(tuple(map(tuple, vocabulary(model))))  # bounded: the vocabulary
    others = [c for c in docs.columns if c != "text"]
    ordered = docs.select(*[F.col(f"`{c}`") for c in others], "text")
    schema = ordered.withColumn("ids", F.lit(None).cast("array<int>")).drop("text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(*shared.value, theta)
        for batch in pieces(batches, most=BATCH_BYTES):
            texts = batch.column(len(others)).to_pylist()
            ids, off = lattice.encode([t or "" for t in texts], _keys(batch.column(others.index(key))), seed)
            none = pa.array([t is None for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))
            if batch.column(len(others)).null_count:
                lists = pc.if_else(none, pa.scalar(None, lists.type), lists)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*others, "ids"])

    return ordered.mapInArrow(run, schema)


def decoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs with ids replaced by the text they spell (null ids: null). A column named text is kept as text_input."""
    docs = aside(docs, "text")
    shared = docs.sparkSession.sparkContext.broadcast(tuple(map(tuple, vocabulary(model))))
    others = [c for c in docs.columns if c != "ids"]
    ordered = docs.select(*[F.col(f"`{c}`") for c in others], F.col("ids").cast("array<int>"))
    schema = docs.select(*[F.col(f"`{c}`") for c in others]).withColumn("text", F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(*shared.value, THETA)
        for batch in batches:
            lists = batch.column(len(others))
            none = lists.is_null().to_pylist()
            flat = lists.fill_null([]) if any(none) else lists
            off = np.concatenate([[0], np.cumsum([len(x) if x is not None else 0 for x in flat.to_pylist()])]) if any(none) else flat.offsets.to_numpy().astype(np.int64)
            values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            texts = lattice.decode(values, off - off[0])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([None if x else t for x, t in zip(none, texts)], pa.string())], names=[*others, "text"])

    return ordered.mapInArrow(run, schema)


def round_trips(docs: DataFrame, model: str = MODEL, theta: float = THETA, seed: int = SEED) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of little-endian 32-bit ids), decoded_sha256, lossless: encoding and decoding in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(map(tuple, vocabulary(model))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(*shared.value, theta)
        for batch in pieces(batches, most=BATCH_BYTES):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, off = lattice.encode(texts, _keys(batch.column(0)), seed)
            back = lattice.decode(ids, off)
            small = ids.astype("<i4")
            rows = list(zip(off[:-1].tolist(), off[1:].tolist()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(off), pa.int64()),
                    pa.array([hashlib.sha256(small[a:b].tobytes()).hexdigest() for a, b in rows]),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back]),
                    pa.array([t == x for t, x in zip(back, texts)]),
                ],
                names=["doc_id", "n_pieces", "ids_sha256", "decoded_sha256", "lossless"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_pieces long, ids_sha256 string, decoded_sha256 string, lossless boolean")


def op10(docs: DataFrame) -> DataFrame:
    """The round trip of every whole text (null: empty)."""
    return round_trips(docs)
