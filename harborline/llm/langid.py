"""Language ID with bit-sliced Bloom filters over character n-grams.

Each learned language owns one bit of a mask, of as many 64-bit words as that takes. A filter slot holds the OR of the masks of
the n-grams that hash to it, so one probe of k slots (AND) answers for all languages of a word at once. A text's votes per language are popcounts over its n-grams; the
expected votes from false positives, known from each language's fill, are taken off before the largest one decides.

Every n-gram of a language is in its filter, however rare. The number of slots follows from the fullest language, so that a
probe of a slot hits by chance no more often than ``FILL`` of the time; from ``MOST_SLOTS`` on, which bounds what is broadcast, the
fill rises instead, and with it what is taken off.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, aside, crc_fold, dropped, mix, pieces, written

PROBES, WORD = 3, 64
#: The share of slots that the fullest language may set, and the most slots (8 bytes each for every 64 languages, one up to 8).
FILL, MOST_SLOTS = 0.25, 1 << 26
#: Characters of a text looked at together; a longer text goes slice by slice, with the last symbols of one put before the next.
SLICE = 1 << 18


def _ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the 2- to 4-grams of lower-cased letters with one blank between words; their text numbers; has-a-letter per text."""
    low = [(t or "").lower() for t in texts]
    joined = " " + "  ".join(low) + " "
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _letters(int(code.max()) + 1)
    letter = table[code]
    lengths = np.fromiter(map(len, low), np.int64, len(low)) + 2
    owner_ends = np.cumsum(lengths)
    kept = letter | np.concatenate([[True], letter[:-1]])  # runs of other characters shrink to one blank
    kept[owner_ends - lengths] = True  # a text begins with one, whatever stands before it in the batch
    ended = np.flatnonzero(kept)
    code, owner = np.where(letter[ended], code[ended], 32).astype(U64), np.searchsorted(owner_ends, ended, "right")
    grams, starts = _hashes(code, owner)
    has = np.zeros(len(low), bool)
    has[owner[code != 32]] = True
    return grams, owner[starts], has


def _hashes(code: np.ndarray, owner: np.ndarray | None = None, old: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the 2- to 4-grams of symbols that lie in one text and reach beyond the first ``old`` symbols."""
    out, at = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for n in (2, 3, 4):
        if len(code) < n:
            continue
        h = np.full(len(code) - n + 1, n, U64)
        for i in range(n):
            h = h * U64(0x9E3779B97F4A7C15) + code[i : len(code) - n + 1 + i] * U64(0xC2B2AE3D27D4EB4F)
        same = (code[: len(h)] != 32) | (code[n - 1 :] != 32) | (n > 2)
        if owner is not None:
            same &= owner[: len(h)] == owner[n - 1 :]
        same[: max(0, old - n + 1)] = False
        out.append(mix(h[same]))
        at.append(np.flatnonzero(same))
    return np.concatenate(out), np.concatenate(at)


def _long(text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What ``_ngrams`` gives for one text, slice by slice: the n-grams of the slices are those of the whole text."""
    low = " " + text.lower() + " "
    last, seam = True, np.zeros(0, U64)  # whether the character before was a letter; the last symbols before the slice
    for j in range(0, len(low), SLICE):
        code = np.frombuffer(low[j : j + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters(int(code.max()) + 1)[code]
        ended = np.flatnonzero(letter | np.concatenate([[last], letter[:-1]]))
        new = np.where(letter[ended], code[ended], 32).astype(U64)
        both = np.concatenate([seam, new])
        grams, _ = _hashes(both, None, len(seam))
        yield grams, np.zeros(len(grams), np.int64), np.array([bool(letter.any())])
        last, seam = bool(letter[-1]), both[-3:]


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(number of the first text, number of texts, their n-grams): texts together, but a long one slice by slice."""
    at = 0
    for i, t in enumerate(texts):
        if t and len(t) > SLICE:
            if at < i:
                yield at, i - at, _ngrams(texts[at:i])
            for found in _long(t):
                yield i, 1, found
            at = i + 1
    if at < len(texts):
        yield at, len(texts) - at, _ngrams(texts[at:])


_TABLE = np.zeros(0, bool)


def _letters(n: int) -> np.ndarray:
    global _TABLE
    if len(_TABLE) < n:
        size = 0x3000 if n <= 0x3000 else 0x110000
        _TABLE = np.fromiter((chr(c).isalpha() for c in range(size)), bool, size)
    return _TABLE


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all texts with a non-null lang; partial counts are made per batch before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                gram = np.concatenate([p[0] for p in parts])
                n = np.concatenate([p[1] for p in parts])
                order = np.argsort(gram, kind="stable")
                gram, n = gram[order], n[order]
                first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(first)), pa.array(gram[first].view(np.int64)), pa.array(np.add.reduceat(n, first))], names=["lang", "gram", "n"])
            held.clear()

        for batch in pieces(batches):
            langs, texts = batch.column(0), batch.column(1)
            for lang in langs.unique().to_pylist():
                mine = texts.filter(pc.equal(langs, lang)).to_pylist()
                for _, _, (found, _, _) in _parts(mine):
                    gram, n = np.unique(found, return_counts=True)
                    if len(gram):
                        held.setdefault(lang, []).append((gram, n))
                        size += len(gram)
            if size > 1_500_000:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    part = docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    return part.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _slots(members: int, probes: int, fill: float = FILL) -> int:
    """The least power of two of slots of which ``members`` n-grams with ``probes`` each set at most ``fill``."""
    return min(MOST_SLOTS, 1 << max(10, math.ceil(math.log2(max(1, members) * probes / -math.log(1 - fill)))))


def fit(docs: DataFrame, probes: int = PROBES) -> dict:
    """Learn the filters from docs(text, lang). What reaches the driver is a mask of a bit for each language for every slot,
    of which there are ``MOST_SLOTS`` at most, and a row of each language."""
    spark = docs.sparkSession
    member = written(ngram_counts(docs).select("lang", "gram"), "members")
    members = {r[0]: r[1] for r in member.groupBy("lang").count().collect()}
    langs = sorted(members)
    if not langs:
        dropped(member)
        return {"langs": [], "mask": np.zeros((1, 1 << 10), np.uint8), "probes": probes}
    bits = [(lang, i // WORD, 1 << i % WORD if i % WORD < 63 else -(1 << 63)) for i, lang in enumerate(langs)]
    member_bits = member.join(F.broadcast(spark.createDataFrame(bits, "lang string, word int, bit long")), "lang")  # a row of each language
    most = max(members.values())
    slots = _slots(most, probes)
    masks = member_bits.select("word", "bit", F.explode(F.array(*[_slot_of(F.col("gram"), i, slots) for i in range(probes)])).alias("slot"))
    rows = masks.groupBy("word", "slot").agg(F.bit_or("bit").alias("mask")).toPandas()
    mask = np.zeros((-(-len(langs) // WORD), slots), np.uint64)
    mask[rows["word"].to_numpy(), rows["slot"].to_numpy()] = rows["mask"].to_numpy().astype(np.int64).view(np.uint64)
    dropped(member)
    kind = np.uint8 if len(langs) <= 8 else np.uint16 if len(langs) <= 16 else np.uint32 if len(langs) <= 32 else np.uint64
    return {"langs": langs, "mask": mask.astype(kind), "probes": probes}


def _slot_of(gram: Column, probe: int, slots: int) -> Column:
    """The slot of one probe: the n-gram's hash, turned by 21 bits a probe."""
    turned = gram if not probe else F.shiftrightunsigned(gram, 21 * probe).bitwiseOR(F.shiftleft(gram, 64 - 21 * probe))
    return turned.bitwiseAND(F.lit(slots - 1))


def _probe(gram: np.ndarray, probe: int, slots: int) -> np.ndarray:
    """``_slot_of`` on numpy."""
    turned = gram if not probe else gram >> U64(21 * probe) | gram << U64(64 - 21 * probe)
    return (turned & U64(slots - 1)).astype(np.int64)


def predict(docs: DataFrame, model: dict, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs plus the predicted language and its score, from the text alone. Nulls and texts without letters: ``und`` and 0.0.

    Extra columns stay, whatever their names; one that has the name of a new column is kept as ``<name>_input``. Ties go to
    the first language by name.
    """
    docs = aside(docs, *names)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: see fit
    schema = docs.select("*", F.lit("").alias(names[0]), F.lit(0.0).alias(names[1])).schema

    def votes_of(texts: list[str | None], m: dict, bit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: n-grams that each language has, n-grams, has a letter."""
        mask = m["mask"]
        votes, n, has = np.zeros((len(texts), len(m["langs"]))), np.zeros(len(texts)), np.zeros(len(texts), bool)
        for at, many, (gram, who, letters) in _parts(texts):
            hit = np.full((len(mask), len(gram)), np.iinfo(mask.dtype).max, mask.dtype)
            for i in range(m["probes"]):
                slot = _probe(gram, i, mask.shape[1])
                for word, of in zip(hit, mask):
                    word &= of[slot]
            to = slice(at, at + many)
            n[to] += np.bincount(who, minlength=many)
            has[to] |= letters
            for i in range(len(m["langs"])):
                votes[to, i] += np.bincount(who, weights=bit(hit, i), minlength=many)
        return votes, n, has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        langs, mask, k = m["langs"], m["mask"], m["probes"]
        bit = lambda words, i: (words[i // WORD] >> mask.dtype.type(i % WORD)) & mask.dtype.type(1)
        fill = np.array([float(bit(mask, i).mean()) ** k for i in range(len(langs))])
        for batch in pieces(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            votes, n, has = votes_of(texts, m, bit)
            share = np.clip((votes / np.maximum(n, 1)[:, None] - fill) / np.maximum(1 - fill, 1e-9), 0, 1)
            ok = has & bool(langs)
            best = share.argmax(1) if langs else np.zeros(len(texts), int)
            score = np.where(ok, share.max(1), 0.0) if langs else np.zeros(len(texts))
            found = [langs[b] if o else "und" for b, o in zip(best.tolist(), ok.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def learn_from(docs: DataFrame) -> dict:
    """Filters from the documents whose crc32(doc_id as text) mod 4 is not 2."""
    return fit(docs.where(crc_fold("doc_id", 4) != 2))


def op5(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    out = predict(docs.select("doc_id", "text"), learn_from(docs))
    return out.select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
