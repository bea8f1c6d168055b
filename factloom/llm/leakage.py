"""Evaluation texts leaking into training text: spaced-seed hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.hashing import Powers, batches_of, code_points, mix, prefix_sums, span_hashes
from factloom.operators.skew import hot_join
from factloom.session import cut

_U = np.uint64
#: Masks over 13 words: positions marked 1 are hashed, the others may differ.  Of four blocks two are kept in each,
#: so that every placement of at most two different words leaves some mask whole.
MASKS = ("1111110000000", "1110001110000", "1110000001111", "0001111110000", "0001110001111", "0000001111111")
#: Enough where only equal runs of 13 words count.
RUN_MASKS = ("1101110110111",)
#: A word is a maximal run of letters and digits.
NO_WORD = r"[^\p{L}\p{N}]+"
#: The filter of the items' seeds: bits a seed, bits set by each, and its greatest and least size in bits (64 MB).
_BITS, _PROBES, _MOST, _LEAST = 64, 4, 29, 16
_CHUNK = 22


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the lower-cased words of all texts, offsets of the texts in them); null has none."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts.fill_null("")), NO_WORD)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.not_equal(flat, "")
    kept = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)))
    return flat.filter(full), kept[offsets]


def hashed_words(texts: pa.Array, kept: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, offsets of the texts in them)."""
    words, bounds = words_of(texts)
    if not len(words):
        return np.empty(0, _U), bounds
    coded = words.dictionary_encode()
    points, at = code_points(coded.dictionary.to_pylist())
    known = span_hashes(prefix_sums(points.astype(_U) + _U(1), kept), at[:-1], at[1:], kept)
    return known[coded.indices.to_numpy()], bounds


def seed_hashes(codes: np.ndarray, at: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash of the words at the mask's marked positions, for windows that begin at ``at``."""
    h = np.full(len(at), salt + 1, _U)
    for k, on in enumerate(mask):
        if on == "1":
            h = mix(h * _U(31) + codes[at + k])
    return h


def seed_starts(n_words: int, bounds: np.ndarray, width: int) -> np.ndarray:
    """Beginnings of windows of width words inside one text."""
    at = np.arange(max(0, n_words - width + 1))
    return at[at + width <= bounds[np.searchsorted(bounds, at, side="right")]]


def _seeds(codes: np.ndarray, bounds: np.ndarray, masks: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, beginning) of all seeds of all texts."""
    both = [(seed_hashes(codes, at, m, salt), at) for salt, m in enumerate(masks) for at in (seed_starts(len(codes), bounds, len(m)),)]
    return np.concatenate([h for h, _ in both]), np.concatenate([at for _, at in both])


def _probes(h: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Bits that a hash sets in a filter of ``size`` bits (a power of two)."""
    step = (h >> _U(32)) | _U(1)
    for i in range(_PROBES):
        yield (h + _U(i) * step) & _U(size - 1)


def _held(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places in h whose bits are all set."""
    at = np.arange(len(h))
    for i in range(_PROBES):
        x = next(p for k, p in enumerate(_probes(h[at], 8 * len(bits))) if k == i)
        at = at[(bits[x >> _U(3)] >> (x & _U(7)).astype(np.uint8)) & 1 == 1]
    return at


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """A bitmap of the seeds' hashes (column h), of at most 64 MB however many there are."""
    exponent = min(_MOST, max(_LEAST, int(np.ceil(np.log2(_BITS * max(1, seeds.count()))))))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy().view(_U)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(list(_probes(h, 1 << exponent))).view(np.int64))], ["bit"])

    def chunk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << min(_CHUNK, exponent), np.uint8)
        flags[rows["bit"].to_numpy() & ((1 << _CHUNK) - 1)] = 1
        return pd.DataFrame({"chunk": [key[0]], "flags": [np.packbits(flags, bitorder="little").tobytes()]})

    parts = seeds.select("h").mapInArrow(bits, "bit bigint").distinct().groupBy(F.shiftright("bit", _CHUNK).alias("chunk")).applyInPandas(chunk, "chunk bigint, flags binary")
    out = np.zeros((1 << exponent) // 8, np.uint8)
    for r in parts.collect():
        flags = np.frombuffer(r.flags, np.uint8)
        out[r.chunk * len(flags) : (r.chunk + 1) * len(flags)] = flags
    return out


def _lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _hashed(rows: DataFrame, masks: tuple[str, ...], bits: np.ndarray | None) -> DataFrame:
    """(row, id, words, h, at): the word hashes of each text and those of its seeds that the filter holds.

    rows: row, id, text.  With a filter, texts without such a seed fall away.
    """
    held = rows.sparkSession.sparkContext.broadcast(bits)
    kind = rows.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Powers()
        for whole in batches:
            for b in batches_of(whole, 2, 4_000_000):
                codes, bounds = hashed_words(b.column(2), kept)
                h, at = _seeds(codes, bounds, masks)
                if held.value is not None:
                    some = _held(h, held.value)
                    h, at = h[some], at[some]
                text = np.searchsorted(bounds, at, side="right") - 1
                order = np.argsort(text, kind="stable")
                h, at, text = h[order], at[order], text[order]
                n = np.bincount(text, minlength=b.num_rows)
                mine = np.flatnonzero(n)
                words = np.concatenate([codes[bounds[i] : bounds[i + 1]] for i in mine]) if len(mine) else codes[:0]
                take = pa.array(mine)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), _lists(words.view(np.int64), (bounds[1:] - bounds[:-1])[mine], pa.int64()),
                     _lists(h.view(np.int64), n[mine], pa.int64()), _lists(at - bounds[text], n[mine], pa.int32())],
                    ["row", "id", "words", "h", "at"],
                )

    return rows.select("row", "id", "text").mapInArrow(scan, f"row bigint, id {kind}, words array<bigint>, h array<bigint>, at array<int>")


def _verify(doc: np.ndarray, item: np.ndarray, shift: int, allowed: int) -> tuple[int, int, int]:
    """Over the diagonal item position = document position - shift: the longest exact run, and the words and
    substitutions of the longest overlap with at most ``allowed`` substitutions."""
    lo, hi = max(0, shift), min(len(doc), len(item) + shift)
    same = doc[lo:hi] == item[lo - shift : hi - shift]
    wrong = np.concatenate(([-1], np.flatnonzero(~same), [len(same)]))
    exact = int((wrong[1:] - wrong[:-1] - 1).max())
    k = min(allowed, len(wrong) - 2)
    spans = wrong[k + 1 :] - wrong[: len(wrong) - k - 1] - 1
    best = int(spans.argmax())
    return exact, int(spans[best]), k


def find_leaks(
    docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text",
    masks: tuple[str, ...] = MASKS, substitutions: int = 2, least_hot: int = 20_000,
) -> DataFrame:
    """(doc, item, exact_words, overlap_words, substitutions): every document and item that have an aligned stretch of
    as many words as the masks are long, or more, with at most ``substitutions`` different words.

    exact_words is the longest run of equal words and overlap_words the longest aligned stretch with at most
    ``substitutions`` different words, counted with them, each over all alignments that share a seed.  Every run of
    len(mask) or more equal words is found: all its seeds agree.  With the six default masks every stretch of 13 or
    more words with at most two substitutions is found too, wherever they fall.  Items shorter than a mask match
    nothing.  Null or empty texts have no words.  Rows with a null doc count, items with a null id don't; several rows
    of one doc or item count together; the pairs are distinct.  Words are compared by their 64-bit hashes.

    Seeds of the corpus are hashed once, in one scan, and joined with those of the items.  A bitmap of the items'
    seeds (64 MB at most, whatever the items) goes to the tasks beforehand, so that only documents with a seed in it
    leave the scan; where very many items fill it, more seeds go into the join, and the result stays the same.  Hits
    are verified along their diagonal.
    """
    if clash := {doc, item} & {"exact_words", "overlap_words", "substitutions"}:
        raise ValueError(f"reserved: {clash}")
    width = len(masks[0])
    number = F.monotonically_increasing_id()
    named = items.select(F.col(item).alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull()).distinct()
    known = cut(_hashed(named.withColumn("row", number), masks, None))
    pairs_of = lambda df: df.select("row", F.explode(F.arrays_zip("h", "at")).alias("s")).select("row", "s.h", "s.at")
    seeds = pairs_of(known).select(F.col("row").alias("i_row"), "h", F.col("at").alias("i_at"))
    source = docs.select(F.col(doc).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).withColumn("row", number)
    hits = cut(_hashed(source, masks, seed_filter(seeds)))
    met = pairs_of(hits).join(seeds, "h").groupBy("row", "i_row").agg(F.collect_set(F.col("at") - F.col("i_at")).alias("shifts"))
    met = hot_join(cut(met), known.select(F.col("row").alias("i_row"), F.col("id").alias("i_id"), F.col("words").alias("i_words")), ["i_row"], least_hot=least_hot)
    both = met.join(hits.select("row", "id", "words"), "row").select("id", "i_id", "words", "i_words", "shifts")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, y, shifts in zip(*(b.column(i) for i in (2, 3, 4)), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                found = [_verify(x, y, int(s), substitutions) for s in shifts.values.to_numpy()]
                overlap, k = max((o, -k) for _, o, k in found)
                out.append((max(e for e, _, _ in found), overlap, -k))
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int32()) for c in columns)], ["d", "i", "exact_words", "overlap_words", "substitutions"])

    kinds = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    found = both.mapInArrow(verify, f"d {kinds['id']}, i {kinds['i_id']}, exact_words int, overlap_words int, substitutions int")
    best = F.max(F.struct("overlap_words", (-F.col("substitutions")).alias("k")))
    return found.where(F.col("overlap_words") >= width).groupBy(F.col("d").alias(doc), F.col("i").alias(item)).agg(
        F.max("exact_words").alias("exact_words"), best["overlap_words"].alias("overlap_words"), (-best["k"]).alias("substitutions")
    )
