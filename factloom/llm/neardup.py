"""Near-duplicate records with small edits: ProbMinHash, banding and verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.components import components
from factloom.llm.hashing import Powers, batches_of, code_points, mix, prefix_sums, span_hashes
from factloom.operators.skew import hot_join
from factloom.session import cut

_U = np.uint64
_BLANK = np.array([chr(c).isspace() for c in range(0x3001)] + [False])
_WORD = np.array([chr(c).isalnum() or c == 95 for c in range(128)] + [False])
#: Bits of a shingle's hash that stay beside the number of its text in a slice.
_BITS = 54
_SLICE = 1 << (63 - _BITS)
#: Arrivals that a round of signatures draws at least, and of one element at most.
_DRAWS, _AHEAD = 20_000, 32
#: Words of 64 bits in a sketch, one bit for each of the first registers.
_SKETCH = 4


def shingles(texts: list[str], size: int, kept: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys ``text << 54 | hash``, tokens of each text).

    A token is a maximal run of ASCII letters, digits and underscores, or any other single non-blank character.
    """
    points, bounds = code_points(texts)
    word = _WORD[np.minimum(points, 128)]
    blank = _BLANK[np.minimum(points, 0x3001)]
    first = np.zeros(len(points) + 1, bool)
    first[bounds[:-1]] = True
    first = first[:-1] if len(points) else first[:0]
    starts = ~blank
    starts[1:] &= ~(word[1:] & word[:-1]) | first[1:]
    start = np.flatnonzero(starts)
    stop = np.append(start[1:], len(points))
    # a word ends before the first character that is no word character
    ends_here = np.flatnonzero(np.concatenate((~word[1:] | ~word[:-1] | first[1:], [True]))) + 1 if len(points) else np.empty(0, np.int64)
    end = ends_here[np.searchsorted(ends_here, start, side="right")] if len(start) else stop
    text = np.searchsorted(bounds, start, side="right") - 1
    tokens = np.bincount(text, minlength=len(texts))
    value = span_hashes(prefix_sums(points.astype(_U) + _U(1), kept), start, end, kept)
    n = len(start) - size + 1
    if n <= 0:
        return np.empty(0, _U), tokens
    h = np.zeros(n, _U)
    for k in range(size):
        h = mix(h * _U(31) + value[k : k + n])
    whole = text[:n] == text[size - 1 :]
    return np.unique((text[:n][whole].astype(_U) << _U(_BITS)) | (h[whole] >> _U(64 - _BITS))), tokens


def prob_min_hash(keys: np.ndarray, weights: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """Signatures (n_texts x m): registers of two texts agree with the probability of their weighted Jaccard.

    keys: sorted, see shingles.  Every element is a Poisson process with its weight as rate, whose arrivals fall on
    random registers; a register keeps the element that arrives first.  Arrivals are drawn in rounds, an element's only
    until it is later than every register of its text (early termination); when few elements are left, a round draws
    several arrivals of each.
    """
    text = (keys >> _U(_BITS)).astype(np.int64)
    element = mix(keys << _U(64 - _BITS))
    times = np.full(n_texts * m, np.inf)
    won = np.zeros(n_texts * m, _U)
    clock, turn = np.zeros(len(keys)), 1
    while len(text):
        ahead = max(1, min(_AHEAD, _DRAWS // len(text)))
        draw = mix(element[:, None] + np.arange(turn, turn + ahead, dtype=_U) * _U(0xD1342543DE82EF95))
        # 40 bits of a draw give the time to the next arrival, the others its register
        time = -np.log(((draw >> _U(24)).astype(np.float64) + 0.5) * 2.0**-40) / weights[:, None]
        time[:, 0] += clock
        np.cumsum(time, axis=1, out=time)
        register = text[:, None] * m + ((draw & _U((1 << 24) - 1)) * _U(m) >> _U(24)).astype(np.int64)
        row, column = np.nonzero(time < times[register])
        flat, when = register[row, column], time[row, column]
        np.minimum.at(times, flat, when)
        best = times[flat] == when
        won[flat[best]] = element[row[best]]
        new = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        worst = times.reshape(n_texts, m)[text[new]].max(axis=1)
        stay = time[:, -1] <= np.repeat(worst, np.diff(np.append(new, len(text))))
        text, element, weights, clock, turn = text[stay], element[stay], weights[stay], time[stay, -1], turn + ahead
    return won.reshape(n_texts, m)


def _sketch(letter: str) -> list[str]:
    return [f"{letter}{j + 1}" for j in range(_SKETCH)]


def _signatures(rows: DataFrame, key: str, text: str, size: int, least: int, bands: int, width: int) -> DataFrame:
    """(id, n, k1, k2, s1 to s4, bands): the set's size and identity, a 256-bit sketch, and the band keys.

    All shingles weigh the same, so that registers agree with the probability of the overlap that decides.
    """
    m = max(64 * _SKETCH, bands * width)
    source = rows.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull() & F.col("id").isNotNull())
    kind = source.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Powers()
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                for b in batches_of(whole.slice(at, _SLICE), 1, 1_000_000):
                    keys, tokens = shingles(b.column(1).to_pylist(), size, kept)
                    text_of = (keys >> _U(_BITS)).astype(np.int64)
                    n = np.bincount(text_of, minlength=b.num_rows)
                    keep = np.flatnonzero((tokens >= least) & (n > 0))
                    if not len(keep):
                        continue
                    dense = np.full(b.num_rows, -1)
                    dense[keep] = np.arange(len(keep))
                    inside = dense[text_of] >= 0
                    low = keys[inside] & _U((1 << _BITS) - 1)
                    text_of = dense[text_of[inside]]
                    keys = (text_of.astype(_U) << _U(_BITS)) | low
                    cuts = np.flatnonzero(np.concatenate(([True], text_of[1:] != text_of[:-1])))
                    k1, k2 = np.add.reduceat(mix(low), cuts), np.add.reduceat(mix(low + _U(0x5851F42D4C957F2D)), cuts)
                    sig = prob_min_hash(keys, np.ones(len(keys)), len(keep), m)
                    band = np.zeros((len(keep), bands), _U)
                    for j in range(width):
                        band = mix(band * _U(31) + sig[:, j : bands * width : width])
                    band = mix(band + np.arange(bands, dtype=_U))
                    bits = (mix(sig[:, : 64 * _SKETCH]) & _U(1)).reshape(len(keep), _SKETCH, 64) << np.arange(64, dtype=_U)
                    sketch = np.bitwise_or.reduce(bits, axis=2)
                    long = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(keep)), pa.array(n[keep].astype(np.int32)), long(k1), long(k2), *(long(sketch[:, j]) for j in range(_SKETCH)),
                         pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, bands, dtype=np.int32)), long(band.ravel()))],
                        ["id", "n", "k1", "k2", *_sketch("s"), "bands"],
                    )

    return source.mapInArrow(sign, f"id {kind}, n int, k1 bigint, k2 bigint, {', '.join(f'{c} bigint' for c in _sketch('s'))}, bands array<bigint>")


def _meet(rows: DataFrame, key: str, cell: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join of rows that share key (column c: how many): groups larger than cell are cut into a
    grid of cells, so that no task joins more than cell by cell rows of one group."""
    parts = F.ceil(F.col("c") / cell).cast("int")
    mine = F.pmod(F.xxhash64("id"), parts).cast("int")
    every = F.explode(F.sequence(F.lit(0), parts - 1))
    left = rows.withColumn("x", mine).withColumn("y", every)
    right = rows.withColumn("y", mine).withColumn("x", every)
    return left.withColumnRenamed("id", "a"), right.withColumnRenamed("id", "b")


def _sets(keys: np.ndarray, n_texts: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sizes) of the sets of texts ``which`` in a row, numbered by their places there; keys: see shingles."""
    bounds = np.searchsorted(keys >> _U(_BITS), np.arange(n_texts + 1, dtype=_U))
    sizes = np.diff(bounds)[which]
    place = np.repeat(np.arange(len(which)), sizes)
    at = np.arange(len(place)) + np.repeat(bounds[which] - (np.cumsum(sizes) - sizes), sizes)
    return (place.astype(_U) << _U(_BITS)) | (keys[at] & _U((1 << _BITS) - 1)), sizes


def _verified(pairs: DataFrame, rows: DataFrame, key: str, text: str, size: int, threshold: float) -> DataFrame:
    """Pairs (a, b) whose shingle sets overlap by threshold, with their similarity, counted from the whole texts."""
    bodies = rows.select(F.col(key).alias("id"), F.col(text).alias("text")).dropDuplicates(["id"])
    sides = pairs.join(bodies.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(
        bodies.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b"
    )
    kind = pairs.schema["a"].dataType.simpleString()
    least = round(threshold * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Powers()
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                for b in batches_of(whole.slice(at, _SLICE), 2, 1_000_000):
                    # a text is in many pairs, but is cut into shingles once
                    at = pa.concat_arrays([b.column(0), b.column(1)]).dictionary_encode().indices.to_numpy()
                    once = pa.array(np.unique(at, return_index=True)[1])
                    keys, _ = shingles(pa.concat_arrays([b.column(2), b.column(3)]).take(once).to_pylist(), size, kept)
                    x, n_x = _sets(keys, len(once), at[: b.num_rows])
                    y, n_y = _sets(keys, len(once), at[b.num_rows :])
                    both = np.bincount((np.intersect1d(x, y, assume_unique=True) >> _U(_BITS)).astype(np.int64), minlength=b.num_rows)
                    union = n_x + n_y - both
                    good = np.flatnonzero((union > 0) & (both * 1_000_000 >= least * union))
                    rows_at = pa.array(good)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(rows_at), b.column(1).take(rows_at), pa.array(both[good] / union[good])], ["a", "b", "similarity"])

    return sides.select("a", "b", "ta", "tb").mapInArrow(count, f"a {kind}, b {kind}, similarity double")


def near_links(
    rows: DataFrame, key: str, text: str, size: int = 3, threshold: float = 0.6, least: int = 40, bands: int = 76, width: int = 4,
    differ: int = 85, cell: int = 4096, least_hot: int = 20_000,
) -> tuple[DataFrame, DataFrame]:
    """(members, links) of near-duplicate texts.

    members: id, rep, copies - each row with at least ``least`` tokens, the least id with the same shingle set and
    how many have it.  links: a < b, similarity - the pairs of representatives whose sets of ``size`` consecutive
    tokens overlap by ``threshold`` or more.  Other texts (null and empty ones too) take no part.

    Candidates are pairs that agree in a whole band of ``width`` ProbMinHash registers and whose 256-bit sketches of
    the first registers differ in at most ``differ`` bits (two texts of similarity s differ in 128 (1 - s) on
    average).  A pair at similarity 0.6 shares no band with probability 3e-5 and fails the sketch test with 5e-8,
    whatever the tokens are that differ.  Buckets of any size are joined in full, large ones in a grid of cells; equal sets are one row there.
    Each candidate is then counted exactly.
    """
    signed = cut(_signatures(rows, key, text, size, least, bands, width))
    once = signed.select("id", "k1", "k2", "n").dropDuplicates(["id"])
    groups = once.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    rows_signed = signed.count()
    same = ["k1", "k2", "n"]
    members = hot_join(once, groups, same, counts=groups.select(*same, F.col("copies").alias("c")), total=rows_signed, least_hot=least_hot)
    members = cut(members.select("id", "rep", "copies"))
    reps = signed.join(groups.select(F.col("rep").alias("id")), "id", "left_semi")
    banded = reps.select("id", F.explode("bands").alias("key"))
    counts = cut(banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))
    met = cut(hot_join(banded, counts, ["key"], counts=counts, total=rows_signed * bands, least_hot=least_hot).join(reps.select("id", *_sketch("s")), "id"))
    left, right = _meet(met, "key", cell)
    right = right.select("key", "x", "y", "b", *(F.col(s).alias(t) for s, t in zip(_sketch("s"), _sketch("t"), strict=True)))
    apart = [F.bit_count(F.col(s).bitwiseXOR(F.col(t))) for s, t in zip(_sketch("s"), _sketch("t"), strict=True)]
    close = sum(apart[1:], apart[0]) <= differ
    pairs = cut(left.join(right, ["key", "x", "y"]).where(F.col("a") < F.col("b")).where(close).select("a", "b").distinct())
    return members, cut(_verified(pairs, rows, key, text, size, threshold))


def near_pairs(rows: DataFrame, key: str, text: str, **settings) -> DataFrame:
    """(a, b), a < b: all pairs of rows whose texts are near duplicates, copies included (see near_links)."""
    members, links = near_links(rows, key, text, **settings)
    copies = members.where("copies > 1").withColumn("c", F.col("copies"))
    left, right = _meet(copies.drop("copies"), "rep", settings.get("cell", 4096))
    same = left.join(right, ["rep", "x", "y"]).where("a < b").select("a", "b")
    of = lambda c: members.select(F.col("rep").alias(c), F.col("id").alias(f"{c}_id"))
    across = links.join(of("a"), "a").join(of("b"), "b")
    return same.unionByName(across.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")))


def near_groups(rows: DataFrame, key: str, text: str, **settings) -> DataFrame:
    """(id, group_id, n_links): each row in a group of near duplicates, the group's least id, and to how many other
    rows it is linked (copies counted)."""
    members, links = near_links(rows, key, text, **settings)
    hot = {"least_hot": settings.get("least_hot", 20_000)}
    weights = members.groupBy("rep").agg(F.max("copies").alias("copies"))
    each = links.select(F.col("a").alias("rep"), F.col("b").alias("o")).unionByName(links.select(F.col("b").alias("rep"), F.col("a").alias("o")))
    near = hot_join(each, weights.select(F.col("rep").alias("o"), "copies"), ["o"], **hot).groupBy("rep").agg(F.sum("copies").alias("near"))
    linked = near.join(components(links, "a", "b", **hot).withColumnRenamed("node", "rep"), "rep")  # both have each node of a link once
    # a group of copies may hold a third of all rows
    full = hot_join(members, linked, ["rep"], "left", counts=weights.select("rep", F.col("copies").alias("c")), **hot)
    return full.select("id", F.coalesce("root", "rep").alias("group_id"), (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links")).where("n_links > 0")
