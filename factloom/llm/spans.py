"""Long exact spans shared between records: super-k-mer partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.hashing import Powers, batches_of, code_points, mix, prefix_sums, span_hashes, window_minima
from factloom.operators.skew import hot_join
from factloom.session import cut

#: Random-looking 64-bit values of the code points, for two independent hashes.
_SALTS = (np.uint64(1), np.uint64(0x632BE59BD9B4E019))
_ALPHABETS = [mix(np.arange(1 << 16, dtype=np.uint64) + salt) for salt in _SALTS]


def _values(points: np.ndarray, which: int = 0) -> np.ndarray:
    """The value of each code point for one of the two hashes."""
    low = np.minimum(points, 0xFFFF)
    out = _ALPHABETS[which][low]
    far = points > 0xFFFF
    if far.any():
        out[far] = mix(points[far].astype(np.uint64) + _SALTS[which])
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _runs(docs: DataFrame, doc: str, text: str, k: int, m: int) -> DataFrame:
    """(minimiser, h, n, doc, start): each super-k-mer, n consecutive windows of k characters with one minimiser.

    h identifies its packed text: the hash of the n + k - 1 characters from start.
    """
    source = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where(F.char_length("text") >= k)
    kind = source.schema["doc"].dataType.simpleString()

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Powers()
        for whole in batches:
            for b in batches_of(whole, 1, 1_000_000):
                points, bounds = code_points(b.column(1).to_pylist())
                if len(points) < k:
                    continue
                sums = prefix_sums(_values(points), kept)
                _, down = kept.upto(len(sums))
                grams = mix((sums[m:] - sums[:-m]) * down[: len(sums) - m])
                low = window_minima(grams, k - m + 1)
                inside = np.ones(len(low), bool)
                for e in bounds[1:-1]:  # windows that would reach into the next text
                    inside[max(0, e - k + 1) : e] = False
                new = inside.copy()
                new[1:] &= (low[1:] != low[:-1]) | ~inside[:-1]
                starts = np.flatnonzero(new)
                last = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
                n = last - starts + 1
                at = np.searchsorted(bounds, starts, side="right") - 1
                h = span_hashes(sums, starts, starts + n + k - 1, kept)
                yield pa.RecordBatch.from_arrays(
                    [_signed(low[starts]), _signed(h), pa.array(n.astype(np.int32)), b.column(0).take(pa.array(at)), pa.array((starts - bounds[at]).astype(np.int32))],
                    ["minimiser", "h", "n", "doc", "start"],
                )

    return source.mapInArrow(cover, f"minimiser bigint, h bigint, n int, doc {kind}, start int")


class _Windows:
    """The windows of k characters of packed texts: window i is in text which[i], from offset[i] there."""

    def __init__(self, texts: list[str], n: np.ndarray, k: int, kept: Powers) -> None:
        self.points, bounds = code_points(texts)
        self.which = np.repeat(np.arange(len(texts)), n)
        self.offset = np.arange(len(self.which)) - np.repeat(np.cumsum(n) - n, n)
        self.starts, self.k, self.kept = bounds[self.which] + self.offset, k, kept

    def hashes(self, which: int, some: np.ndarray | None = None) -> np.ndarray:
        """One of the two hashes of all or of some windows."""
        starts = self.starts if some is None else self.starts[some]
        return span_hashes(prefix_sums(_values(self.points, which), self.kept), starts, starts + self.k, self.kept)


def _several(hashes: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether windows equal in all hashes stand in more than one record (lo to hi: ranks of a window's records)."""
    order = np.lexsort(hashes) if len(hashes) > 1 else np.argsort(hashes[0], kind="stable")
    new = np.concatenate([[True], np.any([h[order][1:] != h[order][:-1] for h in hashes], axis=0)])
    cuts = np.flatnonzero(new)
    least, most = np.minimum.reduceat(np.minimum(lo, hi)[order], cuts), np.maximum.reduceat(np.maximum(lo, hi)[order], cuts)
    flags = np.empty(len(order), bool)
    flags[order] = np.repeat(least != most, np.diff(np.append(cuts, len(order))))
    return flags


def _intervals(which: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive offsets: (index, first, last); sorted input."""
    if not len(which):
        return which, offset, offset
    new = np.concatenate(([True], (which[1:] != which[:-1]) | (offset[1:] != offset[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(which) - 1)
    return which[first], offset[first], offset[last]


def shared_spans(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = 400, m: int = 100, hot_windows: int = 2_000_000
) -> DataFrame:
    """(doc, shared): for each record the number of characters that lie in a span of at least k characters that
    stands character for character in a record with another doc; records without any are left out.

    Texts that are null or shorter than k share nothing; repetitions inside one record don't count; several
    rows of one doc count as one record only if they are equal.

    Consecutive windows of k characters with the same minimiser (least hash of an m-gram inside) form a
    super-k-mer.  First only its hash goes to the minimiser's bucket: a packed text that stands in two records is
    shared throughout, and a minimiser of one record only shares nothing.  For the rest one packed text of
    each kind travels to the bucket, where its windows are sorted and counted.  Equal texts so cost one row however
    often they stand.  A bucket with more than hot_windows windows is not gathered: its windows are counted
    by an aggregation over window hashes instead, with the same result.  Windows are equal if two independent 64-bit
    hashes agree, packed texts if their hash, length and minimiser do.
    """
    runs = cut(_runs(docs, doc, text, k, m))
    key = ["minimiser", "h", "n"]
    classes = runs.groupBy(*key).agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min(F.struct("doc", "start")).alias("rep"), F.count("*").alias("c"))
    buckets = runs.groupBy("minimiser").agg(F.min("doc").alias("b_lo"), F.max("doc").alias("b_hi")).where("b_lo < b_hi").select("minimiser")
    classes = cut(classes.join(buckets, "minimiser", "left_semi"))
    whole = classes.where("lo < hi").select(*key, F.lit(0).alias("a"), (F.col("n") - 1).alias("b"))
    # buckets in which some packed text is of one record only
    unsure = classes.groupBy("minimiser").agg(F.count(F.when(F.col("lo") == F.col("hi"), 1)).alias("single"), F.sum("n").alias("windows"))
    unsure = unsure.where("single > 0").select("minimiser", (F.col("windows") > hot_windows).alias("hot"))
    wanted = classes.join(unsure, "minimiser").groupBy(F.col("rep.doc").alias("doc")).agg(
        F.collect_list(F.struct("minimiser", "h", "n", "lo", "hi", F.col("rep.start").alias("start"), "hot")).alias("ks")
    )
    texts = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where(F.char_length("text") >= k).dropDuplicates(["doc"])
    packed = texts.join(wanted, "doc").select("text", F.explode("ks").alias("s")).select(
        *(F.col(f"s.{c}").alias(c) for c in (*key, "lo", "hi", "hot")), F.substring("text", F.col("s.start") + 1, F.col("s.n") + (k - 1)).alias("packed")
    )
    kinds = {f.name: f.dataType.simpleString() for f in packed.schema.fields}

    def sort_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Powers()

        def counted(t: pa.Table) -> Iterator[pa.RecordBatch]:
            t = t.combine_chunks()
            n = t["n"].to_numpy().astype(np.int64)
            windows = _Windows(t["packed"].to_pylist(), n, k, kept)
            # ranks of the record keys, so that any type can be compared
            names = pa.chunked_array([*t["lo"].chunks, *t["hi"].chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
            lo, hi = names[: len(t)][windows.which], names[len(t) :][windows.which]
            first = windows.hashes(0)
            some = np.flatnonzero(_several([first], lo, hi))
            if len(some):  # equal by a second hash too
                some = some[_several([first[some], windows.hashes(1, some)], lo[some], hi[some])]
            some = some[(t["lo"].to_numpy() == t["hi"].to_numpy())[windows.which[some]]]
            index, a, b = _intervals(windows.which[some], windows.offset[some])
            rows = t.select(key).take(pa.array(index)).combine_chunks()
            yield from rows.append_column("a", pa.array(a.astype(np.int32))).append_column("b", pa.array(b.astype(np.int32))).to_batches()

        held, held_windows = [], 0
        for b in batches:
            held.append(b)
            held_windows += int(b.column(2).to_numpy().sum())
            if held_windows < hot_windows:
                continue
            t = pa.Table.from_batches(held)
            last = t["minimiser"][-1].as_py()
            minimisers = t["minimiser"].to_numpy()
            end = int(np.flatnonzero(minimisers == last)[0])  # the last bucket may go on
            if end:
                yield from counted(t.slice(0, end))
            held = t.slice(end).to_batches()
            held_windows = int(t["n"].to_numpy()[end:].sum())
        if held:
            yield from counted(pa.Table.from_batches(held))

    spread = packed.where("not hot").select(*key, "lo", "hi", "packed").repartition("minimiser").sortWithinPartitions("minimiser")
    parts = spread.mapInArrow(sort_windows, "minimiser bigint, h bigint, n int, a int, b int")
    if not unsure.where("hot").isEmpty():
        def explode_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = Powers()
            for whole_batch in batches:
                for b in batches_of(whole_batch, 5, 500_000):
                    windows = _Windows(b.column(5).to_pylist(), b.column(2).to_numpy().astype(np.int64), k, kept)
                    at = pa.array(windows.which)
                    yield pa.RecordBatch.from_arrays(
                        [*(b.column(i).take(at) for i in range(5)), _signed(windows.hashes(0)), _signed(windows.hashes(1)), pa.array(windows.offset.astype(np.int32))],
                        [*key, "lo", "hi", "wh", "wi", "at"],
                    )

        each = packed.where("hot").select(*key, "lo", "hi", "packed").mapInArrow(
            explode_windows, f"minimiser bigint, h bigint, n int, lo {kinds['lo']}, hi {kinds['hi']}, wh bigint, wi bigint, at int"
        )
        same = ["minimiser", "wh", "wi"]
        both = each.groupBy(*same).agg(F.min("lo").alias("l"), F.max("hi").alias("u")).where("l < u").select(*same)
        order = W.partitionBy(*key).orderBy("at")
        found = each.where("lo = hi").join(both, same, "left_semi").withColumn("island", F.col("at") - F.row_number().over(order))
        parts = parts.unionByName(found.groupBy(*key, "island").agg(F.min("at").alias("a"), F.max("at").alias("b")).drop("island"))
    pieces = hot_join(runs, whole.unionByName(parts), key, counts=classes.select(*key, "c")).select("doc", (F.col("start") + F.col("a")).alias("s"), (F.col("start") + F.col("b") + k).alias("e")).distinct()
    before = F.max("e").over(W.partitionBy("doc").orderBy("s", "e").rowsBetween(W.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce(before, F.lit(0))))
    return pieces.select("doc", fresh.alias("x")).groupBy("doc").agg(F.sum("x").alias("shared")).select(F.col("doc").alias(doc), "shared")
