"""Several values packed in one field: dictionary-guided segmentation."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.skew import hot_join
from factloom.session import cut

#: A double-quoted text, in which a doubled quote stands for one.
_QUOTED = re.compile(r'"(?:[^"]|"")*"')
#: A number with or without a prefix, and a remark in parentheses after it.
_VALUE = re.compile(r"""(?<!\w)(?<!\d\.)(?:[A-Za-z]+#?|#)?(\d+)(?!\w|\.\d)('?\s*\([^()"]*\))?""")
_NUMBER = re.compile(r"\d+")
#: A number in groups of three digits, which may also be a list.
_GROUPED = r"(?<![\w.,])\d{1,3}(?:,\d{3})+(?![\w.,])"
_GROUP = re.compile(_GROUPED)
#: Values with the same prefix and nothing, or an underscore, between them.
_GLUED = re.compile(r"(?<!\w)([A-Za-z]+_?)\d+(?:_?\1\d+)*(?!\w|\.\d)")
#: What a piece is worth to the cover: a whole quoted text or remark, a value of the dictionary, another number,
#: a quoted text without number, and a quote that belongs to none.
_WHOLE, _KNOWN, _NUMERIC, _VOID, _ORPHAN = 1000.0, 4.0, 2.0, 0.5, -2000.0
_MOST = 2**63 - 1


def _automaton(known: set[int]) -> ahocorasick.Automaton | None:
    """Finds every spelling of the known values: their digits, plain or in groups of three."""
    automaton = ahocorasick.Automaton()
    for n in known:
        for spelled in {str(n), f"{n:,}"}:
            automaton.add_word(spelled, (len(spelled), n))
    if not len(automaton):
        return None
    automaton.make_automaton()
    return automaton


def _hits(text: str, automaton: ahocorasick.Automaton | None) -> dict[tuple[int, int], int]:
    """(start, end) -> value of the known whole values in the text: no digit goes on before or after them."""
    found = {}
    for last, (size, n) in automaton.iter(text) if automaton else ():
        start, end = last - size + 1, last + 1
        while text[start - 1 : start] == "0":
            start -= 1
        if not text[end : end + 1].isdigit() and not text[max(0, start - 1) : start].isdigit():
            found[start, end] = n
    return found


def _segment(text: str, hits: dict[tuple[int, int], int]) -> list[int]:
    """Ids in their order, by the best cover of the text with non-overlapping pieces.

    hits: the known whole values that the automaton found in the text.
    """
    pieces: list[tuple[int, int, float, int | None]] = []
    at = 0
    while m := _VALUE.search(text, at):
        worth = _KNOWN if m.span(1) in hits else _NUMERIC
        pieces.append((m.start(), m.end(), worth + _WHOLE * (m.group(2) is not None), int(m.group(1))))
        at = m.end(1)
    for start, end in hits:  # a known value keeps the delimiters inside it, if none of its parts is known too
        if (m := _GROUP.match(text, start)) and m.end() == end:
            pieces.append((start, end, _NUMERIC * (text.count(",", start, end) + 1) + 1, hits[start, end]))
    for m in _GLUED.finditer(text):  # values that nothing but the dictionary tells apart
        spans = [(n.start(), n.end()) for n in _NUMBER.finditer(text, m.start(), m.end())]
        if (len(spans) > 1 or "_" in m.group()) and all(s in hits for s in spans):
            pieces += [(s, e, _KNOWN, hits[s, e]) for s, e in spans]
    at = -1
    while (at := text.find('"', at + 1)) >= 0:
        pieces.append((at, at + 1, _ORPHAN, None))
        if m := _QUOTED.match(text, at):
            first = _NUMBER.search(text, at, m.end())
            pieces.append((at, m.end(), _WHOLE if first else _VOID, int(first.group()) if first else None))
    pieces.sort(key=lambda p: p[0])
    starts = [p[0] for p in pieces]
    best: list[tuple[float, int]] = [(0.0, -1)] * (len(pieces) + 1)  # from the right: worth, 1 if taken
    follow = [bisect_left(starts, p[1]) for p in pieces]
    for i in range(len(pieces) - 1, -1, -1):
        other = best[i + 1][0] if text[starts[i]] != '"' or (i + 1 < len(pieces) and starts[i + 1] == starts[i]) else float("-inf")
        taken = pieces[i][2] + best[follow[i]][0]
        best[i] = (taken, 1) if taken >= other else (other, 0)
    chosen, i = [], 0
    while i < len(pieces):
        if best[i][1] == 1:
            chosen.append(pieces[i][3])
            i = follow[i]
        else:
            i += 1
    return [n for n in chosen if n is not None and n <= _MOST]


def split_values(rows: DataFrame, keys: list[str], text: str, dictionary: DataFrame | None, known: str = "id", least_hot: int = 20_000) -> DataFrame:
    """(keys, pos, value): one row per number that a packed text names, pos from 1 in text order.

    dictionary: the known whole values (column ``known``).  It may be larger than memory: the numbers of each
    text are matched against it by a join, and only those that occur travel with the text; in the task they
    form an Aho-Corasick automaton for the batch.  Every text is covered from its hits, other numbers, remarks and
    quoted texts; the best cover counts.  A known value is worth more than another number, keeps delimiters inside
    it (``1,234`` is one value if 1234 is known, and neither 1 nor 234 is) and may be glued to others
    (``E12E13``, ``id_12``: values only if all numbers are known).  A double-quoted text is one value whatever it
    holds (its first number); a remark in parentheses belongs to the number before it.  Null, empty and mark-only
    texts give no row; repeated values keep their places; rows equal in keys and text count once.
    """
    if clash := {"_text", "_known"} & set(keys):
        raise ValueError(f"reserved: {clash}")
    base = rows.select(*keys, F.col(text).alias("_text")).where(F.col("_text").rlike(r"\d")).distinct()
    if dictionary is not None:
        words = dictionary.select(F.col(known).cast("bigint").alias("_n")).where(F.col("_n").isNotNull()).distinct()
        grouped = F.transform(F.regexp_extract_all("_text", F.lit(_GROUPED), 0), lambda x: F.replace(x, F.lit(","), F.lit("")))
        numbers = F.array_distinct(F.concat(F.regexp_extract_all("_text", F.lit(r"(\d+)"), 1), grouped))
        asked = base.select(F.xxhash64("_text").alias("_t"), F.explode(numbers).alias("_s")).select("_t", F.col("_s").try_cast("bigint").alias("_n"))
        met = hot_join(cut(asked.where("_n is not null")), words, ["_n"], least_hot=least_hot).groupBy("_t").agg(F.collect_set("_n").alias("_known"))
        base = base.withColumn("_t", F.xxhash64("_text")).join(met, "_t", "left").drop("_t")
    else:
        base = base.withColumn("_known", F.lit(None).cast("array<bigint>"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.select(*keys).schema.fields)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, know = b.column(len(keys)).to_pylist(), b.column(len(keys) + 1)
            automaton = _automaton(set(know.flatten().to_pylist()))
            at, pos, out = [], [], []
            for i, t in enumerate(texts):
                values = _segment(t, _hits(t, automaton))
                at += [i] * len(values)
                pos += range(1, len(values) + 1)
                out += values
            rows_at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k).take(rows_at) for k in range(len(keys))), pa.array(pos, pa.int32()), pa.array(out, pa.int64())],
                [*keys, "pos", "value"],
            )

    return base.select(*keys, "_text", "_known").mapInArrow(split, f"{schema}, pos int, value bigint")
