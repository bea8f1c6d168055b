"""Nested documents into flat tables linked by interval containment."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NODE_SCHEMA = "node_type string, pre bigint, post bigint, pos int, kind string, scalar string"
_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][-+]?\d+)?")
_WORDS = {"true": True, "false": False, "null": None}


def _no_constant(name: str):
    raise ValueError(name)


def _deep(text: str):
    """The value of a JSON text nested deeper than json.loads reads."""
    stack: list[tuple] = []  # of (container, key of the value that is read now)
    value, at = None, _SPACE.match(text).end()
    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            box, at = {} if c == "{" else [], _SPACE.match(text, at + 1).end()
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                stack.append((box, None))
                key = None
                if c == "{":
                    key, at = _key(text, at)
                stack[-1] = (box, key)
                continue
            value, at = box, at + 1
        elif c == '"':
            value, at = scanstring(text, at + 1)
        elif word := next((w for w in _WORDS if text.startswith(w, at)), None):
            value, at = _WORDS[word], at + len(word)
        elif m := _NUMBER.match(text, at):
            value, at = (float if m.group(1) or m.group(2) else int)(m.group()), m.end()
        else:
            raise ValueError(f"no value at {at}")
        while True:
            at = _SPACE.match(text, at).end()
            if not stack:
                if at < len(text):
                    raise ValueError(f"more text at {at}")
                return value
            box, key = stack.pop()
            if isinstance(box, dict):
                box[key] = value
            else:
                box.append(value)
            c, at = text[at : at + 1], _SPACE.match(text, at + 1).end()
            if c == ",":
                key = None
                if isinstance(box, dict):
                    key, at = _key(text, at)
                stack.append((box, key))
                break
            if c != ("}" if isinstance(box, dict) else "]"):
                raise ValueError(f"no end at {at}")
            value = box


def _key(text: str, at: int) -> tuple[str, int]:
    """(key, begin of its value) of an object's next member."""
    if text[at : at + 1] != '"':
        raise ValueError(f"no key at {at}")
    key, at = scanstring(text, at + 1)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError(f"no value at {at}")
    return key, _SPACE.match(text, at + 1).end()


def _steps(node_types: Iterable[str]) -> dict:
    """The node types as a tree of steps (a key, or ``[]`` for an entry); "" holds a type's own name."""
    tree: dict = {}
    for t in node_types:
        at = tree
        for step in re.findall(r"\[\]|[^.\[\]]+", t):
            at = at.setdefault(step, {})
        at[""] = t
    return tree


def _label(payload: str, tree: dict) -> list[tuple]:
    """(type, pre, post, pos, kind, scalar) of every wanted node, by a depth-first walk with one counter."""
    try:
        root = json.loads(payload, parse_constant=_no_constant)
    except RecursionError:
        try:
            root = _deep(payload)
        except ValueError:
            return []
    except ValueError:
        return []
    nodes: list[list] = []
    count = 0
    none: dict = {}
    stack: list[tuple] = [(tree, root, None, False)]
    while stack:
        steps, value, pos, ends = stack.pop()
        if ends:
            if value is not None:
                nodes[value][2] = count
            count += 1
            continue
        at = None
        if "" in steps:
            kind = "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "null" if value is None else "bool" if isinstance(value, bool) else "text" if isinstance(value, str) else "number"
            at = len(nodes)
            nodes.append([steps[""], count, 0, pos, kind, None if kind in ("object", "array", "null") else value if kind == "text" else json.dumps(value)])
        count += 1
        stack.append((none, at, None, True))
        if isinstance(value, dict):
            stack.extend((steps.get(k, none) if k not in ("", "[]") else none, v, None, False) for k, v in reversed(value.items()))
        elif isinstance(value, list):
            inner = steps.get("[]", none)
            stack.extend((inner, v, i, False) for i, v in reversed(list(enumerate(value))))
    return [tuple(n) for n in nodes]


def label_nodes(docs: DataFrame, doc: str, payload: str, node_types: Iterable[str]) -> DataFrame:
    """(doc, key, node_type, pre, post, pos, kind, scalar): the nodes of the given types of each JSON text.

    key is the digest of the text, so that several texts under one doc stay apart.  A node type is the path without
    positions, as ``functions[].callers[]``.  pre and post come from one counter of a depth-first walk over all nodes,
    so that a node lies in another of its text exactly if its interval does.  pos is the place in the node's own
    array, null outside arrays.  Texts that are null or not valid JSON give no node; any depth is read.  Rows equal
    in doc and payload count once.
    """
    tree = _steps(node_types)
    source = docs.select(F.col(doc).alias("doc"), F.unhex(F.md5(payload)).alias("key"), F.col(payload).alias("payload")).where(F.col("payload").isNotNull()).distinct()
    kind = source.schema["doc"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):  # bounded output batches, however many nodes a text has
                part = b.slice(at, 256)
                labelled = [_label(p, tree) for p in part.column(2).to_pylist()]
                counts = [i for i, ns in enumerate(labelled) for _ in ns]
                flat = list(zip(*(n for ns in labelled for n in ns), strict=True)) or [()] * 6
                arrays = [part.column(i).take(pa.array(counts, pa.int64())) for i in (0, 1)]
                arrays += [pa.array(v, t) for v, t in zip(flat, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc", "key", "node_type", "pre", "post", "pos", "kind", "scalar"])

    return source.mapInArrow(walk, f"doc {kind}, key binary, {NODE_SCHEMA}")


def node_tables(nodes: DataFrame, node_types: Iterable[str]) -> dict[str, DataFrame]:
    """One table per node type, whose rows are linked to those of any other by (doc, key) and interval containment."""
    return {t: nodes.where(F.col("node_type") == t).drop("node_type") for t in node_types}


def enclosing(node_types: Iterable[str], *cols: str) -> Column:
    """Of the row's innermost enclosing node of the given types: a struct of cols, or null.

    To be used on rows of label_nodes: a sweep over each document in pre-order; since intervals nest or are
    disjoint, the last such node begun encloses the row exactly if it ends after it.
    """
    sweep = W.partitionBy("doc", "key").orderBy("pre").rowsBetween(W.unboundedPreceding, 0)
    begun = F.last(F.when(F.col("node_type").isin(*node_types), F.struct("pre", "post", *cols)), ignorenulls=True).over(sweep)
    return F.when(begun["post"] >= F.col("post"), begun)


def scalar_address(kind: Column, scalar: Column) -> Column:
    """The canonical address of a JSON number (in decimal) or text."""
    from factloom.functions.names import canonical_address

    number = scalar.try_cast("bigint")
    return F.when(kind == "number", F.when(number >= 0, F.concat(F.lit("0x"), F.lower(F.hex(number))))).when(kind == "text", canonical_address(scalar))


def call_links(docs: DataFrame, doc: str, payload: str) -> DataFrame:
    """(doc, function_pos, function_address, link_side, link_pos, link_address): one row per listed caller or callee.

    The node tables (functions, link entries, address values) are linked by interval containment alone.
    Null entries give no row but keep their place; a bare value has place 0; entries without a readable
    address, and functions without one, have a null address.
    """
    function_types = ["functions[]"]
    sides = {"caller": "functions[].callers", "callee": "functions[].callees"}
    lists = list(sides.values())
    entries = [f"{p}[]" for p in lists]
    tails = ["", ".address", ".offset", ".address.offset"]
    own = [f"functions[]{t}" for t in tails]
    addressed = own + [x + t for x in lists + entries for t in tails]
    nodes = label_nodes(docs, doc, payload, {*function_types, *lists, *entries, *addressed})
    is_list, is_entry = F.col("node_type").isin(*lists), F.col("node_type").isin(*entries)
    nodes = nodes.withColumn("address", F.when(F.col("node_type").isin(*addressed), scalar_address(F.col("kind"), F.col("scalar"))))
    # a bare value in place of a list is itself the entry
    starts = (is_entry & (F.col("kind") != "null")) | (is_list & ~F.col("kind").isin("array", "null"))
    nodes = nodes.withColumn("entry", F.when(starts, F.struct("pre", "post", F.coalesce("pos", F.lit(0)).alias("pos"))))
    sweep = W.partitionBy("doc", "key").orderBy("pre").rowsBetween(W.unboundedPreceding, 0)
    nodes = nodes.withColumn("f", enclosing(function_types, "pos")).withColumn("e", F.last("entry", ignorenulls=True).over(sweep))
    nodes = nodes.withColumn("e", F.when(F.col("e.post") >= F.col("post"), F.col("e")))
    functions = W.partitionBy("doc", "key", "f.pre")
    nodes = nodes.withColumn("f_address", F.max(F.when(F.col("node_type").isin(*own), F.col("address"))).over(functions))
    side = F.when(F.col("node_type").startswith(sides["caller"]), "caller").otherwise("callee")
    return (
        nodes.where(F.col("e").isNotNull() & F.col("f").isNotNull())
        .groupBy("doc", "key", F.col("f.pos").alias("function_pos"), side.alias("link_side"), F.col("e.pre").alias("pre"), F.col("e.pos").alias("link_pos"))
        .agg(F.max("f_address").alias("function_address"), F.max("address").alias("link_address"))
        .select(F.col("doc").alias(doc), "function_pos", "function_address", "link_side", "link_pos", "link_address")
    )
