"""Shredding nested JSON into an adjacency table of nodes, and pivoting that into flat tables of objects."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from itertools import islice
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.runtime import spread

NODE_FIELDS = "node_id int, parent_id int, node_path string, object_path string, label string, ordinal int, kind string, scalar string, in_array boolean"
_ARROW = pa.schema([("node_id", pa.int32()), ("parent_id", pa.int32()), ("node_path", pa.string()), ("object_path", pa.string()), ("label", pa.string()), ("ordinal", pa.int32()), ("kind", pa.string()), ("scalar", pa.string()), ("in_array", pa.bool_())])


class _Written(str):
    """A whole number as it is written: Python turns no more than 4,300 digits into a number."""


def _refuse(name: str) -> None:
    raise ValueError(name)


_LOADS = {"parse_constant": _refuse, "parse_int": _Written}
_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|(")|(-?(?:0|[1-9][0-9]*)(?![0-9.eE]))|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(true|false|null))')
_NAMED = {"true": True, "false": False, "null": None}


def _loads_deep(text: str):
    """json.loads with a stack of its own, for documents nested deeper than Python's parser goes."""
    at, stack, done, root = 0, [], False, None
    # what may come next: a value, a key, the colon after one, or a comma or closing sign; first: right after an opening sign
    expect, first = "value", False
    while True:
        found = _TOKEN.match(text, at)
        if found is None:
            break
        at = found.end()
        sign, quote, whole, number, named = found.groups()
        if sign in ("}", "]") and stack and (expect == "comma" or first) and isinstance(stack[-1][0], dict if sign == "}" else list):
            stack.pop()
            expect, first, done = "comma", False, not stack
            continue
        if sign == "," and expect == "comma" and stack:
            expect, first = ("key" if isinstance(stack[-1][0], dict) else "value"), False
            continue
        if sign == ":" and expect == "colon":
            expect = "value"
            continue
        if quote:
            value, at = scanstring(text, at, True)
            if expect == "key":
                stack[-1][1], expect, first = value, "colon", False
                continue
        elif sign in ("{", "["):
            value = {} if sign == "{" else []
        elif sign is None:
            value = _Written(whole) if whole is not None else float(number) if number is not None else _NAMED[named]
        else:
            raise ValueError("unexpected sign")
        if expect != "value" or done:
            raise ValueError("unexpected value")
        if not stack:
            root = value
        elif isinstance(stack[-1][0], dict):
            stack[-1][0][stack[-1][1]] = value
        else:
            stack[-1][0].append(value)
        if sign:
            stack.append([value, None])
            expect, first = ("key" if sign == "{" else "value"), True
        else:
            expect, first, done = "comma", False, not stack
    if not done or text[at:].strip(" \t\n\r"):
        raise ValueError("incomplete")
    return root


def loads(text: str):
    """A JSON text of any depth, whole numbers as they are written; ValueError if it is none."""
    try:
        return json.loads(text, **_LOADS)
    except RecursionError:
        return _loads_deep(text)


def parse(text: str | None):
    """The document in a text, unwrapped once if it is a JSON string; raises ValueError if it is no valid JSON.

    NaN and Infinity are no JSON. Of repeated keys in one object the last counts. Whole numbers stay as they are written, of any
    length, and documents may be nested to any depth.
    """
    if text is None:
        raise ValueError("null")
    found = loads(text)
    return loads(found) if isinstance(found, str) and not isinstance(found, _Written) else found


def _path(place: tuple | None) -> str:
    """The text of a path kept as (place before, step)."""
    steps = []
    while place is not None:
        place, step = place
        steps.append(step)
    return "".join(reversed(steps))


def walk(document) -> Iterator[tuple]:
    """The nodes of a document in NODE_FIELDS order, parents before children.

    Paths are kept as chains of steps and written out for objects only, so a document of depth d costs d steps, not d texts of length d.
    """
    root = (None, "$")
    n, stack = 0, [(document, None, root, "$", None, None, False)]
    while stack:
        value, parent, place, owner, label, ordinal, in_array = stack.pop()
        me, n = n, n + 1
        if isinstance(value, dict):
            path = _path(place)
            yield me, parent, path, owner, label, ordinal, "object", None, in_array
            stack.extend((v, me, ((None, path), f".{k}"), path, k, i, False) for i, (k, v) in enumerate(value.items()))
        elif isinstance(value, list):
            yield me, parent, None, None, label, ordinal, "array", None, in_array
            stack.extend((v, me, (place, f"[{i}]"), owner, label, i, True) for i, v in enumerate(value))
        else:
            kind = "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (_Written, float)) else "string"
            text = None if value is None else "0" if kind == "number" and value == "-0" else str(value) if isinstance(value, str) else json.dumps(value)
            yield me, parent, None, None, label, ordinal, kind, text and text.encode("utf-8", "replace").decode(), in_array


def shred(rows: DataFrame, key: str, document: str, budget: int = 50_000) -> DataFrame:
    """The adjacency table of a column of JSON texts: the key and NODE_FIELDS, one row per node.

    Each node has its parent node, its label (the member it lies in), its position in the parent and, if it is a scalar, its text;
    objects also have their path and that of the nearest object around (`$` if none), null for other nodes, whose place their parents
    give. Paths: `$`, `.key`, `[i]` from 0. Texts that are null, blank or not valid JSON have no nodes. rows: a scan, see runtime.spread. The key must be unique; other columns are ignored. Batches leave a task at ``budget`` nodes,
    also within a document.
    """
    kind = rows.schema[key].dataType.simpleString()

    def nodes(batches):
        for batch in batches:
            keys, at, found = batch.column(0), [], []
            for i, text in enumerate(batch.column(1)):
                try:
                    parsed = parse(text.as_py())
                except ValueError:
                    continue
                each = walk(parsed)
                while part := list(islice(each, max(1, budget - len(found)))):
                    found.extend(part)
                    at.extend([i] * len(part))
                    if len(found) >= budget:
                        yield _batch(key, keys, at, found)
                        at, found = [], []
            yield _batch(key, keys, at, found)

    return spread(rows.select(key, document)).mapInArrow(nodes, f"`{key}` {kind}, {NODE_FIELDS}")


def _batch(name: str, keys, at: list[int], found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found)) or [[]] * len(_ARROW)
    own = keys.take(pa.array(at, pa.int32()))
    return pa.RecordBatch.from_arrays([own, *(pa.array(c, f.type) for c, f in zip(columns, _ARROW))], [name, *_ARROW.names])


def entities(nodes: DataFrame, key: str) -> DataFrame:
    """The objects of an adjacency table with their scalar members as a map: key, node_id, parent_path, node_path, label, ordinal, in_array, members.

    Object nodes meet their scalar members on (key, object), both read from one pass over the nodes and one shuffle; objects without
    scalars keep an empty map. parent_path is the nearest object around, so rows of one table link to rows of another by
    (key, parent_path) = (key, node_path). No member is lost, as labels are unique within an object.
    """
    is_object = F.col("kind") == "object"
    is_member = ~F.col("kind").isin("object", "array") & ~F.col("in_array") & F.col("parent_id").isNotNull()
    info = F.struct("parent_path", "node_path", "label", "ordinal", "in_array")
    own = nodes.filter(is_object | is_member).withColumnRenamed("object_path", "parent_path")
    grouped = own.groupBy(key, F.when(is_object, F.col("node_id")).otherwise(F.col("parent_id")).alias("node_id")).agg(
        F.max(F.when(is_object, info)).alias("__info"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(is_member, F.struct("label", "scalar"))))).alias("members"),
    )
    return grouped.select(key, "node_id", "__info.*", "members")


def entity_table(found: DataFrame, key: str, label: str | None, columns: Sequence[str]) -> DataFrame:
    """One flat table: the entities that lie under a label (all, if None), their links and the named members as columns ``m_<name>``; a missing member is null."""
    own = found if label is None else found.filter(F.col("label") == label)
    return own.select(key, "parent_path", "node_path", "ordinal", *(F.col("members")[c].alias(f"m_{c}") for c in columns))


def array_objects(nodes: DataFrame, key: str) -> DataFrame:
    """key, parent_path, node_path of every object that is an element of an array."""
    return entities(nodes, key).filter("in_array").select(key, "parent_path", "node_path")
