"""Deeply nested records as flat node tables with interval labels.

Every record is walked depth first; each node gets its position in pre-order and in post-order. A node encloses another
exactly if its interval does: ``pre`` is smaller and ``post`` larger. The flat tables carry these labels, and a child's
parent is found from them by containment, never from the nesting itself.

Defined results: a null or empty column, a null or invalid JSON element and a null entry of an array give no node; a block without a type is an ``object``; of
repeated keys in one JSON object the last counts; extra columns are ignored; any depth is walked without recursion. A null
field of a block or of its entries is not set and gives no attribute; a null inside an array is one of kind ``null``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "page_id bigint, nodes array<struct<pre:int,post:int,depth:int,node_type:string,node_path:string,parent_pre:int,parent_path:string>>, "
    "attributes array<struct<owner_pre:int,name:string,kind:string,value:string>>"
)
_NODE = pa.struct([("pre", pa.int32()), ("post", pa.int32()), ("depth", pa.int32()), ("node_type", pa.string()), ("node_path", pa.string()), ("parent_pre", pa.int32()), ("parent_path", pa.string())])
_ATTRIBUTE = pa.struct([("owner_pre", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("value", pa.string())])
#: Node types with a table of their own: the kinds of blocks, objects without a type, and common types of structured data.
NODE_TYPES = (
    "heading", "paragraph", "image", "list", "form", "embed", "table", "code", "quote", "media", "definitionlist", "object",
    "AggregateOffer", "Answer", "Article", "BlogPosting", "BreadcrumbList", "Comment", "ContactPoint", "Event", "FAQPage", "GeoCoordinates", "ImageObject", "LocalBusiness", "Offer", "Organization", "Person", "Place", "PostalAddress", "Product", "Question", "Review",
)
#: Rows of which whole blocks are Python objects at a time.
BLOCK_ROWS = 500
_TOKEN = re.compile(r'\s*("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|[\[\]{},:])')


def _decode_deep(text: str):
    """JSON of any depth without recursion; raises ValueError where json.loads would."""
    root: list = []
    stack: list = [root]
    keys: list = [None]
    expect, at = "value", 0
    while True:
        m = _TOKEN.match(text, at)
        if not m:
            if text[at:].strip(" \t\n\r") or expect != "end":
                raise ValueError("invalid JSON")
            return root[0]
        token, at, top = m[1], m.end(), stack[-1]
        if expect == "end":
            raise ValueError("extra data")
        if token in "]}" and expect in ("comma", "first"):
            if (token == "]") != isinstance(top, list) or top is root:
                raise ValueError("unbalanced")
            stack.pop()
            keys.pop()
        elif expect == "comma":
            if token != ",":
                raise ValueError("comma expected")
            expect = "key" if isinstance(top, dict) else "value"
            continue
        elif expect == "colon":
            if token != ":":
                raise ValueError("colon expected")
            expect = "value"
            continue
        elif isinstance(top, dict) and expect in ("key", "first"):
            if token[0] != '"':
                raise ValueError("key expected")
            keys[-1], expect = json.loads(token), "colon"
            continue
        else:
            if token in "]},:":
                raise ValueError("value expected")
            value = [] if token == "[" else {} if token == "{" else json.loads(token)
            if isinstance(top, dict):
                top[keys[-1]] = value
            else:
                top.append(value)
            if token in "[{":
                stack.append(value)
                keys.append(None)
                expect = "first"
                continue
        expect = "end" if stack[-1] is root else "comma"


def _no_number(name: str):
    raise ValueError(f"{name} is no JSON")


def decode(text: str | None):
    """``(value, True)`` of valid JSON, else ``(None, False)``; NaN and infinities aren't valid."""
    if text is None:
        return None, False
    try:
        return json.loads(text, parse_constant=_no_number), True
    except ValueError as e:
        if "integer string conversion" in str(e):  # longer than Python converts; still valid
            try:
                return json.loads(text, parse_int=Decimal, parse_constant=_no_number), True
            except ValueError:
                return None, False
        return None, False
    except RecursionError:
        try:
            return _decode_deep(text), True
        except ValueError:
            return None, False


def label(roots: list[tuple[str, object, str | None]], with_attributes: bool = True, of_blocks: bool = False) -> tuple[list[list], list[tuple]]:
    """Interval labels of every object under ``roots`` (path, value, type name), in pre-order.

    Arrays are numbered like objects, so that intervals nest strictly, but only objects give nodes: ``[pre, post, depth,
    type, path]``. Scalars inside objects give attributes ``(owner's pre, name, kind, value)``: those of the roots without a
    type name (JSON), or with ``of_blocks`` those of the others.
    """
    nodes: list[list] = []
    attributes: list[tuple] = []
    pre = post = 0
    for root_path, root, root_type in roots:
        # path, value, depth, type of a block or None, owner's pre, name; a finished node is put back as (node,)
        stack: list[tuple] = [(root_path, root, 0, root_type, -1, "")]
        while stack:
            entry = stack.pop()
            if len(entry) == 1:
                if entry[0] is not None:
                    entry[0][1] = post
                post += 1
                continue
            path, value, depth, kind, owner, name = entry
            if isinstance(value, dict):
                if kind is None:
                    kind = value.get("@type")
                    kind = kind if isinstance(kind, str) else "object"
                node = [pre, 0, depth, kind, path]
                nodes.append(node)
                stack.append((node,))
                mine, pre = pre, pre + 1
                stack.extend((f"{path}.{k}", v, depth + 1, None, mine, k) for k, v in reversed(value.items()))
            elif isinstance(value, list):
                stack.append((None,))
                pre += 1
                stack.extend((f"{path}[{i}]", value[i], depth + 1, None, owner, f"{name}[{i}]") for i in range(len(value) - 1, -1, -1))
            elif with_attributes and owner >= 0 and (root_type is not None) == of_blocks:
                kind = "null" if value is None else "bool" if isinstance(value, bool) else "number" if isinstance(value, (int, float, Decimal)) else "string"
                attributes.append((owner, name, kind, value if kind == "string" else None if kind == "null" else str(value) if isinstance(value, Decimal) else json.dumps(value)))
    return nodes, attributes


def link(nodes: list[list]) -> list[int]:
    """For nodes in pre-order, the index of the nearest node whose interval contains each, or -1."""
    parents: list[int] = []
    open_: list[int] = []
    for i, node in enumerate(nodes):
        while open_ and nodes[open_[-1]][1] < node[1]:
            open_.pop()
        parents.append(open_[-1] if open_ else -1)
        open_.append(i)
    return parents


def _json_roots(sd: list[str | None] | None) -> list[tuple[str, object, str | None]]:
    decoded = ((i, *decode(text)) for i, text in enumerate(sd or ()))
    return [(f"structured_data[{i}]", value, None) for i, value, ok in decoded if ok]


def _walk(batches: Iterator[pa.RecordBatch], with_attributes: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, found, extra = batch.column(0), [], []
        for sd, types, fields, definitions, present in zip(*(batch.column(k).to_pylist() for k in range(1, 6)), strict=True):
            roots = _json_roots(sd)
            for i, kind in enumerate(types or ()):
                if present[i]:
                    inner = {k: [{} if full else None for full in a[i]] for k, a in (("fields", fields), ("definitions", definitions)) if a and a[i]}
                    roots.append((f"content_blocks[{i}]", inner, "object" if kind is None else kind))
            nodes, attributes = label(roots, with_attributes)
            up = link(nodes)
            found.append([(*n, nodes[p][0] if p >= 0 else -1, nodes[p][4] if p >= 0 else "") for n, p in zip(nodes, up, strict=True)])
            extra.append(attributes if with_attributes else [])
        yield pa.RecordBatch.from_arrays([ids, _structs(found, _NODE), _structs(extra, _ATTRIBUTE)], names=["page_id", "nodes", "attributes"])


def _values(record: dict) -> dict:
    """A block or entry with what is set in it; arrays of strings as one value per position, so that they aren't numbered."""
    out: dict = {}
    for name, value in record.items():
        if name in ("fields", "definitions"):
            if value:
                out[name] = [e if e is None else _values(e) for e in value]
        elif isinstance(value, list):
            for i, v in enumerate(value):
                out |= {f"{name}[{i}][{j}]": x for j, x in enumerate(v)} if isinstance(v, list) else {f"{name}[{i}]": v}
        elif value is not None:
            out[name] = value
    return out


def _walk_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK_ROWS):
            batch, found = whole.slice(at, BLOCK_ROWS), []
            for sd, blocks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                roots = _json_roots(sd) + [(f"content_blocks[{i}]", _values(b), "object" if b["type"] is None else b["type"]) for i, b in enumerate(blocks or ()) if b is not None]
                found.append(label(roots, of_blocks=True)[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), _structs(found, _ATTRIBUTE)], names=["page_id", "attributes"])


def _valid(texts: tuple) -> tuple:
    """Texts with lone surrogates, which JSON escapes can hold and UTF-8 can't, replaced."""
    try:
        "".join(x for x in texts if x).encode()
        return texts
    except UnicodeEncodeError:
        return tuple(x and x.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for x in texts)


def _structs(rows: list[list[tuple]], kind: pa.StructType) -> pa.Array:
    """List array of structs, column by column."""
    flat = [x for row in rows for x in row]
    columns = list(zip(*flat, strict=True)) or [()] * kind.num_fields
    columns = [c if not pa.types.is_string(f.type) else _valid(c) for c, f in zip(columns, kind, strict=True)]
    offsets = [0]
    for row in rows:
        offsets.append(offsets[-1] + len(row))
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _present(nested: Column) -> Column:
    """Of an array of arrays of structs, which entries are there; the structs themselves aren't sent to Python."""
    return F.transform(nested, lambda inner: F.transform(inner, lambda e: e.isNotNull()))


def labelled_pages(page_data: DataFrame, with_attributes: bool = True) -> DataFrame:
    """One row per page: its object nodes with interval labels and their attributes. Redelivered rows count once."""
    wanted = page_data.select(
        "page_id", "structured_data", F.col("content_blocks.type").alias("types"), _present(F.col("content_blocks.fields")).alias("fields"), _present(F.col("content_blocks.definitions")).alias("definitions"),
        F.transform("content_blocks", lambda b: b.isNotNull()).alias("present"),
    )
    walked = wanted.mapInArrow(lambda batches: _walk(batches, with_attributes), NODE_SCHEMA)
    return walked.dropDuplicates(["page_id"])


def node_table(page_data: DataFrame) -> DataFrame:
    """All object nodes: page_id, pre, post, depth, node_type, node_path, parent_pre (-1 at the top), parent_path."""
    return labelled_pages(page_data, False).select("page_id", F.inline("nodes"))


def attribute_table(page_data: DataFrame) -> DataFrame:
    """Scalars of the JSON objects, linked to their object by its pre-order number: page_id, owner_pre, name, kind, value."""
    return labelled_pages(page_data).select("page_id", F.inline("attributes"))


def block_attribute_table(page_data: DataFrame) -> DataFrame:
    """Values of the blocks and of their fields and definitions, linked like those of the JSON objects to the nodes of ``node_table``.

    Arrays of strings give one row per position, such as ``items[2]`` or ``rows[0][1]``; options belong to their field.
    """
    schema = "page_id bigint, attributes array<struct<owner_pre:int,name:string,kind:string,value:string>>"
    return page_data.select("page_id", "structured_data", "content_blocks").mapInArrow(_walk_blocks, schema).dropDuplicates(["page_id"]).select("page_id", F.inline("attributes"))


def type_table(nodes: DataFrame, node_type: str) -> DataFrame:
    """The node table of one type."""
    return nodes.where(F.col("node_type") == node_type)


def other_table(nodes: DataFrame) -> DataFrame:
    """The nodes of all types without a table of their own."""
    return nodes.where(~F.col("node_type").isin(*NODE_TYPES))


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Links each node of ``inner`` with every node of ``outer`` on its page that encloses it, by interval containment."""
    a, b = inner.alias("inner"), outer.alias("outer")
    inside = (F.col("inner.page_id") == F.col("outer.page_id")) & (F.col("outer.pre") < F.col("inner.pre")) & (F.col("outer.post") > F.col("inner.post"))
    return a.join(b, inside).select(F.col("inner.page_id").alias("page_id"), F.col("inner.pre").alias("inner_pre"), F.col("outer.pre").alias("outer_pre"))


def found(page_data: DataFrame) -> DataFrame:
    """page_id, node_path and the path of the nearest enclosing object, or the empty string."""
    return node_table(page_data).select("page_id", "node_path", "parent_path")
