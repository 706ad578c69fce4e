"""Deeply nested semi-structured records into related flat tables, in a single pass.

A depth-first visitor walks each payload once and emits rows tagged with their table: (tag, pk, parent_pk, positions,
key_text, payload). The emission is written partitioned by tag; each table is then read from its own partition with its
own schema. Key names and nesting may vary, fields may be absent.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.runtime import read, workspace

EMISSION = "raw_id long, tag string, pk string, parent_pk string, paper_pos int, child_pos int, key_text string, payload string"
#: An object with one of these keys is a paper.
PAPER_KEYS = ("arxiv_id", "title", "entities", "relations", "novelty")
#: What each kind of child is called in a paper.
CHILDREN = {"entity": "entities", "relation": "relations", "novelty": "novelty"}
KEY_TEXT = {"entity": ("name", "entity_name"), "relation": ("source", "source_name"), "novelty": ("classification",)}
#: Schemas of the tables, applied to the payload of each tag.
TABLES = {
    "paper": "arxiv_id string, title string, abstract string, authors array<string>, year string, venue string, errors array<string>",
    "entity": "name string, type string, entity_type string, description string, mathematical_structure string, bottleneck_class string",
    "relation": "source string, source_name string, source_type string, relation string, target string, target_name string, target_type string, confidence string, supporting_text string",
    "novelty": "classification string, confidence string, reasoning string",
}
#: The fields of a child: an object with one of them is a child, not a group of children.
FIELDS = {tag: frozenset(f.split()[0] for f in schema.split(", ")) for tag, schema in TABLES.items()}


def _refuse(x: str) -> None:
    raise ValueError(x)


def _object(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    """An object; of a key written twice, collections are put together in one list, else the last value stays."""
    out = dict(pairs)
    if len(out) < len(pairs):
        out = {}
        for k, v in pairs:
            if k in out and (isinstance(v, (list, dict)) or isinstance(out[k], (list, dict))):
                both = [x if isinstance(x, list) else [] if x is None else [x] for x in (out[k], v)]
                v = both[0] + both[1]
            out[k] = v
    return out


_DECODER = json.JSONDecoder(parse_constant=_refuse, object_pairs_hook=_object)


def decode(text: str) -> list[Any] | None:
    """All JSON texts in a row (one, or one after another with white space between); None if any part can't be read."""
    out, at, n = [], 0, len(text)
    text_ws = " \t\r\n"
    if text.startswith("\ufeff"):
        at = 1
    while True:
        while at < n and text[at] in text_ws:
            at += 1
        if at >= n:
            return out or None
        try:
            value, at = _DECODER.raw_decode(text, at)
        except (ValueError, RecursionError):
            return None
        if at < n and text[at] not in text_ws and isinstance(value, (int, float)) and not isinstance(value, bool):
            return None
        out.append(value)


def _text(x: Any) -> str:
    if x is None:
        return ""
    return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def _inner(x: str) -> list[Any] | None:
    """The values of a string that is JSON text itself. Escapes double with each encoding, so depth is at most logarithmic."""
    return decode(x) if x.lstrip()[:1] in ("{", "[", '"') else None


def _members(value: Any, tag: str) -> Iterator[Any]:
    """The children of one kind in reading order: of a list, of groups of lists, or a single one, also where any of these is
    JSON text in a string. Other strings are names of children in a collection, or a novelty's class."""
    stack = [(iter([value]), False)]
    while stack:
        it, in_list = stack[-1]
        x = next(it, stack)
        if x is stack:
            stack.pop()
        elif isinstance(x, list):
            stack.append((iter(x), True))
        elif isinstance(x, dict):
            if FIELDS[tag].intersection(x):
                yield x
            elif any(isinstance(v, (list, dict)) for v in x.values()):
                stack.append((iter(x.values()), False))
            elif in_list or any(v is not None for v in x.values()):
                yield x
        elif isinstance(x, str):
            inner = _inner(x)
            if inner is not None and not any(isinstance(v, str) for v in inner):
                stack.append((iter(inner), in_list))
            elif tag == "novelty" or len(stack) > 1:
                yield {KEY_TEXT[tag][0]: x}


class Visitor:
    """Depth-first over one payload; rows() gives the tagged rows."""

    def __init__(self, raw_id: int) -> None:
        self.raw_id, self.papers, self.out = raw_id, 0, []

    def emit(self, tag: str, pk: str, parent: str | None, paper: int, child: int, key: str, payload: Any) -> None:
        self.out.append((self.raw_id, tag, pk, parent, paper, child, key, None if payload is None else json.dumps(payload, ensure_ascii=False)))

    def visit(self, value: Any) -> None:
        """Papers in reading order; a paper's own children come before papers that lie in its other fields."""
        stack = [(iter([value]), True)]
        while stack:
            it, strings = stack[-1]
            x = next(it, stack)
            if x is stack:
                stack.pop()
            elif isinstance(x, dict):
                if any(k in x for k in PAPER_KEYS):
                    # texts of a paper stay texts, also if they look like JSON
                    stack.append((iter(self.paper(x)), False))
                else:
                    stack.append((iter(x.values()), strings))
            elif isinstance(x, list):
                stack.append((iter(x), strings))
            elif isinstance(x, str) and strings:
                inner = _inner(x)
                if inner is not None:
                    stack.append((iter(inner), True))

    def paper(self, x: dict) -> list[Any]:
        """Emits the paper and its children; returns its other fields."""
        pos = self.papers
        self.papers += 1
        pk = f"{self.raw_id}/{pos}"
        own = {k: v for k, v in x.items() if k not in CHILDREN.values()}
        self.emit("paper", pk, f"{self.raw_id}", pos, pos, _text(x.get("arxiv_id")), own)
        for tag, field in CHILDREN.items():
            for i, child in enumerate(_members(x.get(field), tag)):
                key = next((child[k] for k in KEY_TEXT[tag] if child.get(k) is not None), None)
                self.emit(tag, f"{pk}/{tag}/{i}", pk, pos, i, _text(key), child)
        return list(own.values())

    def rows(self, payload: str) -> list[tuple]:
        values = decode(payload)
        if values is not None and any(isinstance(v, str) and decode(v) is None and v.lstrip()[:1] in ("{", "[") for v in values):
            values = None
        if values is None:
            self.emit("unreadable", f"{self.raw_id}", None, -1, -1, "", None)
        else:
            for v in values:
                self.visit(v)
        return self.out


def _encodable(x: str | None) -> str | None:
    """Lone surrogates (legal as JSON escapes) can't be stored as UTF-8; they become the replacement character."""
    return x if x is None or x.isascii() else x.encode("utf-8", "surrogatepass").decode("utf-8", "replace")


def flatten(raw: DataFrame) -> DataFrame:
    """raw(raw_id, payload) -> the tagged emission (EMISSION), no shuffle.

    Null payloads give no row. A payload that is not, in full, JSON text (or several texts one after another, or such text
    encoded as a JSON string), also an empty or blank one, gives the single tag 'unreadable' with positions -1. Null and empty
    collections give no rows; null items of a list neither, but empty objects in a list are children without fields. Strings
    in strings are decoded however deep; papers inside other fields of a paper follow it. Rows sent again are kept, by raw_id. Other columns of `raw` are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        names = [c.split()[0] for c in EMISSION.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows))
            cols = [[_encodable(v) for v in c] if t == pa.string() else c for c, t in zip(cols, types)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for b in batches:
            rows: list[tuple] = []
            for raw_id, payload in zip(b.column(0).to_pylist(), b.column(1)):
                rows += Visitor(raw_id).rows(payload.as_py())
                if len(rows) >= 5000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    return raw.select("raw_id", "payload").filter("payload is not null").mapInArrow(run, EMISSION)


def write_tables(emission: DataFrame, path: str) -> None:
    """One pass over the payloads; one folder per tag."""
    emission.write.mode("overwrite").partitionBy("tag").parquet(path)


def read_table(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """The table of a tag with its schema and its links: pk, parent_pk."""
    df = spark.read.schema(EMISSION).parquet(path).filter(F.col("tag") == tag)
    return apply_schema(df, tag)


def apply_schema(emission: DataFrame, tag: str) -> DataFrame:
    rows = emission.filter(F.col("tag") == tag)
    return rows.select("raw_id", "paper_pos", "child_pos", "pk", "parent_pk", "key_text", F.from_json("payload", TABLES[tag]).alias("r")).select("raw_id", "paper_pos", "child_pos", "pk", "parent_pk", "key_text", "r.*")


def tables_of(spark: SparkSession, d: str) -> str:
    """The folder of the flat tables of raw_extractions, written in one pass."""
    path = workspace(spark, "nested")
    write_tables(flatten(read(spark, d, "raw_extractions")), path)
    return path


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """(raw_id, paper_pos, child, child_pos, key_text) of every entity, relation and novelty, and of unreadable payloads: the
    tables of these tags, one after another."""
    path = tables_of(spark, d)
    parts = [spark.read.schema(EMISSION).parquet(path).filter(F.col("tag") == t) for t in (*CHILDREN, "unreadable")]
    return reduce(DataFrame.unionByName, parts).select("raw_id", "paper_pos", F.col("tag").alias("child"), "child_pos", "key_text")


def p6_tables(spark: SparkSession, d: str) -> DataFrame:
    """Row counts of the flat tables per payload, through the written, tag-partitioned emission."""
    path = tables_of(spark, d)
    return reduce(DataFrame.unionByName, [read_table(spark, path, t).groupBy("raw_id").agg(F.lit(t).alias("table_name"), F.count("*").alias("n"), F.count("parent_pk").alias("linked")) for t in TABLES])


def _flat(tag: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return read_table(spark, tables_of(spark, d), tag)

    query.__doc__ = f"The flat table of tag {tag} with its keys and its parent's."
    return query


QUERIES = {"p6_found": p6_found, "p6_tables": p6_tables, "p6_papers": _flat("paper"), "p6_entities": _flat("entity"), "p6_relations": _flat("relation"), "p6_novelty": _flat("novelty")}
SQL: dict[str, str] = {}
