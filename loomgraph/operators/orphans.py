"""References to records that do not exist: orphan ends of relations, per table referred to and month.

References and parent events are co-partitioned and sorted by (key, time), by range, and merged linearly: running sums over
the sorted stream hold how many validity intervals of the key are open. A range partition may begin or end anywhere, also
within a key or within one instant of it, so no key is ever too large for a task; what a partition leaves open for the next
one is a single row, and those rows (one per partition) are folded in order and added to the first key of each partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.canonical import canonical, canonical_pair, is_blank
from loomgraph.runtime import cut, read

#: The end of open intervals, and the time of what has none.
FOREVER = "9999-12-31 00:00:00"
#: Start of parents that were always there; the mark of a key comes before it.
ALWAYS = "0001-01-01 00:00:00"


def _ts(x: str):
    return F.lit(x).cast("timestamp_ntz")


def _key():
    """kind and key as one string that sorts."""
    return F.concat("kind", F.lit("\u0001"), "key").alias("k")


def parent_events(parents: DataFrame) -> DataFrame:
    """parents(kind, key, valid_from, valid_to) -> merge events (k, at, known, begun, opens).

    Each key has one mark before all times (known 1). An interval [valid_from, valid_to) opens once and closes once; an
    interval that ends before it begins never opens but still begins. A null valid_from never begins (the row counts as
    coming after everything). Times are microseconds; rows of equal time are one event.
    """
    begin = F.coalesce(F.col("valid_from"), _ts(FOREVER))
    end = F.coalesce(F.col("valid_to"), _ts(FOREVER))
    row = lambda at, known, begun, opens: F.struct(at.alias("at"), F.lit(known).alias("known"), F.lit(begun).alias("begun"), opens.alias("opens"))
    real = (end > begin) & (end < _ts(FOREVER))
    events = F.array(row(_ts("0000-01-01 00:00:00"), 1, 0, F.lit(0)), row(begin, 0, 1, F.when(end > begin, 1).otherwise(0)), row(end, 0, 0, F.lit(-1)))
    events = F.when(real, events).otherwise(F.slice(events, 1, 2))
    return parents.select(_key(), F.inline(events)).groupBy("k", "at").agg(F.max("known").alias("known"), F.sum("begun").alias("begun"), F.sum("opens").alias("opens"))


class _Merge:
    """The linear merge of one sorted partition; columns k, side, known, begun, opens, kind, ref, said."""

    COUNTS = ("known", "begun", "opens")

    def __init__(self) -> None:
        self.first: str | None = None
        self.last: str | None = None
        self.at = dict.fromkeys(self.COUNTS, 0)

    def batch(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """(rows to keep, which of them belong to the partition's first key, running sums of those)."""
        n, k = b.num_rows, b.column("k")
        new = np.empty(n, bool)
        new[0] = k[0].as_py() != self.last
        new[1:] = pc.not_equal(k.slice(1), k.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        if self.first is None:
            self.first = k[0].as_py()
        starts = np.flatnonzero(new)
        group = np.cumsum(new)  # 0: the key that the batch before ended with
        runs = {}
        for c in self.COUNTS:
            x = b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.cumsum(x)
            base = np.concatenate([[-self.at[c]], (total - x)[starts]])
            runs[c] = total - base[group]
            self.at[c] = int(runs[c][-1])
        is_first = group == 0 if self.last == self.first else np.zeros(n, bool)
        if k[0].as_py() == self.first:
            is_first = is_first | (group == group[0])
        self.last = k[n - 1].as_py()
        side = b.column("side").to_numpy(zero_copy_only=False)
        kept = np.flatnonzero((side == 1) & (is_first | (runs["opens"] <= 0)))
        return kept, is_first[kept], {c: r[kept] for c, r in runs.items()}

    def summary(self) -> tuple:
        sign = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
        return sign(self.first), sign(self.last), *(self.at[c] for c in self.COUNTS)


def _carried(ends: list[tuple]) -> list[tuple]:
    """(part, first, last, known, begun, opens) of each partition -> the same sums carried into its first key, where any are."""
    out, last, carry = [], None, (0, 0, 0)
    for part, first, end, *sums in sorted(ends):
        into = carry if first == last else (0, 0, 0)
        if any(into):
            out.append((part, *into))
        carry = tuple(a + b for a, b in zip(sums, into)) if first == end else tuple(sums)
        last = end
    return out


def find_orphans(references: DataFrame, parents: DataFrame, parts: int | None = None) -> DataFrame:
    """references(kind, key, at, ref) against parents(kind, key, valid_from, valid_to) -> (ref, kind, at, state).

    state: 'missing' (no parent row has the key), 'late' (all parent rows begin after `at`), 'deleted' (else; none is valid
    at `at`). References to a valid parent give no row; a null `at` counts as later than everything. ref is any column,
    also a struct. parts: range partitions; by default as the session says, joined adaptively. Null kinds and keys refer to
    nothing and are no parents. Empty tables and repeated rows are allowed.
    """
    spark = references.sparkSession
    refs = references.select(_key(), F.coalesce(F.col("at"), _ts("9999-12-30 00:00:00")).alias("at"), F.lit(1).alias("side"), *(F.lit(0).alias(c) for c in _Merge.COUNTS), "kind", "ref", F.col("at").alias("said")).filter("k is not null")
    events = parent_events(parents).filter("k is not null")
    events = events.select("k", "at", F.lit(0).alias("side"), *(F.col(c).cast("int").alias(c) for c in _Merge.COUNTS), *(F.lit(None).cast(refs.schema[c].dataType).alias(c) for c in ("kind", "ref", "said")))
    both = cut(refs.unionByName(events))
    order = ["k", "at", "side", F.xxhash64("ref")]
    ranged = both.repartitionByRange(parts, *order) if parts else both.repartitionByRange(*order)
    ranged = ranged.sortWithinPartitions("k", "at", "side").drop("at")
    ref_type = refs.schema["ref"].dataType.simpleString()
    sums = ", ".join(f"{c} long" for c in _Merge.COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, merge, last = TaskContext.get().partitionId(), _Merge(), None
        for b in batches:
            if b.num_rows:
                last = b
                at, edge, runs = merge.batch(b)
                if len(at):
                    rows = pa.array(at)
                    nothing = pa.nulls(len(at), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part, np.int32)), nothing, nothing, pa.array(edge), *(pa.array(runs[c]) for c in _Merge.COUNTS), *(b.column(c).take(rows) for c in ("kind", "ref", "said"))], names)
        if last is not None:
            first, end, *totals = merge.summary()
            none = pa.array([0], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first]), pa.array([end]), pa.array([False]), *(pa.array([x], pa.int64()) for x in totals), *(pa.nulls(1, last.column(c).type) for c in ("kind", "ref", "said"))], names)

    names = ["part", "first", "last", "edge", *_Merge.COUNTS, "kind", "ref", "said"]
    merged = cut(ranged.select("k", "side", *_Merge.COUNTS, "kind", "ref", "said").mapInArrow(run, f"part int, first string, last string, edge boolean, {sums}, kind string, ref {ref_type}, said timestamp_ntz"))
    carry = _carried([tuple(r) for r in merged.filter("first is not null").select("part", "first", "last", *_Merge.COUNTS).collect()])  # a row per partition
    rows = merged.filter("first is null")
    if carry:
        into = spark.createDataFrame(carry, "part int, c_known long, c_begun long, c_opens long")
        rows = rows.join(F.broadcast(into), "part", "left")
        rows = rows.select("kind", "ref", "said", *((F.col(c) + F.when(F.col("edge"), F.coalesce(f"c_{c}", F.lit(0))).otherwise(0)).alias(c) for c in _Merge.COUNTS))
    state = F.when(F.col("known") == 0, "missing").when(F.col("begun") == 0, "late").otherwise("deleted")
    return rows.filter("opens <= 0").select("ref", "kind", F.col("said").alias("at"), state.alias("state"))


def _named(name, *types):
    """The canonical forms of name and types, and whether the name is not blank; each is derived once, as what an array holds."""
    c = canonical(name)
    return [c.alias("cname"), *(canonical(t).alias(a) for t, a in types), ((c != "") | ~is_blank(name)).alias("said")]


def relation_ends(relations: DataFrame) -> DataFrame:
    """Both non-blank ends of each relation in one pass: (kind, key, at, ref(relation_id, side))."""
    ends = F.array(*[F.struct(F.lit(s).alias("side"), *_named(F.col(s), (F.col(f"{s}_type"), "ctype"))) for s in ("source", "target")])
    flat = relations.select("relation_id", F.col("created_at").cast("timestamp_ntz").alias("at"), F.inline(ends)).filter("said")
    paper = F.col("ctype") == "paper"
    key = F.when(paper, F.col("cname")).otherwise(canonical_pair(F.col("cname"), F.col("ctype")))
    return flat.select(F.when(paper, "paper").otherwise("entity").alias("kind"), key.alias("key"), "at", F.struct("relation_id", "side").alias("ref"))


def known_parents(entities: DataFrame, nodes: DataFrame, papers: DataFrame) -> DataFrame:
    """(kind, key, valid_from, valid_to) of the flat tables; nodes were always there."""
    none = F.lit(None).cast("timestamp_ntz")

    def rows(df: DataFrame, kind: str, name: str, type_: str | None, since, until) -> DataFrame:
        flat = df.select(since.cast("timestamp_ntz").alias("valid_from"), until.cast("timestamp_ntz").alias("valid_to"), F.inline(F.array(F.struct(*_named(F.col(name), (F.col(type_) if type_ else F.lit(""), "ctype")))))).filter("said")
        key = canonical_pair(F.col("cname"), F.col("ctype")) if type_ else F.col("cname")
        return flat.select(F.lit(kind).alias("kind"), key.alias("key"), "valid_from", "valid_to")

    e = rows(entities, "entity", "name", "type", F.col("extracted_at"), F.col("deleted_at"))
    n = rows(nodes, "entity", "name", "node_type", _ts(ALWAYS), none)
    return e.unionByName(n).unionByName(rows(papers, "paper", "title", None, F.col("ingested_at"), none))


def p4_orphans(spark: SparkSession, d: str) -> DataFrame:
    found = find_orphans(relation_ends(read(spark, d, "relations")), known_parents(read(spark, d, "entities"), read(spark, d, "nodes"), read(spark, d, "papers")))
    return found.select("ref.relation_id", "ref.side", F.col("state").alias("kind"), F.date_format("at", "yyyy-MM").alias("period"), F.when(F.col("kind") == "paper", "papers").otherwise("entities").alias("referred_to"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """(relation_id, side, kind, period) of every orphan end."""
    return p4_orphans(spark, d).drop("referred_to")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table referred to, month and kind."""
    return p4_orphans(spark, d).groupBy("referred_to", "period", "kind").agg(F.count("*").alias("orphans"))


_CANON = r"replace(lower(upper(regexp_replace(coalesce({0}, ''), '[\s\p{{Z}}\p{{P}}\p{{C}}$+<=>^`|~]+', '', 'g'))), 'ß', 'ss')"


def sql_canon(x: str) -> str:
    return _CANON.format(x)


def sql_key(a: str, b: str) -> str:
    x, y = sql_canon(a), sql_canon(b)
    return f"concat(least({x}, {y}), chr(1), greatest({x}, {y}))"


def sql_not_blank(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '[\s\p{{Z}}\p{{C}}]+', '', 'g') <> ''"


_P4 = f"""
WITH ends AS (
  SELECT relation_id, 'source' AS side, source AS name, source_type AS type, created_at FROM relations
  UNION ALL SELECT relation_id, 'target', target, target_type, created_at FROM relations),
refs AS (
  SELECT relation_id, side, created_at, {sql_canon('type')} = 'paper' AS paper,
    CASE WHEN {sql_canon('type')} = 'paper' THEN {sql_canon('name')} ELSE {sql_key('name', 'type')} END AS k
  FROM ends WHERE {sql_not_blank('name')}),
parents AS (
  SELECT false AS paper, {sql_key('name', 'type')} AS k, extracted_at AS f, deleted_at AS t FROM entities WHERE {sql_not_blank('name')}
  UNION ALL SELECT false, {sql_key('name', 'node_type')}, TIMESTAMP '0001-01-01', NULL FROM nodes WHERE {sql_not_blank('name')}
  UNION ALL SELECT true, {sql_canon('title')}, ingested_at, NULL FROM papers WHERE {sql_not_blank('title')}),
judged AS (
  SELECT r.relation_id, r.side, r.paper, r.created_at,
    count(p.k) AS n, count(*) FILTER (p.f <= r.created_at) AS begun,
    count(*) FILTER (p.f <= r.created_at AND (p.t IS NULL OR p.t > r.created_at)) AS known
  FROM refs r LEFT JOIN parents p ON r.paper = p.paper AND r.k = p.k GROUP BY ALL)
"""
_STATE = "CASE WHEN n = 0 THEN 'missing' WHEN begun = 0 THEN 'late' ELSE 'deleted' END"

SQL = {
    "p4_found": _P4 + f"SELECT relation_id, side, {_STATE} AS kind, strftime(created_at, '%Y-%m') AS period FROM judged WHERE known = 0",
    "p4_report": _P4 + f"SELECT CASE WHEN paper THEN 'papers' ELSE 'entities' END AS referred_to, strftime(created_at, '%Y-%m') AS period, {_STATE} AS kind, count(*) AS orphans FROM judged WHERE known = 0 GROUP BY ALL",
}
QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
