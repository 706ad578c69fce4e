"""Filling containers with items: variable-capacity best fit, planned on the histogram of sizes.

Sizes are integers up to the largest capacity, so the whole corpus is described by one histogram of bounded length. Best fit
in decreasing order of size is run on that histogram, with classes of equal items and of equally filled bins in place of
single ones: a class takes the tightest open bins it fits in, and when none is left it opens bins. All permitted lengths are
tried at each opening: the remaining histogram is let into one bin of that length, largest sizes first, and the length whose
bin, downsized to its contents, costs least per token is opened. At the end each bin is downsized to the least permitted
length that holds its contents. The same is planned with each length alone, and the plan of least cost is carried out. The plan (which ranks of which size go to which bins) is small; the items look their bin up by their size and
their rank within it, which is counted in salted parts, so no size class is ever in one task.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.tokenize import VOCABULARY, encode
from loomgraph.runtime import cut, read

#: Permitted container lengths in tokens; nothing is longer than the largest.
LENGTHS = tuple(range(256, 2049, 256))
#: Tokens that a container costs besides its length.
OVERHEAD = 16


def cost(bins: list[tuple], overhead: int = OVERHEAD) -> int:
    """Tokens that the bins of a plan cost, room and overhead included."""
    return sum(n * (length + overhead) for _, n, length, _ in bins)


def plan(histogram: dict[int, int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> tuple[list[tuple], list[tuple]]:
    """The cheapest of the joint plan and those that open one length only (see fill_bins for what they hold)."""
    largest = max(histogram, default=0)
    plans = [fill_bins(histogram, lengths, overhead)] + [fill_bins(histogram, lengths, overhead, only=x) for x in lengths if x >= largest]
    return min(plans, key=lambda p: cost(p[1], overhead))


def fill_bins(histogram: dict[int, int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, only: int | None = None) -> tuple[list[tuple], list[tuple]]:
    """histogram: size -> items -> (segments, bins). only: the one length that bins are opened with.

    segments: (size, lo, hi, first_bin, per): of the items of that size those ranked lo..hi-1 (from 0) go `per` to a bin,
    from first_bin on. bins: (first_bin, count, length, used) of equally filled bins.
    """
    lengths = tuple(sorted(lengths))
    free: list[tuple[int, int]] = []  # (room, first bin), sorted
    groups: dict[int, list[int]] = {}  # first bin -> [count, length, used]
    segments: list[tuple] = []
    bins = 0
    volume = sum(s * n for s, n in histogram.items())

    def put(first: int, count: int, size: int, lo: int, n: int, per: int) -> None:
        """n items into the first bins of a group that is in no list: the full ones, one partly filled, the untouched."""
        _, length, used = groups.pop(first)
        segments.append((size, lo, lo + n, first, per))
        full, rest = divmod(n, per)
        for at, k, more in ((first, full, per), (first + full, 1 if rest else 0, rest), (first + full + bool(rest), count - full - bool(rest), 0)):
            if k:
                groups[at] = [k, length, used + more * size]
                insort(free, (length - used - more * size, at))

    sizes = sorted(histogram)

    def filled(length: int, at: int, left: int) -> int:
        """Tokens that one bin of this length holds, if the largest remaining sizes that fit are let in first."""
        room, n = length, left
        while True:
            room -= sizes[at] * min(n, room // sizes[at])
            at = bisect_right(sizes, room, 0, at) - 1
            if at < 0:
                return length - room
            n = histogram[sizes[at]]

    def per_token(length: int, at: int, left: int) -> tuple[float, int]:
        used = filled(length, at, left)
        return (next(x for x in lengths if x >= used) + overhead) / used, -length

    for at in range(len(sizes) - 1, -1, -1):
        size = sizes[at]
        left, lo = histogram[size], 0
        while left:
            i = bisect_left(free, (size, -1))
            if i < len(free):
                room, first = free.pop(i)
            else:
                length = only or min((x for x in lengths if x >= size), key=lambda x: per_token(x, at, left))
                first, count = bins, -(-left // (length // size))
                if volume < length * count:
                    count = min(count, max(1, volume // length))
                bins += count
                groups[first] = [count, length, 0]
                room = length
            count, per = groups[first][0], room // size
            n = min(left, count * per)
            put(first, count, size, lo, n, per)
            left, lo, volume = left - n, lo + n, volume - n * size
    out = [(first, count, next(x for x in lengths if x >= used), used) for first, (count, _, used) in sorted(groups.items())]
    return segments, out


def split_long(items: DataFrame, largest: int) -> DataFrame:
    """items(doc_id, tokens) -> (doc_id, piece, token_start, size): longer ones in pieces of `largest` and a rest, others whole."""
    pieces = F.greatest(F.ceil(F.col("tokens") / largest), F.lit(1)).cast("int")
    rows = items.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    start = F.col("piece").cast("long") * largest
    return rows.select("doc_id", "piece", start.alias("token_start"), F.least(F.col("tokens") - start, F.lit(largest)).cast("int").alias("size"))


def pack(items: DataFrame, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, salts: int | None = None) -> DataFrame:
    """items(doc_id, tokens) -> (container_id, capacity, doc_id, piece, token_start, size), one row per piece.

    Only items longer than the largest length are split. Items without tokens (null counts as 0) need no container: they
    have one row with container_id and capacity null. doc_id repeated means separate items. An empty table gives no rows.
    """
    spark = items.sparkSession
    pieces = cut(split_long(items.select("doc_id", F.coalesce("tokens", F.lit(0)).alias("tokens")), max(lengths)).withColumn("_id", F.monotonically_increasing_id()))
    sizes = {r["size"]: r["count"] for r in pieces.groupBy("size").count().collect()}  # at most max(lengths) + 1 rows
    empty = pieces.filter("size = 0").select(F.lit(None).cast("long").alias("container_id"), F.lit(None).cast("int").alias("capacity"), "doc_id", "piece", "token_start", "size")
    sizes.pop(0, None)
    if not sizes:
        return empty
    segments, bins = plan(sizes, lengths, overhead)
    salts = salts or max(8, sum(sizes.values()) // 1_000_000)
    salted = pieces.filter("size > 0").withColumn("salt", F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("size", "salt").count().select("size", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("off"))
    ranked = salted.withColumn("in", F.row_number().over(Window.partitionBy("size", "salt").orderBy("_id"))).join(offsets, ["size", "salt"])
    ranked = ranked.withColumn("rank", F.col("off") + F.col("in") - 1).drop("in", "off", "salt", "_id")
    # both tables follow the plan, whose length depends on the number of sizes, not of items
    where = spark.createDataFrame(segments, "size int, lo long, hi long, first_bin long, per int")
    placed = ranked.join(F.broadcast(where), (ranked["size"] == where["size"]) & (ranked["rank"] >= where["lo"]) & (ranked["rank"] < where["hi"])).drop(where["size"])
    placed = placed.withColumn("container_id", F.col("first_bin") + F.floor((F.col("rank") - F.col("lo")) / F.col("per")))
    kinds = spark.createDataFrame([(a, a + n, c) for a, n, c, _ in bins], "from_bin long, to_bin long, capacity int")
    starts = sorted(a for a, _, _, _ in bins)
    return _with_capacity(placed, kinds, starts).select("container_id", "capacity", "doc_id", "piece", "token_start", "size").unionByName(empty)


def _with_capacity(placed: DataFrame, kinds: DataFrame, starts: list[int]) -> DataFrame:
    """Adds the capacity of each container; ranges of bins meet by blocks, so that the join is on equality."""
    width = max(1, starts[-1] // max(1, len(starts)) + 1)
    blocks = kinds.withColumn("block", F.explode(F.sequence(F.floor(F.col("from_bin") / width), F.floor((F.col("to_bin") - 1) / width))))
    keyed = placed.withColumn("block", F.floor(F.col("container_id") / width))
    joined = keyed.join(F.broadcast(blocks), "block").filter("container_id >= from_bin and container_id < to_bin")
    return joined.drop("block", "from_bin", "to_bin")


def document_sizes(spark: SparkSession, d: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return encode(read(spark, d, "documents"), vocabulary, keep="count")


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or piece of a longer one, with its container of at most 2,048 tokens."""
    return pack(document_sizes(spark, d))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers by capacity, with tokens used and room."""
    per = p9_packed(spark, d).filter("container_id is not null").groupBy("container_id", "capacity").agg(F.sum("size").alias("used"))
    return per.groupBy("capacity").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), (F.sum("capacity") - F.sum("used")).alias("unused"))


def p9_policies(spark: SparkSession, d: str) -> DataFrame:
    """What the joint choice of lengths gains: containers, capacity and unused tokens by policy, with every length alone beside it."""
    pieces = split_long(document_sizes(spark, d).select("doc_id", F.coalesce("tokens", F.lit(0)).alias("tokens")), max(LENGTHS))
    sizes = {r["size"]: r["count"] for r in pieces.filter("size > 0").groupBy("size").count().collect()}
    largest, volume = max(sizes, default=0), sum(s * n for s, n in sizes.items())
    rows = []
    for policy, only in [("joint", None), *((f"only {x}", x) for x in LENGTHS if x >= largest)]:
        bins = fill_bins(sizes, only=only)[1]
        capacity = sum(n * length for _, n, length, _ in bins)
        rows.append((policy, sum(n for _, n, _, _ in bins), capacity, capacity - volume, cost(bins)))
    return spark.createDataFrame(rows, "policy string, containers long, capacity long, unused long, cost long")


QUERIES = {"p9_packed": p9_packed, "p9_fill": p9_fill, "p9_policies": p9_policies}
SQL: dict[str, str] = {}
