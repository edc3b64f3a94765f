"""Filling containers of fixed capacity by bulk-synchronous best-fit.

Items go by bands of size, largest first. In a round the gaps of all started containers offer themselves to a band: a
gap that certainly holds several of its items as that many equal slots, any other as one. Items and slots are sorted by
size together, and all items look for their successor at once, the smallest slot that holds them. Conflicts are resolved
by rank: a slot gets the item next below it that no slot between them gets, as brackets pair. Then the gaps are updated
and the round is repeated with what is left. Before a round, containers are opened for as many items as would find no
slot: the least number these need, by their number or their volume.

Which brackets pair follows from ranks alone: an item or slot has a level, how many items wait before or after it, and
on each level the k-th item meets the k-th slot. Ranks are sums over counts per size (a whole number up to the capacity)
and bucket of the key, so the sweep is over counts per size, and everything that grows with the data is a grouped window
or an equi-join. A level has at most one item and one slot of a size. The number of rounds grows with the logarithm of
the number of items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landweave.session import cut_lineage


def bands(capacity: int) -> list[tuple[int, int]]:
    """(least, greatest) size of each band: halves, then three quarters, then quarters from a sixteenth of the capacity."""
    out, high = [], capacity
    while high > 0:
        low = (high // 2 if high == capacity else high * 3 // 4 if high * 16 > capacity else high // 4) + 1
        low = min(low, high)
        out.append((low, high))
        high = low - 1
    return out


def sorted_groups(items: DataFrame, slots: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Rows (k1, k2, size, is_slot, _b) of items and slots, and their groups in order of size, items first, and bucket.

    Groups have ``_n`` rows and, from those before them, ``items``, ``slots`` and ``idle``, minus how many slots have no
    item. There are at most two per bucket and whole number up to the capacity, whatever the data."""
    rows = items.select(F.col("doc_id").alias("k1"), F.col("piece").alias("k2"), "size", F.lit(0).alias("is_slot")).unionByName(slots.select(F.col("container").alias("k1"), F.col("slot").alias("k2"), "size", F.lit(1).alias("is_slot")))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("k1", "k2"), F.lit(buckets)).cast("int"))
    before = W.orderBy("size", "is_slot", "_b").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy("size", "is_slot", "_b").agg(F.count(F.lit(1)).alias("_n"))
    summed = counts.select("*", *[F.coalesce(F.sum(F.when(F.col("is_slot") == k, F.col("_n"))).over(before), F.lit(0)).alias(c) for k, c in enumerate(("items", "slots"))])
    after = F.col("items") - F.col("slots") + F.when(F.col("is_slot") == 0, F.col("_n")).otherwise(-F.col("_n"))
    return rows, summed.withColumn("_after", after).withColumn("idle", F.least(F.coalesce(F.min("_after").over(before), F.lit(0)), F.lit(0)))


def slots_of(gaps: DataFrame, low: int, high: int) -> DataFrame:
    """(container, size, slot): what the gaps offer to items from ``low`` to ``high``."""
    n = F.greatest(F.floor(F.col("gap") / high), F.lit(1)).cast("int")
    return gaps.where(F.col("gap") >= low).select("container", F.floor(F.col("gap") / n).cast("int").alias("size"), F.explode(F.sequence(F.lit(1), n)).alias("slot"))


def without_slot(items: DataFrame, slots: DataFrame) -> tuple[int, int, int]:
    """How many items there are, how many find no slot, and their volume if they are as large as the others."""
    of_items = F.when(F.col("is_slot") == 0, F.col("_n"))
    _, groups = sorted_groups(items, slots, 1)
    row = groups.agg(F.sum(of_items), F.sum(of_items * F.col("size")), F.sum(F.when(F.col("is_slot") == 1, F.col("_n")).otherwise(0)), F.least(F.min("_after"), F.lit(0))).first()
    if not row[0]:
        return 0, 0, 0
    number = row[0] - row[2] - row[3]
    return row[0], number, -(-number * row[1] // row[0])


def match(items: DataFrame, slots: DataFrame, buckets: int) -> DataFrame:
    """Items (doc_id, piece, size) with the container they go to, null where no slot is left for them."""
    rows, groups = sorted_groups(items, slots, buckets)
    nth = F.row_number().over(W.partitionBy("size", "is_slot", "_b").orderBy("k1", "k2"))
    placed = rows.withColumn("_nth", nth).join(F.broadcast(groups.drop("_n", "_after")), ["size", "is_slot", "_b"])
    level = F.col("items") - F.col("slots") - F.col("idle") + F.when(F.col("is_slot") == 0, F.col("_nth")).otherwise(1 - F.col("_nth"))
    # on a level items and slots take turns; a slot that no item waits for has none
    then = W.partitionBy("_level").orderBy("size", "is_slot")
    turns = placed.withColumn("_level", level).where("_level > 0").select("k1", "k2", "size", "is_slot", F.lead(F.when(F.col("is_slot") == 1, F.col("k1"))).over(then).alias("container"))
    return turns.where("is_slot = 0").select(F.col("k1").alias("doc_id"), F.col("k2").alias("piece"), "size", "container")


def numbered(rows: DataFrame, key: list[str], number: str, buckets: int) -> DataFrame:
    """Adds ``number``, from 0, in order of a bucket of the key and the key."""
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    before = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select("_b", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    nth = F.row_number().over(W.partitionBy("_b").orderBy(*key)) - 1
    return rows.withColumn("_r", nth).join(F.broadcast(before), "_b").withColumn(number, (F.col("_r") + F.col("_before")).cast("long")).drop("_b", "_r", "_before")


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, size): documents beyond the capacity in full pieces and a rest, all others whole."""
    full, rest = F.floor(F.col("n_tokens") / capacity), F.col("n_tokens") % capacity
    n = F.when(F.col("n_tokens") <= capacity, F.lit(1)).otherwise(full + F.when(rest > 0, 1).otherwise(0))
    cut = sizes.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("piece"))
    return cut.select("doc_id", F.col("piece").cast("int").alias("piece"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).cast("int").alias("size"))


def pack(sizes: DataFrame, capacity: int = 2048, buckets: int = 64) -> DataFrame:
    """(doc_id, piece, container, position, size) of documents (doc_id, n_tokens).

    Every document is placed, those without tokens too, which are dealt evenly over the containers; only documents of
    more than ``capacity`` are split. A null size counts as 0. Ties and the input's order don't matter as long as
    (doc_id, n_tokens) tells rows apart; an empty table gives no rows."""
    spark = sizes.sparkSession
    sizes = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
    items = cut_lineage(pieces(sizes, capacity))
    gaps = spark.createDataFrame([], "container bigint, gap int, n int")
    placed, opened, held = [], 0, {r[0] for r in items.select("size").distinct().collect()}  # at most capacity + 1 numbers

    for low, high in bands(capacity):
        if not any(low <= s <= high for s in held):
            continue
        left = items.where(F.col("size").between(low, high))
        most = capacity // low  # of a band's items in a container
        while True:
            count, number, volume = without_slot(left, slots_of(gaps, low, high))
            if not count:
                break
            if number:
                new = max(-(-number // most), -(-volume // capacity))
                gaps = gaps.unionByName(spark.range(opened, opened + new).select(F.col("id").alias("container"), F.lit(capacity).alias("gap"), F.lit(0).alias("n")))
                opened += new
            done = cut_lineage(match(left, slots_of(gaps, low, high), buckets))
            got = done.where("container is not null")
            placed.append(got)
            filled = got.groupBy("container").agg(F.sum("size").cast("int").alias("_s"), F.count(F.lit(1)).cast("int").alias("_n"))
            gaps = cut_lineage(gaps.join(filled, "container", "left").select("container", (F.col("gap") - F.coalesce("_s", F.lit(0))).alias("gap"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n")))
            left = done.where("container is null").drop("container")

    out = items.where("1 = 0").withColumn("container", F.lit(0).cast("long"))
    for got in placed:
        out = out.unionByName(got)
    # a container holds at most ``capacity`` items with tokens; those without come behind them, counted by their rank
    position = F.row_number().over(W.partitionBy("container").orderBy(F.desc("size"), "doc_id", "piece")) - 1
    out = out.select("doc_id", "piece", "container", position.cast("int").alias("position"), "size")
    if 0 in held:
        used = gaps.where("n > 0")
        n = max(1, used.count())
        boxes = numbered(used.select("container", "n"), ["container"], "_k", buckets)
        empty = numbered(items.where("size = 0"), ["doc_id", "piece"], "_e", buckets).withColumn("_k", F.col("_e") % n)
        behind = (F.coalesce("n", F.lit(0)) + F.floor(F.col("_e") / n)).cast("int")
        out = out.unionByName(empty.join(boxes, "_k", "left").select("doc_id", "piece", F.coalesce("container", F.lit(0)).cast("long").alias("container"), behind.alias("position"), "size"))
    return out
