"""Shards through fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into thousands of slots, bytes are added up per slot, and a
small stored map says which shard holds a slot. Rebalancing edits the latest stored
version only: a new one moves as few slots as it needs, and is stored beside those
before it. Records never change their slot.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postweave.session import scratch_path
from postweave.sources.store import exists

# Fixed for the life of a data set; bounds every table of slots.
SLOTS = 16_384
MAP_SCHEMA = "version int, vslot int, shard int, bytes long"


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot) of ``docs``.

    size is the text's UTF-8 bytes (null: none) plus 1. The slot depends on the
    id alone, and rows with an equal id share one; rows without an id are dealt by
    their text. Other columns of ``docs`` are not read, whatever their names.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(
        docs["doc_id"].alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(
            F.when(docs["doc_id"].isNull(), F.xxhash64(text)).otherwise(F.xxhash64(docs["doc_id"])), F.lit(slots)
        ).cast("int").alias("vslot"),
    )


def slot_sizes(rows: DataFrame) -> DataFrame:
    """(vslot, bytes, rows): at most one row per slot."""
    return rows.groupBy("vslot").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows")
    )


def first_map(shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Version 0: slots dealt round robin, before any size is known."""
    return {s: s % shards for s in range(slots)}


def rebalance(
    placed: dict[int, int], sizes: dict[int, int], shards: int
) -> dict[int, int]:
    """The next version of a map: near equal bytes on shards 0 to shards - 1.

    Slots leave a shard only while it is above the mean, largest first that
    still fits; then the moved slots go, largest first, to the lightest shard.
    Last, pairs of the heaviest and lightest shard exchange slots while that
    narrows the gap. Slots without bytes stay where they are if they can.
    """
    mean = sum(sizes.values()) / shards
    held: dict[int, list[int]] = {k: [] for k in range(shards)}
    loads = dict.fromkeys(range(shards), 0)
    moved = []
    for slot, shard in sorted(placed.items(), key=lambda x: (-sizes.get(x[0], 0), x[0])):
        size = sizes.get(slot, 0)
        if shard < shards and loads[shard] + size <= mean:
            held[shard].append(slot)
            loads[shard] += size
        else:
            moved.append(slot)
    heap = [(load, k) for k, load in loads.items()]
    heapq.heapify(heap)
    for slot in moved:
        load, k = heapq.heappop(heap)
        held[k].append(slot)
        loads[k] = load + sizes.get(slot, 0)
        heapq.heappush(heap, (loads[k], k))
    while _exchange(held, loads, sizes):
        pass
    return {slot: k for k, own in held.items() for slot in own}


def _exchange(held, loads, sizes) -> bool:
    """One move or swap between the heaviest and the lightest shard, if it helps."""
    high = max(loads, key=lambda k: (loads[k], -k))
    low = min(loads, key=lambda k: (loads[k], k))
    gap = loads[high] - loads[low]
    own = sorted(held[low], key=lambda s: (sizes.get(s, 0), s))
    values = [sizes.get(s, 0) for s in own]
    best = None
    for slot in held[high]:
        size = sizes.get(slot, 0)
        want = size - gap / 2  # size of the slot that should come back
        choices = [(abs(gap - 2 * size), None)] if size else []
        at = bisect_left(values, want)
        choices += [(abs(gap - 2 * (size - values[i])), own[i]) for i in (at - 1, at) if 0 <= i < len(own)]
        for left, back in choices:
            if best is None or left < best[0]:
                best = (left, slot, back)
    if best is None or best[0] >= gap:
        return False
    _, slot, back = best
    for a, b, s in ((high, low, slot), (low, high, back)):
        if s is not None:
            held[a].remove(s)
            held[b].append(s)
            loads[a] -= sizes.get(s, 0)
            loads[b] += sizes.get(s, 0)
    return True


def latest_map(spark: SparkSession, path: str) -> tuple[int, dict[int, int]] | None:
    """The newest stored version and its slots' shards, one number per slot."""
    if not exists(spark, path):
        return None
    stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    version = stored.agg(F.max("version")).first()[0]
    rows = stored.filter(F.col("version") == version).select("vslot", "shard").collect()
    return version, {r.vslot: r.shard for r in rows}


def store_map(spark: SparkSession, path: str, version: int, placed: dict[int, int], sizes: dict[int, int]) -> None:
    """Store a version once; the versions before it stay."""
    rows = [(slot, shard, sizes.get(slot, 0)) for slot, shard in sorted(placed.items())]
    table = spark.createDataFrame(rows, "vslot int, shard int, bytes long")
    table.coalesce(1).write.parquet(f"{path}/version={version}")


def balanced_map(
    spark: SparkSession, rows: DataFrame, shards: int, path: str, slots: int = SLOTS
) -> tuple[DataFrame, int]:
    """The stored map (version, vslot, shard, bytes), and the version for ``rows``.

    The latest version at ``path`` is edited until the bytes of ``rows`` are near
    equal over ``shards`` shards; a version is added only if a slot has moved.
    Without any, version 0 deals the slots round robin. The driver sees one number
    per slot, ``slots`` at most.
    """
    sizes = {r["vslot"]: r["bytes"] for r in slot_sizes(rows).collect()}
    if latest_map(spark, path) is None:
        store_map(spark, path, 0, first_map(shards, slots), {})
    version, placed = latest_map(spark, path)
    edited = rebalance(placed, sizes, shards)
    if edited != placed:
        version += 1
        store_map(spark, path, version, edited, sizes)
    return spark.read.schema(MAP_SCHEMA).parquet(path), version


def assign(rows: DataFrame, placed: DataFrame, version: int) -> DataFrame:
    """``rows`` with shard and slot, the place in the shard, gapless from 0.

    Rows are numbered inside their virtual slot by id, checksum and size, and
    shifted by the rows of the shard's earlier slots; no shard is ever gathered.
    An empty table gives an empty result.
    """
    used = placed.filter(F.col("version") == version).select("vslot", "shard")
    counts = rows.groupBy("vslot").agg(F.count(F.lit(1)).alias("n")).join(used, "vslot")
    # One row per slot: this window is bounded by the number of slots.
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "vslot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    own = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("at", F.row_number().over(own) - 1)
    # Bounded by the number of slots as well, whatever the input.
    return numbered.join(F.broadcast(starts), "vslot").withColumn(
        "slot", (F.col("start") + F.col("at")).cast("long")
    ).drop("at", "start")


def shards(
    spark: SparkSession, docs: DataFrame, n: int = 16, slots: int = SLOTS, path: str | None = None
) -> DataFrame:
    """Every row of ``docs`` with its shard under the byte-balanced map.

    ``path`` is the folder of the map's versions, which a later run goes on from; a
    new one in the shared folder if not given.
    """
    rows = records(docs, slots)
    placed, version = balanced_map(spark, rows, n, path or scratch_path(spark, "slot-map"), slots)
    return assign(rows, placed, version)
