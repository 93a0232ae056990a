"""Shards of near equal bytes by histogram sort.

Equal texts make one item, kept whole in one shard. The order of items is the order of 64-bit keys. For the borders
between shards, exact bytes are counted below evenly spaced probes of the key space in every partition at once; each
border's interval is then probed anew, 4,096 times finer, until one probe's bytes are within the tolerance or a single
key is left. Then every row knows its shard and all rows are exchanged once.

Two kinds of items are placed before, so that no border has to fall into them: items above the tolerance (at most
shards / TOLERANCE of them, a bound by arithmetic) go to the shard with the least bytes, largest first. Those that no
shard has room for whole - a group of copies may hold a third of all rows - are dealt row by row, by a histogram sort
of their own over hashes of rows. The borders of all other items then fill what is left.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from docaudit.llm import batches
from docaudit.session import scratch

SHARDS = 40
#: Bytes that a row counts beside its text.
ROW_BYTES = 16
#: Share of a shard above which an item is placed by itself; no border is farther from its aim than half of it.
TOLERANCE = 0.01
#: Bits by which one round of probes refines an interval, and bits of a key.
PROBE_BITS, KEY_BITS = 12, 60
#: Rows that one task numbers, on average.
ROWS_PER_TASK = 100_000


def size_of(text: Column) -> Column:
    """UTF-8 bytes, none for null, and ROW_BYTES."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + ROW_BYTES


def _key(*columns: Column | str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(17), *columns), 64 - KEY_BITS)


def borders(items: DataFrame, aims: list[int]) -> list[int]:
    """For each aim (bytes, ascending) a key: the items below it have the bytes next to the aim that keys can give.

    items has key (below 2 ** KEY_BITS) and size. Every round counts bytes below all probes exactly.
    """
    slack = TOLERANCE * max(np.diff([0, *aims]).max(initial=0), 1) / 8
    found: dict[int, int] = {}
    open_ = {k: (0, 0) for k in range(len(aims))}  # number of the interval at this depth, bytes below it
    for depth in range(PROBE_BITS, KEY_BITS + 1, PROBE_BITS):
        parent = F.shiftright("key", KEY_BITS - depth + PROBE_BITS)
        within = sorted({own for own, _ in open_.values()})
        probed = items.where(parent.isin(within)) if depth > PROBE_BITS else items
        counted = probed.groupBy(F.shiftright("key", KEY_BITS - depth).alias("slot")).agg(F.sum("size").alias("size"))
        # At most 4,096 rows for each border.
        sizes: dict[int, list[tuple[int, int]]] = {}
        for slot, size in sorted(map(tuple, counted.collect())):
            sizes.setdefault(slot >> PROBE_BITS, []).append((slot, size))
        for k, (own, below) in list(open_.items()):
            for slot, size in sizes.get(own, []):
                if below + size >= aims[k]:
                    if size <= slack or depth == KEY_BITS:
                        found[k] = (slot if aims[k] - below <= below + size - aims[k] else slot + 1) << (KEY_BITS - depth)
                    else:
                        open_[k] = (slot, below)
                    break
                below += size
            else:
                found[k] = (own + 1) << (KEY_BITS - depth + PROBE_BITS)
            if k in found:
                del open_[k]
        if not open_:
            break
    return [found[k] for k in range(len(aims))]


def place_whole(heavy: list[tuple[int, int, int]], shards: int, total: int) -> tuple[dict[int, int], list[int], list[int]]:
    """(hash, bytes, rows) of items: shard by hash, hashes of those no shard has room for, and bytes placed in each shard.

    The largest come first, each goes to the shard with the least bytes. A single row goes somewhere in any case.
    """
    loads = [(0, k) for k in range(shards)]
    placed, split = {}, []
    room = total / shards * (1 + TOLERANCE)
    for h, size, rows in sorted(heavy, key=lambda x: (-x[1], x[0])):
        load, k = loads[0]
        if rows > 1 and load + size > room:
            split.append(h)
        else:
            heapq.heapreplace(loads, (load + size, k))
            placed[h] = k
    return placed, split, [load for load, _ in sorted(loads, key=lambda x: x[1])]


def _aims(loads: list[int], total: int) -> list[int]:
    """Bytes below each inner border, if `total` more fill the shards so that the least full end equal."""
    high = sorted(loads)
    level = next(top for n in range(len(high), 0, -1) if (top := (total + sum(high[:n])) / n) >= high[n - 1])
    return [round(x) for x in itertools.accumulate(max(0.0, level - load) for load in loads)][:-1]


def _by_key(key: Column, bounds: list[int]) -> Column:
    """The number of bounds at or below the key."""
    if not bounds:
        return F.lit(0)
    ordered = F.array(*(F.lit(b).cast("bigint") for b in bounds))
    return F.size(F.filter(ordered, lambda b: b <= key))


def shards(docs: DataFrame, count: int = SHARDS) -> DataFrame:
    """docs with size (bigint), shard (int, 0 to count - 1) and slot (bigint, gapless from 0 in each shard).

    Null text counts no bytes and makes one item with other null texts, the empty text another. Repeated rows are rows
    of their own and equal texts. An empty table stays empty; with fewer items than shards some shards have no row.
    Equal texts share a shard, unless they are more than a shard has room for. Columns size, shard and slot of the
    input are replaced; any others stay. Rows within a shard come in the order of a hash.
    """
    docs = docs.drop("size", "shard", "slot")
    item, row, key, place, part = (batches.free_name(docs, c) for c in ("item", "row", "key", "place", "part"))
    spark = docs.sparkSession
    with_item = docs.withColumn("size", size_of(F.col("text"))).withColumn(item, F.xxhash64("text")).withColumn(row, F.monotonically_increasing_id())
    with scratch(spark) as kept:
        # The sizes and hashes alone are what the histograms read, again and again.
        items = kept(with_item.select("size", F.col(item).alias("item"), F.col(row).alias("row")))
        total, n = items.agg(F.sum("size"), F.count("*")).first()
        limit = TOLERANCE * (total or 0) / count
        # Their bytes sum up to the total at most: no more than count / TOLERANCE rows.
        heavy = items.groupBy("item").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).where(F.col("size") > limit).collect() if n else []
        placed, split, loads = place_whole([tuple(x) for x in heavy], count, total or 0)
        named = spark.createDataFrame([(h, k) for h, k in placed.items()] + [(h, None) for h in split], T.StructType([T.StructField("item", T.LongType()), T.StructField("shard", T.IntegerType())]))
        named = F.broadcast(named.withColumn("heavy", F.lit(True)))
        joined = items.join(named, "item", "left")
        spread = joined.where("heavy AND shard IS NULL").select(_key("row").alias("key"), "size")
        split_bounds: list[int] = []
        if split:
            aims = _aims(loads, spread.agg(F.sum("size")).first()[0])
            split_bounds = borders(spread, aims)
            for k, size in spread.groupBy(_by_key(F.col("key"), split_bounds).alias("k")).agg(F.sum("size")).collect():
                loads[k] += size
        light = joined.where("heavy IS NULL").select(_key("item").alias("key"), "size")
        left = light.agg(F.sum("size")).first()[0] or 0
        light_bounds = borders(light, _aims(loads, left)) if left else []
    named = named.withColumnsRenamed({"item": part, "shard": place, "heavy": key})
    found = with_item.join(named, F.col(item) == F.col(part), "left")
    shard = F.when(F.col(key).isNull(), _by_key(_key(item), light_bounds)).when(F.col(place).isNull(), _by_key(_key(row), split_bounds)).otherwise(F.col(place))
    # Rows of a shard are numbered in parts of bounded size: any hash of rows deals them evenly, whatever the texts.
    parts = max(1, -(-(n or 0) // (ROWS_PER_TASK * count)))
    out = found.withColumn("shard", shard.cast("int")).drop(place, key, part).withColumn(part, F.pmod(F.xxhash64(F.lit(29), row), F.lit(parts)).cast("int"))
    sizes = out.groupBy("shard", part).agg(F.count("*").alias(place))
    first = F.sum(place).over(W.Window.partitionBy("shard").orderBy(part)) - F.col(place)
    sizes = sizes.select("shard", part, first.alias(key))
    nth = F.row_number().over(W.Window.partitionBy("shard", part).orderBy(F.xxhash64(F.lit(31), row), row))
    numbered = out.withColumn("slot", nth.cast("bigint") - 1).join(sizes, ["shard", part])
    return numbered.withColumn("slot", F.col("slot") + F.col(key)).select(*docs.columns, "size", "shard", "slot")


def write(sharded: DataFrame, folder: str, rows_per_file: int = 1_000_000) -> None:
    """One folder a shard; its files, read by name, hold the rows in the order of slot."""
    file_ = batches.free_name(sharded, "file")
    dealt = sharded.withColumn(file_, F.floor(F.col("slot") / rows_per_file))
    dealt.repartitionByRange("shard", file_).sortWithinPartitions("shard", "slot").drop(file_).write.partitionBy("shard").parquet(folder)
