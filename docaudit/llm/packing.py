"""Best-fit packing of token pieces, certified by dual feasible functions.

Every partition packs its own pieces by best-fit decreasing and bounds from below how many sequences they need at
least. Where both numbers agree the partition is done. Partitions with a gap keep their full sequences and put the
pieces of the others up for exchange; those are dealt anew, over as many partitions as their number asks for, and
packed again. The last round keeps what it finds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm import batches, tokens
from docaudit.session import checkpointed

CAPACITY = 2048
SEPARATOR = 0
#: Bytes of text that are encoded at once.
SLICE_BYTES = 1 << 19
#: Pieces that one task packs, and rounds of exchange.
PIECES_PER_TASK = 20_000
ROUNDS = 4
#: A sequence at least this full is kept when its partition exchanges.
KEPT_SHARE = 0.99


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its tokens and the separator. One longer than the capacity is cut into pieces of just the
    capacity, of which the first may be shorter. Null text is the empty one: a separator alone. Repeated rows are
    documents of their own.
    """

    def run(part, data, offsets):
        ids, at = tokens.encoder(tokenizer).encode(data, offsets)
        doc, nth, begin, size, check, kept = [], [], [], [], [], []
        ids_of = part.column(part.schema.get_field_index("doc_id"))
        for k in range(len(offsets) - 1):
            own = np.empty(at[k + 1] - at[k] + 1, "<u4")
            own[:-1], own[-1] = ids[at[k] : at[k + 1]], SEPARATOR
            cuts = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
            for j, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                doc.append(k), nth.append(j), begin.append(a), size.append(b - a)
                check.append(zlib.crc32(own[a:b].tobytes()))
                if keep_ids:
                    kept.append(own[a:b].astype(np.int32))
        made = {"doc_id": ids_of.take(pa.array(doc, pa.int64())), "piece": pa.array(nth, pa.int32()), "start": pa.array(begin, pa.int64()), "length": pa.array(size, pa.int64()), "ids_crc32": pa.array(check, pa.int64())}
        return batches.record(**made, **({"ids": pa.array(kept, pa.list_(pa.int32()))} if keep_ids else {}))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return batches.map_slices(docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids, limit=SLICE_BYTES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """For each piece its bin and its offset there, and the number of bins; equal lengths go in the given order."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0  # bit r of rooms: a bin with r left
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            bin_ = waiting[room].pop()
            if not waiting[room]:
                rooms &= ~(1 << room)
        else:
            room, bin_, n = capacity, n, n + 1
        bins[i], offsets[i] = bin_, capacity - room
        if left := room - size:
            waiting[left].append(bin_)
            rooms |= 1 << left
    return bins, offsets, n


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins needed at least: the best of three families of dual feasible functions, in whole numbers."""
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True)
    best = -(-int((sizes * counts).sum()) // capacity)
    eps = np.unique(np.minimum(sizes, capacity - sizes))
    for e in eps[(eps > 0) & (2 * eps <= capacity)].tolist():
        # Threshold: the small vanish, and what leaves no room for them counts whole.
        value = np.where(sizes > capacity - e, capacity, np.where(sizes < e, 0, sizes))
        best = max(best, -(-int((value * counts).sum()) // capacity))
        # Halves: small ones rounded down to multiples of e, large ones what the small beside them leave.
        q = capacity // e
        twice = np.where(2 * sizes > capacity, 2 * (q - (capacity - sizes) // e), np.where(2 * sizes == capacity, q, 2 * (sizes // e)))
        best = max(best, -(-int((twice * counts).sum()) // (2 * q)))
    for k in range(1, 21):
        # Rounding to multiples of 1/k.
        value = np.where((k + 1) * sizes % capacity == 0, k * sizes, (k + 1) * sizes // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def pack(cut: DataFrame, capacity: int = CAPACITY, per_task: int = PIECES_PER_TASK, rounds: int = ROUNDS) -> DataFrame:
    """Adds sequence_id and offset to a table with `length`; other columns stay, ones of these names are replaced.

    Lengths are 1 to capacity; nulls in other columns stay, repeated rows are pieces of their own, an empty table stays
    empty. Equal pieces may change places; the number of sequences of a partition does not.
    """
    keep = [c for c in cut.columns if c not in ("sequence_id", "offset")]
    row = batches.free_name(cut, "row")
    # Rows are dealt by a number of their own, so that equal ones do not meet in one task.
    open_ = checkpointed(cut.select(*keep, F.monotonically_increasing_id().alias(row)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in open_.schema)
    settled_ = batches.free_name(cut, "settled")
    schema += f", sequence_id bigint, `offset` bigint, `{settled_}` boolean"
    done, before = [], None
    for nth in range(rounds):
        n = open_.count()
        parts = max(1, -(-n // per_task))
        final = nth + 1 == rounds or parts == 1 == before
        before = parts

        def run(found: Iterator[pa.RecordBatch], nth=nth, final=final) -> Iterator[pa.RecordBatch]:
            held = [b for b in found if b.num_rows]
            if not held:
                return
            rows = pa.Table.from_batches(held).select([*keep, row]).combine_chunks()
            lengths = rows.column("length").to_numpy()
            bins, offsets, count = best_fit_decreasing(lengths, capacity)
            settled = np.ones(len(lengths), bool)
            if not final and count > lower_bound(lengths, capacity):
                settled = (np.bincount(bins, weights=lengths) >= KEPT_SHARE * capacity)[bins]
            number = ((nth << 24) + TaskContext.get().partitionId() << 32) + bins
            for name, column in (("sequence_id", number), ("offset", offsets), (settled_, settled)):
                rows = rows.append_column(name, pa.array(column))
            yield from rows.to_batches(max_chunksize=10_000)

        dealt = open_.repartition(parts, F.xxhash64(F.lit(nth), row))
        packed = checkpointed(dealt.mapInArrow(run, schema))
        done.append(packed.where(F.col(settled_)).drop(settled_, row))
        open_ = packed.where(~F.col(settled_)).select(*keep, row)
        if final or open_.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of every sequence, its pieces in the order of their offsets (pieces made with keep_ids)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
