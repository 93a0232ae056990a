"""Substring dedup: windows of words that an earlier document has are removed, found by an FM-index for each shard.

Every window of 13 words goes to the shard that the least hash of its three-word grams names, so that equal windows
meet; neighbouring windows with the same least hash travel as one fragment of text. Within a slice of the input equal
fragments are merged first: only the one of the least doc_id travels, the others are decided on the spot. A shard drops
fragments that stand alone, indexes the rest, and streams them through the index: the least document of each window
tells which intervals go.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm import batches, words
from docaudit.llm.fm_index import WindowIndex

WINDOW = 13
GRAM = 3
#: Bytes of text in one slice of the input, and about so many of the input's bytes for each shard.
SLICE_BYTES = 6 << 20
SHARD_BYTES = 4 << 20
#: A run of windows with one least hash is cut into fragments of at most so many.
LONGEST = 64
#: Stands for a null doc_id: after all others.
NULL_ID = (1 << 63) - 1
U64 = np.uint64


@functools.cache
def _zstd() -> pa.Codec:
    return pa.Codec("zstd", compression_level=6)


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    span = 1
    while 2 * span <= size:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = size - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _sequence_hashes(h: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of h[start : start + size] for each pair, from sums of powers."""
    base, inverse = U64(0x9E3779B97F4A7C15), U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    powers = np.cumprod(np.r_[U64(1), np.full(len(h), base)], dtype=U64)
    back = np.cumprod(np.r_[U64(1), np.full(len(h), inverse)], dtype=U64)
    sums = np.r_[U64(0), np.cumsum(words.mixed(h) * powers[:-1], dtype=U64)]
    return words.mixed((sums[starts + sizes] - sums[starts]) * back[starts] + sizes.astype(U64))


def fragments(h: np.ndarray, first: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word (over all texts), windows and least gram hash of every fragment."""
    starts, counts = words.gram_starts(first, window)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(U64)
    least = _sliding_min(words.gram_hashes(h, GRAM), window - GRAM + 1)[starts]
    text = np.repeat(np.arange(len(counts)), counts)
    head = np.ones(len(starts), bool)
    head[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    runs = np.flatnonzero(head)
    nth = np.arange(len(starts)) - np.repeat(runs, np.diff(np.r_[runs, len(starts)]))
    heads = np.flatnonzero(nth % LONGEST == 0)
    return text[heads], starts[heads], np.diff(np.r_[heads, len(starts)]), least[heads]


def _groups(key: np.ndarray, data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Numbers of groups of equal byte spans, neighbours in the order of their hashes; hashes that different bytes share are told apart."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    rest = np.flatnonzero(~new)
    sizes = (high - low)[rest]
    same = sizes == (high - low)[head[rest]]
    own, other = words.ranges(low[rest[same]], sizes[same]), words.ranges(low[head[rest[same]]], sizes[same])
    same[np.flatnonzero(same)[np.repeat(np.arange(int(same.sum())), sizes[same])[data[own] != data[other]]]] = False
    group = np.cumsum(new) - 1
    if not same.all():
        raw, known = data.tobytes(), {}
        for k in range(len(key)):
            group[k] = known.setdefault(raw[low[k] : high[k]], len(known))
    return group


_CUT = "shard bigint, data binary, sizes binary, many binary, docs binary, marks binary, starts binary"


def _cut(docs: DataFrame, shards: int, window: int) -> DataFrame:
    """A row for each shard and slice: packed fragments. Shard -1: intervals decided within the slice."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for part, data, offsets in batches.slices(batch, limit=SLICE_BYTES):
                ids = part.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                marks = part.column(1).to_numpy(zero_copy_only=False)
                at, to, first = words.word_spans(data, offsets, ~words.SPACES)
                h = words.hash_spans(words.padded(data), at, to)
                text, start, count, least = fragments(h, first, window)
                if not len(text):
                    continue
                sizes = to - at
                joined = np.full(int(sizes.sum()) + len(at), 0x20, np.uint8)
                begin = np.cumsum(sizes + 1) - sizes - 1
                joined[words.ranges(begin, sizes)] = data[~words.SPACES[data]]
                key = _sequence_hashes(h, start, count + window - 1)
                order = np.argsort(key, kind="stable")
                last = start + count + window - 2
                group = np.empty(len(key), np.int64)
                group[order] = _groups(key[order], joined, begin[start[order]], (begin + sizes)[last[order]])
                order = np.lexsort((start, ids[text], group))
                group, text, start, count, least = group[order], text[order], start[order], count[order], least[order]
                new = np.ones(len(group), bool)
                new[1:] = group[1:] != group[:-1]
                doc = ids[text]
                own = doc == doc[np.flatnonzero(new)][np.cumsum(new) - 1]
                place = start - first[text]
                if not own.all():
                    late = ~own
                    yield _row(-1, b"", [], [], doc[late], marks[text][late], np.stack([place[late], place[late] + count[late] + window - 1], 1))
                heads = np.flatnonzero(new)
                many = np.add.reduceat(own, heads)
                raw = joined.tobytes()
                where = ((least[heads] * U64(0xD6E8FEB86659FD93)) >> U64(33)).astype(np.int64) % shards
                turn = np.argsort(where, kind="stable")
                cuts = np.flatnonzero(np.r_[True, np.diff(where[turn]) != 0, True])
                last = start[heads] + count[heads] + window - 2
                lows, highs = begin[start[heads]].tolist(), (begin + sizes)[last].tolist()
                for a, b in zip(cuts[:-1], cuts[1:]):
                    g = turn[a:b]
                    pieces = b"\n".join(raw[lows[k] : highs[k]] for k in g.tolist())
                    members = words.ranges(heads[g], many[g])
                    yield _row(int(where[g[0]]), pieces, count[heads[g]].astype(np.uint8), many[g].astype(np.int32), doc[members], marks[text[members]], place[members].astype(np.int32))

    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, _CUT)


def _row(shard: int, data: bytes, sizes, many, docs, marks, starts) -> pa.RecordBatch:
    packed = _zstd().compress(data, asbytes=True) if data else b""
    parts = {"data": len(data).to_bytes(4, "little") + packed, "sizes": np.asarray(sizes, np.uint8), "many": np.asarray(many, np.int32), "docs": np.asarray(docs, np.int64), "marks": np.asarray(marks, np.int64), "starts": np.asarray(starts, np.int32)}
    return batches.record(shard=pa.array([shard], pa.int64()), **{k: pa.array([x if isinstance(x, bytes) else x.tobytes()], pa.binary()) for k, x in parts.items()})


_SPANS = "doc_id bigint, mark bigint, spans binary"


def _by_document(docs: np.ndarray, marks: np.ndarray, spans: np.ndarray) -> pa.Table:
    """One row for each document with its intervals, start and end one behind the other."""
    order = np.lexsort((spans[:, 0], marks, docs))
    docs, marks, spans = docs[order], marks[order], spans[order].astype(np.int32)
    heads = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (marks[1:] != marks[:-1])]) if len(docs) else np.zeros(0, np.int64)
    tails = np.r_[heads[1:], len(docs)].astype(np.int64) if len(docs) else heads
    packed = pa.array([spans[a:b].tobytes() for a, b in zip(heads.tolist(), tails.tolist())], pa.binary())
    return pa.table({"doc_id": pa.array(docs[heads], pa.int64()), "mark": pa.array(marks[heads], pa.int64()), "spans": packed})


def _in_company(blocks: list[bytes], window: int) -> np.ndarray:
    """For each fragment whether another has its least gram: only then can it share a window."""
    least = []
    for block in blocks:
        data = np.frombuffer(block, np.uint8)
        lines = np.flatnonzero(data == 0x0A)
        at, to, first = words.word_spans(data, np.r_[0, lines + 1, len(data)], ~words.SPACES)
        h = words.hash_spans(words.padded(data), at, to)
        least.append(_sliding_min(words.gram_hashes(h, GRAM), window - GRAM + 1)[first[:-1]])
    _, inverse, times = np.unique(np.concatenate(least), return_inverse=True, return_counts=True)
    return times[inverse] > 1


def search_shard(table: pa.Table, window: int = WINDOW) -> pa.Table:
    """Intervals of a shard's fragments whose windows an earlier document has."""

    def column(name: str, dtype) -> list[np.ndarray]:
        return [np.frombuffer(x.as_py(), dtype) for x in table.column(name)]

    docs, marks = np.concatenate(column("docs", np.int64)), np.concatenate(column("marks", np.int64))
    starts = np.concatenate(column("starts", np.int32))
    if table.column("shard")[0].as_py() == -1:
        return _by_document(docs, marks, starts.reshape(-1, 2))
    many, count = np.concatenate(column("many", np.int32)), np.concatenate(column("sizes", np.uint8)).astype(np.int64)
    member = np.cumsum(many) - many
    empty = _by_document(docs[:0], marks[:0], np.zeros((0, 2), np.int32))
    blocks = []
    for x in table.column("data"):
        raw = x.as_py()
        blocks.append(_zstd().decompress(raw[4:], int.from_bytes(raw[:4], "little"), asbytes=True))
    kept = _in_company(blocks, window)
    if not kept.any():
        return empty
    texts: dict[bytes, int] = {}
    name = np.full(len(many), -1, np.int64)
    k = 0
    for block in blocks:
        for piece in block.split(b"\n"):
            if kept[k]:
                name[k] = texts.setdefault(piece, len(texts))
            k += 1
    entries = np.flatnonzero(kept)
    least_doc = np.full(len(texts), NULL_ID, np.int64)
    np.minimum.at(least_doc, name[entries], docs[member[entries]])
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    at, to, first = words.word_spans(data, offsets, ~words.SPACES)
    _, symbols = np.unique(words.hash_spans(words.padded(data), at, to), return_inverse=True)
    index = WindowIndex(symbols + 1, first, least_doc, window)
    found, place = index.least_owner(index.at, np.diff(first))
    # Each entry of each occurrence against what its windows have as least document.
    of = np.repeat(entries, many[entries])
    members = words.ranges(member[entries], many[entries])
    windows = count[of]
    at_window = words.ranges(place[name[of]], windows)
    gone = found[at_window] < np.repeat(docs[members], windows)
    occurrence = np.repeat(np.arange(len(of)), windows)
    nth = words.ranges(np.zeros(len(of), np.int64), windows)
    # Runs of windows that go are one interval.
    k = np.flatnonzero(gone)
    if not len(k):
        return empty
    head = np.ones(len(k), bool)
    head[1:] = (k[1:] != k[:-1] + 1) | (occurrence[k[1:]] != occurrence[k[:-1]])
    a = k[head]
    b = k[np.r_[np.flatnonzero(head)[1:] - 1, len(k) - 1]]
    m = members[occurrence[a]]
    spans = np.stack([starts[m] + nth[a], starts[m] + nth[b] + window], 1)
    return _by_document(docs[m], marks[m], spans)


def repeated_spans(docs: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, mark and spans (binary pairs of word numbers, end exclusive) of all that earlier documents have."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_bytes))
    packed = _cut(docs, shards, window)
    # Decisions made in the slices are no work: they are spread over all shards' tasks. A task has one shard.
    place = F.when(F.col("shard") < 0, F.pmod(F.xxhash64("docs"), F.lit(shards))).otherwise(F.col("shard")).cast("int")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[pa.RecordBatch]] = {True: [], False: []}
        for batch in found:
            decided = pc.less(batch.column(0), 0)
            for which, mask in ((True, decided), (False, pc.invert(decided))):
                held[which].append(batch.filter(mask))
        for rows in held.values():
            table = pa.Table.from_batches(rows) if rows else None
            if table is not None and table.num_rows:
                yield from search_shard(table, window).to_batches()

    return packed.repartitionById(shards, place).mapInArrow(run, _SPANS)


def deduplicated(docs: DataFrame, window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if wanted, the kept text: words that stay, joined by one space.

    doc_id is a whole number. Null texts have no words; texts of fewer words than the window lose none. Null ids count
    as after all others, so ids are below 2**63 - 1. Documents with one id do not remove each other's windows; rows
    with the same id are told apart by 64 bits of the text's hash, and equal rows have equal answers. A document's windows are judged on the input, whatever else is removed.
    """
    spans = repeated_spans(docs, window).groupBy("doc_id", "mark").agg(F.collect_list("spans").alias("spans"))
    spans = spans.withColumnsRenamed({"doc_id": "_doc_id", "mark": "_mark"})
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)).alias("_id"), F.xxhash64("text").alias("mark"), "text")
    packed = keyed.mapInArrow(_squeezed, "doc_id bigint, _id bigint, mark bigint, size int, text binary")
    joined = packed.join(spans, (F.col("_id") == F.col("_doc_id")) & (F.col("mark") == F.col("_mark")), "left").select("doc_id", "size", "text", "spans")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            n_words, n_removed, digests, texts = [], [], [], []
            for size, text, own in zip(*(c.to_pylist() for c in batch.columns[1:])):
                parts = _zstd().decompress(text, size, asbytes=True).split() if size else []
                n = len(parts)
                if own:
                    cover = np.zeros(n + 1, np.int64)
                    pairs = np.concatenate([np.frombuffer(x, np.int32).reshape(-1, 2) for x in own])
                    np.add.at(cover, pairs[:, 0], 1)
                    np.add.at(cover, pairs[:, 1], -1)
                    stay = np.cumsum(cover)[:n] == 0
                    parts = [parts[k] for k in np.flatnonzero(stay).tolist()]
                kept = b" ".join(parts)
                n_words.append(n), n_removed.append(n - len(parts)), digests.append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    texts.append(kept.decode("utf-8", "replace"))
            yield batches.record(doc_id=batch.column(0), n_words=pa.array(n_words, pa.int64()), n_removed=pa.array(n_removed, pa.int64()), kept_sha256=pa.array(digests, pa.string()), **({"text": pa.array(texts, pa.string())} if keep_text else {}))

    return joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", text string" * keep_text)


def _squeezed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffle."""
    for batch in found:
        raw = [x.as_buffer() if x.is_valid else None for x in batch.column(3).cast(pa.large_binary())]
        sizes = [x.size if x is not None else 0 for x in raw]
        packed = [_zstd().compress(x, asbytes=True) if n else b"" for x, n in zip(raw, sizes)]
        yield batches.record(doc_id=batch.column(0), _id=batch.column(1), mark=batch.column(2), size=pa.array(sizes, pa.int32()), text=pa.array(packed, pa.binary()))
