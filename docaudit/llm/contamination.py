"""Benchmark decontamination: a broadcast hash set of the test items' normalised word n-grams.

Training documents stream past it: the hash of every token window is looked up, hits are verified on the words
themselves, and hit spans or whole documents are removed. The set is bounded: a benchmark larger than
``BLOCK_BYTES`` is applied in blocks of items, one pass over the documents for each.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.llm import batches, words

WINDOW = 10
#: Bytes of benchmark text in one broadcast set.
BLOCK_BYTES = 4 << 20
SCHEMA = "n_words bigint, hits array<struct<start:int,end:int>>, items array<string>"


class Grams:
    """Windows of the items of one block: by length in words, their hashes and the items of each word sequence."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.items: dict[bytes, list[str]] = defaultdict(list)
        hashes = defaultdict(set)
        for item_id, text in items:
            raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
            if not len(raw):
                continue
            low = words.LOWER[raw]
            at, to, _ = words.word_spans(low, np.array([0, len(low)]), words.ALNUM)
            if not len(at):
                continue
            n = min(window, len(at))
            own = words.gram_hashes(words.hash_spans(words.padded(low), at, to), n)
            parts = [low[a:b].tobytes() for a, b in zip(at, to)]
            for k, h in enumerate(own.tolist()):
                hashes[n].add(h)
                key = b" ".join(parts[k : k + n])
                own_items = self.items[key]
                if item_id is not None and item_id not in own_items[-1:]:
                    own_items.append(item_id)
        self.items = dict(self.items)
        self.sorted = {n: np.array(sorted(h), np.uint64) for n, h in sorted(hashes.items())}
        self.maps = {}
        for n, h in self.sorted.items():
            seen = np.zeros(1 << 20, bool)
            seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.maps[n] = seen

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
        """For each text: its words, the spans of words that a window covers, and the items found."""
        low = words.LOWER[data] if len(data) else data
        at, to, first = words.word_spans(low, offsets, words.ALNUM)
        spans: list[list[tuple[int, int]]] = [[] for _ in range(len(offsets) - 1)]
        items: list[set[str]] = [set() for _ in range(len(offsets) - 1)]
        h = words.hash_spans(words.padded(low), at, to)
        for n, known in self.sorted.items():
            grams = words.gram_hashes(h, n)
            maybe = np.flatnonzero(self.maps[n][(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
            place = np.minimum(np.searchsorted(known, grams[maybe]), len(known) - 1)
            maybe = maybe[known[place] == grams[maybe]]
            text = np.searchsorted(first, maybe, "right") - 1
            inside = maybe + n <= first[text + 1]
            for k, t in zip(maybe[inside].tolist(), text[inside].tolist()):
                found = self.items.get(b" ".join(low[a:b].tobytes() for a, b in zip(at[k : k + n], to[k : k + n])))
                if found is not None:  # else only the hashes are equal
                    items[t].update(found)
                    spans[t].append((k - int(first[t]), k - int(first[t]) + n))
        return np.diff(first), [merged(s) for s in spans], items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """The items with a block number, and how many blocks keep each below about `limit` bytes."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // limit))
    return items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), n


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """Adds n_words, hits (merged spans of word numbers, end exclusive) and items (sorted ids) to docs.

    Columns of docs with these names are replaced. Null and empty texts have no words; items without words have no
    window; an item without an id hits like any other but is not among the items; repeated rows are each answered; an
    empty benchmark hits nothing.
    """
    keep = [c for c in docs.columns if c not in ("n_words", "hits", "items")]
    numbered, n = blocks(benchmark, limit)
    out = docs.select(*keep).withColumns({"n_words": F.lit(0).cast("bigint"), "hits": F.array().cast("array<struct<start:int,end:int>>"), "items": F.array().cast("array<string>")})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    for k in range(n):
        rows = [(r.item_id, r.text) for r in numbered.where(F.col("block") == k).collect()]
        grams = docs.sparkSession.sparkContext.broadcast(Grams(rows, window))

        def run(part, data, offsets, grams=grams, later=k > 0):
            n_words, spans, items = grams.value.find(data, offsets)
            if later:
                old = part.column(part.schema.get_field_index("hits")).to_pylist()
                spans = [merged([(x["start"], x["end"]) for x in o] + s) for o, s in zip(old, spans)]
                items = [set(o) | i for o, i in zip(part.column(part.schema.get_field_index("items")).to_pylist(), items)]
            made = [
                pa.array(n_words, pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                pa.array([sorted(i) for i in items], pa.list_(pa.string())),
            ]
            return pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), *made], names=[*keep, "n_words", "hits", "items"])

        out = batches.map_slices(out, run, ", ".join(x for x in (schema, SCHEMA) if x))
    return out


def n_hit() -> Column:
    return F.aggregate("hits", F.lit(0).cast("bigint"), lambda s, x: s + (x["end"] - x["start"]))


def cut_out(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The columns of docs, with the words at `hits` cut out of text: from the first byte of a span to its last word's last.

    Texts without a hit stay as they are; n_chars, where docs has it, follows the text.
    """
    columns = docs.columns

    def run(part, data, offsets):
        hits = part.column(part.schema.get_field_index("hits")).to_pylist()
        texts = part.column(part.schema.get_field_index("text")).to_pylist()
        counts = part.column(part.schema.get_field_index("n_chars")).to_pylist() if "n_chars" in columns else None
        at, to, first = words.word_spans(words.LOWER[data] if len(data) else data, offsets, words.ALNUM)
        for k, spans in enumerate(hits):
            if spans:
                raw, cut, base = data[offsets[k] : offsets[k + 1]].tobytes(), 0, offsets[k]
                kept = []
                for s in spans:
                    kept.append(raw[cut : at[first[k] + s["start"]] - base])
                    cut = to[first[k] + s["end"] - 1] - base
                texts[k] = b"".join([*kept, raw[cut:]]).decode("utf-8", "replace")
                if counts:
                    counts[k] = len(texts[k])
        changed = {"text": lambda c: pa.array(texts, pa.string()), "n_chars": lambda c: pa.array(counts, part.schema.field(c).type)}
        return pa.RecordBatch.from_arrays([changed.get(c, lambda c: part.column(part.schema.get_field_index(c)))(c) for c in columns], names=columns)

    return batches.map_slices(found, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


#: Documents with at least this share of hit words go as a whole.
MOSTLY = 0.5


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, mostly: float = MOSTLY) -> DataFrame:
    """docs without the spans that windows cover, and without documents where these are `mostly` of the words or more.

    All columns of docs stay, also those named like the scan's own.
    """
    own = _renamed(docs)
    found = scan(own, benchmark, window)
    return cut_out(own, found.where((F.size("hits") == 0) | (n_hit() < mostly * F.col("n_words")))).toDF(*docs.columns)


def without_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without those that hold any window of an item."""
    own = _renamed(docs)
    return scan(own, benchmark, window).where(F.size("hits") == 0).select(*own.columns).toDF(*docs.columns)


def _renamed(docs: DataFrame) -> DataFrame:
    return docs.withColumnsRenamed({c: f"_own_{c}" for c in ("n_words", "hits", "items")})
