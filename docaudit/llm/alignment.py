"""Alignment of two tokenizers' ids by external spill counting.

Documents are encoded by both; where a token of each ends at one byte, the two are linked. A run holds the links of
some documents: pairs of ids with the documents they stand in. The pairs of a run are sorted by B's id, then A's, and
their counts radix-partitioned into zstd chunks; only these are exchanged. One task merges all runs' chunks of a radix
by a k-way heap, counts each pair, takes the greatest count of each B id on its way (side-major order keeps an id's
pairs together) and streams the counts back to the runs they came from, where they are summed up for each document.
A pair that stands in every document is one entry a run, so no pair and no id makes a large group.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm import batches, tokens, words
from docaudit.session import checkpointed, scratch

#: Bytes of text in a run, on average at most, and in one pass of numpy.
RUN_BYTES, PASS_BYTES = 32 << 20, 2 << 20
#: Bytes of text for one radix, and the least and greatest number of radixes.
RADIX_BYTES, RADIXES = 256 << 20, (64, 16_384)
#: Entries that one zstd chunk holds, and runs that one heap merges.
CHUNK, FAN_IN = 1 << 15, 256
RUN_SCHEMA = "docs array<struct<{ids}n_a: bigint, n_b: bigint, n_groups: bigint, groups_sha256: string>>, at array<int>, places binary, times binary, heads array<struct<radix: int, pairs: binary, counts: binary>>"


def squeezed(numbers: np.ndarray) -> bytes:
    """Whole numbers as zstd frames of CHUNK entries: differences, byte by byte of equal weight."""
    out = []
    for k in range(0, len(numbers), CHUNK):
        own = np.diff(numbers[k : k + CHUNK].astype(np.int64), prepend=0)
        folded = ((own << 1) ^ (own >> 63)).astype("<i8")
        width = max(1, (int(np.bitwise_or.reduce(folded)).bit_length() + 7) // 8) if (folded >= 0).all() else 8
        planes = np.ascontiguousarray(folded.view(np.uint8).reshape(-1, 8)[:, :width].T)
        frame = zstandard.compress(bytes([width]) + planes.tobytes(), 3)
        out.append(len(frame).to_bytes(4, "little") + frame)
    return b"".join(out)


def chunks(blob: bytes) -> Iterator[np.ndarray]:
    """The numbers of squeezed(), a frame at a time."""
    at = 0
    while at < len(blob):
        size = int.from_bytes(blob[at : at + 4], "little")
        raw = zstandard.decompress(blob[at + 4 : at + 4 + size])
        planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
        folded = np.zeros((planes.shape[1], 8), np.uint8)
        folded[:, : raw[0]] = planes.T
        folded = folded.view("<i8").ravel()
        yield np.cumsum((folded >> 1 & 0x7FFFFFFFFFFFFFFF) ^ -(folded & 1))
        at += 4 + size


def whole(blob: bytes) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *chunks(blob)])


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, and the sum of its counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def merged(runs: list[Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A k-way merge of sorted runs of (keys, counts) in chunks: each key once, its counts summed.

    The heap has the last key of every run's loaded chunk. All keys up to the least of them are there.
    """
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def load(k: int) -> None:
        for keys, counts in runs[k]:
            if len(keys):
                held[k] = keys, counts
                heapq.heappush(heap, (int(keys[-1]), k))
                return

    for k in range(len(runs)):
        load(k)
    while heap:
        bound = heap[0][0]
        parts, ended = [], []
        for k, (keys, counts) in held.items():
            n = int(np.searchsorted(keys, bound, "right"))
            if n:
                parts.append((keys[:n], counts[:n]))
                held[k] = keys[n:], counts[n:]
                if n == len(keys):
                    ended.append(k)
        for _ in ended:
            heapq.heappop(heap)  # those that ended are just those with the bound as their last key
        for k in ended:
            del held[k]
            load(k)
        yield summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def _merged_whole(runs: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All keys of many runs with their sums: heaps of FAN_IN runs, whose results are runs again."""
    while True:
        out = []
        for k in range(0, len(runs), FAN_IN):
            made = list(merged([zip(chunks(a), chunks(b)) for a, b in runs[k : k + FAN_IN]]))
            keys, counts = (np.concatenate([np.zeros(0, np.int64), *(m[i] for m in made)]) for i in (0, 1))
            if len(runs) <= FAN_IN:
                return keys, counts
            out.append((squeezed(keys), squeezed(counts)))
        runs = out


def _radix(pairs: np.ndarray, radixes: int) -> np.ndarray:
    return (words.mixed(pairs.astype(np.uint64)) >> words.U64(40)).astype(np.int64) % radixes


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0 to n - 1, from the left, and their number."""
    numbers = np.arange(max(n, 1))
    sizes = np.char.str_len(numbers.astype("S")).astype(np.int64)
    wide = int(sizes.max())
    text = np.frombuffer(numbers.astype(f"S{wide}").tobytes(), np.uint8).reshape(-1, wide)
    return text, sizes


class Aligner:
    """Tokens of both sides over many texts: groups, links and what a run keeps of them."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = tokens.encoder(path_a, plain=True), tokens.piece_encoder(path_b)
        self.bytes = self.a.token_bytes(), self.b.token_bytes()
        self.lengths = tuple(np.array([len(x) for x in own], np.int64) for own in self.bytes)
        self.digits, self.n_digits = _digits(max(map(len, self.bytes)))

    def _same(self, side: int, ids: np.ndarray, raw: bytes) -> bool:
        return b"".join(map(self.bytes[side].__getitem__, ids.tolist())) == raw

    def groups(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[dict], np.ndarray, np.ndarray]:
        """For texts that are empty or begin with a blank: their columns, the pair of each link, and links before each text.

        A text whose tokens' bytes are not its own has no tokens.
        """
        sides, raw = [enc.encode(data, offsets) for enc in (self.a, self.b)], data.tobytes()
        differs = np.zeros(len(offsets) - 1, bool)
        for side, (ids, at) in enumerate(sides):
            total = np.r_[0, np.cumsum(self.lengths[side][ids])]
            differs |= np.diff(total[at]) != np.diff(offsets)
            for k in np.flatnonzero(~differs & (offsets[1:] > offsets[:-1])).tolist():
                differs[k] = not self._same(side, ids[at[k] : at[k + 1]], raw[offsets[k] : offsets[k + 1]])
        if differs.any():
            for side, (ids, at) in enumerate(sides):
                sizes = np.where(differs, 0, np.diff(at))
                sides[side] = ids[words.ranges(at[:-1], sizes)], np.r_[0, np.cumsum(sizes)]
        (ids_a, at_a), (ids_b, at_b) = sides
        end_a, end_b = (np.cumsum(self.lengths[side][ids]) for side, (ids, _) in enumerate(sides))
        marked = np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, bool)
        marked[end_a] = True
        both_b = marked[end_b]
        marked[:] = False
        marked[end_b[both_b]] = True
        both_a = marked[end_a]
        pairs = ids_b[both_b].astype(np.int64) << 32 | ids_a[both_a]
        links = np.r_[0, np.cumsum(both_a)][at_a]
        written, ends = self._written(ids_a, both_a, ids_b, both_b, at_a, at_b)
        rows = []
        for k in range(len(offsets) - 1):
            own = written[ends[k] : max(ends[k + 1] - 1, ends[k])]  # no mark behind the last group
            sha = hashlib.sha256(own).hexdigest() if links[k + 1] > links[k] else ""
            rows.append({"n_a": int(at_a[k + 1] - at_a[k]), "n_b": int(at_b[k + 1] - at_b[k]), "n_groups": int(links[k + 1] - links[k]), "groups_sha256": sha})
        return rows, pairs, links

    def _written(self, ids_a, both_a, ids_b, both_b, at_a, at_b) -> tuple[np.ndarray, np.ndarray]:
        """All texts' groups as `a1,a2|b1;` and so on, one text behind the other, and where each text's begin."""
        # A token comes behind all tokens of groups before its own; within one, A's come before B's.
        group_a, group_b = np.cumsum(both_a) - both_a, np.cumsum(both_b) - both_b
        behind_a, behind_b = np.flatnonzero(both_a) + 1, np.flatnonzero(both_b) + 1
        place_a = np.arange(len(ids_a)) + np.r_[0, behind_b][group_a]
        place_b = np.arange(len(ids_b)) + (behind_a[group_b] if len(behind_a) else group_b)
        n, wide = len(ids_a) + len(ids_b), self.digits.shape[1]
        ids, mark = np.zeros(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[place_a], ids[place_b] = ids_a, ids_b
        mark[place_a[both_a]], mark[place_b[both_b]] = ord("|"), ord(";")
        cells = np.empty((n, wide + 1), np.uint8)
        cells[:, :wide] = self.digits[ids]
        sizes = self.n_digits[ids]
        cells[np.arange(n), sizes] = mark
        total = np.r_[0, np.cumsum(sizes + 1)]
        return cells[np.arange(wide + 1) <= sizes[:, None]], total[at_a + at_b]


class _Run:
    """Links of some documents: pairs with their counts, and for each document places among them with multiplicity."""

    def __init__(self):
        self.parts, self.docs, self.size = [], [], 0

    def add(self, doc_ids: list, rows: list[dict], pairs: np.ndarray, links: np.ndarray, size: int) -> None:
        keys, place = np.unique(pairs, return_inverse=True)
        doc = np.repeat(np.arange(len(rows)), np.diff(links))
        one, times = np.unique(doc * max(len(keys), 1) + place, return_counts=True)
        counts = np.bincount(one % max(len(keys), 1), weights=times, minlength=len(keys)).astype(np.int64)
        at = np.searchsorted(one, np.arange(1, len(rows) + 1) * max(len(keys), 1))
        self.parts.append((keys, counts, (one % max(len(keys), 1)).astype(np.int32), times.astype(np.int32), at))
        self.docs += [dict(doc_id=d, **r) for d, r in zip(doc_ids, rows)]
        self.size += size

    def row(self, radixes: int) -> dict:
        made = list(merged([iter([(keys, counts)]) for keys, counts, *_ in self.parts]))
        keys, counts = (np.concatenate([np.zeros(0, np.int64), *(m[i] for m in made)]) for i in (0, 1))
        # Heads lie by radix, within one by pair; places count in that order.
        radix = _radix(keys, radixes)
        order = np.argsort(radix, kind="stable")
        nth = np.empty(len(keys), np.int64)
        nth[order] = np.arange(len(keys))
        heads = []
        starts = np.searchsorted(radix[order], np.arange(radixes + 1))
        for k in np.flatnonzero(np.diff(starts)).tolist():
            own = order[starts[k] : starts[k + 1]]
            heads.append({"radix": k, "pairs": squeezed(keys[own]), "counts": squeezed(counts[own])})
        places, times, at, before = [], [], [], 0
        for part, _, place, n, ends in self.parts:
            found = nth[np.searchsorted(keys, part)][place] if len(part) else place
            # Each document's places in order: their differences are small.
            doc = np.searchsorted(ends, np.arange(len(found)), "right")
            sort = np.lexsort((found, doc))
            places.append(found[sort]), times.append(n[sort]), at.append(ends + before)
            before += len(found)
        return {"docs": self.docs, "at": np.concatenate([[0], *at]).astype(np.int32), "places": squeezed(np.concatenate(places)), "times": squeezed(np.concatenate(times)), "heads": heads}


def runs(docs: DataFrame, path_a: str, path_b: str, radixes: int) -> DataFrame:
    """One row a run: its documents' columns, their places among the run's pairs, and those pairs' counts by radix."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = RUN_SCHEMA.format(ids=f"doc_id: {kind}, ")
    types = _arrow(schema)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, held = Aligner(path_a, path_b), _Run()
        for batch in found:
            for rows, data, offsets in batches.slices(batch, limit=PASS_BYTES):
                sizes = np.diff(offsets)
                # A blank before every text but the empty ones.
                into = np.zeros(len(data) + int((sizes > 0).sum()), np.uint8)
                shift = np.cumsum(sizes > 0)
                into[np.arange(len(data)) + np.repeat(shift, sizes)] = data
                ends = np.r_[0, offsets[1:] + shift]
                into[ends[:-1][sizes > 0]] = 0x20
                held.add(rows.column(rows.schema.get_field_index("doc_id")).to_pylist(), *aligner.groups(into, ends), len(into))
                if held.size >= RUN_BYTES:
                    yield pa.RecordBatch.from_pylist([held.row(radixes)], schema=types)
                    held = _Run()
        if held.docs:
            yield pa.RecordBatch.from_pylist([held.row(radixes)], schema=types)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def counted(heads: DataFrame) -> DataFrame:
    """run, radix, counts (of the run's pairs corpus-wide, in the run's order), b and most (greatest counts of the radix).

    heads has run, radix, pairs and counts, the rows of a radix one behind the other in a partition. b and most are
    given once for each radix, beside its first run.
    """

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(own: list[tuple]) -> pa.RecordBatch:
            keys, counts = _merged_whole([(pairs, n) for _, _, pairs, n in own])
            first = np.flatnonzero(np.diff(keys >> 32, prepend=-1))
            most = np.maximum.reduceat(counts, first)
            answers = [b"".join(squeezed(counts[np.searchsorted(keys, part)]) for part in chunks(pairs)) for _, _, pairs, _ in own]
            none = [None] * (len(own) - 1)
            return batches.record(
                run=pa.array([x[0] for x in own], pa.int64()), radix=pa.array([x[1] for x in own], pa.int32()), counts=pa.array(answers, pa.binary()),
                b=pa.array([(keys[first] >> 32).astype(np.int32).tolist(), *none], pa.list_(pa.int32())), most=pa.array([most.tolist(), *none], pa.list_(pa.int64())),
            )

        own: list[tuple] = []
        for batch in found:
            for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("run", "radix", "pairs", "counts"))):
                if own and own[0][1] != row[1]:
                    yield done(own)
                    own = []
                own.append(row)
        if own:
            yield done(own)

    return heads.select("run", "radix", "pairs", "counts").mapInArrow(run, "run bigint, radix int, counts binary, b array<int>, most array<bigint>")


def summed_up(found: DataFrame, answered: DataFrame, most: dict[int, int]) -> DataFrame:
    """The documents of runs with n_links, n_best and count_sum; most: the greatest count of each B id, corpus-wide.

    found has run, docs, at, places, times and heads, answered has counts for each run and radix.
    """
    table = np.zeros(max(most, default=0) + 1, np.int64)
    table[list(most)] = list(most.values())
    kind = found.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    types = _arrow(schema)

    def run(runs_: pa.Table, answers: pa.Table) -> pa.Table:
        own, none = runs_.to_pylist()[0], np.zeros(0, np.int64)
        by_radix = dict(zip(answers.column("radix").to_pylist(), answers.column("counts").to_pylist()))
        counts = np.concatenate([none, *(whole(by_radix[x["radix"]]) for x in own["heads"])])
        b = np.concatenate([none, *(whole(x["pairs"]) >> 32 for x in own["heads"])])
        best = counts == table[b]
        places, times = whole(own["places"]), whole(own["times"])
        total, n_best = (np.r_[0, np.cumsum(x[places] * times)] for x in (counts, best))
        at = np.array(own["at"])
        made = [d | {"n_links": d["n_groups"], "n_best": int(n), "count_sum": int(c)} for d, n, c in zip(own["docs"], np.diff(n_best[at]), np.diff(total[at]))]
        return pa.Table.from_pylist(made, schema=types)

    left, right = found.select("run", "docs", "at", "places", "times", "heads"), answered.select("run", "radix", "counts").toDF("run", "radix", "counts")
    return left.groupBy("run").cogroup(right.groupBy("run")).applyInArrow(run, schema)


def radixes_for(size: int) -> int:
    return min(max(RADIXES[0], 1 << (max(size, 1) // RADIX_BYTES).bit_length()), RADIXES[1])


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    path_a names a byte-level BPE, path_b a sentencepiece BPE that neither normalises nor drops blanks. Null and empty
    texts, and those whose tokens' bytes are not a blank and the text, have zeros and the empty text. Repeated rows are
    rows of their own, a null doc_id stays null, an empty table stays empty, extra columns are not read. A text is held
    whole by one task.
    """
    spark = docs.sparkSession
    with scratch(spark) as kept:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        # A run is what one task makes of up to RUN_BYTES; it is written once and then read by parts.
        found = kept(runs(docs, path_a, path_b, radixes_for(size)).withColumn("run", F.monotonically_increasing_id()))
        heads = found.select("run", F.explode("heads").alias("h")).select("run", "h.*")
        dealt = heads.repartition("radix").sortWithinPartitions("radix", "run")
        answered = kept(counted(dealt))
        # One number for each id of B's vocabulary at most.
        most = dict(answered.where("b IS NOT NULL").select(F.explode(F.arrays_zip("b", "most")).alias("x")).groupBy("x.b").agg(F.max("x.most")).collect())
        return checkpointed(summed_up(found, answered, most))


def groups_of(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id and groups: arrays of A's and B's ids between bytes where tokens of both end."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(rows, data, offsets):
        texts = batches.strings(data, offsets)
        aligner, out = Aligner(path_a, path_b), []
        for text in texts:
            raw = np.frombuffer((" " + text if text else "").encode(), np.uint8)
            ends = np.array([0, len(raw)])
            (a, _), (b, _) = (enc.encode(raw, ends) for enc in (aligner.a, aligner.b))
            same = aligner._same(0, a, raw.tobytes()) and aligner._same(1, b, raw.tobytes())
            end_a, end_b = (np.cumsum(aligner.lengths[s][x]) if same else np.zeros(0, np.int64) for s, x in ((0, a), (1, b)))
            cuts = np.intersect1d(end_a, end_b)
            part = lambda ids, end: np.split(ids, np.searchsorted(end, cuts, "right")[:-1]) if len(cuts) else []
            out.append([{"a": x.tolist(), "b": y.tolist()} for x, y in zip(part(a, end_a), part(b, end_b))])
        return batches.record(doc_id=rows.column(rows.schema.get_field_index("doc_id")), groups=pa.array(out, pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))))

    return batches.map_slices(docs.select("doc_id", "text"), run, f"doc_id {kind}, `groups` array<struct<a: array<int>, b: array<int>>>")
