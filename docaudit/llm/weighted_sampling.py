"""Document fingerprints by consistent weighted sampling.

A document is the weighted set of its five-word shingles, with their counts as weights. For each of the samples every
term draws r and c from Gamma(2, 1) and b from the unit interval, all fixed by its hash; t = floor(log(weight) / r + b)
and the term with the least log(c) - r * (t - b) - r is the sample, together with t. Two documents have the same
sample with a probability of just their generalised Jaccard similarity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm import batches, words
from docaudit.session import checkpointed

SHINGLE = 5
SAMPLES = 64
U64 = np.uint64
_SPREAD = U64(0xD6E8FEB86659FD93)


def _survivors(s: np.ndarray) -> np.ndarray:
    """The numbers that a Gamma(2, 1) draw exceeds with probability s, by Newton's method on log(1 + x) - x."""
    goal = np.log(s)
    x = np.maximum(np.sqrt(-2 * goal), -goal)
    for _ in range(60):
        x = x - (np.log1p(x) - x - goal) / (1 / (1 + x) - 1)
    return x


#: Draws by 16 bits of the hash each: r, and log(c) of other bits. Of the 256 places with the largest r, which decide
#: most samples, each is split by 8 more bits.
_PLACES = (np.arange(1 << 16) + 0.5) / (1 << 16)
R = _survivors(_PLACES).astype(np.float32)
R_TAIL = _survivors(_PLACES / 256).astype(np.float32)
LOG_C = np.log(_survivors(_PLACES)).astype(np.float32)
SALTS = words.mixed(np.arange(1, SAMPLES + 1, dtype=U64))
FACTORS = words.mixed(SALTS) | U64(1)


def _drawn(term: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each term's sample k: r, log(c) and b, from bits of their own, and the hash."""
    p = (term ^ SALTS[k]) * FACTORS[k]
    p ^= p >> U64(32)
    p *= _SPREAD
    p ^= p >> U64(29)
    part = p.view(np.uint16).reshape(-1, 4)
    r = R[part[:, 3]]
    tail = np.flatnonzero(part[:, 3] < 256)
    r[tail] = R_TAIL[(part[tail, 3].astype(np.int64) << 8) | (part[tail, 0] >> 8)]
    return r, LOG_C[part[:, 2]], (part[:, 1].astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-16), p


def _ordered(x: np.ndarray) -> np.ndarray:
    """Numbers as unsigned ones of 32 bits in the same order, in the upper half."""
    raw = x.astype(np.float32).view(np.int32)
    return (np.where(raw < 0, ~raw, raw | np.int32(-(2**31))).view(np.uint32).astype(U64)) << U64(32)


def terms(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, 48-bit hash and count of every distinct shingle; a text with fewer words is one shingle."""
    low = words.LOWER[data] if len(data) else data
    at, to, first = words.word_spans(low, offsets, ~words.SPACES)
    h = words.hash_spans(words.padded(low), at, to)
    n = np.diff(first)
    starts, counts = words.gram_starts(first, shingle)
    grams = words.gram_hashes(h, shingle)[starts] if len(starts) else np.zeros(0, U64)
    text = np.repeat(np.arange(len(n)), counts)
    for size in range(1, shingle):
        short = np.flatnonzero(n == size)
        if len(short):
            grams = np.r_[grams, words.gram_hashes(h, size)[first[short]]]
            text = np.r_[text, short]
    key = np.sort((text.astype(U64) << U64(48)) | (grams >> U64(16)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return (key[at] >> U64(48)).astype(np.int64), key[at] & U64((1 << 48) - 1), np.diff(np.r_[at, len(key)])


def signatures(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """[texts, SAMPLES] numbers of 16 bits; a text without words has zeros."""
    return sampled(*terms(data, offsets, shingle), len(offsets) - 1)


def sampled(text: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The samples of n texts, given as their number, hash and weight of every term, text by text."""
    out = np.zeros((n, SAMPLES), np.uint16)
    if not len(text):
        return out
    term = words.mixed(term)
    heads = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    more = np.flatnonzero(weight > 1)
    log_weight = np.log(weight[more]).astype(np.float32)
    for k in range(SAMPLES):
        r, log_c, b, own = _drawn(term, k)
        # The usual weight is 1, with t = 0.
        place = log_c - r * (1 - b)
        if len(more):
            t = np.floor(log_weight / r[more] + b[more])
            place[more] -= r[more] * t
            own[more] ^= t.astype(np.int64).astype(U64) * U64(0x9E3779B1)
        least = np.minimum.reduceat(_ordered(place) | (own & U64(0xFFFFFFFF)), heads)
        out[text[heads], k] = words.mixed(least & U64(0xFFFFFFFF)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(1)


def _place(raw: np.ndarray, points: int) -> int:
    """Bytes of the first `points` code points."""
    heads = np.flatnonzero((raw & 0xC0) != 0x80)
    return int(heads[points]) if points < len(heads) else len(raw)


def edited(raw: bytes, following: bytes) -> tuple[bytes, int]:
    """The text with its last half replaced by as much of the next, and its code points."""
    own, other = np.frombuffer(raw, np.uint8), np.frombuffer(following, np.uint8)
    n = int(((own & 0xC0) != 0x80).sum())
    return raw[: _place(own, n - n // 2)] + following[: _place(other, n // 2)], n


def _packed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)


_COLUMNS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_TYPES = "n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _answers(texts: list[bytes], following: list[bytes]) -> dict[str, pa.Array]:
    """The result columns of texts with the texts that follow them; following may hold one text beyond."""
    made = [edited(a, b) for a, b in zip(texts, following)]
    own = signatures(*_packed(texts))
    # In a run of rows the next text's signature is there already.
    shared = len(texts) > 1 and all(a is b for a, b in zip(texts[1:], following))
    after = np.vstack([own[1:], signatures(*_packed(following[-1:]))]) if shared else signatures(*_packed(following))
    changed = signatures(*_packed([m[0] for m in made]))
    return {
        "n_chars": pa.array([m[1] for m in made], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(m[0]).digest() for m in made], pa.binary()),
        "fingerprint": pa.array([x.tobytes() for x in own], pa.binary()),
        "edited_fingerprint": pa.array([x.tobytes() for x in changed], pa.binary()),
        "near_edited": pa.array(likeness(own, changed)),
        "near_next": pa.array(likeness(own, after)),
    }


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and binary signature of every text; null counts as empty, whose signature is zeros."""

    def run(part, data, offsets):
        made = signatures(data, offsets)
        return batches.record(doc_id=part.column(part.schema.get_field_index("doc_id")), fingerprint=pa.array([x.tobytes() for x in made], pa.binary()))

    return batches.map_slices(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint binary")


def edit_probe(docs: DataFrame) -> DataFrame:
    """Every document beside its edited text, whose last half is the start of the next document by descending doc_id.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (binary), near_edited, near_next. Null
    text is empty. Equal ids follow each other by a hash of the text, then the text; null ids come last. After the last document comes
    the first; a single document follows itself. Documents are dealt by ranges of doc_id, so that a text moves once;
    only those at the ranges' borders, two for each partition, meet in a second step.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    order = (F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text"))
    dealt = docs.select("doc_id", text.alias("text")).repartitionByRange(*order[:2]).sortWithinPartitions(*order)

    def row(ids: pa.Array, made: dict[str, pa.Array]) -> pa.RecordBatch:
        n = len(ids)
        return batches.record(doc_id=ids, **made, edge=pa.nulls(n, pa.int32()), part=pa.nulls(n, pa.int32()), text=pa.nulls(n, pa.binary()))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None

        def border(edge: int, ids: pa.Array, raw: bytes) -> pa.RecordBatch:
            blank = {"n_chars": pa.int64(), "edited_sha256": pa.binary(), "fingerprint": pa.binary(), "edited_fingerprint": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64()}
            return batches.record(doc_id=ids, **{k: pa.nulls(1, t) for k, t in blank.items()}, edge=pa.array([edge], pa.int32()), part=pa.array([part], pa.int32()), text=pa.array([raw], pa.binary()))

        for batch in found:
            for rows, data, offsets in batches.slices(batch, limit=1 << 20):
                raw, cuts = data.tobytes(), offsets.tolist()
                texts = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
                ids = rows.column(0)
                if held is None:
                    yield border(0, ids.slice(0, 1), texts[0])
                else:
                    texts, ids = [held[1], *texts], pa.concat_arrays([held[0], ids])
                if len(texts) > 1:
                    yield row(ids.slice(0, len(texts) - 1), _answers(texts[:-1], texts[1:]))
                held = (ids.slice(len(texts) - 1, 1), texts[-1])
        if held is not None:
            yield border(1, *held)

    schema = f"doc_id {kind}, {_TYPES}, edge int, part int, text binary"
    made = checkpointed(dealt.mapInArrow(run, schema))
    borders = made.where("edge IS NOT NULL")
    parts = sorted(r.part for r in borders.where("edge = 0").select("part").collect())
    pairs = [(p, q) for p, q in zip(parts, parts[1:] + parts[:1])]
    session = docs.sparkSession
    following = session.createDataFrame(pairs, "part int, next_part int")
    first = borders.where("edge = 0").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    last = borders.where("edge = 1").select("doc_id", "part", "text").join(following, "part").join(first, "next_part").select("doc_id", "text", "next_text")

    def finish(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                yield batches.record(doc_id=one.column(0), **_answers([one.column(1)[0].as_py()], [one.column(2)[0].as_py()]))

    done = last.mapInArrow(finish, f"doc_id {kind}, {_TYPES}")
    return made.where("edge IS NULL").select("doc_id", *_COLUMNS).unionByName(done)
