"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints at three or fewer differing bits agree, but for one bit at most, in one of their two halves. Each half is
indexed with one bit a wildcard, for every bit: 64 keys for a fingerprint. Equal keys are joined, and candidates are
verified on all bits. Only distinct fingerprints take part, so copies cost nothing. A key with very many
fingerprints is cut again by the same rule over the other half, and again: links stay whole.

Near copies of the pipeline take the same links as candidates, and MinHash keys over shingle sets for what lies beyond
three bits; both are verified on the sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm import batches, words
from docaudit.llm.components import components
from docaudit.session import checkpointed

SHINGLE = 3
BITS = 3
SEED = 42
#: Fingerprints that one key's group is compared within; larger groups are cut again. Cutting makes 32 rows of each,
#: which costs more than comparing it with so many.
GROUP = 8192
U64 = np.uint64
_P1, _P2, _P3, _P4, _P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def xxh64_spans(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of every span of a padded() buffer."""
    view = words.loads(buffer)
    size = ends - starts
    with np.errstate(over="ignore"):
        s = U64(seed)
        h = np.full(len(starts), s + _P5)
        at = starts.copy()
        long = np.flatnonzero(size >= 32)
        if len(long):
            lanes = [np.full(len(long), v) for v in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            stripes, live, t = size[long] // 32, np.arange(len(long)), 0
            while len(live):
                for k in range(4):
                    lanes[k][live] = _rotated(lanes[k][live] + view[at[long[live]] + 8 * k] * _P2, 31) * _P1
                at[long[live]] += 32
                t += 1
                live = live[stripes[live] > t]
            x = _rotated(lanes[0], 1) + _rotated(lanes[1], 7) + _rotated(lanes[2], 12) + _rotated(lanes[3], 18)
            for v in lanes:
                x = (x ^ (_rotated(v * _P2, 31) * _P1)) * _P1 + _P4
            h[long] = x
        h += size.astype(U64)
        rest = ends - at
        for k in range(3):
            i = np.flatnonzero(rest >= 8 * (k + 1))
            h[i] = _rotated(h[i] ^ (_rotated(view[at[i] + 8 * k] * _P2, 31) * _P1), 27) * _P1 + _P4
        at, rest = at + (rest & ~7), rest & 7
        i = np.flatnonzero(rest >= 4)
        h[i] = _rotated(h[i] ^ ((view[at[i]] & U64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
        at, rest = at + (rest & 4), rest & 3
        for k in range(3):
            i = np.flatnonzero(rest > k)
            h[i] = _rotated(h[i] ^ (buffer[at[i] + k].astype(U64) * _P5), 11) * _P1
        h = (h ^ (h >> U64(33))) * _P2
        h = (h ^ (h >> U64(29))) * _P3
        return h ^ (h >> U64(32))


#: For each byte, eight counters of eight bits, one for each of its bits.
_SPREAD = np.zeros(256, U64)
for _k in range(8):
    _SPREAD |= ((np.arange(256, dtype=U64) >> U64(_k)) & U64(1)) << U64(8 * _k)


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """One number for each text: a bit is 1 if it is set in over half of the shingles' hashes."""
    low = words.LOWER[data] if len(data) else data
    inside = ~words.SPACES[low]
    at, to, first = words.word_spans(low, offsets, ~words.SPACES)
    # Words with one space behind each: a shingle is a slice of that.
    sizes = to - at
    joined = np.full(int(sizes.sum()) + len(at), 0x20, np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    joined[words.ranges(begin, sizes)] = low[inside]
    n = np.diff(first)
    counts = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    starts = words.ranges(first[:-1], counts)
    text = np.repeat(np.arange(len(n)), counts)
    last = np.minimum(starts + shingle, first[1:][text]) - 1
    h = xxh64_spans(words.padded(joined), begin[starts], (begin + sizes)[last], seed)
    return _majority(h, counts)


def _majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of counts[i] hashes, the bits set in over half of them; 0 for an empty run."""
    out = np.zeros(len(counts), U64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    blocks = -(-counts[some] // 255)
    edges = words.ranges(np.zeros(len(some), np.int64), blocks) * 255 + np.repeat((np.cumsum(counts) - counts)[some], blocks)
    of = np.cumsum(blocks) - blocks
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[((h >> U64(8 * k)) & U64(255)).astype(np.int64)], edges)
        each = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), of)
        bits = 2 * each > counts[some][:, None]
        out[some] |= (bits.astype(U64) << np.arange(8 * k, 8 * k + 8, dtype=U64)).sum(1)
    return out


def fingerprinted(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint as a signed long; null, empty and wordless texts have 0."""

    def run(part, data, offsets):
        return batches.record(doc_id=part.column(part.schema.get_field_index("doc_id")), f=pa.array(fingerprints(data, offsets, shingle).view(np.int64)))

    return batches.map_slices(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, f bigint")


def _keys(level: int):
    """The keys of one level: a segment of the bits that no earlier level used, with each of its bits a wildcard.

    Level 0 has two segments of 32 bits. A group that it leaves large agrees in 31 bits of one; the other is cut into
    two of 16, and the half of that which level 1 leaves over into two of 8. After that 53 bits agree.
    """
    f, k1, k2 = F.col("f"), F.col("k1"), F.col("k2")
    width = (32, 16, 8)[level]

    def lower(x, by, bits):
        return F.call_function("shiftrightunsigned", x, by.cast("int")).bitwiseAND(F.lit((1 << bits) - 1))

    def key(i):
        part, bit = F.floor(i / width), i % width
        if level == 0:
            free = f
        else:
            outer = F.floor(F.call_function("shiftrightunsigned", k1, F.lit(32)).bitwiseAND(63) / 32)
            free = lower(f, 32 * (1 - outer), 32)
            if level == 2:
                free = lower(free, 16 * (1 - F.floor(F.call_function("shiftrightunsigned", k2, F.lit(16)) / 16)), 16)
        rest = lower(free, part * width, width).bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.cast("int"))))
        return (k1 + i.cast("bigint") * (1 << 32) + rest) if level == 0 else (k2 * (1 << (12 if level == 2 else 0)) + i.cast("bigint") * (1 << width) + rest)

    return F.transform(F.sequence(F.lit(0), F.lit(2 * width - 1)), key)


def _forest(v: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over the rows of v that differ in `most` bits or fewer."""
    left = np.arange(len(v))
    found: list[tuple[int, int]] = []
    while len(left) > 1:
        reached, left = left[:1].tolist(), left[1:]
        while reached and len(left):
            r = reached.pop()
            near = np.bitwise_count(v[left] ^ v[r]).sum(1) <= most
            new = left[near].tolist()
            found += [(r, x) for x in new]
            reached += new
            left = left[~near]
    return found


def links(prints: DataFrame, verify: list[str], most: int, group: int = GROUP) -> DataFrame:
    """Links (a, b) of nodes that connect all pairs with 3 or fewer differing bits in f and `most` in the verify columns.

    prints: node, t (number of the fingerprint kind, below 100), f, verify columns; all longs. Within the group of one
    key a spanning forest is emitted: what it leaves out is connected through it.
    """
    columns = list(dict.fromkeys(["node", *verify]))
    kept = list(dict.fromkeys([*columns, "f"]))
    # A small table makes many keys: it is dealt out first, to tasks that are not merged again.
    prints = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node", "t")
    keyed = prints.select((F.col("t").cast("bigint") * (1 << 40)).alias("k1"), F.lit(0).cast("bigint").alias("k2"), *kept)
    keyed = keyed.select("*", F.explode(_keys(0)).alias("k")).select(F.col("k").alias("k1"), "k2", *kept)
    at = [columns.index(c) for c in verify]
    out = None
    for level in range(3):
        sizes = checkpointed(keyed.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1"))
        small = sizes if level == 2 else sizes.where(F.col("n") <= group)
        # By a shuffle at every size: the list of keys grows with the input.
        groups = keyed.select("k1", "k2", *columns).join(small.select("k1", "k2").hint("merge"), ["k1", "k2"])
        lists = groups.groupBy("k1", "k2").agg(*(F.collect_list(F.struct(*columns)).alias("rows"),)).select("rows")

        def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in found:
                rows = batch.column(0)
                flat = rows.flatten()
                fields = [np.asarray(x) for x in flat.flatten()]
                node, v = fields[0], np.stack([fields[k] for k in at], 1).view(np.uint64)
                bounds = np.r_[0, np.cumsum(np.asarray(rows.value_lengths()))]
                # Most groups are pairs: these at once.
                two = bounds[:-1][np.diff(bounds) == 2]
                near = two[np.bitwise_count(v[two] ^ v[two + 1]).sum(1) <= most]
                made = [(node[near], node[near + 1])]
                for k in np.flatnonzero(np.diff(bounds) > 2).tolist():
                    own = _forest(v[bounds[k] : bounds[k + 1]], most)
                    if own:
                        pair = np.array(own) + bounds[k]
                        made.append((node[pair[:, 0]], node[pair[:, 1]]))
                yield batches.record(a=np.concatenate([x for x, _ in made]), b=np.concatenate([x for _, x in made]))

        made = lists.mapInArrow(run, "a bigint, b bigint").distinct()
        out = made if out is None else out.unionByName(made)
        if level == 2:
            break
        large = sizes.where(F.col("n") > group).select("k1", "k2")
        if large.isEmpty():
            break
        keyed = keyed.join(large, ["k1", "k2"]).select("*", F.explode(_keys(level + 1)).alias("k")).select("k1", F.col("k").alias("k2"), *kept)
    return out


def near_components(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, f (the fingerprint as a signed long) and component_id, the least doc_id reachable over links.

    Documents without words have fingerprint 0 and are linked like any other; repeated rows share a component;
    a null id is never a component's name unless all its documents' ids are null.
    """
    if bits > 3:
        raise ValueError("two segments with one wildcard bit each find up to 3 differing bits")
    prints = checkpointed(fingerprinted(docs, shingle))
    distinct = checkpointed(prints.groupBy("f").agg(F.min("doc_id").alias("first")))
    found = components(links(distinct.select(F.col("f").alias("node"), F.lit(0).alias("t"), "f"), ["node"], bits))
    named = _named(distinct, found.withColumnRenamed("node", "f"), "f")
    return prints.join(named, "f", "left").select("doc_id", "f", "component_id")


def _named(distinct: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """key and component_id for every distinct key with its least id `first`."""
    rooted = checkpointed(distinct.join(roots, key, "left"))
    least = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("least"))
    return checkpointed(rooted.join(checkpointed(least), "root", "left").select(key, F.coalesce("least", "first").alias("component_id")))


#: The pipeline's rule: sets of five-word shingles with a Jaccard similarity of 4/5 or more. MinHashes in BANDS keys of
#: ROWS each give candidates beside the links of fingerprints: a pair at 0.8 shares no key once in 13,000 times, one at 0.85 once in 1.3 million.
#: The sets themselves verify.
NEAR_SHINGLE = 5
BANDS = 24
ROWS = 5
_FACTORS = words.mixed(np.arange(1, BANDS * ROWS + 1, dtype=U64)) | U64(1)
#: Nodes of a block; two blocks at most meet in a task.
BLOCK = 256
#: So many candidates' document ids are sent to the tasks that read their texts; more are joined.
BROADCAST_NODES = 500_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, sorted, one text behind the other, and their number. A text of fewer words is one shingle."""
    low = words.LOWER[data] if len(data) else data
    at, to, first = words.word_spans(low, offsets, ~words.SPACES)
    h, n = words.hash_spans(words.padded(low), at, to), np.diff(first)
    starts, counts = words.gram_starts(first, NEAR_SHINGLE)
    grams = words.gram_hashes(h, NEAR_SHINGLE)[starts]
    short = np.flatnonzero((n > 0) & (n < NEAR_SHINGLE))
    whole = np.array([words.gram_hashes(h[first[k] : first[k + 1]], int(n[k]))[0] for k in short], U64)
    grams = np.insert(grams, (np.cumsum(counts) - counts)[short], whole)
    counts[short] = 1
    text = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((grams, text))
    grams = grams[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    return grams[new], np.bincount(text[new], minlength=len(counts))


def set_prints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text a hash of its shingle set, the set's size and its BANDS keys; an empty set has hash 0 and no keys."""
    grams, counts = shingle_sets(data, offsets)
    some = np.flatnonzero(counts)
    node = np.zeros(len(counts), U64)
    keys = np.zeros((len(some), BANDS), U64)
    if len(some):
        at = (np.cumsum(counts) - counts)[some]
        node[some] = words.mixed(np.add.reduceat(words.mixed(grams), at) + counts[some].astype(U64))
        for b in range(BANDS):
            h = np.full(len(some), U64(b))
            for factor in _FACTORS[b * ROWS : (b + 1) * ROWS]:
                h = words.mixed(h ^ np.minimum.reduceat(grams * factor, at))
            keys[:, b] = h
    return node, counts, keys


def _sets(docs: DataFrame, distinct: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and s (the shingle set) of all given nodes, read from one document of each."""
    wanted = checkpointed(distinct.join(nodes, "node", "left_semi").select("node", F.col("rep.doc_id").alias("_id"), F.col("rep.row").alias("_own")))
    few = wanted.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    texts = rows.join(F.broadcast(wanted) if few else wanted, rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["row"] == F.col("_own"))).select("node", "text")

    def run(part, data, offsets):
        grams, counts = shingle_sets(data, offsets)
        ends = np.r_[0, np.cumsum(counts)].astype(np.int32)
        return batches.record(node=part.column(part.schema.get_field_index("node")), s=pa.ListArray.from_arrays(pa.array(ends), pa.array(grams.view(np.int64))))

    # Repeated rows give a set more than once.
    return checkpointed(batches.map_slices(texts, run, "node bigint, s array<bigint>", limit=1 << 20).groupBy("node").agg(F.first("s").alias("s")))


def _verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a similarity of 4/5 or more."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    return checkpointed(both.where(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b"))


def _first_links(member: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified links between each node and one other: in its largest key, the node that has most company over all keys."""
    company = member.groupBy("node").agg(F.sum("many").alias("company"), F.max(F.struct("many", "key")).alias("own"))
    company = checkpointed(company.select("node", "company", F.col("own.key").alias("key")))
    pivots = member.join(company.select("node", "company"), "node").groupBy("key").agg(F.max(F.struct("company", "node")).alias("p"))
    pairs = company.select("node", "key").join(pivots.select("key", F.col("p.node").alias("b")), "key").where("node != b")
    return _verified(sets, checkpointed(pairs.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()))


def _joined(comps: np.ndarray, outside: np.ndarray, nodes: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links that join the components of one group as far as its outside nodes' sets allow: a forest, not all pairs."""
    sizes = np.array([len(x) for x in sets])
    _, comp = np.unique(comps, return_inverse=True)
    _, gram = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.cumsum(sizes) - sizes
    mark = np.zeros(int(gram.max()) + 1, bool)
    a, b = [], []
    for x in np.flatnonzero(outside).tolist():
        open_ = (comp != comp[x]) & (5 * np.minimum(sizes, sizes[x]) >= 4 * np.maximum(sizes, sizes[x]))
        if not open_.any():
            continue
        own = gram[at[x] : at[x] + sizes[x]]
        mark[own] = True
        other = np.flatnonzero(open_)
        if 2 * len(other) > len(sizes):
            shared = np.add.reduceat(mark[gram].astype(np.int64), at)[other]
        else:
            shared = np.array([np.count_nonzero(mark[gram[at[y] : at[y] + sizes[y]]]) for y in other.tolist()])
        mark[own] = False
        near = other[9 * shared >= 4 * (sizes[other] + sizes[x])]
        _, first = np.unique(comp[near], return_index=True)
        for y in near[first].tolist():
            a.append(int(nodes[x])), b.append(int(nodes[y]))
            comp[comp == comp[y]] = comp[x]
    return a, b


def _rest_links(member: DataFrame, found: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Links between components that meet in a key. Of each key, the nodes outside its largest component meet all others, in blocks."""
    held = member.join(components(found), "node", "left").select("key", "node", F.coalesce("root", "node").alias("c"))
    held = checkpointed(held)
    counts = held.groupBy("key", "c").agg(F.count("*").alias("of"))
    open_ = counts.groupBy("key").agg(F.max(F.struct("of", "c")).alias("top"), F.sum("of").alias("many"), F.count("*").alias("comps")).where("comps > 1")
    turns = lambda n: F.ceil(n / block)
    open_ = checkpointed(open_.select("key", F.col("top.c").alias("top"), turns(F.col("many")).alias("n_all"), turns(F.col("many") - F.col("top.of")).alias("n_out")))
    rows = held.join(open_, "key").withColumn("outside", F.col("c") != F.col("top"))
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    place = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "node"), n)
    meet = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    as_other = F.transform(every(F.col("n_out")), lambda i: meet(i, place(F.col("n_all"), 1)))
    as_outside = F.transform(every(F.col("n_all")), lambda j: meet(place(F.col("n_out"), 2), j))
    alone = (F.col("n_all") == 1) & F.col("outside")
    other = rows.where(~alone).select("key", "node", "c", F.lit(False).alias("outside"), F.explode(as_other).alias("t"))
    outside = rows.where("outside").select("key", "node", "c", "outside", F.explode(as_outside).alias("t"))
    met = outside.unionByName(other).select("key", "t.i", "t.j", "node", "c", "outside")
    dealt = met.join(sets, "node").select("key", "i", "j", "node", "c", "outside", "s").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answered(rows: list) -> pa.RecordBatch:
            a, b = _joined(*(np.concatenate(x) for x in list(zip(*rows))[:3]), [s for r in rows for s in r[3]])
            return batches.record(a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()))

        group, last = [], None
        for batch in batches_in:
            if not batch.num_rows:
                continue
            turn = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            heads = np.flatnonzero(np.r_[True, (turn[1:] != turn[:-1]).any(1)]).tolist()
            lists = batch.column(6)
            grams, ends = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            node, c, outside = batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(5).to_numpy(zero_copy_only=False)
            for lo, hi in zip(heads, [*heads[1:], batch.num_rows]):
                if group and tuple(turn[lo]) != last:
                    yield answered(group)
                    group = []
                last = tuple(turn[lo])
                group.append((c[lo:hi].copy(), outside[lo:hi].copy(), node[lo:hi].copy(), [grams[ends[k] : ends[k + 1]].copy() for k in range(lo, hi)]))
        if group:
            yield answered(group)

    return checkpointed(dealt.mapInArrow(run, "a bigint, b bigint"))


def near_links(docs: DataFrame, distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """node and root of the components over all pairs that share a key and whose sets are near.

    distinct: node, rep (doc_id and row of one document), keys, f. Candidates are the links of fingerprints by deletion
    variants, and the keys for pairs that more than BITS bits keep apart. A first link for each node joins most of a
    key; what stays apart there is compared in blocks, so that no key's nodes are gathered and no pair is listed.
    """
    near = checkpointed(links(distinct.where("keys IS NOT NULL AND size(keys) > 0").select("node", F.lit(0).alias("t"), "f"), ["f"], BITS))
    member = distinct.select("node", F.explode("keys").alias("key"))
    sizes = checkpointed(member.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"))
    member = checkpointed(member.join(sizes, "key"))
    named = member.select("node").unionByName(near.select(F.explode(F.array("a", "b")).alias("node")))
    sets = _sets(docs, distinct, named.distinct())
    found = checkpointed(_verified(sets, near).unionByName(_first_links(member, sets)))
    return components(found.unionByName(_rest_links(member, found, sets, block)))


def duplicates(docs: DataFrame, prints: Callable = set_prints) -> DataFrame:
    """doc_id, row (xxhash64 of the text) and component_id over near-copies, chained.

    Candidates are SimHash fingerprints at BITS or fewer differing bits, met by deletion variants, and equal MinHash keys.
    Near means a Jaccard similarity of 0.8 or more between the sets of five-word shingles; every link is verified on
    the sets. Texts without words are one group. prints: set_prints(), or another choice of keys.
    """

    def run(part, data, offsets):
        node, counts, keys = prints(data, offsets)
        ends = np.r_[0, np.cumsum(np.where(counts > 0, BANDS, 0))].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))
        return batches.record(doc_id=part.column(part.schema.get_field_index("doc_id")), row=part.column(part.schema.get_field_index("row")), node=pa.array(node.view(np.int64)), n=pa.array(counts.astype(np.int64)), keys=lists, f=pa.array(fingerprints(data, offsets).view(np.int64)))

    kind = docs.schema["doc_id"].dataType.simpleString()
    each = checkpointed(batches.map_slices(docs.select("doc_id", F.xxhash64("text").alias("row"), "text"), run, f"doc_id {kind}, row bigint, node bigint, n bigint, keys array<bigint>, f bigint", limit=1 << 20))
    distinct = checkpointed(each.groupBy("node").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "row")).alias("rep"), F.first("keys").alias("keys"), F.min("f").alias("f")))
    named = _named(distinct.select("node", "first"), near_links(docs, distinct), "node")
    return each.select("doc_id", "row", "node").join(named, "node", "left").select("doc_id", "row", "component_id")
