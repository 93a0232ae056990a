"""Hard negatives by vertical scans of vectors in whole numbers.

Anchors and rows are dealt into blocks, and each pair of blocks meets in a task of its own. There the rows lie as
columns, one a dimension. For each anchor the columns are read in the order of its descending magnitudes; what the
unread columns can add at least and at most, by their least and greatest values in the block, bounds every row's score
from both sides. Rows whose bounds can no longer lead into the result drop out of the candidate bitmap, until the last
column makes the scores of those left exact. A first pass finds each anchor's positives. Their scores set the windows
in which a second pass looks for negatives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from docaudit.session import checkpointed, scratch

POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between these shares, in percent, of the positive's.
LOW, HIGH = 30, 90
SCALE = 256
#: Rows and anchors in a block, on average; both sides are copied once for each block of the other.
ROWS, ANCHORS = 8_192, 8_192
#: Dimensions between two looks at the bitmap.
STEP = 8
#: Whole numbers that a double holds exactly.
EXACT = 1 << 53
INT64 = (-(1 << 63), (1 << 63) - 1)


def quantised(vector: Column) -> Column:
    """floor(SCALE * x) of every component, x as a double."""
    return F.transform(vector, lambda x: F.floor(SCALE * x.cast("double")).cast("bigint"))


def usable(label: Column, vector: Column) -> Column:
    """Label and vector are there, and all components are finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return label.isNotNull() & vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(finite(x.cast("double")), F.lit(False)))


def _matrix(lists: pa.Array) -> np.ndarray:
    """One row a list of whole numbers, zeros behind shorter ones; Python numbers where a sum could leave a double."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _as_numbers(rows: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both padded to one width, as doubles if all sums of products are exact in them, else as Python's numbers."""
    width = max(rows.shape[1], anchors.shape[1])
    rows, anchors = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (rows, anchors))
    top = [max(abs(int(x.min(initial=0))), int(x.max(initial=0))) for x in (rows, anchors)]
    kind = np.float64 if max(width, 1) * top[0] * top[1] < EXACT else object
    return rows.astype(kind), anchors.astype(kind)


class Columns:
    """Rows of a block as columns, and the least and greatest value of each."""

    def __init__(self, rows: np.ndarray):
        self.columns = np.ascontiguousarray(rows.T)
        n = len(self.columns)
        self.low = self.columns.min(axis=1) if rows.size else np.zeros(n, rows.dtype)
        self.high = self.columns.max(axis=1) if rows.size else np.zeros(n, rows.dtype)

    def scan(self, anchor: np.ndarray, alive: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """Rows (of those in `alive`) that `keep(least, most)` holds to the end, and their exact scores.

        keep gets the bounds of the candidates' scores and gives a mask; it must hold every row of the result.
        """
        order = np.argsort(-np.abs(anchor), kind="stable")
        order = order[anchor[order] != 0]
        one, other = anchor[order] * self.low[order], anchor[order] * self.high[order]
        # What the columns from the k-th on can add.
        least, most = (np.append(np.cumsum(f(one, other)[::-1])[::-1], 0) for f in (np.minimum, np.maximum))
        score = np.zeros(len(alive), self.columns.dtype)
        for k in range(0, len(order), STEP):
            if not len(alive):
                break
            read = order[k : k + STEP]
            block = self.columns[read] if len(alive) == self.columns.shape[1] else self.columns[read[:, None], alive]
            score = score + anchor[read] @ block
            held = keep(score + least[min(k + STEP, len(order))], score + most[min(k + STEP, len(order))])
            if not held.all():
                alive, score = alive[held], score[held]
        return alive, score


def _kth(values: np.ndarray, k: int):
    """The k-th greatest, or None if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else None


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k by score, then id; null ids, as the greatest number, come last."""
    if len(score) > k:
        least = _kth(score, k)
        near = np.flatnonzero(score >= least)
    else:
        near = np.arange(len(score))
    return near[np.lexsort((ids[near], -score[near]))][:k]


def _longs(values: list) -> pa.Array:
    """Scores beyond 64 bits become the nearest number that 64 bits hold."""
    return pa.array([min(max(int(x), INT64[0]), INT64[1]) for x in values], pa.int64())


def _ids(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().fill_null(INT64[1]).to_numpy(zero_copy_only=False)


def _met(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, function, schema: str) -> DataFrame:
    """function(anchors, rows) over every pair of blocks: a stated set of queries against all rows."""
    a, b = max(1, -(-n_anchors // ANCHORS)), max(1, -(-n_rows // ROWS))
    to_all = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("_a", F.pmod(F.xxhash64("row"), F.lit(a))).withColumn("_b", to_all(b))
    right = rows.toDF(*rows.columns).withColumn("_b", F.pmod(F.xxhash64("row"), F.lit(b))).withColumn("_a", to_all(a))
    keys = [F.col("_a").cast("bigint"), F.col("_b").cast("bigint")]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(function, schema)


def _nearest(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """For each anchor the first POSITIVES of the block's other rows with its label."""
    matrix, wanted = _as_numbers(_matrix(rows.column("q")), _matrix(anchors.column("q")))
    labels, ids, numbers = rows.column("label").to_pylist(), _ids(rows, "vec_id"), rows.column("row").to_numpy()
    own: dict = {}
    for k, label in enumerate(labels):
        own.setdefault(label, []).append(k)
    own = {label: (np.array(x), Columns(matrix[x])) for label, x in own.items()}
    at, row, score = [], [], []
    for k, (label, number) in enumerate(zip(anchors.column("label").to_pylist(), anchors.column("row").to_pylist())):
        if label not in own:
            continue
        members, block = own[label]

        def keep(least, most):
            bar = _kth(least, POSITIVES)
            return np.ones(len(least), bool) if bar is None else most >= bar

        found, exact = block.scan(wanted[k], np.flatnonzero(numbers[members] != number), keep)
        best = _first(exact, ids[members[found]], POSITIVES)
        at += [k] * len(best)
        row += members[found[best]].tolist()
        score += exact[best].tolist()
    anchor = anchors.select(["row", "vec_id"]).take(pa.array(at, pa.int64()))
    return pa.table({"row": anchor.column(0), "anchor_id": anchor.column(1), "positive_id": rows.column("vec_id").take(pa.array(row, pa.int64())), "positive_score": _longs(score)})


def window(positive: int) -> tuple[int, int]:
    """Least and greatest score of a negative; nothing lies between them if the positive's is negative."""
    return -(-LOW * positive // 100), HIGH * positive // 100


def _within(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """For each anchor and positive the first NEGATIVES of the block's rows with other labels and scores in the window."""
    matrix, wanted = _as_numbers(_matrix(rows.column("q")), _matrix(anchors.column("q")))
    labels, ids = np.array(rows.column("label").to_pylist(), object), _ids(rows, "vec_id")
    block = Columns(matrix)
    # Nulls stay away from here: rows without label took no part.
    others = {label: np.flatnonzero(labels != label) for label in set(anchors.column("label").to_pylist())}
    at, nth, row, score = [], [], [], []
    for k, (label, positives) in enumerate(zip(anchors.column("label").to_pylist(), anchors.column("positives").to_pylist())):
        spans = [window(p["positive_score"]) for p in positives]
        open_ = sorted({s for s in spans if s[0] <= s[1]})
        if not open_:
            continue

        def keep(least, most):
            held = np.zeros(len(least), bool)
            for low, high in open_:
                may = (most >= low) & (least <= high)
                sure = least[(least >= low) & (most <= high)]
                bar = _kth(sure, NEGATIVES)
                held |= may if bar is None else may & (most >= bar)
            return held

        found, exact = block.scan(wanted[k], others[label], keep)
        for n, (low, high) in enumerate(spans):
            inside = np.flatnonzero((exact >= low) & (exact <= high))
            best = inside[_first(exact[inside], ids[found[inside]], NEGATIVES)]
            at += [k] * len(best)
            nth += [n] * len(best)
            row += found[best].tolist()
            score += exact[best].tolist()
    return pa.table({"row": anchors.column("row").take(pa.array(at, pa.int64())), "nth": pa.array(nth, pa.int32()), "negative_id": rows.column("vec_id").take(pa.array(row, pa.int64())), "negative_score": _longs(score)})


def mine(vectors: DataFrame, is_anchor: Column, label: str = "label", vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of all anchors.

    vectors has vec_id, label and vector. Rows without a usable label or vector take no part; a null vec_id comes last
    among ties and leads to a null id. Vectors of different lengths are compared as if zeros followed the shorter.
    Rows with one vec_id are rows of their own: each is an anchor if is_anchor says so, and the other one's candidate;
    rows that tie in score and id change nothing in the result. An anchor without positives or negatives has no row,
    an empty table gives none. Extra columns are not read.
    """
    found = vectors.where(usable(F.col(label), F.col(vector)))
    found = found.select("vec_id", F.col(label).alias("label"), quantised(F.col(vector)).alias("q"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.monotonically_increasing_id().alias("row"))
    with scratch(vectors.sparkSession) as kept:
        rows = kept(found)
        n_rows, n_anchors = rows.agg(F.count("*"), F.count_if("anchor")).first()
        anchors = rows.where("anchor").drop("anchor")
        rows = rows.drop("anchor")
        kind = rows.schema["vec_id"].dataType.simpleString()
        ranked = lambda df, keys, score, id_: df.withColumn("rank", F.row_number().over(W.Window.partitionBy(*keys).orderBy(F.desc(score), F.asc_nulls_last(id_))))
        positives = _met(anchors, rows, n_anchors, n_rows, _nearest, f"row bigint, anchor_id {kind}, positive_id {kind}, positive_score bigint")
        positives = ranked(positives, ["row"], "positive_score", "positive_id").where(F.col("rank") <= POSITIVES)
        # At most POSITIVES in a list.
        lists = kept(positives.groupBy("row", "anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("positives")))
        known = anchors.join(lists.drop("anchor_id"), "row")
        negatives = _met(known, rows, n_anchors, n_rows, _within, f"row bigint, nth int, negative_id {kind}, negative_score bigint")
        negatives = ranked(negatives, ["row", "nth"], "negative_score", "negative_id").where(F.col("rank") <= NEGATIVES)
        named = negatives.join(lists, "row").withColumn("positive", F.col("positives")[F.col("nth")])
        out = named.select("anchor_id", "positive.positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive.positive_score", "negative_score")
        return checkpointed(out)


#: The same result in DuckDB's SQL.
SQL = f"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score
QUALIFY rank <= {NEGATIVES}
"""
