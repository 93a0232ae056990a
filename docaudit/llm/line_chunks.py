"""Line dedup by content-defined chunks, in DataFrame functions only.

Each line is hashed; a rolling hash over the hashes of two consecutive lines ends a chunk where it falls on a multiple,
so that the same run of lines is cut alike wherever it stands. Chunks of two or more lines are grouped by hash over all
documents, their bytes are compared, and all but the first of equal ones go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.llm import batches
from docaudit.session import checkpointed

#: A chunk ends at one line in so many.
MEAN_LINES = 4
#: Factor of the rolling hash for the line before.
FACTOR = 31


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("bigint")


def _ends_chunk(i: Column) -> Column:
    h = F.col("_hashes")
    before = F.when(i > 1, F.element_at(h, F.greatest(i - 1, F.lit(1)))).otherwise(F.lit(0))
    return (i == F.size(h)) | ((F.element_at(h, i) + FACTOR * before) % MEAN_LINES == 0)


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, _row (hash of the text), start (first line, from 1), n (lines), h and chunk of all chunks of two or more lines."""
    lines = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("_row"), F.split("text", "\n", -1).alias("_lines"))
    hashed = lines.withColumn("_hashes", F.transform("_lines", _line_hash))
    ended = hashed.withColumn("_ends", F.filter(F.sequence(F.lit(1), F.size("_hashes")), _ends_chunk))
    start = lambda k: F.when(k > 0, F.element_at("_ends", F.greatest(k, F.lit(1))) + 1).otherwise(F.lit(1))
    spans = F.transform("_ends", lambda e, k: F.struct(start(k).alias("start"), (e - start(k) + 1).alias("n")))
    several = F.filter(spans, lambda s: s["n"] > 1)
    # Not explode(): the filter on an empty list that it brings splits the text anew for each line.
    cut = ended.select("doc_id", "_row", "_lines", F.explode_outer(several).alias("s")).where("s IS NOT NULL")
    text = F.array_join(F.slice("_lines", F.col("s.start"), F.col("s.n")), "\n")
    return cut.select("doc_id", "_row", "s.start", "s.n", text.alias("chunk")).withColumn("h", F.xxhash64("chunk"))


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, _row, start and n of every chunk that an equal one comes before, in the order of doc_id, text hash, line.

    Repeated rows with the same id and text count once. A hash that different texts share is decided by the texts.
    """
    every = chunks(docs)
    place = F.struct("doc_id", "_row", "start")
    by_hash = every.groupBy("h").agg(F.count("*").alias("count"), F.min(place).alias("first"), (F.min("chunk") == F.max("chunk")).alias("same"))
    by_hash = checkpointed(by_hash.where("count > 1").drop("count"))
    found = every.drop("chunk").join(by_hash, "h").where("same")
    out = found.where(~place.eqNullSafe(F.col("first"))).select("doc_id", "_row", "start", "n")
    clashes = by_hash.where("NOT same").select("h")
    if not clashes.isEmpty():
        own = every.join(clashes, "h", "left_semi")
        first = own.groupBy("h", "chunk").agg(F.min(place).alias("first"))
        more = own.join(first, ["h", "chunk"]).where(~place.eqNullSafe(F.col("first"))).select("doc_id", "_row", "start", "n")
        out = out.unionByName(more)
    return out


def _with_spans(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, Column]:
    """docs beside the array `gone` that `found` has for doc_id and _row, and that array's column."""
    text_hash, id_, row, gone = (batches.free_name(docs, c) for c in ("text_hash", "of_id", "of_row", "gone"))
    found = found.select(F.col("doc_id").alias(id_), F.col("_row").alias(row), F.col("gone").alias(gone))
    keyed = docs.withColumn(text_hash, F.xxhash64("text"))
    joined = keyed.join(found, keyed["doc_id"].eqNullSafe(found[id_]) & (keyed[text_hash] == found[row]), "left")
    return joined, F.col(gone)


def _computed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row: what is filtered or used later does not compute them again."""
    held = batches.free_name(df, "held")
    made = df.select("*", F.explode_outer(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))).alias(held))
    return made.select(*df.columns, *(F.col(held)[k].alias(k) for k in columns))


def _n_lines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with repeated chunks cut out of text, and n_lines and n_removed.

    Null text stays null with 0 lines; the empty text is one line. A document all of whose lines go keeps an empty
    text. Ties are broken by doc_id (null first), then a hash of the text, then the line. Columns n_lines and
    n_removed of the input are replaced.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    spans = repeated(docs).distinct().groupBy("doc_id", "_row").agg(F.array_sort(F.collect_list(F.struct("start", "n"))).alias("gone"))
    joined, gone = _with_spans(docs.select(*keep), spans)
    lines_, kept_ = batches.free_name(joined, "lines"), batches.free_name(joined, "kept")
    split = _computed(joined, **{lines_: F.when(gone.isNotNull(), F.split("text", "\n", -1))})
    # What stands before each chunk that goes, and behind the last.
    nth = lambda k: F.element_at(gone, F.greatest(k, F.lit(1)))
    begin = lambda k: F.when(k > 0, nth(k)["start"] + nth(k)["n"]).otherwise(F.lit(1))
    until = lambda k: F.when(k < F.size(gone), F.element_at(gone, F.least(k + 1, F.size(gone)))["start"]).otherwise(F.size(lines_) + 1)
    rest = F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda k: F.slice(lines_, begin(k), until(k) - begin(k))))
    cut = _computed(split, **{kept_: F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))})
    n_removed = F.coalesce(F.aggregate(gone, F.lit(0), lambda s, x: s + x["n"]), F.lit(0)).cast("bigint")
    n_lines = F.coalesce(_n_lines(F.col("text")), F.lit(0)).cast("bigint")
    return cut.select(*(F.col(kept_).alias(c) if c == "text" else F.col(c) for c in keep), n_lines.alias("n_lines"), n_removed.alias("n_removed"))


#: Ends a line, but within a run of empty lines.
UNIT_END = r"\n(?:(?<!\n\n)|(?!\n))"


#: A line of text: two words, or two characters of a script that writes no blanks between words.
TEXT_LINE = r"\S\s+\S|[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]{2}"


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, _row, start and n (1 or 2) of every line of text that stood before, and of every two lines in a row, one not blank, that did, in the order of doc_id, text hash, line.

    Empty lines in a row between others count as one line here. A single word (a mark, a brace) stands for itself and
    is repeated only beside a line that is repeated with it. Two lines of text are repeated if each is, so that such
    pairs are not looked for. Lines are equal if 128 bits of their hash are; repeated rows with the same id and text
    count once.
    """
    lines = docs.where(F.length("text") > 0).select("doc_id", F.xxhash64("text").alias("_row"), F.split("text", UNIT_END, -1).alias("_lines"))
    lines = _computed(lines, _own=F.transform("_lines", lambda x: x.rlike(TEXT_LINE)))

    def looked_for(i: Column) -> Column:
        line, after = F.element_at("_lines", i), F.get("_lines", i)
        own, next_own = F.element_at("_own", i), F.get("_own", i)
        one = F.when(own, F.struct(i.alias("start"), F.lit(1).alias("n"), line.alias("said")))
        two = F.when(~(own & next_own), F.struct(i.alias("start"), F.lit(2).alias("n"), F.concat(line, F.lit("\n"), after).alias("said")))
        return F.array(one, two)

    # Not explode(): the filter on an empty list that it brings splits the text anew for each line.
    every = lines.select("doc_id", "_row", F.explode_outer(F.flatten(F.transform(F.sequence(F.lit(1), F.size("_lines")), looked_for))).alias("p")).where(F.col("p.said").rlike(r"\S"))
    every = every.select("doc_id", "_row", "p.start", "p.n", F.unhex(F.md5(F.concat(F.col("p.n").cast("string"), F.col("p.said")).cast("binary"))).alias("h"))
    place = F.struct("doc_id", "_row", "start")
    firsts = checkpointed(every.groupBy("h").agg(F.count("*").alias("count"), F.min(place).alias("first")).where("count > 1").drop("count"))
    return every.join(firsts, "h").where(~place.eqNullSafe(F.col("first"))).select("doc_id", "_row", "start", "n").distinct()


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs without what repeated_lines() finds, and n_lines and n_removed as in deduplicated().

    Every line's text stays where it stands first.
    """
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    joined, gone = _with_spans(docs.select(*keep), repeated_lines(docs).groupBy("doc_id", "_row").agg(F.flatten(F.collect_list(F.sequence("start", F.col("start") + F.col("n") - 1))).alias("gone")))
    lines_, rest_, kept_ = (batches.free_name(joined, c) for c in ("lines", "rest", "kept"))
    split = _computed(joined, **{lines_: F.when(gone.isNotNull(), F.split("text", UNIT_END, -1))})
    left = F.array_except(F.sequence(F.lit(1), F.size(lines_)), gone)
    cut = _computed(split, **{rest_: F.when(gone.isNotNull(), F.transform(left, lambda i: F.element_at(lines_, i)))})
    cut = _computed(cut, **{kept_: F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(rest_, "\n"))})
    n_left = F.when(F.size(rest_) > 0, _n_lines(F.col(kept_))).otherwise(0)
    n_removed = F.when(gone.isNull(), F.lit(0)).otherwise(_n_lines(F.col("text")) - n_left).cast("bigint")
    n_lines = F.coalesce(_n_lines(F.col("text")), F.lit(0)).cast("bigint")
    return cut.select(*(F.col(kept_).alias(c) if c == "text" else F.col(c) for c in keep), n_lines.alias("n_lines"), n_removed.alias("n_removed"))


#: The same result in DuckDB's SQL, chunks compared as texts.
SQL = f"""
WITH lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents
), hashed AS (
  SELECT *, list_transform(l, lambda x: CAST('0x' || md5(x)[1:8] AS BIGINT)) AS h FROM lines
), ended AS (
  SELECT *, list_filter(range(1, len(l) + 1), lambda i: i = len(l) OR (h[i] + {FACTOR} * (CASE WHEN i > 1 THEN h[i - 1] ELSE 0 END)) % {MEAN_LINES} = 0) AS e FROM hashed
), chunked AS (
  SELECT doc_id, l, unnest(e) AS last, unnest(list_concat([0], e[1:len(e) - 1])) + 1 AS start FROM ended
), texts AS (
  SELECT doc_id, start, last, array_to_string(l[start:last], chr(10)) AS chunk FROM chunked
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY chunk, last > start ORDER BY doc_id, start) AS nth FROM texts
), kept AS (
  SELECT doc_id, string_agg(chunk, chr(10) ORDER BY start) FILTER (NOT (last > start AND nth > 1)) AS text,
    coalesce(sum(last - start + 1) FILTER (last > start AND nth > 1), 0)::BIGINT AS n_removed
  FROM ranked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(d.l), 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.text, '')) END AS kept_sha256
FROM lines d LEFT JOIN kept k USING (doc_id)
"""
