"""Named queries over the tables, each beside the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.functions import text as T
from docaudit.operators import findings, reports, structure, tables
from docaudit.plans import model, oracle
from docaudit.plans import planted as planted  # registers its queries
from docaudit.plans.registry import ORACLE, QUERIES, query
from docaudit.plans.rules import FORMS, PATTERNS, PHRASES
from docaudit.sources import readers

#: Bands of account balances that the tier query uses, and tiers by market segment.
BANDS = (("AUTOMOBILE", -1000.0, 9000.0), ("BUILDING", 0.0, 10000.0), ("FURNITURE", -500.0, 9500.0), ("MACHINERY", 0.0, 9999.0), ("HOUSEHOLD", -1000.0, 10000.0))
SWEEP_LIMITS = (15, 20, 25, 30, 40, 50, 75)
SIGNALS = ("all-caps-shouting", "repeated-exclamation", "digit-density", "comma-space-form", "exclamation-form", "demonstrative-opener", "common-opener", "doubled-punctuation", "which-that-consistency")


def _with(rest: str) -> str:
    return f"WITH {model.SQL.strip()} {rest}"


@query(_with("SELECT doc_id, para, sent, text FROM sentences"), "documents")
def doc_sentences(docs):
    return model.sentences(docs).select("doc_id", "para", "sent", "text")


@query(_with("SELECT doc_id, para, text FROM paragraphs"), "documents")
def doc_paragraphs(docs):
    return model.paragraphs(docs).select("doc_id", "para", "text")


@query(_with("SELECT word, count(*) AS n, count(DISTINCT doc_id) AS documents FROM words GROUP BY word HAVING count(*) > 20"), "documents")
def word_counts(docs):
    return model.words(docs).groupBy("word").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents")).where("n > 20")


@query(_with("SELECT doc_id, para, sent, n_words::BIGINT AS n FROM sized WHERE n_words > 25"), "documents")
def sentence_too_long(docs):
    return structure.sentence_too_long(docs)


_SIZE = r"length(regexp_replace(text, '\s', '', 'g'))"


@query(_with(f"SELECT doc_id, count(*) AS n, round(100 * stddev_pop({_SIZE}) / avg({_SIZE}))::BIGINT AS cv FROM sentences GROUP BY doc_id HAVING count(*) >= 8 AND round(100 * stddev_pop({_SIZE}) / avg({_SIZE})) < 60"), "documents")
def sentence_rhythm(docs):
    return structure.sentence_rhythm(docs, 60)


@query(_with(f"SELECT doc_id, count(*) AS n, round(100 * stddev_pop({_SIZE}) / avg({_SIZE}))::BIGINT AS cv FROM paragraphs WHERE {_SIZE} > 0 GROUP BY doc_id HAVING count(*) >= 9 AND round(100 * stddev_pop({_SIZE}) / avg({_SIZE})) < 60"), "documents")
def paragraph_variance(docs):
    return structure.paragraph_variance(docs, 60)


@query(_with("SELECT doc_id, para, count(*) AS n FROM sized GROUP BY doc_id, para HAVING count(*) > 5 AND sum(n_words) > 60"), "documents")
def paragraph_too_long(docs):
    return structure.paragraph_too_long(docs)


@query(
    _with(""", each AS (SELECT doc_id, para, count(*) AS n FROM sentences GROUP BY doc_id, para),
    ones AS (SELECT doc_id, para, n, row_number() OVER (PARTITION BY doc_id ORDER BY para) - row_number() OVER (PARTITION BY doc_id, n = 1 ORDER BY para) AS island FROM each)
    SELECT doc_id, min(para) AS first, count(*) AS n FROM ones WHERE n = 1 GROUP BY doc_id, island HAVING count(*) > 1"""),
    "documents",
)
def one_sentence_runs(docs):
    return structure.one_sentence_runs(docs, 1)


@query(
    _with(r""", raw AS (SELECT doc_id, para, sent, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM (
      SELECT doc_id, para, sent, list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda x: length(x) > 0), lambda x: lower(x)) AS w FROM sentences)),
    pairs AS (SELECT *, lag(word) OVER (PARTITION BY doc_id, para, sent ORDER BY pos) AS before FROM raw)
    SELECT doc_id, para, sent, word FROM pairs WHERE word = before AND regexp_full_match(word, '\p{L}+')"""),
    "documents",
)
def doubled_word(docs):
    return structure.doubled_words(docs)


@query(
    _with(r""", headed AS (SELECT doc_id, para, sent, list_filter(regexp_split_to_array(text, '\s+'), lambda x: length(x) > 0)[1] AS head FROM sentences),
    islands AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para, sent) - row_number() OVER (PARTITION BY doc_id, head ORDER BY para, sent) AS island FROM headed)
    SELECT doc_id, head, count(*) AS n FROM islands GROUP BY doc_id, head, island HAVING count(*) > 1"""),
    "documents",
)
def repeated_head(docs):
    return structure.repeated_heads(docs, 1)


@query(
    _with(""", lists AS (SELECT doc_id, para, sent, list(word ORDER BY pos) AS w FROM words GROUP BY doc_id, para, sent),
    grams AS (SELECT doc_id, para, sent, unnest(list_distinct(list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' ')))) AS gram FROM lists WHERE len(w) >= 4)
    SELECT doc_id, gram, count(*) AS n FROM grams WHERE length(gram) >= 18 GROUP BY doc_id, gram HAVING count(*) > 2"""),
    "documents",
)
def ngram_repeat(docs):
    return structure.repeated_grams(docs, limit=2)


@query(
    _with(r""", b AS (SELECT doc_id, para, regexp_replace(text, '[^(){}\[\]（）［］「」『』]', '', 'g') AS marks FROM paragraphs),
    c AS (SELECT doc_id, para, list_reduce(list_concat([''], string_split(marks, '')), lambda s, c: CASE WHEN s <> '' AND list_contains(['()', '[]', '{}', '（）', '［］', '「」', '『』'], right(s, 1) || c) THEN left(s, length(s) - 1) ELSE s || c END) AS marks FROM b WHERE marks <> '')
    SELECT * FROM c WHERE marks <> ''"""),
    "documents",
)
def unbalanced_bracket(docs):
    return structure.unbalanced_brackets(docs)


@query(
    r"""WITH a AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Z]{2,6}'))) AS found, regexp_extract_all(text, '\(([A-Z]{2,6})\)', 1) AS spelled FROM documents WHERE text IS NOT NULL),
    b AS (SELECT doc_id, list_sort(list_filter(found, lambda x: NOT list_contains(spelled, x) AND x NOT IN ('USA','EU','PDF','URL','HTML','API','FAQ','CEO','GNU','MIT','BSD','THE'))) AS a FROM a)
    SELECT doc_id, len(a) AS n, array_to_string(a, ',') AS acronyms FROM b WHERE len(a) >= 3""",
    "documents",
)
def undefined_acronym(docs):
    return structure.undefined_acronyms(docs)


@query(oracle.patterns(PATTERNS), "documents")
def pattern_findings(docs):
    return findings.pattern_findings(docs).select("doc_id", "rule", "severity", "n")


@query(oracle.forms(FORMS), "documents")
def form_findings(docs):
    return findings.form_findings(docs).select("doc_id", "rule", "severity", "n")


@query(oracle.phrases(PHRASES), "documents")
def phrase_findings(docs):
    return findings.phrase_findings(docs)


@query(f"WITH {oracle.all_findings(PATTERNS, FORMS, PHRASES)} SELECT rule, severity, count(*) AS documents, sum(n)::BIGINT AS n FROM found GROUP BY rule, severity", "documents")
def findings_by_rule(docs):
    both = findings.pattern_findings(docs).unionByName(findings.form_findings(docs)).unionByName(findings.phrase_findings(docs))
    return both.groupBy("rule", "severity").agg(F.count("*").alias("documents"), F.sum("n").alias("n"))


@query(
    f"WITH {oracle.all_findings(PATTERNS, FORMS, PHRASES)} SELECT doc_id, count(DISTINCT rule) AS n, array_to_string(list_sort(list(DISTINCT rule)), ',') AS rules FROM found WHERE rule IN {SIGNALS} GROUP BY doc_id HAVING count(DISTINCT rule) >= 3",
    "documents",
)
def composite_signal(docs):
    both = findings.pattern_findings(docs).unionByName(findings.form_findings(docs)).unionByName(findings.phrase_findings(docs))
    return findings.composite(both, SIGNALS)


@query(
    f"WITH {oracle.all_findings(PATTERNS, FORMS, PHRASES)} SELECT doc_id, rule, substr(sha256(doc_id::VARCHAR || ' ' || rule || ' ' || n), 1, 16) AS fingerprint FROM found",
    "documents",
)
def fingerprint(docs):
    both = findings.pattern_findings(docs).unionByName(findings.form_findings(docs)).unionByName(findings.phrase_findings(docs))
    from docaudit.functions import text as T

    return both.select("doc_id", "rule", T.fingerprint(F.col("doc_id"), F.col("rule"), F.col("n")).alias("fingerprint"))


@query(oracle.not_run(PATTERNS, FORMS, PHRASES), "documents")
def not_run(docs):
    return findings.not_run(docs).groupBy("rule", "reason").agg(F.count("*").alias("documents"))


@query(
    r"SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[\p{Han}\p{Hiragana}\p{Katakana}]')) * 100 >= 15 * greatest(length(regexp_replace(text, '\s', '', 'g')), 1) THEN 'ja' ELSE 'en' END AS guessed FROM documents",
    "documents",
)
def lang_guess(docs):
    return docs.select("doc_id", readers.guessed_language(F.col("text")).alias("guessed"))


@query("WITH g AS (SELECT sha256(text) AS text_sha256, min(doc_id) AS first, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text) SELECT * FROM g WHERE n > 1", "documents")
def duplicate_document(docs):
    """Texts on several rows: rows meet by a hash of 256 bits, texts are not exchanged."""
    each = docs.where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("text_sha256")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    return each.where("n > 1").select("text_sha256", "first", "n")


@query(_with("SELECT sha256(text) AS para_sha256, count(*) AS n, count(DISTINCT doc_id) AS documents FROM paragraphs GROUP BY text HAVING count(*) > 1"), "documents")
def duplicate_paragraph(docs):
    each = model.paragraphs(docs).groupBy(F.sha2("text", 256).alias("para_sha256")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))
    return each.where("n > 1")


@query(
    _with(r""", raw AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS w FROM sentences),
    forms AS (SELECT doc_id, lower(w) AS key, w AS form FROM raw WHERE regexp_full_match(w, '\p{L}{4,}')),
    votes AS (SELECT key, form, count(DISTINCT doc_id) AS n FROM forms GROUP BY key, form),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, form) AS place FROM votes)
    SELECT key, form, n FROM ranked WHERE place > 1"""),
    "documents",
)
def cross_doc_term_variant(docs):
    own = model.sentences(docs).select("doc_id", F.explode(F.split("text", "\\s+")).alias("form")).where(F.col("form").rlike("^\\p{L}{4,}$"))
    votes = own.select("doc_id", F.lower("form").alias("key"), "form").distinct()
    return tables.minority(votes, "key", "form")


@query(
    _with(""", counts AS (SELECT word, count(*) AS n FROM words WHERE regexp_full_match(word, '[a-z]{4,}') GROUP BY word),
    known AS (SELECT word FROM counts WHERE n >= 40), rare AS (SELECT word FROM counts WHERE n = 1)
    SELECT rare.word AS unknown, min(known.word) AS near FROM rare JOIN known ON abs(length(rare.word) - length(known.word)) <= 1 AND levenshtein(rare.word, known.word) = 1 GROUP BY rare.word"""),
    "documents",
)
def unknown_word(docs):
    counts = model.words(docs).where(F.col("word").rlike("^[a-z]{4,}$")).groupBy("word").agg(F.count("*").alias("n"))
    kept = counts.where("n >= 40 OR n = 1")
    pairs = tables.near_variants(kept, "word")
    both = pairs.select(F.col("a").alias("unknown"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("unknown"), F.col("a").alias("near")))
    rare, known = kept.where("n = 1").select(F.col("word").alias("unknown")), kept.where("n >= 40").select(F.col("word").alias("near"))
    return both.join(rare, "unknown", "left_semi").join(known, "near", "left_semi").groupBy("unknown").agg(F.min("near").alias("near"))


@query("SELECT a.name AS a, b.name AS b FROM (SELECT DISTINCT s_name AS name FROM supplier) a JOIN (SELECT DISTINCT s_name AS name FROM supplier) b ON a.name < b.name AND levenshtein(a.name, b.name) <= 1", "supplier")
def name_variant(supplier):
    return tables.near_variants(supplier, "s_name")


@query(
    r"""WITH phones AS (SELECT DISTINCT regexp_replace(unnest(regexp_extract_all(text, '\+[0-9][0-9() -]{8,18}[0-9]')), '[^0-9]', '', 'g') AS name FROM documents)
    SELECT a.name AS a, b.name AS b FROM phones a JOIN phones b ON a.name < b.name AND abs(length(a.name) - length(b.name)) <= 2 AND levenshtein(a.name, b.name) <= 2""",
    "documents",
)
def phone_variant(docs):
    raw = docs.where("text IS NOT NULL").select(F.explode(F.regexp_extract_all("text", F.lit("(\\+[0-9][0-9() -]{8,18}[0-9])"), F.lit(1))).alias("raw"))
    return tables.near_variants(raw.select(F.regexp_replace("raw", "[^0-9]", "").alias("name")), "name", 2)


@query(_with(f"SELECT v.k::BIGINT AS \"limit\", count(*) FILTER (n_words > v.k) AS findings, count(DISTINCT doc_id) FILTER (n_words > v.k) AS documents FROM sized, (VALUES {', '.join(f'({k})' for k in SWEEP_LIMITS)}) v(k) GROUP BY v.k"), "documents")
def threshold_sweep(docs):
    return reports.sweep(model.sentences(docs), "n_words", SWEEP_LIMITS)


_MEASURES = ("paragraphs", "sentences", "words", "sentences_10_paragraphs", "words_a_sentence", "variation")
_MEASURED = """, m AS (SELECT doc_id, count(DISTINCT para) AS paragraphs, count(*) AS sentences, sum(n_words)::BIGINT AS words, round(count(*) * 10 / count(DISTINCT para))::BIGINT AS sentences_10_paragraphs,
  round(avg(n_words))::BIGINT AS words_a_sentence, round(100 * stddev_pop(n_words) / avg(n_words))::BIGINT AS variation FROM sized GROUP BY doc_id)"""


@query(_with(_MEASURED + " SELECT * FROM m"), "documents")
def structure_measures(docs):
    return reports.measures(docs)


@query(
    _with(_MEASURED + " " + " UNION ALL ".join(f"SELECT '{c}' AS measure, " + ", ".join(f"quantile_disc({c}, {p / 100})::BIGINT AS p{p}" for p in reports.PERCENTILES) + " FROM m" for c in _MEASURES)),
    "documents",
)
def structure_percentiles(docs):
    return reports.percentiles(reports.measures(docs), _MEASURES)


@query(
    r"""SELECT b.item_id, count(d.doc_id) > 0 AS quoted FROM benchmark b LEFT JOIN documents d ON contains(lower(regexp_replace(d.text, '\s+', '', 'g')), lower(regexp_replace(b.text, '\s+', '', 'g'))) AND regexp_replace(b.text, '\s+', '', 'g') <> '' GROUP BY b.item_id""",
    "benchmark", "documents",
)
def cite_check(benchmark, docs):
    """Which benchmark texts, of any length, some document holds; white space and case do not count."""
    from docaudit.functions import text as T
    from docaudit.operators import mentions

    keyed = benchmark.select("item_id", T.folded(F.col("text")).alias("key"))
    found = mentions.held_anywhere(keyed.where("key <> ''").select("key"), docs).withColumn("quoted", F.lit(True))
    return keyed.join(found, "key", "left").select("item_id", F.coalesce("quoted", F.lit(False)).alias("quoted"))


@query(
    r"""WITH q AS (SELECT l.doc_id, unnest(range(0, 3)) AS k, d.text FROM labels l JOIN documents d USING (doc_id) WHERE length(d.text) >= 40),
    c AS (SELECT doc_id || ':' || k AS quote_id, CASE k WHEN 2 THEN doc_id + 1 ELSE doc_id END AS doc_id, CASE k WHEN 1 THEN 'zq' || replace(substr(text, 11, 25), ' ', '  ') ELSE replace(substr(text, 11, 25), ' ', '  ') END AS quote FROM q),
    f AS (SELECT doc_id, lower(regexp_replace(text, '\s+', '', 'g')) AS body FROM documents WHERE text IS NOT NULL), k AS (SELECT quote_id, c.doc_id, lower(regexp_replace(quote, '\s+', '', 'g')) AS key, f.body FROM c LEFT JOIN f USING (doc_id))
    SELECT quote_id, CASE WHEN body IS NULL THEN 'missing-address' WHEN key <> '' AND contains(body, key) THEN 'ok' WHEN key <> '' AND EXISTS (SELECT 1 FROM f WHERE contains(f.body, k.key)) THEN 'quote-elsewhere' ELSE 'quote-not-found' END AS outcome FROM k""",
    "labels", "documents",
)
def cite_outcomes(labels, docs):
    """Quotations that begin within words, cut from labelled documents: their own, a changed one, and one that names the next document."""
    from docaudit.operators import mentions

    own = labels.join(docs, "doc_id").where(F.length("text") >= 40).select("doc_id", F.replace(F.substring("text", 11, 25), F.lit(" "), F.lit("  ")).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    named = F.when(F.col("k") == 2, F.col("doc_id") + 1).otherwise(F.col("doc_id"))
    quotes = own.select(F.concat_ws(":", "doc_id", "k").alias("quote_id"), named.alias("doc_id"), F.when(F.col("k") == 1, F.concat(F.lit("zq"), "part")).otherwise(F.col("part")).alias("quote"))
    return mentions.cite(quotes, docs)


@query(
    r"""WITH t AS (SELECT conv_id, turn, role, text, lag(role) OVER w AS before_role, lag(text) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    i AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: lower(regexp_replace(x, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'))), lambda x: length(x) > 0) AS w,
      list_filter(list_transform(regexp_split_to_array(coalesce(before, ''), '\s+'), lambda x: lower(regexp_replace(x, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'))), lambda x: length(x) > 0) AS r,
      list_filter(list_distinct(regexp_extract_all(coalesce(before, ''), '[0-9]+')), lambda x: NOT list_contains(regexp_extract_all(coalesce(text, ''), '[0-9]+'), x)) AS lost FROM t WHERE role = 'assistant' AND before_role = 'user'),
    g AS (SELECT conv_id || ':' || turn AS item_id, list_filter([CASE WHEN len(w) = 0 THEN 'empty' END, CASE WHEN len(w) > 400 THEN 'too long' END, CASE WHEN len(w) >= 20 AND len(list_distinct(w)) * 2 <= len(w) THEN 'repeats' END,
      CASE WHEN len(lost) > 0 THEN 'missing numbers' END, CASE WHEN len(r) > 0 AND len(list_distinct(list_intersect(w, r))) * 10 < len(list_distinct(r)) THEN 'unlike' END], lambda x: x IS NOT NULL) AS reasons FROM i)
    SELECT item_id, len(reasons) = 0 AS passed, array_to_string(reasons, ',') AS reasons FROM g""",
    "conversations",
)
def grade_items(conversations):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = conversations.withColumns({"before_role": F.lag("role").over(w), "reference": F.lag("text").over(w)})
    items = turns.where("role = 'assistant' AND before_role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("item_id"), F.col("text").alias("output"), "reference")
    return reports.grade(items)


@query("WITH t AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, turn AS number, before FROM t WHERE turn <> before + 1", "conversations")
def turn_gap(conversations):
    return tables.numbering_gaps(conversations, "conv_id", "turn")


@query("WITH t AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, turn, role FROM t WHERE role = before OR (role = 'system' AND turn > 0)", "conversations")
def role_order(conversations):
    from pyspark.sql import Window

    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return conversations.withColumn("before", before).where("role = before OR (role = 'system' AND turn > 0)").select("conv_id", "turn", "role")


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity * p_retailprice AS exact, l_extendedprice AS amount FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT l_orderkey, l_linenumber, round(amount * 100)::BIGINT AS written, round(exact * 100)::BIGINT AS expected FROM l
    WHERE round(amount * 100)::BIGINT NOT IN (floor(exact * 100)::BIGINT, round(exact * 100)::BIGINT, ceil(exact * 100)::BIGINT, floor(exact)::BIGINT * 100, round(exact)::BIGINT * 100, ceil(exact)::BIGINT * 100)""",
    "lineitem", "part",
)
def line_amount_mismatch(lineitem, part):
    rows = lineitem.join(part.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey")
    return tables.product_mismatch(rows, ["l_orderkey", "l_linenumber"], "l_quantity", "p_retailprice", "l_extendedprice")


@query(
    """WITH s AS (SELECT l_orderkey, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS expected, count(*) AS n FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS written, expected, n FROM orders JOIN s ON o_orderkey = l_orderkey WHERE n >= 2 AND abs(round(o_totalprice * 100)::BIGINT - expected) > n""",
    "lineitem", "orders",
)
def total_mismatch(lineitem, orders):
    return tables.total_mismatch(lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), orders, "o_orderkey", "l_extendedprice", "o_totalprice")


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_extendedprice::DECIMAL(12, 2) * l_tax::DECIMAL(4, 2) AS exact FROM lineitem), t AS (SELECT *, round(exact, 1) AS written FROM p)
    SELECT l_orderkey, l_linenumber, (written * 100)::BIGINT AS written, round(exact * 100)::BIGINT AS expected FROM t
    WHERE (written * 100)::BIGINT NOT IN (floor(exact * 100)::BIGINT, round(exact * 100)::BIGINT, ceil(exact * 100)::BIGINT, floor(exact)::BIGINT * 100, round(exact)::BIGINT * 100, ceil(exact)::BIGINT * 100)""",
    "lineitem",
)
def tax_amount(lineitem):
    base, rate = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_tax").cast("decimal(4,2)")
    rows = lineitem.select("l_orderkey", "l_linenumber", base.alias("base"), rate.alias("rate"), F.round(base * rate, 1).alias("written"))
    return tables.rate_mismatch(rows, ["l_orderkey", "l_linenumber"], "base", "rate", "written")


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_extendedprice::DECIMAL(12, 2) AS gross, l_discount::DECIMAL(4, 2) AS d FROM lineitem),
    n AS (SELECT l_orderkey, l_linenumber, (gross * 100)::BIGINT AS gross, round(gross * d * 100)::BIGINT AS cut, (round(gross * (1 - d), 1) * 100)::BIGINT AS written FROM p)
    SELECT l_orderkey, l_linenumber, written, gross - cut AS expected FROM n WHERE written <> gross - cut""",
    "lineitem",
)
def discount_rate(lineitem):
    gross, rate = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_discount").cast("decimal(4,2)")
    rows = lineitem.select("l_orderkey", "l_linenumber", gross.alias("gross"), (gross * rate).alias("cut"), F.round(gross * (1 - rate), 1).alias("written"))
    return tables.difference_mismatch(rows, ["l_orderkey", "l_linenumber"], "gross", "cut", "written")


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate", "lineitem", "orders")
def date_order_violation(lineitem, orders):
    rows = lineitem.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return tables.reversed_ranges(rows, ["l_orderkey", "l_linenumber"], "o_orderdate", "l_shipdate")


@query("SELECT o_orderkey, strftime(max(l_shipdate), '%Y-%m-%d') AS last_ship FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY o_orderkey, o_orderdate HAVING max(l_shipdate) > o_orderdate + INTERVAL 120 DAY", "orders", "lineitem")
def deadline_after_event(orders, lineitem):
    rows = orders.where("o_orderstatus = 'F'").join(lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate"), "o_orderkey")
    each = rows.groupBy("o_orderkey", "o_orderdate").agg(F.max("l_shipdate").alias("last"))
    return each.where(F.col("last") > F.col("o_orderdate") + F.expr("INTERVAL 120 DAYS")).select("o_orderkey", F.date_format("last", "yyyy-MM-dd").alias("last_ship"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1", "lineitem")
def reference_number_repeated(lineitem):
    return tables.repeated_keys(lineitem, ["l_orderkey", "l_linenumber"])


@query(
    """WITH b AS (SELECT user_id, event_id, round(value * 100)::BIGINT AS c, lag(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
    SELECT user_id, event_id, c AS written, before + c AS expected FROM b WHERE before + c <> c""",
    "events",
)
def running_balance(events):
    return tables.running_balance_mismatch(events, "user_id", ["event_id"], "value", "value")


@query(
    """WITH t AS (SELECT user_id, event_id, round((value - 20) * 100)::BIGINT AS c, sum(round((value - 20) * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS total FROM events)
    SELECT user_id, event_id, total FROM t WHERE total < c""",
    "events",
)
def cumulative_below_current(events):
    return tables.cumulative_below_current(events.withColumn("value", F.col("value") - 20), "user_id", ["event_id"], "value")


@query(
    """WITH s AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events), g AS (SELECT user_id, count(*) AS rows, count(*) FILTER (step > 0) AS ups, count(*) FILTER (step < 0) AS downs FROM s GROUP BY user_id)
    SELECT user_id, ups, downs, least(ups, downs) AS n FROM g WHERE rows >= 3 AND ups <> downs AND least(ups, downs) > 0""",
    "events",
)
def time_order_majority(events):
    return tables.order_violations(events, "user_id", "event_id", "value")


_BAND_ROWS = ", ".join(f"('{a}', {b}, {c})" for a, b, c in BANDS)


@query(f"SELECT c_custkey, c_mktsegment FROM customer JOIN (VALUES {_BAND_ROWS}) b(seg, low, high) ON c_mktsegment = seg WHERE NOT c_acctbal BETWEEN low AND high", "customer")
def tier_threshold(customer):
    bands = customer.sparkSession.createDataFrame(list(BANDS), "c_mktsegment string, low double, high double")
    return tables.outside_band(customer, bands, ["c_custkey"], "c_acctbal", "c_mktsegment")


@query(
    """WITH b AS (SELECT p_brand, min(p_size) AS low, max(p_size) AS high FROM part GROUP BY p_brand), g AS (SELECT substr(p_brand, 1, 7) AS family, low, high, lead(low) OVER (PARTITION BY substr(p_brand, 1, 7) ORDER BY low, high) AS next_low FROM b)
    SELECT family, high, next_low FROM g WHERE next_low <> high""",
    "part",
)
def range_bands(part):
    bands = part.groupBy("p_brand").agg(F.min("p_size").alias("low"), F.max("p_size").alias("high")).select(F.substring("p_brand", 1, 7).alias("family"), "low", "high")
    return tables.band_gaps(bands, "family")


@query(
    """WITH c AS (SELECT n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), s AS (SELECT n_name, round(n * 100.0 / sum(n) OVER (PARTITION BY n_name), 1) AS share FROM c)
    SELECT n_name, round(sum(share), 1) AS total, count(*) AS n FROM s GROUP BY n_name HAVING abs(round(sum(share), 1) - 100) > count(*) * 0.05 + 0.001""",
    "customer", "nation",
)
def percent_sum(customer, nation):
    counts = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("k"))
    return tables.percent_sums(counts, "n_name", "k")


@query("SELECT p_name, min(p_brand) AS one, max(p_brand) AS other FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) = 2", "part")
def fact_conflict(part):
    return tables.conflicts(part, "p_name", "p_brand")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)", "orders", "customer")
def dangling_reference(orders, customer):
    return tables.dangling(orders, customer, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", "customer", "orders")
def unused_definition(customer, orders):
    return tables.dangling(customer.select("c_custkey"), orders, "c_custkey", "o_custkey")


@query(
    "SELECT coalesce(p_partkey, l_partkey) AS key, CASE WHEN p_partkey IS NULL THEN 'right' ELSE 'left' END AS side FROM (SELECT doc_id AS p_partkey FROM documents) FULL JOIN (SELECT DISTINCT doc_id AS l_partkey FROM labels) ON p_partkey = l_partkey WHERE p_partkey IS NULL OR l_partkey IS NULL".replace("p_partkey", "a").replace("l_partkey", "b"),
    "documents", "labels",
)
def full_outer_refs(docs, labels):
    return tables.unmatched(docs.select(F.col("doc_id").alias("key")), labels.select(F.col("doc_id").alias("key")), "key")


@query("SELECT l_orderkey, l_linenumber, l_quantity AS value, p_size::DOUBLE AS most FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > p_size", "lineitem", "part")
def delivered_over_ordered(lineitem, part):
    rows = lineitem.join(part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("double").alias("p_size")), "l_partkey")
    return tables.over_limit(rows, ["l_orderkey", "l_linenumber"], "l_quantity", "p_size")


@query("WITH c AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_linestatus) AS place FROM c) SELECT l_returnflag, l_linestatus, n FROM r WHERE place > 1", "lineitem")
def minority_form(lineitem):
    return tables.minority(lineitem, "l_returnflag", "l_linestatus")


@query(r"SELECT page_id, trim(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')) AS title FROM pages".replace('\\"', '"'), "pages")
def html_title(pages):
    return pages.select("page_id", readers.html_title(F.col("html")).alias("title"))


@query(
    r"""WITH a AS (SELECT page_id, unnest(range(0, len(r))) AS nth, unnest(r) AS raw FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>') AS r FROM pages WHERE html IS NOT NULL))
    SELECT page_id, nth, regexp_extract(raw, 'href="([^"]*)"', 1) AS href, trim(regexp_replace(raw, '<[^>]*>', '', 'g')) AS text FROM a""",
    "pages",
)
def html_links(pages):
    return readers.html_links(pages)


@query(
    r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>')) AS raw FROM pages WHERE html IS NOT NULL)
    SELECT page_id, count(*) AS n FROM a WHERE trim(regexp_replace(raw, '<[^>]*>', '', 'g')) <> regexp_replace(regexp_extract(raw, 'href="([^"]*)"', 1), '^/', '') GROUP BY page_id""",
    "pages",
)
def link_text_url_mismatch(pages):
    links = readers.html_links(pages)
    return links.where(F.col("text") != F.regexp_replace("href", "^/", "")).groupBy("page_id").agg(F.count("*").alias("n"))


@query(
    r"""SELECT page_id, len(regexp_extract_all(html, '(?i)<p[ >]')) AS opened, len(regexp_extract_all(html, '(?i)</p>')) AS closed FROM pages
    WHERE len(regexp_extract_all(html, '(?i)<p[ >]')) <> len(regexp_extract_all(html, '(?i)</p>'))""",
    "pages",
)
def unclosed_tag(pages):
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("bigint")
    return pages.select("page_id", count("(?i)<p[ >]").alias("opened"), count("(?i)</p>").alias("closed")).where("opened <> closed")


@query(
    _with(r", r AS (SELECT doc_id, para, len(string_split(text, ' | ')) AS cells FROM paragraphs WHERE contains(text, ' | ')), h AS (SELECT doc_id, arg_min(cells, para) AS head FROM r GROUP BY doc_id) SELECT doc_id, para, cells FROM r JOIN h USING (doc_id) WHERE cells > head"),
    "documents",
)
def table_row_overflow(docs):
    rows = model.paragraphs(docs).where(F.contains("text", F.lit(" | "))).select("doc_id", "para", F.size(F.split("text", " \\| ")).cast("bigint").alias("cells"))
    head = rows.groupBy("doc_id").agg(F.min_by("cells", "para").alias("head"))
    return rows.join(head, "doc_id").where("cells > head").select("doc_id", "para", "cells")


#: Measures of documents, by dimension: what is good, what is bad, and the weight.
_METRICS = (("readability", "words_a_sentence", 15.0, 40.0, 2.0), ("readability", "variation", 60.0, 10.0, 1.0), ("structure", "sentences_10_paragraphs", 30.0, 120.0, 1.0))
_METRIC_ROWS = ", ".join(f"('{d}', (SELECT avg({m}) FROM m), {good}, {bad}, {weight})" for d, m, good, bad, weight in _METRICS)


@query(
    _with(_MEASURED + f""" SELECT dimension, round(sum(weight * 100 * least(1, greatest(0, (bad - value) / (bad - good)))) / sum(weight), 4) AS score
    FROM (VALUES {_METRIC_ROWS}) v(dimension, value, good, bad, weight) GROUP BY dimension"""),
    "documents",
)
def rubric_score(docs):
    means = reports.measures(docs).agg(*(F.avg(m).alias(m) for _, m, _, _, _ in _METRICS))
    rows = F.array(*(F.struct(F.lit(d).alias("dimension"), F.lit(m).alias("metric"), F.lit("ok").alias("state"), F.col(m).alias("value"), F.lit(good).alias("good"), F.lit(bad).alias("bad"), F.lit(weight).alias("weight")) for d, m, good, bad, weight in _METRICS))
    return reports.rubric(means.select(F.explode(rows).alias("r")).select("r.*"))


_LINE_TEXT = ("Budget: ", "l_extendedprice", "\nActual: ", "actual", "\nVariance: ", "variance", "\nGross weight: ", "l_quantity", " kg\nNet weight: ", "net", " kg\nCapacity: ", "seats", "\nRegistered: ", "l_quantity")


@query(
    """WITH d AS (SELECT l_orderkey || ':' || l_linenumber AS doc_id, l_quantity, l_linenumber FROM lineitem)
    SELECT doc_id, 'variance-mismatch' AS rule FROM d WHERE l_quantity > 40 UNION ALL SELECT doc_id, 'net-over-gross' FROM d WHERE l_linenumber * 6 > l_quantity UNION ALL SELECT doc_id, 'count-over-capacity' FROM d WHERE l_quantity > 45""",
    "lineitem",
)
def figure_findings(lineitem):
    """Statements written out from line items and read again: the rules must find what the columns say."""
    from docaudit.operators import arithmetic

    typed = lineitem.withColumns({
        "actual": F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 2), "seats": F.lit(45.0), "net": F.col("l_linenumber") * 6.0,
    }).withColumn("variance", F.col("l_extendedprice") - F.col("actual") + F.when(F.col("l_quantity") > 40, 1).otherwise(0))
    parts = [F.format_number(x, 2) if x.isidentifier() else F.lit(x) for x in _LINE_TEXT]
    # Behind explode, what reads a text many times does not write it each time.
    docs = T.exploded(typed, [F.concat_ws(":", "l_orderkey", "l_linenumber").alias("doc_id")], F.array(F.concat(*parts)), "text")
    return arithmetic.figure_findings(docs).select("doc_id", "rule")


@query(None, "documents")
def arithmetic_findings(docs):
    from docaudit.operators import arithmetic

    return arithmetic.findings(docs)


@query(None, "documents")
def mention_findings(docs):
    from docaudit.operators import mentions

    return mentions.findings(docs)


@query(None, "documents")
def document_atoms(docs):
    from docaudit.operators import mentions

    return mentions.atoms(docs).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


@query(_with(r""", n AS (SELECT doc_id, list_sort(regexp_extract_all(text, '[0-9]+')) AS numbers, string_split(text, chr(10))[1] AS head FROM documents WHERE text IS NOT NULL),
    p AS (SELECT first_value(doc_id) OVER w AS a, doc_id AS b, first_value(numbers) OVER w AS x, numbers AS y FROM n WINDOW w AS (PARTITION BY head ORDER BY doc_id))
    SELECT a, b, len(x) AS before, len(y) AS after FROM p WHERE x <> y"""), "documents")
def fact_diff(docs):
    """Documents with one first line against the first of them: their numbers differ. A hot line is met once a document."""
    own = docs.where("text IS NOT NULL").select("doc_id", F.array_sort(F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1))).alias("numbers"), F.xxhash64(F.split("text", "\n", 2)[0]).alias("h"), F.split("text", "\n", 2)[0].alias("head"))
    first = own.groupBy("h", "head").agg(F.min(F.struct("doc_id", "numbers")).alias("f")).select("h", "head", F.col("f.doc_id").alias("a"), F.col("f.numbers").alias("x"))
    pairs = own.join(first, ["h", "head"]).select("a", F.col("doc_id").alias("b"), "x", F.col("numbers").alias("y")).where("x <> y")
    return pairs.select("a", "b", F.size("x").cast("bigint").alias("before"), F.size("y").cast("bigint").alias("after"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
