"""Documents written out from the typed tables, so that what the rules must find follows from the columns.

Each order writes one document for one rule: with the fault if its number says so, else without. The rule must find
the first and leave the second, and no other rule may speak.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.functions import text as T
from docaudit.operators import arithmetic, crossdoc, density, findings, markdown, masking, mentions, ranges, runs, shape, signatures, stet, tables, tree
from docaudit.plans.registry import query
from docaudit.plans.rules import PATTERNS, PHRASES, Settings
from docaudit.sources import html_tables

#: One document in so many has its fault.
FAULTY = 3

#: What a template may say between braces: SQL over the order's columns and these names.
NAMES = {"a": "(o_custkey + 1000)", "k": "CAST(o_orderkey % 7 + 2 AS INT)", "d": "CAST(o_orderdate AS DATE)"}


def written(template: str) -> Column:
    """The template with each {expression} replaced by its value; d+n is a day, {day: ...} its weekday."""
    parts = []
    for k, x in enumerate(re.split(r"\{([^{}]*)\}", template)):
        if k % 2 == 0:
            parts.append(F.lit(x))
        else:
            named = re.sub(r"\b[akd]\b", lambda m: NAMES[m[0]], x.removeprefix("day:"))
            parts.append(F.expr(f"date_format({named}, 'EEEE')" if x.startswith("day:") else f"CAST({named} AS STRING)"))
    return F.concat(*parts)


def documents(orders: DataFrame, texts: dict[str, tuple[str, str]]) -> DataFrame:
    """doc_id (the order's key), lang and text: rule number o_orderkey % rules, faulty if o_orderkey / rules % FAULTY is 0."""
    n = len(texts)
    nth, faulty = F.col("o_orderkey") % n, F.floor(F.col("o_orderkey") / n) % FAULTY == 0
    text = F.coalesce(*(F.when(nth == k, F.when(faulty, written(bad)).otherwise(written(good))) for k, (bad, good) in enumerate(texts.values())))
    # Behind explode, what reads a text many times does not write it each time.
    return T.exploded(orders.select("o_orderkey", F.array(text).alias("text")), [F.col("o_orderkey").alias("doc_id"), F.lit("en").alias("lang")], F.col("text"), "text")


def expected(texts: dict[str, tuple[str, str]]) -> str:
    rows = ", ".join(f"({k}, '{rule}')" for k, rule in enumerate(texts))
    return f"SELECT o_orderkey AS doc_id, rule FROM orders JOIN (VALUES {rows}) r(nth, rule) ON o_orderkey % {len(texts)} = nth WHERE o_orderkey // {len(texts)} % {FAULTY} = 0"


FIGURES = {
    "closing-balance-mismatch": ("Opening balance: {a}.00\nDeposits: {k}.00\nDeposits: 50.00\nWithdrawals: 100.00\nClosing balance: {a+k-40}.00", "Opening balance: {a}.00\nDeposits: {k}.00\nDeposits: 50.00\nWithdrawals: 100.00\nClosing balance: {a+k-50}.00"),
    "net-amount-mismatch": ("| Gross pay | {a} |\n| Total deductions | {k} |\n| Net pay | {a-k+50} |", "| Gross pay | {a} |\n| Total deductions | {k} |\n| Net pay | {a-k} |"),
    "annual-pay-mismatch": ("Monthly salary: {a}\nBonus (months): 2\nAnnual salary: {a*15}", "Monthly salary: {a}\nBonus (months): 2\nAnnual salary: {a*14}"),
    "interest-mismatch": ("Principal: {a*100}\nInterest rate: 5%\nInterest: {a*6}", "Principal: {a*100}\nInterest rate: 5%\nInterest: {a*5}"),
    "installment-total-mismatch": ("Number of payments: 12\nMonthly payment: {k}.50\nTotal payable: {k*12+7}.00", "Number of payments: 12\nMonthly payment: {k}.50\nTotal payable: {k*12+6}.00"),
    "rent-multiple-mismatch": ("Rent: {a}\nDeposit (months): 2\nDeposit: {a*2+k}", "Rent: {a}\nDeposit (months): 2\nDeposit: {a*2}"),
    "ratio-mismatch": ("Sales: {a*8}\nProfit: {a}\nMargin: 13.5%", "Sales: {a*8}\nProfit: {a}\nMargin: 12.5%"),
    "share-amount-mismatch": ("Total charges: {a*10}\nPatient share: 30%\nAmount paid: {a*3+k}", "Total charges: {a*10}\nPatient share: 30%\nAmount paid: {a*3}"),
    "bmi-mismatch": ("Height: 17{k} cm\nWeight: 65 kg\nBMI: 35.5", "Height: 170 cm\nWeight: 65 kg\nBMI: 22.5"),
    "capacity-runtime-mismatch": ("Battery capacity (Wh): {a*10}\nConsumption (W): 10\nRuntime (hours): {a+k}", "Battery capacity (Wh): {a*10}\nConsumption (W): 10\nRuntime (hours): {a}"),
    "count-over-capacity": ("Capacity: {a}\nRegistered: {a+k}", "Capacity: {a}\nRegistered: {a}"),
    "net-over-gross": ("Gross weight: {a}.0 kg\nNet weight: {a+k}.5 kg", "Gross weight: {a}.0 kg\nNet weight: {a-k}.5 kg"),
    "meter-usage-mismatch": ("Previous reading: {a}\nCurrent reading: {a+50*k}\nUsage: {50*k+10}", "Previous reading: {a}\nCurrent reading: {a+50*k}\nUsage: {50*k}"),
    "deductible-exceeds-limit": ("Benefit limit: {a}\nDeductible: {a+k}", "Benefit limit: {a}\nDeductible: {a-k}"),
    "product-exceeds-maximum": ("Dose: {a} mg\nDoses per day: 4\nDaily maximum: {a*3} mg", "Dose: {a} mg\nDoses per day: 3\nDaily maximum: {a*3} mg"),
    "interval-count-mismatch": ("Minimum interval (hours): 8\nDoses per day: {k+2}", "Minimum interval (hours): 8\nDoses per day: 3"),
    "variance-mismatch": ("Budget: {a}\nActual: {a+60}\nVariance: {50-k}", "Budget: {a}\nActual: {a+60}\nVariance: -60"),
    "serial-range-reversed": ("Recalled: lots Q{500000+a+k} to Q{500000+a} only.", "Recalled: lots Q{500000+a} to Q{500000+a+k} only."),
    "revision-direction-mismatch": ("The outlook was revised up from {a+k} to {a} today.", "The outlook was revised down from {a+k} to {a} today."),
    "period-part-exceeds-whole": ("Trials are free for {k+12} months within a 12-month plan.", "Trials are free for {k} weeks within a 6-month plan."),
    "walk-time-distance-mismatch": ("A {k}-minute walk ({k*80+400} m) from the pier.", "A {k}-minute walk ({k*80} m) from the pier."),
    "annual-holidays-mismatch": ("We give two days off every week. That makes {80+k} days off per year.", "We give two days off every week. That makes {104+k} days off per year."),
    "email-subject-length": ("Subject: \nDear all, see order {a}.", "Subject: Order {a}\nDear all"),
    "attachment-not-attached": ("Subject: Order {a}\nPlease find attached the list.", "Subject: Order {a}\nPlease find attached the list.\nAttachments: list{a}.pdf"),
    "version-order": ("# {k}.1.0\n# {k}.0.0\n# 1.10.0\n# 1.2.0\n# 1.9.0", "# {k}.1.0\n# {k}.0.0\n# 1.10.0\n# 1.9.0\n# 1.2.0"),
}

MENTIONS = {
    "impossible-date": ("Due on {1990+k}-02-30 at noon.", "Due on {1990+k}-02-27 at noon."),
    "date-weekday-mismatch": ("It met on {day:d+1}, {d} as agreed.", "It met on {day:d}, {d} as agreed."),
    "date-range-reversed": ("Open {d} to {d-k} only.", "Open {d} to {d+k} only."),
    "relative-date-mismatch": ("Signed on {d}. {k} days later, on {d+k+1}, it ended.", "Signed on {d}. {k} days later, on {d+k}, it ended."),
    "duration-mismatch": ("It runs from {d} to {d+k}, {k+5} days in all.", "It runs from {d} to {d+k}, {k} days in all."),
    "date-without-year": ("Signed on 2019-03-04 and 2021-05-06. The June {k} meeting stands.", "Signed on 2019-03-04 and 2021-05-06. The June {k}, 2020 meeting stands."),
    "date-order": ("{d} opened\n{d+5} moved\n{d+2} cleaned\n{d+8} painted\n{d+9} closed", "{d} opened\n{d+2} moved\n{d+5} cleaned\n{d+8} painted\n{d+9} closed"),
    "amount-range-reversed": ("It costs ${a+k} to ${a} each.", "It costs ${a} to ${a+k} each."),
    "quantity-range-reversed": ("Made {a+k} to {a} mm long.", "Made {a} to {a+k} mm long."),
    "time-range-reversed": ("Open 19:00 - 1{k}:00 daily.", "Open 08:00 - 1{k}:00 daily."),
    "number-word-figure-mismatch": ("Pay within ten ({k}) days.", "Pay within ten (10) days."),
    "percent-sum-mismatch": ("The shares break down as 40%, 40% and {17-k}%.", "The shares break down as 40%, {40-k}% and {20+k}%."),
    "duration-product-mismatch": ("It has {k} sessions of 50 minutes, a total of {k*50+5} minutes.", "It has {k} sessions of 50 minutes, a total of {k*50} minutes."),
    "change-rate-mismatch": ("Sales rose from {a} to {a*2}, up 90% this year.", "Sales rose from {a} to {a*2}, up 100% this year."),
    "acronym-expansion-conflict": ("Order {a}: the Order Review Board (ORB) met. Later the Open Records Bureau (ORB) did.", "Order {a}: the Order Review Board (ORB) met. Later the Order Review Board (ORB) closed."),
    "use-before-definition": ("The Buyer of {a} pays. Acme Ltd (the \"Buyer\") accepts.", "Acme Ltd (the \"Buyer\") accepts {a}. The Buyer pays."),
    "duplicate-definition": ("Acme (the \"Buyer\") and Bolt (the \"Buyer\") sign; the Buyer pays {a}.", "Acme (the \"Buyer\") and Bolt (the \"Seller\") sign; the Buyer pays the Seller {a}."),
    "unused-definition": ("Acme (the \"Buyer\") signs {a}.", "Acme (the \"Buyer\") signs {a}. The Buyer pays."),
    "phone-number-variant": ("Call 03-12{10+k}-5678 or 03-12{10+k}-5687.", "Call 03-12{10+k}-5678 or 03-12{10+k}-5678."),
    "unit-mismatch": ("Length: {a} mm\nLength: {a} cm\nLength: {a} m", "Length: {a*1000} mm\nLength: {a*100} cm\nLength: {a} m"),
    "fact-conflict": ("Owner: Ann {a}\nOwner: Bob {a}", "Owner: Ann {a}\nOwner: Ann {a}"),
    "cross-doc-fact-conflict": ("Region code: west", "Region code: east"),
}

_RULED = "| n | w |\n|---|---|\n"
MARKDOWN = {
    "heading-level-skip": ("# Order {a}\ntext {k}\n### Deep\nmore", "# Order {a}\ntext {k}\n## Deep\nmore"),
    "empty-section": ("# First {a}\n# Second\ntext", "# First {a}\ntext\n# Second\ntext"),
    "duplicate-heading": ("# Order {a}\nx\n## Same\ny\n## Same\nz", "# Order {a}\nx\n## Same\ny\n## Other\nz"),
    "title-length": ("# a b c d e f g h i j k l m n {a}\ntext", "# a b c d e f g h i j k l m {a}\ntext"),
    "numbering-gap": ("1. one {a}\n2. two\n4. three", "1. one {a}\n2. two\n3. three"),
    "empty-list-item": ("- one {a}\n-\n- two", "- one {a}\n- half\n- two"),
    "announced-count-mismatch": ("There are three points:\n- one {a}\n- two", "There are two points:\n- one {a}\n- two"),
    "table-row-overflow": (_RULED + "| {a} | 2 | 3 |", _RULED + "| {a} | 2 |"),
    "empty-table-cell": (_RULED + "| x | {a} |\n| y |  |\n| z | {k} |", _RULED + "| x | {a} |\n| y | 1 |\n| z | {k} |"),
    "number-without-unit": (_RULED + "| x | {a} kg |\n| y | {k} |\n| z | 9 kg |", _RULED + "| x | {a} kg |\n| y | {k} kg |\n| z | 9 kg |"),
    "broken-link": ("# Order {a}\nSee [part](#missing-{a}).", "# Order {a}\nSee [part](#order-{a})."),
    "image-alt-text": ("![](p{a}.png)", "![chart of {a}](p.png)"),
    "image-file-name-alt": ("![p{a}.png](p.png)", "![p{a} chart](p.png)"),
    "vague-link-text": ("[click here](https://x.org/{a})", "[order {a}](https://x.org/{a})"),
    "link-text-url-mismatch": ("[https://a.org/{a}](https://b.org/{a})", "[https://a.org/{a}](https://www.a.org/{a})"),
    "footnote-mismatch": ("Text[^n{a}] here.", "Text[^n{a}] here.\n\n[^n{a}]: note"),
    "unclosed-code-fence": ("```\ncode {a}", "```\ncode {a}\n```"),
    "heading-echo": ("# Payment terms {a}\nPayment terms.", "# Payment terms {a}\nInvoices are settled monthly."),
    "step-reference-missing": ("1. one {a}\n2. two\n\nRepeat step {k+1} then.", "1. one {a}\n2. two\n\nRepeat step 2 then."),
    "dangling-figure-reference": ("See Figure {k} of {a}.\n\nFigure 1: map", "See Figure 1 of {a}.\n\nFigure 1: map"),
    "dangling-reference": ("# 1 Scope\nx {a}\n# 2 Terms\nSee Section {k+1}.", "# 1 Scope\nx {a}\n# 2 Terms\nSee Section 2."),
    "emoji-heading": ("# \U0001f680 One {a}\nx\n# \U0001f389 Two\ny\n# \U0001f525 Three\nz", "# One {a}\nx\n# Two\ny\n# \U0001f525 Three\nz"),
    "bold-label-list": ("- **One**: {a}\n- **Two**: b\n- **Six**: c\n- **Ten**: d\n- **All**: e", "- **One**: {a}\n- b\n- c\n- d\n- **All**: e"),
    "rule-of-three": ("- {a}\n- b\n- c\n\nthen\n\n- d\n- e\n- f\n\nthen\n\n- g\n- h\n- i\n\nthen\n\n- j\n- k\n- l", "- {a}\n- b\n- c\n\nthen\n\n- d\n- e\n- f\n\nthen\n\n- g\n- h\n\nthen\n\n- j\n- k"),
    "preamble-length": ("one {a}\ntwo\nthree\n## Part\nx", "one {a}\n## Part\nx"),
    "total-mismatch": (_RULED + "| x | {a} |\n| y | {k} |\n| Total | {a+k+5} |", _RULED + "| x | {a} |\n| y | {k} |\n| Total | {a+k} |"),
    "line-amount-mismatch": ("| Qty | Price | Amount |\n|---|---|---|\n| {k} | {a} | {a*k+1} |", "| Qty | Price | Amount |\n|---|---|---|\n| {k} | {a} | {a*k} |"),
}


@query(expected(FIGURES), "orders")
def planted_figures(orders):
    return arithmetic.findings(documents(orders, FIGURES)).select("doc_id", "rule").distinct()


@query(expected(MENTIONS), "orders")
def planted_mentions(orders):
    return mentions.findings(documents(orders, MENTIONS)).select("doc_id", "rule").distinct()


@query(expected(MARKDOWN), "orders")
def planted_markdown(orders):
    return markdown.findings(documents(orders, MARKDOWN)).select("doc_id", "rule").distinct()


#: Every phrase of every rule, with how many sentences must hold it for the rule to speak; densities take all of a text.
PHRASED = tuple(
    (k, r.rule, p, r.lang, r.where, 60 if r.kind == "density" else int(Settings().limit(r.rule, r.limits)) + (r.kind == "above"))
    for k, (r, p) in enumerate((r, p) for r in PHRASES for p in r.phrases)
)


@query(
    f"SELECT o_orderkey AS doc_id, rule FROM orders JOIN (VALUES {', '.join(f"({k}, '{rule}')" for k, rule, *_ in PHRASED)}) r(nth, rule) ON o_orderkey % {len(PHRASED)} = nth WHERE o_orderkey // {len(PHRASED)} % 2 = 0",
    "orders",
)
def planted_phrases(orders):
    """A text for each order with one phrase of one rule, where and as often as it counts, or without: its own rule must find it."""
    rows = orders.sparkSession.createDataFrame(list(PHRASED), "nth bigint, own string, phrase string, lang string, place string, n int")
    spoken = orders.select("o_orderkey", (F.col("o_orderkey") % len(PHRASED)).alias("nth"), (F.floor(F.col("o_orderkey") / len(PHRASED)) % 2 == 0).alias("there")).join(F.broadcast(rows), "nth")
    phrase = F.when(F.col("there"), F.col("phrase")).otherwise("stone")
    start = F.concat(F.upper(F.substring(phrase, 1, 1)), F.substring(phrase, F.lit(2), F.length(phrase)), F.lit(" stone river window. "))
    inside = F.concat(F.lit("Stone window river "), phrase, F.lit(" lamp. "))
    filler = F.repeat(F.lit("\nStone river window lamp."), 5)
    said = F.repeat(F.when(F.col("place") == "any", inside).otherwise(start), F.col("n"))
    text = F.when(F.col("place") == "opening", F.concat(said, filler)).when(F.col("place") == "closing", F.concat(F.lit("Lamp."), filler, F.lit("\n"), said)).otherwise(F.concat(said, F.lit("\nLamp.")))
    docs = spoken.select(F.col("o_orderkey").alias("doc_id"), "lang", text.alias("text"), "own")
    own = docs.select("doc_id", F.col("own").alias("rule")).toDF("doc_id", "rule")
    return findings.phrase_findings(docs).select("doc_id", "rule").toDF("doc_id", "rule").join(own, ["doc_id", "rule"], "left_semi")


def _lines_of(lineitem: DataFrame, line: Column, head: Column, foot: Column) -> DataFrame:
    """doc_id (an order) and text: head, a line for each of its items in the order of place, and foot; all end with a line feed."""
    each = lineitem.withColumn("nth", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_PLACE)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", line.alias("said")))), lambda x: x["said"]), "")
    return each.groupBy(F.col("l_orderkey").alias("doc_id")).agg(body.alias("body"), F.count("*").alias("n")).select("doc_id", F.concat(head, F.col("body"), foot).alias("text"))


_PLACE = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
_NTH = f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_PLACE)})"
_COUNTED = "n AS (SELECT l_orderkey AS doc_id, count(*)::INT AS n FROM lineitem GROUP BY l_orderkey)"


def contracts(lineitem: DataFrame) -> DataFrame:
    """A contract for each order: a part, an article with an item for each line that refers to a term, and half as many terms."""
    head = F.concat(F.lit("PART "), (F.col("doc_id") % 4 + 1).cast("string"), F.lit(" Supply\nARTICLE 1 Items\n"))
    line = F.concat(F.lit("("), F.char(F.col("nth") + 96), F.lit(") goods, see Section 2."), F.col("nth").cast("string"), F.lit(" and Section 1("), F.char(F.col("nth") + 96), F.lit(")\n"))
    terms = F.transform(F.sequence(F.lit(1), F.ceil(F.col("n") / 2).cast("int")), lambda k: F.concat(F.lit("2."), k.cast("string"), F.lit(" Terms\n")))
    return _lines_of(lineitem, line, head, F.array_join(terms, ""))


@query(
    f"""WITH {_COUNTED}, m AS (SELECT *, ((n + 1) // 2)::INT AS m FROM n), k AS (SELECT m.*, unnest(range(1, n + 1))::INT AS k FROM m), t AS (SELECT m.*, unnest(range(1, m + 1))::INT AS k FROM m)
    SELECT doc_id, 1 AS line, 0 AS parent, 'chapter' AS kind, 'pt' || (doc_id % 4 + 1) AS address, 2 + n + m AS last FROM m
    UNION ALL SELECT doc_id, 2, 1, 'article', '1', 2 + n + m FROM m
    UNION ALL SELECT doc_id, 2 + k, 2, 'item', '1.' || chr(96 + k), 2 + k FROM k
    UNION ALL SELECT doc_id, 2 + n + k, 2, 'article', '2.' || k, 2 + n + k FROM t""",
    "lineitem",
)
def structure_nodes(lineitem):
    return tree.nodes(contracts(lineitem)).select("doc_id", "line", "parent", "kind", "address", "last")


@query(
    f"""WITH {_COUNTED}, k AS (SELECT *, unnest(range(1, n + 1))::INT AS k FROM n)
    SELECT doc_id, 2 + k AS line, 'Section 2.' || k AS quote, '2.' || k AS target FROM k WHERE k > (n + 1) // 2""",
    "lineitem",
)
def dangling_addresses(lineitem):
    return tree.dangling_references(contracts(lineitem)).select("doc_id", "line", "quote", "target")


_ITEM = "round(l_extendedprice * 100)::BIGINT"


@query(
    f"""WITH t AS (SELECT l_orderkey AS doc_id, count(*)::INT AS n, sum({_ITEM})::BIGINT AS parts FROM lineitem GROUP BY l_orderkey)
    SELECT doc_id, 5 + n AS line, parts + 500 + 100 AS written, parts + 500 AS expected FROM t WHERE doc_id % 3 = 0
    UNION ALL SELECT doc_id, 3 + n, parts + 7, parts FROM t WHERE doc_id % 3 = 1 AND n > 1""",
    "lineitem",
)
def table_totals(lineitem):
    """Invoices with a subtotal, shipping and a total; one in three has a wrong total, one in three a wrong subtotal."""
    each = lineitem.withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    sums = each.groupBy(F.col("l_orderkey").alias("order")).agg(F.sum("cents").alias("parts"))
    money = lambda c: F.concat(F.lit("$"), F.format_number(c / 100, 2))
    line = F.concat(F.lit("| item | "), money(F.col("cents")), F.lit(" |\n"))
    bodies = _lines_of(each, line, F.lit("| Item | Amount |\n|---|---|\n"), F.lit(""))
    wrong = F.col("doc_id") % 3
    foot = F.concat(F.lit("| Subtotal | "), money(F.col("parts") + F.when(wrong == 1, 7).otherwise(0)), F.lit(" |\n| Shipping | $5.00 |\n| **Total** | "), money(F.col("parts") + 500 + F.when(wrong == 0, 100).otherwise(0)), F.lit(" |\n"))
    docs = bodies.join(sums, F.col("doc_id") == F.col("order")).select("doc_id", F.concat("text", foot).alias("text"))
    return runs.totals(docs).select("doc_id", "line", "written", "expected")


@query(
    """WITH d AS (SELECT DISTINCT l_orderkey AS doc_id, l_shipdate::DATE AS day FROM lineitem), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY day) AS nth, count(*) OVER (PARTITION BY doc_id) AS n FROM d)
    SELECT doc_id, 2 AS line, strftime(max(day), '%Y-%m-%d') AS quote, strftime(min(day), '%Y-%m-%d') AS beside FROM o WHERE n >= 4 AND doc_id % 2 = 0 GROUP BY doc_id""",
    "lineitem",
)
def date_runs(lineitem):
    """Lists of an order's shipping days in order; in every second one the last day stands first."""
    days = lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_set(F.date_format("l_shipdate", "yyyy-MM-dd"))).alias("days"))
    turned = F.when(F.col("doc_id") % 2 == 0, F.concat(F.slice("days", -1, 1), F.slice("days", F.lit(1), F.size("days") - 1))).otherwise(F.col("days"))
    docs = days.select("doc_id", F.concat(F.lit("# Shipped\n- "), F.array_join(turned, " sent\n- "), F.lit(" sent\n")).alias("text"))
    return runs.date_order(docs).select("doc_id", "line", "quote", "beside")


@query(
    f"""WITH {_COUNTED} SELECT doc_id, 'double' AS rule, 7::INT AS start, 9::INT AS end, 1 AS line, 8::INT AS col FROM n
    UNION ALL SELECT doc_id, 'double', (66 + length(n::VARCHAR))::INT, (68 + length(n::VARCHAR))::INT, 6, (13 + length(n::VARCHAR))::INT FROM n
    UNION ALL SELECT doc_id, 'count', 60, (60 + length(n::VARCHAR))::INT, 6, 7 FROM n""",
    "lineitem",
)
def masked_findings(lineitem):
    """Marks and numbers in prose are found at their places in the raw text, those in code and tables are not."""
    text = F.concat(F.lit("Shipped!! on time\n```\nfenced!! 12\n```\n| cell!! | 34 |\n`a!!` "), F.col("n").cast("string"), F.lit(" items!! at https://x.org/b!!5\n"))
    docs = lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").alias("n")).select("doc_id", F.lit("en").alias("lang"), text.alias("text"))
    found = masking.located(docs, (masking.Search("double", "warning", "!!"), masking.Search("count", "info", "[0-9]+")))
    return found.select("doc_id", "rule", "start", "end", "line", "col")


@query(
    f"""WITH {_COUNTED}, k AS (SELECT *, unnest(range(1, n + 1))::INT AS k FROM n), f AS (SELECT doc_id, n, CASE WHEN k % 2 = 0 THEN 'rule-a' ELSE 'rule-b' END AS rule, 2 * k AS line FROM k)
    SELECT doc_id, rule, line FROM f WHERE NOT (rule = 'rule-a' AND line <= n + 1) AND NOT (rule = 'rule-b' AND line BETWEEN n + 3 AND 2 * n + 4)""",
    "lineitem",
)
def findings_that_stand(lineitem):
    """One finding a line item against a comment for the block below it and one for a section."""
    counts = lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").alias("n"))
    said = lambda: F.repeat(F.lit("words\n"), F.col("n").cast("int"))
    docs = counts.select("doc_id", F.concat(F.lit("<!-- stet: rule-a — kept -->\n"), said(), F.lit("\n<!-- stet-section: rule-b — kept -->\n"), said(), F.lit("# Next\nlast\n")).alias("text"))
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_PLACE))
    found = lineitem.select(F.col("l_orderkey").alias("doc_id"), nth.alias("k")).select("doc_id", F.when(F.col("k") % 2 == 0, "rule-a").otherwise("rule-b").alias("rule"), (F.col("k") * 2).alias("line"))
    return stet.kept(found, docs)


@query(
    """WITH s AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE - DATE '1970-01-01' AS first, max(l_shipdate)::DATE - DATE '1970-01-01' AS last FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
    SELECT o.o_orderkey, count(*) AS n FROM orders o JOIN s ON o.o_custkey = s.o_custkey AND o.o_orderkey <> s.o_orderkey AND o.o_orderdate::DATE - DATE '1970-01-01' BETWEEN s.first AND s.last GROUP BY o.o_orderkey""",
    "orders", "lineitem",
)
def orders_meanwhile(orders, lineitem):
    """Orders placed while others of the same customer were under way: days in intervals, joined by cells."""
    last = lineitem.groupBy(F.col("l_orderkey").alias("other")).agg(F.unix_date(F.max("l_shipdate").cast("date")).alias("last"))
    day = F.unix_date(F.col("o_orderdate").cast("date"))
    spans = orders.select(F.col("o_orderkey").alias("other"), "o_custkey", day.alias("first")).join(last, "other")
    points = orders.select("o_orderkey", "o_custkey", day.alias("day"))
    met = ranges.within(points, spans, ["o_custkey"], "day", "first", "last")
    return met.where("o_orderkey <> other").groupBy("o_orderkey").agg(F.count("*").alias("n"))


@query(
    """WITH f AS (SELECT o_orderkey AS k, o_custkey % 20 AS folder FROM orders)
    SELECT 'f' || a.folder || '/o' || a.k || '.md' AS path, CASE WHEN b.k IS NULL THEN 'file' ELSE 'anchor' END AS variant
    FROM f a LEFT JOIN f b ON b.k = a.k + 1 AND b.folder = (a.k + 1) % 20 WHERE b.k IS NULL OR a.k % 2 = 0""",
    "orders",
)
def links_between_files(orders):
    """A file for each order, in one of twenty folders, with a link to the next order's heading as if it lay in a folder by its number."""
    key, after = F.col("o_orderkey"), F.col("o_orderkey") + 1
    path = F.format_string("f%d/o%d.md", F.col("o_custkey") % 20, key)
    head = F.when(key % 2 == 0, F.lit("order-none")).otherwise(F.concat(F.lit("order-"), after.cast("string")))
    text = F.concat(F.format_string("# Order %d\n`[no](none.md)` [next](../f%d/./o%d.md#", key, after % 20, after), head, F.lit(") [top](https://x.org/a.md)\n"))
    return crossdoc.broken_links(orders.select(path.alias("path"), text.alias("text"))).select("path", "variant")


@query(
    """WITH v AS (SELECT lpad(c_custkey::VARCHAR, 12, '0') || '.md' AS path, 'Nation ' || c_nationkey AS term, lower(c_mktsegment) AS body FROM customer),
    b AS (SELECT term, body, count(*) AS n, min(path) AS first FROM v GROUP BY ALL), u AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY n DESC, first) AS place, sum(n) OVER (PARTITION BY term)::BIGINT AS files FROM b)
    SELECT v.path, v.term, u.files, u.first AS example FROM v JOIN u ON v.term = u.term AND u.place = 1 WHERE v.body <> u.body""",
    "customer",
)
def definition_votes(customer):
    """A file for each customer that defines its nation by its segment: those out of step with most files of the nation."""
    path = F.concat(F.lpad(F.col("c_custkey").cast("string"), 12, "0"), F.lit(".md"))
    text = F.concat(F.lit('Here "Nation '), F.col("c_nationkey").cast("string"), F.lit('" means '), F.lower("c_mktsegment"), F.lit(".\n"))
    return crossdoc.definitions_out_of_step(customer.select(path.alias("path"), text.alias("text"))).select("path", "term", "files", "example")


@query(
    f"""WITH k AS (SELECT l_orderkey AS page_id, {_NTH}::INT AS k, count(*) OVER (PARTITION BY l_orderkey) AS n, l_quantity::BIGINT AS q FROM lineitem)
    SELECT page_id, k - 1 AS row, 0 AS col, 'Order ' || page_id AS text FROM k UNION ALL SELECT page_id, k - 1, 1, k::VARCHAR FROM k UNION ALL SELECT page_id, k - 1, 2, 'q' || q FROM k
    UNION ALL SELECT page_id, n, 0, 'Sum of ' || n FROM k WHERE k = 1 UNION ALL SELECT page_id, n, 1, 'Sum of ' || n FROM k WHERE k = 1 UNION ALL SELECT page_id, n, 2, '' FROM k WHERE k = 1""",
    "lineitem",
)
def html_grid(lineitem):
    """Tables of HTML with a head over all rows and a foot over two columns, spread over the places they cover."""
    line = F.concat(F.when(F.col("nth") == 1, F.lit("<tr>@")).otherwise(F.lit("<tr>")), F.lit("<td>"), F.col("nth").cast("string"), F.lit("<td>q"), F.col("l_quantity").cast("bigint").cast("string"))
    counts = lineitem.groupBy(F.col("l_orderkey").alias("order")).agg(F.count("*").cast("string").alias("n"))
    body = _lines_of(lineitem, line, F.lit("<p>Items</p><table>"), F.lit("")).join(counts, F.col("doc_id") == F.col("order"))
    head = F.concat(F.lit("<th rowspan="), F.col("n"), F.lit(">Order "), F.col("doc_id").cast("string"), F.lit("</th>"))
    page = F.concat(F.replace("text", F.lit("@"), head), F.lit("<tr><td colspan=2>Sum of "), F.col("n"), F.lit("</table>"))
    return html_tables.table_grid(body.select(F.col("doc_id").alias("page_id"), page.alias("html"))).select("page_id", "row", "col", "text")


@query(
    """WITH d AS (SELECT DISTINCT l_orderkey AS doc_id, l_shipdate::DATE AS day FROM lineitem), o AS (SELECT *, min(day) OVER (PARTITION BY doc_id) AS first, row_number() OVER (PARTITION BY doc_id ORDER BY day) AS nth FROM d)
    SELECT doc_id, (3 + nth)::INT AS line, strftime(day, '%Y-%m-%d') AS quote FROM o WHERE day > first + 400 AND doc_id % 5 <> 0""",
    "lineitem",
)
def dates_outside_period(lineitem):
    """Lists of an order's shipping days under a period of 400 days from the first; one in five states none."""
    days = lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_set(F.col("l_shipdate").cast("date"))).alias("days"))
    first = F.element_at("days", 1)
    head = F.when(F.col("doc_id") % 5 == 0, F.lit("Some days")).otherwise(F.concat(F.lit("Shipping period: "), first.cast("string"), F.lit(" to "), F.date_add(first, 400).cast("string")))
    docs = days.select("doc_id", F.concat(F.lit("# Order\n"), head, F.lit("\n\n- "), F.array_join(F.transform("days", lambda x: x.cast("string")), " sent\n- "), F.lit("\n")).alias("text"))
    return runs.dates_outside_period(docs).select("doc_id", "line", "quote")


@query(
    """WITH b AS (SELECT s_nationkey AS n, min(s_acctbal) AS low, max(s_acctbal) AS high FROM supplier GROUP BY ALL)
    SELECT c_custkey FROM customer JOIN b ON c_nationkey = n WHERE NOT c_acctbal BETWEEN low AND high""",
    "customer", "supplier",
)
def balances_outside(customer, supplier):
    """Customers whose balance lies outside what suppliers of their nation have."""
    bands = supplier.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_acctbal").alias("low"), F.max("s_acctbal").alias("high"))
    return tables.outside_all(customer.select("c_custkey", "c_nationkey", "c_acctbal"), bands, ["c_nationkey"], "c_acctbal", "low", "high").select("c_custkey")


@query(
    """WITH w AS (SELECT user_id, event_id AS first, count(*) OVER r AS n, max(event_id) OVER r AS last FROM events WINDOW r AS (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN CURRENT ROW AND 999 FOLLOWING)),
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS place FROM w) SELECT user_id, first, last, n FROM o WHERE place = 1""",
    "events",
)
def busiest_stretch(events):
    """The thousand events in a row of which each user has most."""
    return density.densest(events, ["user_id"], "event_id", 1000)


@query(
    f"""WITH {_COUNTED} SELECT doc_id, 5 AS line, 'f' || doc_id AS fn, 'p1' AS name, 'signature' AS side FROM n WHERE doc_id % 3 = 0
    UNION ALL SELECT doc_id, 5, 'f' || doc_id, 'p' || (n + 1), 'table' FROM n WHERE doc_id % 3 = 0""",
    "lineitem",
)
def parameter_tables(lineitem):
    """A function for each order with a parameter for each item, over a table that is off by one in one order of three."""
    off = F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)
    counts = lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").cast("int").alias("n"))
    each = lambda made, between: F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), made), between)
    takes = each(lambda k: F.concat(F.lit("p"), k.cast("string"), F.lit(": Map<string, number> = g(1, 2)")), ", ")
    rows = each(lambda k: F.concat(F.lit("| `p"), (k + off).cast("string"), F.lit("` | text |\n")), "")
    docs = counts.select("doc_id", F.concat(F.lit("```ts\nexport function f"), F.col("doc_id").cast("string"), F.lit("("), takes, F.lit("): void {\n```\nText.\n| Parameter | Kind |\n|---|---|\n"), rows).alias("text"))
    return signatures.parameter_mismatches(docs)


@query(
    """WITH d AS (SELECT o_orderkey AS doc_id, o_orderkey % 9 AS m FROM orders), w AS (SELECT *, m * 30 + CASE WHEN m > 2 THEN 40 ELSE 0 END AS words FROM d)
    SELECT doc_id, CASE WHEN words >= 200 THEN round(m * 1000.0 / words, 1) END AS heading_density, CASE WHEN m >= 3 THEN 100.0 END AS short_sections,
      CASE WHEN m >= 5 THEN round(100 * 40 * sqrt(m - 1) / (30 * m + 40)) END AS section_uniformity, CASE WHEN m >= 4 THEN round(100.0 / m) END AS heading_forms, CASE WHEN m >= 2 THEN 0.0 END AS bookends, CASE WHEN m >= 3 THEN 1.0 ELSE 0.0 END AS emoji_headings FROM w""",
    "orders",
)
def shape_measures(orders):
    """Documents of none to eight sections, the third of which is longer and headed by a question."""
    part = lambda k: F.concat(F.lit("## "), F.when(k == 3, F.lit("\U0001f680 How to do ")).otherwise(F.lit("Part ")), k.cast("string"), F.lit("\n"), F.when(k == 3, F.repeat(F.lit("lamp "), 70)).otherwise(F.repeat(F.lit("lamp "), 30)), F.lit("\n\n"))
    m = (F.col("o_orderkey") % 9).cast("int")
    parts = F.when(m > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), part), "")).otherwise(F.lit(""))
    docs = orders.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("# Order\n\n"), parts).alias("text"))
    found = shape.measures(docs)
    return found.select("doc_id", *(F.col(f"`{m}`").alias(m.replace("-", "_")) for m in ("heading-density", "short-sections", "section-uniformity", "heading-forms", "bookends", "emoji-headings")))


def _places(patterns) -> str:
    """SQL for the place of every match of the patterns in the raw texts."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    for r in patterns:
        lang = "TRUE" if r.lang is None else f"lang = {quoted(r.lang)}"
        parts.append(f"SELECT doc_id, text, {quoted(r.rule)} AS rule, regexp_extract_all(text, {quoted(r.pattern)}) AS q, string_split_regex(text, {quoted(r.pattern)}) AS p FROM documents WHERE text IS NOT NULL AND {lang} AND regexp_matches(text, {quoted(r.pattern)})")
    return f"""WITH m AS ({' UNION ALL '.join(parts)}), k AS (SELECT *, unnest(range(1, len(q) + 1)) AS k FROM m),
    s AS (SELECT doc_id, text, rule, q[k] AS quote, (list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(q[1:k - 1], lambda x: length(x))), 0))::INT AS start FROM k)
    SELECT doc_id, rule, start, (start + length(quote))::INT AS end, (1 + start - length(replace(substr(text, 1, start), chr(10), '')))::INT AS line, (1 + length(string_split(substr(text, 1, start), chr(10))[-1]))::INT AS col, quote FROM s"""


#: Patterns that both dialects split texts by alike.
PLACED = tuple(r for r in PATTERNS if r.rule in ("article-sound", "all-caps-shouting", "repeated-exclamation", "unrendered-emphasis", "bold-density"))


@query(_places(PLACED), "documents")
def finding_places(docs):
    """Every match of some patterns in the raw texts, with its place."""
    found = masking.located(docs, masking.searches_of(PLACED), F.col("text"))
    return found.select("doc_id", "rule", "start", "end", "line", "col", "quote")


@query(None, "documents")
def prose_findings(docs):
    """Every match of all patterns and phrases in prose, with its place, but those that a comment lets stand."""
    from docaudit.plans.rules import PHRASES

    return stet.kept(masking.located(docs, masking.searches_of(PATTERNS, PHRASES)), docs)
