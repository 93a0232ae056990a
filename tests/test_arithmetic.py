"""Each rule with a text that fires and one that does not; the expected findings are worked out by hand."""

from __future__ import annotations

import pytest

from docaudit.operators import arithmetic

#: rule: text that breaks it, text that keeps it.
TEXTS = {
    "closing-balance-mismatch": ("Opening balance: $1,000.00\nDeposits: 250.00\nDeposits: 50.00\nWithdrawals: 100.00\nClosing balance: 1,210.00", "Opening balance: $1,000.00\nDeposits: 250.00\nDeposits: 50.00\nWithdrawals: 100.00\nClosing balance: 1,200.00"),
    "net-amount-mismatch": ("| Gross pay | 3,000 |\n| Total deductions | 600 |\n| Net pay | 2,450 |", "| Gross pay | 3,000 |\n| Total deductions | 600 |\n| Net pay | 2,400 |"),
    "annual-pay-mismatch": ("Monthly salary: 2,000\nBonus (months): 2\nAnnual salary: 30,000", "Monthly salary: 2,000\nBonus (months): 2\nAnnual salary: 28,000"),
    "interest-mismatch": ("Principal: 12,000\nInterest rate: 5%\nInterest: 650", "Principal: 12,000\nInterest rate: 5%\nInterest: 50"),
    "installment-total-mismatch": ("Number of payments: 12\nMonthly payment: 99.50\nTotal payable: 1,200.00", "Number of payments: 12\nMonthly payment: 99.50\nProcessing fee: 6.00\nTotal payable: 1,200.00"),
    "rent-multiple-mismatch": ("Rent: 900\nDeposit (months): 2\nDeposit: 2,000", "Rent: 900\nDeposit (months): 2\nDeposit: 1,800"),
    "ratio-mismatch": ("Sales: 800\nProfit: 100\nMargin: 13.5%", "Sales: 800\nProfit: 100\nMargin: 12.5%"),
    "share-amount-mismatch": ("Total charges: 10,000\nPatient share: 30%\nAmount paid: 3,500", "Total charges: 10,000\nPatient share: 30%\nAmount paid: 3,000"),
    "bmi-mismatch": ("Height: 170 cm\nWeight: 65 kg\nBMI: 24.5", "Height: 1.70 m\nWeight: 65 kg\nBMI: 22.5"),
    "capacity-runtime-mismatch": ("Battery capacity (Wh): 50\nConsumption (W): 10\nRuntime (hours): 8", "Battery capacity (Wh): 50\nConsumption (W): 10\nRuntime (hours): 5"),
    "count-over-capacity": ("Capacity: 80\nRegistered: 95", "Capacity: 80\nRegistered: 80"),
    "net-over-gross": ("Gross weight: 10.0 kg\nNet weight: 11.5 kg", "Gross weight: 10.0 kg\nNet weight: 9.5 kg"),
    "meter-usage-mismatch": ("Previous reading: 1,200\nCurrent reading: 1,450\nUsage: 260", "Previous reading: 1,200\nCurrent reading: 1,450\nUsage: 250"),
    "deductible-exceeds-limit": ("Benefit limit: 500\nDeductible: 750", "Benefit limit: 500\nDeductible: 250"),
    "product-exceeds-maximum": ("Dose: 400 mg\nDoses per day: 4\nDaily maximum: 1,200 mg", "Dose: 400 mg\nDoses per day: 3\nDaily maximum: 1,200 mg"),
    "interval-count-mismatch": ("Minimum interval (hours): 8\nDoses per day: 4", "Minimum interval (hours): 6\nDoses per day: 4"),
    "variance-mismatch": ("Budget: 500\nActual: 560\nVariance: 50", "Budget: 500\nActual: 560\nVariance: -60"),
    "serial-range-reversed": ("Recalled: lots L5240 to L5210 only.", "Recalled: lots L5210 to L5240, A10 to B05."),
    "revision-direction-mismatch": ("The forecast was revised up from 3.2% to 2.9% today.", "The forecast was revised down from 3.2% to 2.9%, and the price cut from 5 to 6."),
    "period-part-exceeds-whole": ("Returns are free for 18 months within a 12-month warranty.", "Returns are free for 6 weeks within a 2-month trial."),
    "walk-time-distance-mismatch": ("A 5-minute walk (800 m) from the station.", "A 10-minute walk (800 m) from the station."),
    "annual-holidays-mismatch": ("We give two days off every week. That makes 95 days off per year.", "We give two days off every week. That makes 110 days off per year."),
    "email-subject-length": ("Subject: \nDear all", "Subject: Minutes of Monday\nDear all"),
    "attachment-not-attached": ("Subject: Minutes\nPlease find attached the minutes.", "Subject: Minutes\nPlease find attached the minutes.\nAttachments: minutes.pdf"),
    "version-order": ("# 2.1.0\n# 2.0.0\n# 1.10.0\n# 1.2.0\n# 1.9.0", "# 2.1.0\n# 2.0.0\n# 1.10.0\n# 1.9.0\n# 1.2.0"),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(2 * k + side, texts[side]) for k, texts in enumerate(TEXTS.values()) for side in (0, 1)] + [(1000, None), (1001, ""), (1002, "No figures: here"), (None, TEXTS["net-over-gross"][0]), (None, TEXTS["net-over-gross"][0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return [tuple(r) for r in arithmetic.findings(docs).select("doc_id", "rule", "n", "quote").collect()]


@pytest.mark.parametrize("rule", TEXTS)
def test_rule_fires_on_the_wrong_text_alone(found, rule):
    at = 2 * list(TEXTS).index(rule)
    assert {r for d, r, _, _ in found if d == at} == {rule}
    assert not [r for d, r, _, _ in found if d == at + 1]


def test_odd_rows(found):
    assert not [x for x in found if x[0] in (1000, 1001, 1002)]
    assert [x[1] for x in found if x[0] is None] == ["net-over-gross", "net-over-gross"]
    quotes = {r: q for _, r, _, q in found}
    assert quotes["closing-balance-mismatch"] == "closing 1210.00 against 1200.00" and quotes["version-order"] == "1.9.0"


def test_every_figure_is_used():
    assert {n for c in arithmetic.CHECKS for n in c.needs} | {"fee"} == set(arithmetic.FIGURES)


def test_an_empty_table(spark):
    assert arithmetic.findings(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


SEVERAL = """Total charges: 10,000

Capacity: 80
Registered: 70

Capacity: 50
Registered: 95

Patient share: 30%
Amount paid: 3,500

Dose: 400 mg
Doses per day: 3
Daily maximum: 1,200 mg
Dose: 500 mg
Doses per day: 3
Daily maximum: 1,200 mg

Deposits: 10
Opening balance: 100
Deposits: 20
Withdrawals: 5
Closing balance: 125

Opening balance: 7
Deposits: 1
Withdrawals: 1
Closing balance: 8
"""


def test_every_statement_of_a_document(spark):
    docs = spark.createDataFrame([(1, SEVERAL), (2, SEVERAL), (2, SEVERAL), (3, "Capacity: 80\nRegistered: 95\n\nCapacity: 80\nRegistered: 95")], "doc_id bigint, text string")
    found = sorted((r.doc_id, r.rule, r.quote) for r in arithmetic.figure_findings(docs).collect())
    own = [("closing-balance-mismatch", "closing 8.00 against 7.00"), ("count-over-capacity", "registered 95.00 against 50.00"), ("product-exceeds-maximum", "daily maximum 1200.00 against 1500.00"), ("share-amount-mismatch", "paid 3500.00 against 3000.00")]
    assert found == sorted([(d, *x) for d in (1, 2, 2) for x in own] + [(3, "count-over-capacity", "registered 95.00 against 80.00")])
