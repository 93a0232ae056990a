"""Runs of dates and versions against a quadratic search, and totals against every sum that may make them."""

import itertools
import random

import pytest

from docaudit.operators import runs, tables


def longest(values, direction):
    """The longest subsequence in order, by trying each value behind all before it."""
    best = []
    for k, v in enumerate(values):
        best.append(1 + max([0, *(best[i] for i in range(k) if ((v > values[i]) - (v < values[i])) != -direction)]))
    return max([0, *best])


def slow_culprits(values):
    signs = [(b > a) - (b < a) for a, b in zip(values, values[1:])]
    direction = (signs.count(1) > signs.count(-1)) - (signs.count(1) < signs.count(-1))
    if not direction or longest(values, direction) * 2 <= len(values):
        return []
    out = []
    for k, sign in enumerate(signs, 1):
        if sign == -direction:
            before, after = (longest(values[:x] + values[x + 1 :], direction) for x in (k - 1, k))
            out.append(k - 1 if before > after else k)
    return list(dict.fromkeys(out))


def test_culprits_equal_a_quadratic_search():
    r = random.Random(1)
    for values in itertools.product("123", repeat=6):
        assert runs.culprits(list(values)) == slow_culprits(list(values))
    for _ in range(400):
        values = sorted(r.choice("abcdefghij") for _ in range(r.randint(0, 14)))
        for _ in range(r.randint(0, 3)):
            if values:
                values.insert(r.randrange(len(values)), values.pop(r.randrange(len(values))))
        values = values[:: r.choice((1, -1))]
        assert runs.culprits(values) == slow_culprits(values)
    many = [f"{k:07}" for k in range(100_000)]
    many[5] = "9999999"
    assert runs.culprits(many) == [5]


def test_ties_by_version_and_by_gap():
    days = [1.0, 8.0, 2.0, 9.0]
    # The swapped neighbours stand equally well; the one farther from its outer neighbour is named.
    assert runs.culprits(["01", "08", "02", "09"], days, None) in ([1], [2])
    assert runs.culprits(["01", "07", "03", "09"], [1.0, 7.0, 3.0, 9.0]) == [2]
    assert runs.culprits(["01", "08", "03", "09"], [1.0, 8.0, 3.0, 9.0]) == [1]


DATES = """# Plan
- 2024-01-05 kick-off
- 2024-02-01 design
  - 2023-01-01 nested
- 2024-09-09 early
- 2024-03-01 build
- 2024-04-01 test

| When | What |
|---|---|
| March 3, 2024 | a |
| 2 March 2024 | b |
| March 1, 2024 | c |
| 1 May 2024 | d |
| 28 February 2024 | e |

```
- 2020-01-01 in code
```
## 1.0.2 - 2024-05-03
## 1.0.1 - 2024-05-09
text
## 1.0.0 - 2024-05-01
## 0.9.0 - 2024-04-01
## 0.8.0
- alpha 2024-01-01
- beta 2023-01-01
- gamma 2024-01-01
"""


def test_date_order(spark):
    docs = spark.createDataFrame([(1, DATES), (2, None), (3, ""), (4, "no dates"), (5, DATES)], "doc_id int, text string")
    found = sorted((r.doc_id, r.line, r.quote, r.beside) for r in runs.date_order(docs).collect())
    own = [(5, "2024-09-09", "2024-02-01"), (14, "1 May 2024", "2024-03-01"), (21, "2024-05-09", "2024-05-03")]
    assert found == [(d, *x) for d in (1, 5) for x in own]
    for r in runs.date_order(docs).collect():
        assert DATES[r.start : r.end] == r.quote


def test_version_order(spark):
    text = "## [2.0.0]\n### Added\n## v1.10.0 - x\n## 1.2.0\n## 1.9.0\n## 1.2.0-rc.10\n## 1.2.0-rc.9\n## 1.1.0"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "- 1.0.0\n- 1.1.0\n- 1.3.0\n- 1.2.0\n- 1.4.0\n- 1.5.0")], "doc_id int, text string")
    found = sorted((r.doc_id, r.line, r.quote, r.beside) for r in runs.version_order(docs).collect())
    assert found == [(1, 5, "1.9.0", "1.2.0"), (3, 4, "1.2.0", "1.3.0")]


def sums(parts_and_totals, closing):
    """All sums a total under these rows may have, written out."""
    parts = [v for kind, v in parts_and_totals if kind == "part"]
    marks = [k for k, (kind, _) in enumerate(parts_and_totals) if kind == "total"]
    totals = [v for kind, v in parts_and_totals if kind == "total"]
    behind = [v for kind, v in parts_and_totals[marks[-1] + 1 :] if kind == "part"] if marks else parts
    if len(parts) < 2 and not (not parts and len(totals) >= 2):
        return None
    found = {sum(parts), sum(behind)} | ({totals[-1] + sum(behind)} if totals else set()) if parts else {sum(totals)}
    if closing:
        found |= {sum(parts[k:]) for k in range(len(parts))} | {sum(parts[:k]) - sum(parts[k:]) for k in range(1, len(parts))}
    return found


@pytest.mark.parametrize("closing", [False, True])
def test_inadmissible_totals_equal_all_sums(spark, closing):
    r, rows, wanted = random.Random(9), [], set()
    for group in range(300):
        table = []
        for at in range(r.randint(1, 8)):
            last = at > 2 and r.random() < 0.35
            table.append(("total" if last else "part", r.randint(1, 4) * 100))
        options = sums(table, closing) or {1}
        table.append(("total", r.choice([*options, *options, r.randint(1, 30) * 100])))
        for at, (kind, value) in enumerate(table):
            end = at + 1 == len(table)
            options = sums(table[:at], closing and end)
            if kind == "total" and options is not None and value not in options:
                wanted.add((group, at))
            rows.append((group, at, kind == "total", value, closing and end, False))
    df = spark.createDataFrame(rows, "g int, at int, label boolean, cents bigint, closing boolean, unsure boolean")
    found = tables.inadmissible_totals(df, ["g"], "at", "label", "cents", unsure="unsure", closing="closing" if closing else None)
    assert {(x.g, x.at) for x in found.collect()} == wanted and len(wanted) > 50


TOTALS = """| Item | Price | Year |
|---|---|---|
| Chair | $120.00 | 2020 |
| Desk | $380.00 | 2021 |
| Subtotal | $500.00 | |
| Tax | $50.00 | |
| **Total** | **$550.00** | 2022 |

| Item | Price |
|---|---|
| Chair | $120.00 |
| Desk | $380.00 |
| Total (incl. tax) | $510.00 |

- Rent: $900
- Food: $300
- Total: $1,100

| Pay | Amount |
|---|---|
| Base | 3,000 |
| Allowance | 500 |
| Pension | 200 |
| Health | 100 |
| Net pay | 3,200 |

| Month | Cost |
|---|---|
| Rent | $10 |
| Power | $20 |
| Annual total | $360 |

| Item | Price |
|---|---|
| A | $5 |
| B | 5 kg |
| Total | $99 |

| Item | Price |
|---|---|
| A | ($5) |
| B | $6 |
| Total | $99 |

- Total conversion: 25%
- a: 5
- b: 6
"""


def test_totals_of_texts(spark):
    docs = spark.createDataFrame([(1, TOTALS), (2, None), (3, ""), (4, TOTALS.replace("$50.00 |", "$51.00 |", 1)), (5, TOTALS.replace("| 3,200", "| 3,300"))], "doc_id int, text string")
    found = sorted((r.doc_id, r.line, r.quote, r.written, r.expected) for r in runs.totals(docs).collect())
    same = [(13, "$510.00", 51000, 50000), (17, "$1,100", 110000, 120000)]
    extra = {1: [], 4: [(7, "$550.00", 55000, 55100)], 5: [(25, "3,300", 330000, 380000)]}
    assert found == sorted((d, *x) for d, more in extra.items() for x in same + more)
    for r in runs.totals(docs).where("doc_id = 1").collect():
        assert TOTALS[r.start : r.end] == r.quote
