"""Shards: every row once, slots without gaps, bytes near equal, equal texts together."""

import random
import zlib

import pytest

from docaudit.llm import queries, sharding

from . import cases


def check(rows, found, count=sharding.SHARDS):
    assert sorted(((r.doc_id, r.size) for r in found), key=str) == sorted(((d, len((t or "").encode()) + 16) for d, t in rows), key=str)
    slots: dict = {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(own) == list(range(len(own))) and 0 <= k < count for k, own in slots.items())
    sizes = [sum(r.size for r in found if r.shard == k) for k in range(count)]
    largest = max(r.size for r in found)
    mean = sum(sizes) / count
    assert max(sizes) <= max(mean * 1.02, mean + largest) and min(sizes) >= mean * 0.98 - largest
    return sizes


def test_query_over_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{cases.DATA}/documents.parquet").collect()]
    found = queries.op13_sharding(spark, cases.DATA).collect()
    check(rows, found)
    crc = dict(zip((d for d, _ in rows), (zlib.crc32((t or "").encode()) for _, t in rows)))
    assert all(r.text_crc32 == crc[r.doc_id] and r.law == "bytes" and r.grown_shard is None for r in found)


@pytest.mark.parametrize("hot", [0, 3000])
def test_balance_and_groups(spark, hot):
    r = random.Random(hot)
    rows = [(k, f"text {k} " * r.choice((1, 3, 9, 30))) for k in range(6000)]
    rows += [(10_000 + k, f"copy {k % 60} " * 12) for k in range(900)] + [(20_000 + k, "hot text " * 20) for k in range(hot)] + [(None, None)] * 5 + [(7, "")] * 4
    docs = cases.documents(spark, rows)
    found = sharding.shards(docs).select("doc_id", "text", "size", "shard", "slot", "items").collect()
    sizes = check(rows, found)
    assert max(sizes) <= 1.02 * sum(sizes) / len(sizes) + 600
    homes: dict = {}
    for x in found:
        homes.setdefault(x.text, set()).add(x.shard)
    whole = {t for t, own in homes.items() if len(own) > 1}
    assert whole == ({"hot text " * 20} if hot else set())


def test_small_and_odd_tables(spark):
    found = sharding.shards(cases.documents(spark).withColumn("shard", cases_lit()), 3)
    assert found.columns.count("shard") == 1
    check(cases.ODD, found.collect(), 3)
    assert sharding.shards(cases.empty(spark)).count() == 0
    (one,) = sharding.shards(cases.documents(spark, [(1, None)])).collect()
    assert (one.size, one.slot) == (16, 0)


def cases_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_borders_equal_a_search_over_sorted_keys(spark):
    r = random.Random(2)
    items = [(r.randrange(1 << sharding.KEY_BITS) >> r.choice((0, 0, 20, 58)), r.randint(1, 50)) for _ in range(3000)]
    df = spark.createDataFrame(items, "key bigint, size int")
    total = sum(s for _, s in items)
    aims = [0, 1, *(total * k // 9 for k in range(1, 9)), total]
    slack = sharding.TOLERANCE * max(b - a for a, b in zip([0, *aims], aims)) / 8
    for aim, border in zip(aims, sharding.borders(df, aims)):
        own = sum(s for k, s in items if k < border)
        reached = {sum(s for k, s in items if k < x) for x in {k for k, _ in items} | {1 << sharding.KEY_BITS}}
        assert abs(own - aim) <= min(abs(x - aim) for x in reached | {0}) + slack


def test_written_shards_read_in_order(spark, tmp_path):
    docs = cases.documents(spark, [(k, "w " * (k % 7)) for k in range(500)])
    sharding.write(sharding.shards(docs, 4), str(tmp_path / "out"), rows_per_file=40)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 500 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
    for folder in (tmp_path / "out").glob("shard=*"):
        slots = [r.slot for file in sorted(folder.glob("*.parquet")) for r in spark.read.parquet(str(file)).collect()]
        assert slots == sorted(slots)
