"""The mix against plain Sainte-Laguë and its own rules."""

import random

import duckdb
import pytest

from ledgerloom.llm import mixture as m

SCHEMA = "text string, doc_id long, source string, seats string, n_chars long"


def plain_seats(weights, seats):
    won = dict.fromkeys(weights, 0)
    for _ in range(seats if sum(weights.values()) > 0 else 0):
        best = max(sorted(weights), key=lambda k: weights[k] / (2 * won[k] + 1))
        won[best] += 1
    return won


@pytest.mark.parametrize("seed", range(6))
def test_apportion_equals_the_quotient_loop(spark, seed):
    r = random.Random(seed)
    groups = {g: ({k: r.choice([0, 1, 5, 5, r.randint(1, 4000)]) for k in range(r.randint(1, 9))}, r.randint(0, 80)) for g in range(4)}
    rows = [(g, k, w, s) for g, (ws, s) in groups.items() for k, w in ws.items()]
    out = m.apportion(spark.createDataFrame(rows, "g long, k long, w long, s long"), ["g"], ["k"], "w", "s", "won").collect()
    assert {(x.g, x.k): x.won for x in out} == {(g, k): n for g, (ws, s) in groups.items() for k, n in plain_seats(ws, s).items()}


def documents(spark, n=300):
    r = random.Random(5)
    rows = [(" ".join(["w"] * r.randint(0, 60)), i, "big" if i % 3 else r.choice(["a", "b", None, "ü"]), "x", 1) for i in range(n)]
    rows += [(None, n, "a", "x", 1), ("", n + 1, None, "x", 1), ("word " * 5000, n + 2, "long", "x", 1), (" \t\n", n + 3, "void", "x", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_targets_limits_and_reruns(spark):
    docs = documents(spark)
    rows = m.mixture(docs, shard_rows=50).collect()
    assert len(rows) == docs.count()
    assert all(0 <= x.taken <= 3 * x.size for x in rows)
    by = {}
    for x in rows:
        by.setdefault(x.source, [x.target, 0, x.source_size])[1] += x.taken
    assert all(abs(target - took) <= 16 * 12 and target <= 3 * size + 1e-9 for target, took, size in by.values())
    assert abs(sum(t for t, _, _ in by.values()) - sum(x.size for x in rows)) < 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, m.mixture(docs.repartition(7), shard_rows=50).collect()))


def test_same_rows_as_sql(spark):
    docs = documents(spark)
    with duckdb.connect() as con:
        con.register("documents", docs.toPandas())
        want = sorted(con.execute(m.OP10_SQL).fetchall())
    got = m.mixture(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, got)) == want


def test_mixed_repeats_rows_and_keeps_columns(spark):
    docs = documents(spark)
    times = {x.doc_id: -(-x.taken // x.size) for x in m.mixture(docs).collect() if x.taken}
    out = m.mixed(docs)
    assert out.columns == docs.columns
    got = {x.doc_id: x["count"] for x in out.groupBy("doc_id").count().collect()}
    assert got == times


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert m.mixture(empty).count() == 0 and m.mixed(empty).count() == 0
    twice = spark.createDataFrame([("a b c", 1, "s", "x", 1)] * 4, SCHEMA)
    assert m.mixture(twice).count() == 4


def test_mixed_keeps_rows_without_an_id(spark):
    docs = spark.createDataFrame([("a b c", None, "s"), ("a b c d e", None, None), ("a b", 1, "s"), ("", None, "s")], "text string, doc_id long, source string")
    want = sorted((x.doc_id or 0, x.source or "", x.size, -(-x.taken // x.size)) for x in m.mixture(docs, block_words=1).collect() if x.taken)
    got = m.mixed(docs, block_words=1).groupBy("text", "doc_id", "source").count().collect()
    assert sorted((x.doc_id or 0, x.source or "", len(x.text.split()), x["count"]) for x in got) == want
    assert any(x.doc_id is None for x in got)


def test_mixed_keeps_columns_of_any_name(spark):
    names = ["_time", "_times", "_id", "_size", "_source", "taken_time", "taken_times", "taken_id", "size", "taken", "shard"]
    rows = [(f"w{i} " * (i + 1), i, "st"[i % 2], *[f"{n}{i}" for n in names]) for i in range(9)] + [("long " * 50_000, 9, "s", *names)]
    docs = spark.createDataFrame(rows, "text string, doc_id long, source string, " + ", ".join(f"{n} string" for n in names))
    out = m.mixed(docs)
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.collect()} <= set(rows) and out.count() > 0
