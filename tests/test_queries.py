"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import duckdb
import pytest

from tidemark.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    return round(x, 5) if isinstance(x, float) and math.isfinite(x) else x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in found], key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sql, name):
    own = QUERIES[name](spark, DATA)
    cursor = sql.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(own.columns) == sorted(columns)
    assert rows(own.columns, own.collect()) == rows(columns, cursor.fetchall())


def test_telegram_counts_and_lists_texts(spark):
    own = {r.role: r for r in QUERIES["src_telegram"](spark, DATA).collect()}
    assert set(QUERIES["src_telegram"](spark, DATA).columns) == {"role", "n", "texts"}
    assert own and all(0 < r.n <= 100 and len(r.texts) == 32 for r in own.values())


def test_telegram_takes_every_message_of_the_last_day(spark, tmp_path):
    # conversation k began k % 48 hours ago, turn m came m minutes earlier: 0 to 23 are of the last day, and 24 at turn 0
    said = [(k % 30, k // 30, ["user", "bot", None][k % 3], ["hi", "hi", f"t{k}", "", None][k % 5]) for k in range(1500)]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    there = [(c, m, r, x) for c, m, r, x in said if x and c * 60 + m <= 1440]
    n = Counter(r for _, _, r, _ in there)
    assert min(n.values()) > 100
    expected = [(r, n[r], hashlib.md5(f"{c}|{m}|{x}".encode()).hexdigest()) for c, m, r, x in there]
    own = QUERIES["src_telegram"](spark, str(tmp_path))
    assert own.columns == ["role", "n", "texts"]
    assert sorted(map(tuple, own.collect()), key=repr) == sorted(expected, key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(con.execute(ORACLES["src_telegram"]).fetchall(), key=repr) == sorted(expected, key=repr)
