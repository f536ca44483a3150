"""Every engine query against its SQL in DuckDB, and the plans' shape."""

import collections

import duckdb
import pytest

from sparklex import queries


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        c.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, data, con, name):
    want = con.execute(queries.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    got = queries.queries()[name](spark, data)
    assert sorted(got.columns) == sorted(cols)
    assert collections.Counter(map(tuple, got.select(cols).collect())) == collections.Counter(want.fetchall())


def test_encode_needs_no_shuffle_and_reads_two_columns(spark, data, monkeypatch):
    from sparklex.sources import corpus

    for size in (0, 1 << 30):  # a large table; a small one, whose rows are dealt to all cores
        monkeypatch.setattr(corpus, "BYTES_PER_CORE", size)
        for name in ("bpe_encode", "wordpiece_encode", "unigram_encode", "tok_encode"):
            plan = queries.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
            assert ("RoundRobinPartitioning" in plan) == (size > 0) and "hashpartitioning" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_entry_without_optional_parts(spark):
    import __spark_entry__

    assert set(queries.queries()) <= set(__spark_entry__.queries()) and __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["contiguous", "isolated", "next", "previous"])
def test_split_rows_with_the_mark(spark, tmp_path, name):
    """Texts that are empty or hold U+0001, by which shown arrays are joined."""
    texts = ["", "a b\x01c d, e", "\x01", "\x01\x01é.\x01,x\x01", ".é\x01.", "plain", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = c.execute(queries.oracle_sql()[f"pretok_split_{name}"])
    cols = [x[0] for x in want.description]
    assert collections.Counter(map(tuple, queries.queries()[f"pretok_split_{name}"](spark, str(tmp_path)).select(cols).collect())) == collections.Counter(want.fetchall())
