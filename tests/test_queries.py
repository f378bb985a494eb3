import pytest
from tables import SF, duck, rows

import __spark_entry__ as entry
from mergeloom.plans.oracles import SQL
from mergeloom.plans.queries import QUERIES

NO_SQL = {"append_turns", "truncate_documents", "chunk_documents"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    if name in SQL:
        assert rows(df) == duck(SQL[name])
    else:
        assert name in NO_SQL and df.count()


def test_append_turns_by_brute_force(spark, vocab):
    got = {(r.conv_id, r.turn): (r.n_bytes, r.n_tokens) for r in QUERIES["append_turns"](spark, SF).collect()}
    text = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        text[r.conv_id] = text.get(r.conv_id, "") + r.text
        data = text[r.conv_id].encode()
        assert got[r.conv_id, r.turn] == (len(data), len(vocab.encode(data)))


def test_cuts_keep_the_text(spark):
    whole = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["chunk_documents"](spark, SF).collect():
        assert whole[r.doc_id][r.start :].startswith(r.chunk) and r.n_tokens <= 256
    for r in QUERIES["truncate_documents"](spark, SF).collect():
        assert whole[r.doc_id].startswith(r.text)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
