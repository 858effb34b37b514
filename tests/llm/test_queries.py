"""The queries return what they are to return: columns, types, rows, and SQL's values where there is SQL."""

import os

import duckdb
import pytest

from loomgraph.llm import entry

SF = "/root/testdata/sf0.001"
WANTED = {
    "op1_token_store": ("documents", {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}),
    "op2_fingerprints": ("documents", {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}),
    "op3_mixing": (None, {"doc_id": "bigint", "source": "string"}),
    "op4_token_counts": ("documents", {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}),
    "op5_byte_bpe": ("documents", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}),
    "op6_warc": ("pages", {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"}),
    "op7_simhash": ("documents", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}),
    "op8_url_filter": ("pages", {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"}),
    "op9_audio": ("documents", {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}),
    "op10_toxicity": ("documents", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}),
}


def test_all_are_there():
    assert set(entry.QUERIES) == set(WANTED)


@pytest.mark.parametrize("name", sorted(WANTED))
def test_contract(spark, name):
    whole, wanted = WANTED[name]
    df = entry.QUERIES[name](spark, SF)
    got = dict(df.dtypes)
    assert {c: got.get(c) for c in wanted} == wanted
    rows = df.collect()
    if whole:
        assert len(rows) == spark.read.parquet(f"{SF}/{whole}.parquet").count()
    if name == "op2_fingerprints":
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
        long = [r for r in rows if r.n_chars > 1000]
        # half of a text stays, but for the chunk at the seam
        assert all(r.near_edited > 0.2 for r in long)


def cell(v):
    return "" if v is None or v != v else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    df, want = entry.QUERIES[name](spark, SF), con.sql(entry.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(cell(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(cell(r[i]) for i in at) for r in want.fetchall())
