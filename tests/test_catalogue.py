"""Every query of the catalogue against its SQL."""

import hashlib

import pytest

from oracle import differences
from twinloom.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
MAY_BE_EMPTY = {"chain_succession"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    assert differences(spark, SF, QUERIES[name], ORACLE_SQL[name]) in (("", "empty") if name in MAY_BE_EMPTY else ("",))


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(QUERIES) - set(ORACLE_SQL) == {"entity_id_blake2b"}


def test_blake2b_of_every_row(spark):
    for r in QUERIES["entity_id_blake2b"](spark, SF).join(spark.read.parquet(f"{SF}/customer.parquet"), "c_custkey").collect():
        raw = r.c_name.encode()
        assert r.id == hashlib.blake2b(len(raw).to_bytes(8, "big") + raw, digest_size=32).hexdigest()
