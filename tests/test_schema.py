import pytest
from pyspark.sql import types as T

from ledgerweave import schema
from ledgerweave.portfolio.billing import BILLING
from ledgerweave.portfolio.contracts import PORTFOLIO


def test_all_tables_are_declared():
    assert len(PORTFOLIO) == 14 and len(BILLING) == 8


def test_link_table_contract():
    link = PORTFOLIO["loan_borrower_link"]
    assert link.primary_key == ("loan_id", "borrower_id", "role_type")
    assert {r.table for r in PORTFOLIO["collateral"].foreign_keys} == {
        "loan",
        "borrower",
        "insurance_provider",
    }


def test_every_reference_leads_to_a_key():
    everything = {**PORTFOLIO, **BILLING}
    for contract in everything.values():
        for reference in contract.foreign_keys:
            assert everything[reference.table].primary_key == (reference.target,)


def test_struct_carries_keys():
    struct = PORTFOLIO["property_collateral"].struct()
    assert struct["property_collateral_id"].metadata["pk"]
    assert struct["collateral_id"].metadata["fk"] == "collateral.collateral_id"
    assert not struct["city"].nullable and struct["postal_code"].nullable


@pytest.mark.parametrize(
    "sql, value, link, exact",
    [
        ("BIGINT", "BigInt", "BIGINT", T.LongType()),
        ("INTEGER", "BigInt", "INT", T.IntegerType()),
        ("SMALLINT", "BigInt", "SMALLINT", T.ShortType()),
        ("NUMERIC(18,2)", "Double", "DOUBLE", T.DecimalType(18, 2)),
        ("DATE", "DateTime", "DATE", T.DateType()),
        ("TIMESTAMPTZ", "DateTime", "TIMESTAMP", T.TimestampType()),
        ("BOOLEAN", "Boolean", "BOOLEAN", T.BooleanType()),
        ("TEXT", "String", "STRING", T.StringType()),
        ("CHAR(2)", "String", "STRING", T.StringType()),
        ("jsonb", "String", "STRING", T.StringType()),
    ],
)
def test_types(sql, value, link, exact):
    assert schema.value_type(sql) == value
    assert schema.link_column_type(sql) == link
    assert schema.exact_type(sql) == exact


def test_type_names_of_columns(spark):
    names = ["BIGINT", "numeric(18, 2)", " TimestampTZ ", "BOOLEAN", "SMALLINT", "date", "double precision", "jsonb", ""]
    found = schema.type_report(spark.createDataFrame([(n,) for n in names], "sql_type string"))
    for row in found.collect():
        assert row.value_type == schema.value_type(row.sql_type)
        assert row.link_type == schema.link_column_type(row.sql_type)
    by = {r.sql_type: (r.value_type, r.entity_type, r.endpoint_type) for r in found.collect()}
    assert by["BOOLEAN"] == ("Boolean", "BOOLEAN", "bit")
    assert by["date"] == ("DateTime", "TIMESTAMP", "datetime2")
    assert by["jsonb"] == ("String", "STRING", "varchar")


def test_contracts_of_declared_rows():
    rows = [("a", "id", "BIGINT"), ("b", "x", "TEXT"), ("a", "amount", "NUMERIC(12,3)"), ("a", "at", "DATE")]
    found = schema.contracts_of(rows, {"a": ["id"]})
    assert found["a"].columns == ["id", "amount", "at"] and found["a"].primary_key == ("id",)
    assert found["a"].field("amount").type == T.DecimalType(12, 3) and found["b"].primary_key == ()
