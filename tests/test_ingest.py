import datetime as dt
from decimal import Decimal as D

import pytest
from conftest import rows

from ledgerweave.portfolio.competency import COMPETENCY
from ledgerweave.portfolio.contracts import PORTFOLIO
from ledgerweave.portfolio.load import catalog_graph, load_portfolio
from ledgerweave.sources import batches
from ledgerweave.sources import text_tables as src

FORBEARANCE = PORTFOLIO["forbearance_event"]
HEADER = (
    "forbearance_event_id,loan_id,borrower_id,start_date,end_date,forbearance_clause,"
    "principal_forgiveness_amount,repayment_step_up_amount,interest_rate_under_forbearance,"
    "clause_to_stop_forbearance,description_of_forbearance,type_identifier,created_at,extra\n"
)


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_values(spark, tmp_path):
    path = write(
        tmp_path / "f.csv",
        HEADER
        + "1, 2 ,,2025-05-17,,  none ,2271.19,0,3.3465,FALSE,\"say \"\"it's\"\",\nplease\","
        + "fb,2025-05-17T20:17:22+00:00,zzz\n"
        + "2,,7,2025-05-18,2025-06-01,term,1,2,,True,  ,fb,2025-05-17T20:17:22+02:00,zzz\n",
    )
    table = src.read_table(spark, path, FORBEARANCE, multi_line=True)
    assert table.schema.fieldNames() == FORBEARANCE.columns
    one, two = sorted(table.collect(), key=lambda r: r.forbearance_event_id)
    assert (one.loan_id, one.borrower_id, one.end_date) == (2, None, None)
    assert one.start_date == dt.date(2025, 5, 17)
    assert one.forbearance_clause == "none"
    assert one.principal_forgiveness_amount == D("2271.19")
    assert one.interest_rate_under_forbearance == D("3.3465")
    assert one.clause_to_stop_forbearance is False and two.clause_to_stop_forbearance is True
    assert one.description_of_forbearance == 'say "it\'s",\nplease'
    assert two.description_of_forbearance is None
    apart = table.selectExpr("max(unix_seconds(created_at)) - min(unix_seconds(created_at))")
    assert apart.first()[0] == 7200


RECEIVERS = "receiver_id,full_name,registration_number,country_code\n"


@pytest.mark.parametrize("multi_line", [False, True])
def test_broken_rows_are_rejects_with_their_text(spark, tmp_path, multi_line):
    path = write(
        tmp_path / "r.csv", RECEIVERS + '1,A,r,ES\n2,"B, ""b""",r,ES,EXTRA\n3,c\n\n4,"D, ""d""",r,ES\n'
    )
    contract = PORTFOLIO["receiver"]
    conformed = src.conform(src.read_text_table(spark, path, multi_line), contract)
    assert rows(src.loadable(conformed).select("receiver_id", "full_name")) == [(1, "A"), (4, 'D, "d"')]
    assert rows(src.rejected(conformed, contract)) == [
        (None, None, '2,"B, ""b""",r,ES,EXTRA'),
        (None, None, "3,c"),
    ]


def test_a_stray_quote_costs_its_own_row_only(spark, tmp_path):
    lines = [f"{i},n{i},r,ES" for i in range(10)]
    lines[4] = '4,"n4,r,ES'
    lines[7] = '7,n7,r,"ES'
    contract = PORTFOLIO["receiver"]
    path = write(tmp_path / "q.csv", RECEIVERS + "\n".join(lines) + "\n")
    conformed = src.conform(src.read_text_table(spark, path), contract)
    assert [r[0] for r in rows(src.loadable(conformed))] == [0, 1, 2, 3, 5, 6, 8, 9]
    assert rows(src.rejected(conformed, contract)) == [(None, None, lines[4]), (None, None, lines[7])]
    with pytest.raises(ValueError):
        src.load_table(spark, path, contract, "stray_receivers")
    # Read as lines that run on, the open quote takes the rest along, and that is no clean row.
    whole = src.conform(src.read_text_table(spark, path, multi_line=True), contract)
    assert src.rejected(whole, contract).count() > 0


def test_lines_that_run_on_are_read_when_said_so(spark, tmp_path):
    write(tmp_path / "a.csv", RECEIVERS + '1,"two\nlines",r,ES\n')
    write(tmp_path / "b c.csv", RECEIVERS + "2,plain,r,ES\n")
    table = src.read_table(spark, str(tmp_path), PORTFOLIO["receiver"], multi_line=True)
    assert rows(table.select("receiver_id", "full_name")) == [(1, "two\nlines"), (2, "plain")]
    # As plain lines the halves are broken rows; nothing is lost in silence.
    split = src.conform(src.read_text_table(spark, str(tmp_path)), PORTFOLIO["receiver"])
    assert src.loadable(split).count() == 1 and src.rejected(split, PORTFOLIO["receiver"]).count() == 2


@pytest.mark.parametrize(
    "text, kind, value",
    [
        ("1.23", "decimal(18,2)", D("1.23")),
        ("1.230", "decimal(18,2)", D("1.23")),
        ("-7", "decimal(18,2)", D("-7")),
        ("1.239", "decimal(18,2)", None),
        ("0.005", "decimal(18,2)", None),
        ("1e2", "decimal(18,2)", D("100")),
        ("1.5e-3", "decimal(18,2)", None),
        ("125e-2", "decimal(18,2)", D("1.25")),
        ("1." + "0" * 30 + "1", "decimal(18,2)", None),
        ("99999999999999999999", "decimal(18,2)", None),
        ("1.5", "int", None),
        ("2024-02-29", "date", dt.date(2024, 2, 29)),
        ("2023-02-29", "date", None),
        ("2024", "date", None),
        ("2024-02", "date", None),
        ("2024-2-3", "date", None),
        ("2024-02-03T10:00:00", "date", None),
        ("12:30", "timestamp", None),
        ("2024-02-03", "timestamp", None),
        ("2024", "timestamp", None),
        ("2024-02-03 10:20:30", "timestamp", dt.datetime(2024, 2, 3, 10, 20, 30)),
        ("2024-02-03T10:20:30+00:00", "timestamp", dt.datetime(2024, 2, 3, 10, 20, 30)),
        ("2024-02-03T10:20:30Z", "timestamp", dt.datetime(2024, 2, 3, 10, 20, 30)),
        ("2024-02-03T10:20:30.1234567", "timestamp", None),
        ("2024-02-03T25:20:30", "timestamp", None),
    ],
)
def test_values_fit_exactly_or_not_at_all(spark, text, kind, value):
    from pyspark.sql import functions as F

    from ledgerweave.functions.casts import typed

    to = spark.range(1).select(F.lit(None).cast(kind).alias("x")).schema["x"].dataType
    found = spark.createDataFrame([(text,)], "t string").select(typed(F.col("t"), to).alias("x"))
    if kind == "timestamp":
        found = found.select(F.date_format("x", "yyyy-MM-dd HH:mm:ss").alias("x"))
        value = value and str(value)
    assert found.first().x == value


def test_missing_columns_are_null_and_order_is_declared(spark, tmp_path):
    path = write(tmp_path / "r.csv", "country_code,receiver_id\nES,1\n")
    table = src.read_table(spark, path, PORTFOLIO["receiver"])
    assert rows(table) == [(1, None, None, "ES", None)]


def test_nothing_to_read(spark, tmp_path):
    receiver = PORTFOLIO["receiver"]
    assert src.read_table(spark, str(tmp_path / "none.csv"), receiver).count() == 0
    strange = write(tmp_path / "s.csv", "a,b\n1,2\n")
    empty = src.read_table(spark, strange, receiver)
    assert empty.count() == 0 and empty.columns == receiver.columns
    for path in (str(tmp_path / "none.csv"), strange, write(tmp_path / "e.csv", "receiver_id\n")):
        assert src.load_table(spark, path, receiver, "skipped_table") is False
    assert not spark.catalog.tableExists("skipped_table")


def test_bad_fields_are_set_aside(spark, tmp_path):
    header = "collateral_id,collateral_type,concerns_loan_id,latest_valuation_amount\n"
    path = write(
        tmp_path / "c.csv", header + "1,cash,1,10.5\n2,cash,x1,oops\n3,cash,9999999999999999999,1\n"
    )
    contract = PORTFOLIO["collateral"]
    raw = src.read_text_table(spark, path)
    conformed = src.conform(raw, contract)
    assert [r.collateral_id for r in src.loadable(conformed).collect()] == [1]
    assert rows(src.rejected(conformed, contract)) == [
        (2, "concerns_loan_id", "x1"),
        (2, "latest_valuation_amount", "oops"),
        (3, "concerns_loan_id", "9999999999999999999"),
    ]
    with pytest.raises(ValueError):
        src.load_table(spark, path, contract, "strict_collateral")
    assert not spark.catalog.tableExists("strict_collateral")
    kept = str(tmp_path / "rejects")
    assert src.load_table(spark, path, contract, "some_collateral", kept)
    assert spark.table("some_collateral").count() == 1
    assert spark.read.parquet(kept).count() == 3


def test_load_appends(spark, tmp_path):
    path = write(tmp_path / "g.csv", "rating_agency_id,legal_name,country_code\n1,A,NL\n2,B,GB\n")
    agency = PORTFOLIO["rating_agency"]
    for _ in range(2):
        assert src.load_table(spark, path, agency, "agencies")
    table = spark.table("agencies")
    assert table.count() == 4
    assert table.schema.fieldNames() == agency.columns
    src.create_table(spark, agency, "agencies")  # there already: stays as it is
    assert spark.table("agencies").count() == 4


def test_load_a_portfolio_and_query_it(spark, tmp_path):
    write(tmp_path / "collection_agent.csv", "collection_agent_id,legal_name\n1,A\n2,B\n")
    write(
        tmp_path / "external_collection_event.csv",
        "external_collection_event_id,collection_agent_id,cash_recoveries\n"
        "1,1,10.5\n2,1,\n3,2,2.25\n4,7,1\n5,,1\n",
    )
    loaded = load_portfolio(spark, str(tmp_path), "p1_")
    assert {name for name, there in loaded.items() if there} == {
        "collection_agent",
        "external_collection_event",
    }
    graph = catalog_graph(spark, "p1_")
    assert [tuple(r) for r in COMPETENCY["cq07"](graph).collect()] == [
        ("A", D("10.50")),
        ("B", D("2.25")),
    ]
    assert COMPETENCY["cq01"](graph).first()[0] == 7


# -- Folders, inputs, batches -------------------------------------------------------


@pytest.mark.parametrize("multi_line", [False, True])
def test_files_of_a_folder_go_by_their_own_headers(spark, tmp_path, multi_line):
    folder = tmp_path / "r.csv"
    folder.mkdir()
    write(folder / "a.csv", '\n\nreceiver_id,full_name,country_code\n1,"A, a",ES\n')
    write(folder / "b [x].csv", "country_code,extra,full_name,receiver_id\r\nNL,zz,B,2\r\n")
    write(folder / "c c.csv", "full_name,receiver_id\nC,3\nfull_name,4\n")
    write(folder / "d.csv", "one,two\n5,foreign\n")
    write(folder / "e.csv", "")
    write(folder / "f.csv", "receiver_id,full_name,country_code\n")
    contract = PORTFOLIO["receiver"]
    raw = src.read_text_table(spark, str(folder), multi_line, contract.columns)
    conformed = src.conform(raw, contract)
    clean = src.loadable(conformed).select("receiver_id", "full_name", "country_code")
    assert rows(clean) == [(1, "A, a", "ES"), (2, "B", "NL"), (3, "C", None), (4, "full_name", None)]
    assert rows(src.rejected(conformed, contract)) == [(None, None, "5,foreign")]


@pytest.mark.parametrize("multi_line", [False, True])
def test_only_the_first_line_is_the_header(spark, tmp_path, multi_line):
    path = write(tmp_path / "h.csv", ("\n\n" if multi_line else "\n \n") + "country_code,full_name\nES,a\ncountry_code,full_name\n")
    found = src.read_text_table(spark, path, multi_line).select("country_code", "full_name")
    assert rows(found) == [("ES", "a"), ("country_code", "full_name")]


def test_the_last_of_equal_names_counts(spark, tmp_path):
    path = write(tmp_path / "h.csv", "﻿full_name,receiver_id,full_name,\nx,1,y,z\n")
    found = src.read_table(spark, path, PORTFOLIO["receiver"])
    assert rows(found.select("receiver_id", "full_name")) == [(1, "y")]


def test_lines_may_hold_anything(spark, tmp_path):
    path = write(tmp_path / "h.csv", "full_name,receiver_id\n￾￿a,1\n#b,2\n\\\"c,3\n")
    found = src.read_text_table(spark, path).select("full_name", "receiver_id", src.BROKEN)
    assert rows(found) == [("#b", "2", None), (None, None, '\\"c,3'), (None, None, "\ufffe\uffffa,1")]


def test_a_large_file_is_split_and_keeps_its_one_header(spark, tmp_path):
    folder = tmp_path / "r.csv"
    folder.mkdir()
    body = "".join(f"{i},name {i}\n" for i in range(20000))
    write(folder / "a.csv", "receiver_id,full_name\n" + body)
    write(folder / "b.csv", "full_name,receiver_id\nlast,20000\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        found = src.read_table(spark, str(folder), PORTFOLIO["receiver"])
        assert found.rdd.getNumPartitions() > 5
        assert found.select("receiver_id").distinct().count() == found.count() == 20001
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_inputs_are_decided_on_before_they_are_read(spark, tmp_path):
    chosen = {n: PORTFOLIO[n] for n in ("receiver", "collateral", "loan", "borrower", "rating_agency")}
    write(tmp_path / "receiver.csv", '"receiver_id",full_name\n1,a\n2,b\n')
    write(tmp_path / "collateral.csv", "")
    write(tmp_path / "loan.csv", "some,thing\n1,2\n")
    write(tmp_path / "borrower.csv", "\nborrower_id\n\n")
    found = src.list_inputs(spark, str(tmp_path), chosen).select("table", "file", "n_rows", "decision")
    assert rows(found) == [
        ("borrower", "borrower.csv", 0, "no rows"),
        ("collateral", "collateral.csv", 0, "empty"),
        ("loan", "loan.csv", 1, "foreign"),
        ("rating_agency", None, 0, "missing"),
        ("receiver", "receiver.csv", 2, "load"),
    ]
    for name, decision in rows(found.select("table", "decision")):
        loaded = src.load_folder(spark, str(tmp_path / f"{name}.csv"), chosen[name], str(tmp_path / "out" / name), "b1")
        assert loaded == (decision == "load")


def test_a_load_can_be_repeated(spark, tmp_path):
    agency = PORTFOLIO["rating_agency"]
    header = "rating_agency_id,legal_name,country_code\n"
    one = write(tmp_path / "1.csv", header + "1,A,NL\n2,B,GB\n")
    two = write(tmp_path / "2.csv", header + "3,C,NL\n")
    target, rejects = str(tmp_path / "agency"), str(tmp_path / "rejects")
    for path, batch in ((one, "007"), (two, "b"), (one, "007"), (two, "b")):
        assert src.load_folder(spark, path, agency, target, batch, rejects)
        assert src.load_table(spark, path, agency, "batched_agencies", rejects + "2", batch=batch)
    for table in (batches.read_batches(spark, target), spark.table("batched_agencies")):
        assert rows(batches.batch_counts(table)) == [("007", 2), ("b", 1)]
    batches.insert_batch(src.empty_table(spark, agency), "batched_agencies", "b")
    assert rows(batches.batch_counts(spark.table("batched_agencies"))) == [("007", 2)]
    # A corrected load takes the place of the first one, rejects included.
    bad = write(tmp_path / "3.csv", header + "x,A,NL\n5,E,ES\n")
    assert src.load_folder(spark, bad, agency, target, "007", rejects)
    found = batches.read_batches(spark, target)
    assert rows(found.select("rating_agency_id", "load_batch")) == [(3, "b"), (5, "007")]
    assert rows(batches.read_batches(spark, rejects).select("raw", "load_batch")) == [("x", "007")]
    assert src.load_folder(spark, one, agency, target, "007", rejects)
    assert batches.read_batches(spark, rejects).count() == 0
    with pytest.raises(ValueError):
        batches.write_batch(found, target, "a/b")


def test_a_write_that_fails_leaves_the_batch_as_it_was(spark, tmp_path):
    from pyspark.sql import functions as F

    target = str(tmp_path / "t")
    batches.write_batch(spark.range(10), target, "b")
    broken = spark.range(100).repartition(4).withColumn(
        "id", F.when(F.col("id") == 77, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).cast("long")
    )
    with pytest.raises(Exception, match="stop"):
        batches.write_batch(broken, target, "b")
    assert batches.read_batches(spark, target).count() == 10
