"""Plans and rows of the stored ledger and the filtered endpoint."""

import re
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import aggregates
from ledgerlark.operators.filters import FilterSpec, compile_filters
from ledgerlark.plans import catalogue
from ledgerlark.sources import ledger, store

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    return store.stored_ledger(spark, SF)


def test_the_table_is_made_once(spark, stored):
    tables = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("ledger_")}
    made = tables()
    store.stored_ledger(spark, SF)
    assert tables() == made and store.fingerprint(spark, SF) != store.fingerprint(spark, "/root/testdata/sf0.01")
    facts = ledger.ledger(spark, SF)
    assert stored.drop("month").count() == facts.count() and stored.drop("month").exceptAll(facts.select(stored.drop("month").columns)).count() == 0
    described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {made.pop()}").collect()}
    assert "rows" in described["Statistics"] and described["Bucket Columns"] == "[`company_key`]"


@pytest.mark.parametrize("how", [dict(date_from="1996-02-11", date_to="1996-06-20"), dict(years=(1996,), months=(1, 2)), dict(date_to="1997-01-01", years=(1996, 1997))])
def test_dates_read_their_months_only(spark, stored, how):
    spec = FilterSpec.of(**how)
    df = store.pruned(stored, spec)
    formatted = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert re.search(r"PartitionFilters: \[.*month#", formatted)
    expected = ledger.ledger(spark, SF).where(compile_filters(spec))
    assert df.select("id").exceptAll(expected.select("id")).count() == 0 and df.count() == expected.count() > 0
    months = {r[0] for r in df.select("month").distinct().collect()}
    assert len(df.inputFiles()) >= len(months)


def test_undated_rows_and_other_bases_are_not_lost(spark, stored):
    assert store.months_of(FilterSpec.of(date_basis="notice", years=1996)) is None
    spec = FilterSpec.of(date_basis="notice", years=1996)
    assert store.pruned(stored, spec).count() == ledger.ledger(spark, SF).where(compile_filters(spec)).count()
    assert stored.where("layoff_date IS NULL").count() == stored.where(F.col("month") == store.UNDATED).count() > 0


def test_joins_on_the_key_need_no_exchange(spark, stored):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(store.executed_after(stored))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert "SortMergeJoin" in text and "Exchange" not in text


def test_the_filtered_endpoint_is_one_scan_and_one_exchange(spark, stored):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        one = plan(aggregates.endpoint(stored, catalogue._SLICED))
        joined = plan(catalogue.QUERIES["endpoint_sliced"](spark, SF))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert one.count("FileScan") == 1 and len(re.findall(r"\bExchange ", one)) == 1
    # Small dimensions are broadcast here; each table is read once, nation once a role.
    assert {t: joined.count(f"/{t}.parquet]") for t in ("orders", "customer", "nation")} == {"orders": 1, "customer": 1, "nation": 2}
    assert len(re.findall(r"\bExchange ", joined)) == 1


def test_a_block_leaves_only_its_own_filter_aside(spark):
    row = lambda i, country, industry, source: (i, 10, country, "", industry, "", source, "gold", False, ["closure"], ["engineering"], 0)
    schema = "id long, job_count long, country string, employer_country string, industry string, state string, source_type string, verification_level string, ai_explicit boolean, reason_tags array<string>, role_categories array<string>, superset_of long"
    rows = [row(1, "A", "X", "news"), row(2, "B", "X", "news"), row(3, "A", "Y", "news"), row(4, "B", "Y", "news"), row(5, None, "X", "news")]
    df = spark.createDataFrame(rows, schema).withColumns({"layoff_date": F.lit("2020-01-05").cast("date"), "announcement_date": F.lit(None).cast("date")})
    found = {(r.block, r.label): r.entries for r in aggregates.endpoint(df, FilterSpec.of(country="a", industry="x")).collect()}
    assert found == {
        ("total", "all"): 1, ("country", "A"): 1, ("country", "B"): 1, ("industry", "X"): 1, ("industry", "Y"): 1, ("source_type", "news"): 1, ("tier", "reported"): 1, ("month", "2020-01"): 1, ("reason", "closure"): 1, ("role", "engineering"): 1,
    }


def test_only_short_rows_are_dealt_to_the_tables_files(spark, tmp_path, monkeypatch):
    # The texts made for each row are several times as long as what they are made of: those never pass an exchange.
    monkeypatch.setattr(store, "TASK_ROWS", 100, raising=False)
    sf = shutil.copytree(SF, tmp_path / "dealt")
    stored = store.stored_ledger(spark, str(sf))
    done = spark._jsparkSession.sharedState().statusStore().executionsList()
    texts = [done.apply(i).physicalPlanDescription() for i in range(done.size())]
    written = [t for t in texts if "InsertIntoHadoopFsRelation" in t and f"{sf}/orders.parquet" in t]
    dealt = re.findall(r"\) Exchange\b.*\nInput \[\d+\]: \[(.*)\]\nArguments: (.*)", written[-1])
    assert dealt and all(not re.search(r"\b(excerpt|dedup_hash|source_url|reason_tags|company_key)#", columns) for columns, _ in dealt)
    # Tasks grow with the rows, whatever the number of shuffle partitions: 1500 rows by 100.
    assert any(re.search(r"none\), 15\), REPARTITION_BY_NUM", how) for _, how in dealt)
    names = Counter((f.split("month=")[1].split("/")[0], re.search(r"_(\d{5})\.", f)[1]) for f in stored.inputFiles())
    assert set(names.values()) == {1}
    facts = ledger.ledger(spark, str(sf))
    assert stored.count() == facts.count() == 1500 and facts.exceptAll(stored.select(facts.columns)).count() == 0


def test_a_table_whose_files_were_deleted_is_written_anew(spark, tmp_path):
    sf = str(shutil.copytree(SF, tmp_path / "gone"))
    first = store.stored_ledger(spark, sf)
    shutil.rmtree(first.inputFiles()[0].removeprefix("file:").split("/month=")[0].replace("///", "/"))
    assert store.stored_ledger(spark, sf).count() == ledger.ledger(spark, sf).count() == 1500
