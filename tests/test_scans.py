"""Scans of small files: headers in any words, files without one, wide and long tables, broken records."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerlark.operators import reports
from ledgerlark.sources import scans


def written(path, text):
    path.write_text(text)
    return str(path)


def test_notice_csv_finds_its_columns(spark, tmp_path):
    path = written(tmp_path / "ct.csv", 'affected_company,Affected Workers,Address,Notice Date,Effective Date\nAcme,"1,250",99 Main St,True,"Jan 22, 2026"\nBeta,,1 Elm,2026-02-01,\n,7,x,2026-02-01,\n')
    assert [tuple(r) for r in scans.notice_csv(spark, path, "CT").collect()] == [("CT", "Acme", 1250, dt.date(2026, 1, 22))]


def test_notice_csv_without_a_header(spark, tmp_path):
    path = written(tmp_path / "md.csv", "1/5/2026,541,Acme LLC,1 Main St,Howard,40,3/6/2026,Closure\n1/6/2026,541,Beta,2 Elm,Howard,none,,Layoff\n")
    assert [tuple(r) for r in scans.notice_csv(spark, path, "MD").collect()] == [("MD", "Acme LLC", 40, dt.date(2026, 3, 6))]


def test_revised_counts_win(spark):
    rows = spark.createDataFrame([("Acme", "215", "2,027", "99"), ("Beta", "30", "0", "99"), ("Gamma", "", "", "5")], ["Location Name", "Expected Layoff", "Revised Layoff", "Total Employees"])
    assert {(r.company, r.job_count) for r in scans.notices(rows, "IL").collect()} == {("Acme", 2027), ("Beta", 30), ("Gamma", 5)}


def test_sdmx_csv_keeps_monthly_adjusted_rates(spark, tmp_path):
    head = "REF_AREA,MEASURE,FREQ,ADJUSTMENT,SEX,AGE,TIME_PERIOD,OBS_VALUE\n"
    path = written(tmp_path / "u.csv", head + "FRA,UNE_LF_M,M,Y,_T,Y_GE15,2026-01,7.456\nFRA,UNE_LF_M,Q,Y,_T,Y_GE15,2026-Q1,7\nFRA,UNE_LF_M,M,Y,_T,Y_GE15,2026-13,7\nFRA,UNE_LF_M,M,Y,_T,Y_GE15,2026-02,\nFRA,OTHER,M,Y,_T,Y_GE15,2026-01,1\n")
    assert [tuple(r) for r in scans.sdmx_csv(spark, path).collect()] == [("FRA", "_T", "Y_GE15", "2026-01", 7.46)]


def test_wide_months_become_long(spark, tmp_path):
    head = "sa,naics_sector,series,geo,year,jan,feb,mar,apr,may,jun,jul,aug,sep,oct,nov,dec\n"
    path = written(tmp_path / "b.csv", head + 'A,TOTAL,BA_BA,US,2025,"1,000",2,.,4,5,6,7,8,9,10,11,12\nU,TOTAL,BA_BA,US,2025,1,1,1,1,1,1,1,1,1,1,1,1\nA,TOTAL,XX,US,2025,1,1,1,1,1,1,1,1,1,1,1,1\nA,TOTAL,BA_BA,US,n.a.,1,1,1,1,1,1,1,1,1,1,1,1\n')
    found = scans.wide_months(spark, path, ("BA_BA",), "2025-11").collect()
    assert {tuple(r) for r in found} == {("US", "BA_BA", "2025-11", 11.0), ("US", "BA_BA", "2025-12", 12.0)}
    assert scans.wide_months(spark, path, ("BA_BA",), "2025-01").count() == 11


def test_observations_and_dots(spark, tmp_path):
    path = written(tmp_path / "f.csv", "series,date,value\nICSA,2026-01-03,210000\nICSA,2026-01-10,.\nICSA,soon,1\n")
    assert [tuple(r) for r in scans.observations(spark, path).collect()] == [("ICSA", dt.date(2026, 1, 3), 210000.0)]


def test_filings_index_keeps_the_latest_version(spark, tmp_path):
    path = written(tmp_path / "c.csv", "company;category;subject;received;protocol;version;link\nAcme;Fato;Demissão em massa;2026-01-03;p1;1;l1\nAcme;Fato;Demissão em massa (rev);2026-01-05;p1;2;l2\nAcme;Fato;Dividendos;2026-01-05;p2;1;l3\n")
    assert [tuple(r) for r in scans.filings_index(spark, path, "(?i)demiss").collect()] == [("p1", "Acme", "Demissão em massa (rev)", dt.date(2026, 1, 5), 2, "l2")]


def test_separations_are_read_and_summed(spark, tmp_path):
    rows = [("202601", "SH", " dept of x", "7"), ("202601", "SH", "DEPT OF X", "*"), ("202601", "SA", "dept of x", "99"), ("2026", "SH", "dept of x", "5"), ("202512", "SH", "dept of x", "50"), ("202601", "SH", "small", "4")]
    wide = spark.createDataFrame(rows, ["personnel_action_effective_date_yyyymm", "separation_category_code", "agency", "count"])
    wide.selectExpr("*", "'unused' AS other").write.parquet(f"{tmp_path}/s")
    found = reports.agency_months(scans.separations(spark, f"{tmp_path}/s"), "202601").collect()
    assert [tuple(r) for r in found] == [("202601", "Dept Of X", 8)]


# Small samples with every odd case: what the queries over written texts don't hold.

def texts(spark, *values):
    return spark.createDataFrame(list(values), "source string, value string")


JSON_STAT = '{"id": ["unit", "geo", "time"], "size": [1, 3, 2], "dimension": {"unit": {"category": {"index": {"PC": 0}}}, "geo": {"category": {"index": {"DE": 0, "FR": 1, "IT": 2}}}, "time": {"category": {"index": {"2025-01": 0, "2025-02": 1}}}}, "value": {"0": 3.1, "1": 3.2, "3": 7.4, "4": 6.0, "9x": 1.0}}'
FEED = "<rss><channel><item><title><![CDATA[Acme & Co cuts]]></title><link>https://a/1</link><pubDate>Tue, 06 Jan 2026 10:00:00 GMT</pubDate></item><item><title>R&D closes</title><link>https://a/2</link></item></channel></rss>trailing junk"
ATOM = '<feed><entry><title>Beta &amp; sons</title><link href="https://b/1"/><updated>2026-02-03T04:05:06Z</updated></entry><entry><title>again</title><link href="https://a/1"/><updated>2026-03-01T00:00:00Z</updated></entry></feed>'
ARTICLES = '{"articles": [{"source": {"name": "Wire"}, "title": "Acme layoffs", "description": "many", "url": "https://w/1", "publishedAt": "2026-01-01T00:00:00Z"}, {"source": {"name": "Wire"}, "title": "Sports", "url": "https://w/2"}]}'
QWI = '[["Emp", "Sep", "time", "state"], ["10", "3.0", "2025-Q1", "01"], [null, null, "2025-Q2", "01"], ["7", null, "2025-Q1", "02"]]'
BLS = '{"status": "REQUEST_SUCCEEDED", "Results": {"series": [{"seriesID": "JTS1", "data": [{"year": "2025", "period": "M02", "value": "1,234", "footnotes": [{"code": "P"}]}, {"year": "2025", "period": "M13", "value": "9"}, {"year": "2025", "period": "M01", "value": "-"}]}]}}'
GKG = "\t".join(["1", "20260102030405", "1", "example.org", "https://e/1", "", "", "LAYOFFS;ECON_JOBS;", *[""] * 18, "<PAGE_TITLE>Acme cuts</PAGE_TITLE>"])


def test_samples(spark):
    at = dt.datetime
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(scans.json_stat(texts(spark, ("a", JSON_STAT), ("b", "{}"), ("c", "no json")))) == [("DE", "2025-01", 3.1), ("DE", "2025-02", 3.2), ("FR", "2025-02", 7.4), ("IT", "2025-01", 6.0)]
    assert rows(scans.feed_items(texts(spark, ("x", FEED), ("y", ATOM), ("z", "no feed")))) == [("https://a/1", "x", "Acme & Co cuts", at(2026, 1, 6, 10)), ("https://a/2", "x", "R&D closes", None), ("https://b/1", "y", "Beta & sons", at(2026, 2, 3, 4, 5, 6))]
    assert rows(scans.api_candidates(texts(spark, ("a", ARTICLES), ("b", "[]")), r"(?i)\blayoffs?\b")) == [("Wire", "Acme layoffs", "many", "https://w/1", at(2026, 1, 1))]
    assert rows(scans.array_table(texts(spark, ("a", QWI), ("b", "[]"), ("c", "?")), ("time", "state"), ("Emp", "Sep"))) == [("2025-Q1", "01", 10, 3), ("2025-Q1", "02", 7, None)]
    assert rows(scans.series_points(texts(spark, ("a", BLS), ("b", '{"status": "REQUEST_FAILED"}')))) == [("JTS1", "2025-02", 1234.0, "P")]
    assert rows(scans.knowledge_graph(texts(spark, ("a", GKG), ("b", "short\tline")))) == [(at(2026, 1, 2, 3, 4, 5), "https://e/1", "Acme cuts", ["LAYOFFS", "ECON_JOBS"])]


def test_a_folder_of_unlike_tables(spark, tmp_path):
    """Each file by its own header, as if it were read alone; empty files, headers alone and broken rows give nothing."""
    files = {
        "CT-a.csv": 'affected_company,Affected Workers,Address,Notice Date,Effective Date\nAcme,"1,250",99 Main St,2026-01-05,"Jan 22, 2026"\nBeta,none,x,,\n,7,x,,\n',
        "CT-b.csv": 'Employer,Jobs,Zip,Received\n"Gamma, ""G""\nWorks",12,99999,2026-02-03\nDelta,0,1,2026-02-03\n',
        "MD-c.csv": "2026-03-01,1234,Epsilon,9 Elm,Kent,40,2026-04-01,Closure\n",
        "NJ-d.csv": "Company,Number Affected\n",
        "NJ-e.csv": "",
        "NJ-f.csv": "what,ever\n1,2\n",
        "NJ-g.csv": "Company,Workforce Affected,Layoff Date\nZeta,3\nEta,4,2026-05-06,more,and more\n",
    }
    for name, text in files.items():
        written(tmp_path / name, text)
    day = dt.date
    found = sorted(tuple(r) for r in scans.notice_folder(spark, [str(tmp_path)]).collect())
    assert found == sorted([("CT", "Acme", 1250, day(2026, 1, 22)), ("CT", 'Gamma, "G"\nWorks', 12, day(2026, 2, 3)), ("MD", "Epsilon", 40, day(2026, 4, 1)), ("NJ", "Zeta", 3, None), ("NJ", "Eta", 4, day(2026, 5, 6))])


def test_a_folder_broadcasts_what_its_columns_are_and_never_its_rows(spark, tmp_path):
    """The estimate of an array of cells is that of one text, so that a folder of 100 MB seemed small enough to broadcast."""
    written(tmp_path / "CA-a.csv", "Company,Employees Affected\n" + "Acme,5\n" * 1000)
    query = scans.notice_folder(spark, [str(tmp_path)])._jdf.queryExecution()
    assert "rightHint=(strategy=broadcast)" in query.optimizedPlan().toString()
    join = next(line for line in query.executedPlan().toString().splitlines() if "BroadcastHashJoin" in line)
    assert "BuildRight" in join


def test_places_are_those_of_the_named_columns(spark):
    headers = [["Company", "Job Site", "title"], ["# of Workers", "Employee Address", "Total Affected", "jobs"], ["DATE", "Effective date", "notice", " Received "], [], [None, "x", "employer"]]
    df = spark.createDataFrame([(h,) for h in headers], "h array<string>")
    for groups, never in ((scans.COMPANY_WORDS, ""), (scans.COUNT_WORDS, scans.NO_COUNT), (scans.DATE_WORDS, "")):
        found = [r[0] for r in df.select(scans.places_like(F.col("h"), groups, never)).collect()]
        assert found == [[h.index(n) for n in scans.columns_like([x or "" for x in h], groups, never)] for h in [[x or "" for x in h] for h in headers]]
