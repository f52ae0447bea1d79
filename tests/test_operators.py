"""Golden rows for the rules of the ledger: filters, deduplication, mutations, kernels, statistics."""

import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ledgerlark.functions import employers, text
from ledgerlark.functions.stats import dark_verdict, vote, wilson
from ledgerlark.operators import aggregates, dedup, evidence, mutations, reconcile, reports, similar
from ledgerlark.operators.components import connected_components
from ledgerlark.operators.filters import FilterSpec, compile_filters
from ledgerlark.plans.catalogue import facts
from ledgerlark.sources import sinks
from ledgerlark.sources.ledger import FACT_SCHEMA

SF = "/root/testdata/sf0.001"
BASE = dict(company="Acme", company_key="acme", ticker="", job_count=100, layoff_date=dt.date(2026, 1, 10), announcement_date=None, industry="", country="US", employer_country="", state="", source_type="news",
            verification_level="silver", source_name="", source_url="", ai_explicit=False, ai_causation="unknown", confidence=1, review_status="pending", announced=False, edited=False, reason_tags=[],
            role_categories=[], excerpt="", event_id=0, superset_of=0, updated_at=None, dedup_hash="")


def ledger(spark, *rows):
    made = [BASE | {"id": i + 1, "event_id": i + 1, "dedup_hash": f"h{i + 1}"} | r for i, r in enumerate(rows)]
    names = [x.strip().split(" ")[0] for x in FACT_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in made], FACT_SCHEMA)


def marks(df):
    return {(r["member"], r["primary"]) for r in df.collect()}


def day(n):
    return dt.date(2026, 1, 1) + dt.timedelta(days=n)


def test_window_pass_takes_notices_within_45_days(spark):
    rows = ledger(spark, dict(job_count=500, layoff_date=day(0)), dict(source_type="warn", job_count=200, layoff_date=day(45)), dict(source_type="warn", job_count=300, layoff_date=day(46)))
    assert marks(dedup.window_marks(rows)) == {(2, 1)}


def test_window_pass_ignores_small_share_and_joins_larger_sum(spark):
    rows = ledger(spark, dict(job_count=500, layoff_date=day(0)), dict(source_type="warn", job_count=700, layoff_date=day(1)), dict(company_key="b", job_count=200), dict(company_key="b", source_type="warn", job_count=900))
    assert marks(dedup.window_marks(rows)) == {(1, 2)}
    with pytest.raises(ValueError):
        dedup.window_marks(rows, days=201)


def test_same_count_pass_spans_150_days(spark):
    assert marks(dedup.same_count_marks(ledger(spark, dict(layoff_date=day(0)), dict(layoff_date=day(150)), dict(layoff_date=day(151))))) == {(2, 1)}
    assert marks(dedup.same_count_marks(ledger(spark, dict(layoff_date=day(3)), dict(layoff_date=day(9), ai_explicit=True)))) == {(1, 2)}


def test_alias_pass_joins_names_of_one_employer(spark):
    rows = ledger(spark, dict(company="Jaguar Land Rover", company_key="jaguar land rover"), dict(company="Jaguar", company_key="jaguar", layoff_date=dt.date(2026, 1, 12)), dict(company="General", company_key="general"))
    assert marks(dedup.alias_marks(rows)) == {(2, 1)}


def test_revision_pass(spark):
    rows = ledger(spark, dict(source_type="warn", company="Acme Inc"), dict(source_type="warn", company="Acme Inc - Revised", layoff_date=day(60)), dict(source_type="warn", company="Acme Inc Updated", layoff_date=day(200)))
    assert marks(dedup.revision_marks(rows)) == {(2, 1)}


def test_declared_marks_win_and_chains_are_released(spark):
    rows = ledger(spark, {}, {}, {}, {})
    found = spark.createDataFrame([(1, 2), (4, 1)], "member long, primary long")
    declared = spark.createDataFrame([(1, 3), (2, 99)], "member long, primary long")
    assert marks(dedup.declared_marks(found, declared, rows)) == {(1, 3), (4, 3)}


def test_filters_raise_on_unknown_names_and_totals_add_up(spark):
    with pytest.raises(ValueError):
        FilterSpec.of(colour="red")
    all_rows = facts(spark, SF)
    for spec in (FilterSpec(), FilterSpec.of(ai_broad=True), FilterSpec.of(stage="verified", years=1997)):
        rows = all_rows.where(compile_filters(spec))
        x = aggregates.totals(rows).first()
        assert x.entries + x.excluded_entries == rows.count()
        assert x.jobs + x.excluded_jobs == (rows.agg(F.sum("job_count")).first()[0] or 0)


def test_free_text_needs_whole_words_for_latin_terms(spark):
    rows = ledger(spark, dict(company="Metal Works"), dict(company="Meta"), dict(company="メタ社"), dict(company="O’Neil"))
    found = lambda q: {r.id for r in rows.where(compile_filters(FilterSpec.of(company=q))).collect()}
    assert (found("meta"), found("メタ"), found("o'neil"), found("zzz")) == ({2}, {3}, {4}, set())


def test_upsert_is_idempotent_and_leaves_edited_rows(spark):
    old = ledger(spark, dict(industry="Retail"), dict(edited=True, job_count=7))
    new = ledger(spark, dict(job_count=5), dict(job_count=9), dict(company="undisclosed"), dict(company="New Co", dedup_hash="h9", id=9))
    once = mutations.upsert(old, new, spark.createDataFrame([("none",)], "dedup_hash string"))
    found = {r.dedup_hash: (r.id, r.job_count, r.industry) for r in once.collect()}
    assert found == {"h1": (1, 5, "Retail"), "h2": (2, 7, ""), "h9": (9, 100, "")}
    again = mutations.upsert(once, new)
    assert sorted(map(str, again.collect())) == sorted(map(str, once.collect()))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 101), (None, 3)], "a long, b long")
    found = {r.node: r.component for r in connected_components(edges).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert connected_components(edges.limit(0)).count() == 0


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_text_kernels(spark):
    assert one(spark, text.first_number(F.col("c")), c="1) On 3/4/2026 about 1,250 jobs") == 1250
    assert one(spark, text.any_date(F.col("c")), c="filed Jan 22, 2026 by mail") == dt.date(2026, 1, 22)
    assert one(spark, text.any_date(F.col("c")), c="on 13/45/2026") is None
    assert one(spark, text.canonical_url(F.col("c")), c="HTTPS://A.example/x/?utm_source=q&b=1#top") == "https://A.example/x/?b=1"
    assert one(spark, text.formula_guard(F.col("c")), c="=1+1") == "'=1+1"
    for words, n, stated in (("cuts 12,000 jobs", 12000, True), ("cuts 12k jobs", 12000, True), ("cuts 120,000 jobs", 12000, False), ("in 2019 it grew", 2019, False), ("2019 jobs go", 2019, True)):
        assert one(spark, text.count_in_text(F.col("n"), F.col("c")), n=n, c=words) is stated, words


def test_employer_names(spark):
    assert one(spark, employers.company_key(F.col("c")), c="The Google, Inc.") == "alphabet"
    assert one(spark, employers.is_anonymous(F.col("c")), c="an online retailer") is True
    assert one(spark, employers.is_anonymous(F.col("c")), c="a large retailer") is False
    assert one(spark, employers.is_anonymous(F.col("c")), c="Retailer Company Inc.") is False
    assert one(spark, employers.legal_name(F.col("c")), c="Société & Fils S.A. GmbH") == "societe and fils"


def test_statistics(spark):
    low, high = wilson(F.lit(99), F.lit(100))
    x = spark.range(1).select(F.round(low, 3).alias("low"), F.round(high, 3).alias("high"), wilson(F.lit(0), F.lit(0))[0].alias("none"), vote(F.lit(2), F.lit(0), F.lit(3)).alias("vote"), dark_verdict(F.lit(200), F.lit(50.0), F.lit(10)).alias("dark")).first()
    assert tuple(x) == (0.946, 0.998, None, "heating", "FAIL")


def test_sinks_round_trip(spark, tmp_path):
    rows = ledger(spark, dict(company="+cmd", reason_tags=["closure", "bankruptcy"], role_categories=["unknown", "engineering"]))
    sinks.write_csv(rows, f"{tmp_path}/csv")
    back = spark.read.option("header", True).csv(f"{tmp_path}/csv").first()
    assert (back.company, back.reasons, back.roles) == ("'+cmd", "closure|bankruptcy", "engineering")
    columns = ["id", "company", "layoff_date"]
    assert sinks.backup(rows, f"{tmp_path}/backup", columns) == 1
    assert sinks.restore(rows, f"{tmp_path}/backup", columns).collect() == rows.select(*columns).collect()
    with pytest.raises(ValueError, match="last backup"):
        sinks.backup(rows, f"{tmp_path}/short", columns, last_rows=100)
    with pytest.raises(ValueError, match="personal"):
        sinks.backup(ledger(spark, dict(company="write to jane.doe@example.org")), f"{tmp_path}/personal", columns)
    runs = spark.createDataFrame([(1, "ok")], "id long, status string")
    sinks.append_runs(runs, f"{tmp_path}/runs")
    sinks.append_runs(runs, f"{tmp_path}/runs")
    assert spark.read.parquet(f"{tmp_path}/runs").count() == 2


def test_snapshots_are_published_once(spark, tmp_path):
    frozen = reports.publish_once(spark.range(3), f"{tmp_path}/1997-Q2")
    with pytest.raises(AnalysisException):
        reports.publish_once(spark.range(9), f"{tmp_path}/1997-Q2")
    assert frozen.count() == 3


def test_alias_pass_spans_two_days_and_needs_one_count(spark):
    names = dict(company="Jaguar Land Rover", company_key="jaguar land rover"), dict(company="JLR", company_key="jlr")
    found = lambda *rows: marks(dedup.alias_marks(ledger(spark, *rows)))
    assert found(names[0] | dict(layoff_date=day(0)), names[1] | dict(layoff_date=day(2))) == {(2, 1)}
    assert found(names[0] | dict(layoff_date=day(0)), names[1] | dict(layoff_date=day(3))) == set()
    assert found(names[0], names[1] | dict(job_count=101)) == set()
    assert found(names[0] | dict(job_count=99), names[1] | dict(job_count=99)) == set()
    assert found(names[0], names[1] | dict(source_type="warn")) == set()


def test_fuzzy_matches_span_thirty_days_and_let_larger_events_be(spark):
    rows = ledger(spark, dict(job_count=100, layoff_date=day(0)), dict(job_count=299, layoff_date=day(30)), dict(job_count=300, layoff_date=day(30)), dict(job_count=10, layoff_date=day(31)))
    found = {r.new_id: (r.matched_id, r.matches) for r in evidence.fuzzy_matches(rows, rows).collect()}
    assert found[2] == (3, 2)
    assert found[3] == (2, 1)


@pytest.mark.parametrize("days, before", [(0, True), (2, True), (45, True), (45, False), (365, False)])
def test_band_joins_equal_the_plain_condition(spark, days, before):
    left = spark.createDataFrame([(i, "k" if i % 3 else "l", day(i * 7 % 211 - 100)) for i in range(60)] + [(99, None, day(0)), (98, "k", None)], "id long, key string, a date")
    right = spark.createDataFrame([(i, "k" if i % 4 else "l", day(i * 11 % 307 - 150)) for i in range(80)] + [(99, None, day(0)), (98, "k", None)], "other long, key string, b date")
    plain = left.join(right, "key").where(F.datediff("b", "a").between(-days if before else 0, days)).select("id", "other")
    found = reconcile.near_days(left, "a", right, "b", ["key"], days, before).select("id", "other")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


def test_reconcile_applies_the_passes_in_order(spark):
    rows = ledger(
        spark, dict(job_count=500, layoff_date=day(0)), dict(job_count=500, layoff_date=day(40)), dict(source_type="warn", job_count=300, layoff_date=day(3)),
        dict(source_type="warn", company="Beta Inc", company_key="beta", job_count=150, layoff_date=day(0)), dict(source_type="warn", company="Beta Inc - Revised", company_key="beta revised", job_count=150, layoff_date=day(20)),
        dict(company="Jaguar Land Rover", company_key="jaguar land rover", job_count=777), dict(company="JLR", company_key="jlr", job_count=777), dict(edited=True, job_count=500, layoff_date=day(0)),
    )
    # The notice goes to the first news row; the second repeats its count; the revision and the alias follow.
    assert marks(dedup.reconcile(rows)) == {(3, 1), (2, 1), (5, 4), (7, 6)}


def test_greedy_clusters_join_what_fits_all_members(spark):
    rows = ledger(
        spark, dict(job_count=100, layoff_date=day(0)), dict(job_count=120, layoff_date=day(100)), dict(job_count=133, layoff_date=day(0)), dict(job_count=150, layoff_date=day(0)),
        dict(job_count=2000, layoff_date=day(0)), dict(job_count=2000, layoff_date=day(1000)), dict(job_count=2050, layoff_date=day(300)), dict(job_count=100, layoff_date=day(0), country="Canada"), dict(company="Acme (The Maker)", job_count=101, layoff_date=day(1)),
    )
    found = {r.id: r.cluster for r in dedup.greedy_clusters(rows).collect()}
    assert found == {1: 1, 9: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8}


def greedy_by_hand(rows):
    """(cluster by id) as one walk over each employer's rows."""
    clusters, named = {}, {}
    for i, key, n, d in sorted(rows, key=lambda r: (r[2], r[3], r[0])):
        for own in clusters.setdefault(key, []):
            if all(m / n >= 0.75 and abs((d - e).days) <= (1095 if m / n >= 0.995 and n >= 100 else 365 if m / n >= 0.95 and n >= 1000 else 120) for m, e in own[1]):
                own[1].append((n, d))
                named[i] = own[0]
                break
        else:
            clusters[key].append((i, [(n, d)]))
            named[i] = i
    return named


def test_greedy_clusters_equal_one_walk_over_each_employer(spark):
    import random

    rng = random.Random(3)
    rows = [dict(company=f"Firm {rng.randrange(4)}", company_key="x", job_count=rng.choice([50, 60, 90, 100, 130, 160, 210, 290, 1000, 1020, 1400]), layoff_date=day(rng.randrange(900))) for _ in range(160)]
    found = {r.id: r.cluster for r in dedup.greedy_clusters(ledger(spark, *rows)).collect()}
    assert found == greedy_by_hand([(i + 1, r["company"], r["job_count"], r["layoff_date"]) for i, r in enumerate(rows)])


def test_greedy_clusters_walk_a_stream_and_gather_no_group(spark):
    """Many rows of one employer, with repeats, in batches of seven: no chain of counts lies in one group, and only open clusters are held."""
    import random

    rng = random.Random(8)
    rows = [dict(company=rng.choice(["One", "One", "One", "Two"]), company_key="x", job_count=rng.choice([80, 99, 100, 101, 398, 400, 402, 950, 970, 1000, 1004, 1049, 1053, rng.randrange(1, 1500)]), layoff_date=day(rng.randrange(1400)), country=rng.choice(["", "", "A", "B"])) for _ in range(700)]
    rows += rng.choices(rows, k=200)
    df = dedup.greedy_clusters(ledger(spark, *rows))
    clusters, expected = {}, {}
    for i, r in sorted(enumerate(rows), key=lambda x: (x[1]["job_count"], x[1]["layoff_date"], x[0])):
        n, d, place = r["job_count"], r["layoff_date"], r["country"]
        fits = lambda m, e, p: m / n >= 0.75 and abs((d - e).days) <= (1095 if m / n >= 0.995 and n >= 100 else 365 if m / n >= 0.95 and n >= 1000 else 120) and not (p and place and p != place)  # noqa: B023, E731
        own = next((c for c in clusters.setdefault(r["company"], []) if all(fits(*m) for m in c[1])), None)
        if own is None:
            clusters[r["company"]].append(own := (i + 1, []))
        own[1].append((n, d, place))
        expected[i + 1] = own[0]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {r.id: r.cluster for r in df.collect()} == expected and len(set(expected.values())) > 50
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()


def test_cross_script_names_meet_on_the_same_day_only(spark):
    names = dict(company="Jaguar", company_key="jaguar"), dict(company="東京電力", company_key="東京電力")
    same = reconcile.cross_alias_groups(ledger(spark, names[0], names[1])).collect()
    later = reconcile.cross_alias_groups(ledger(spark, names[0] | dict(layoff_date=day(0)), names[1] | dict(layoff_date=day(1)))).collect()
    assert ({(r.id, r.component) for r in same}, later) == ({(1, 1), (2, 1)}, [])


def test_agency_months_refuse_incomplete_files(spark):
    with pytest.raises(ValueError, match="count"):
        reports.agency_months(spark.createDataFrame([("199601", "A", "SH")], "yyyymm string, agency string, category string"), "199601")


def test_dateless_neighbours_equal_a_plain_search(spark):
    import datetime as dt
    import random

    rng = random.Random(4)
    rows = [(i, rng.choice([1000, 1003, 1010, 1500, 1501, 1502, 4000, rng.randrange(1000, 1100), 900]), rng.choice(["A", "A", "B", "", "Multiple countries"]), None if rng.random() < 0.3 else dt.date(2024, 1, 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, job_count long, country string, layoff_date date").repartition(5)
    wild, expected = ("", "Multiple countries"), set()
    for i, n, place, day in rows:
        if day is None and n >= 1000:
            fits = [(place != c, -min(n, m) / max(n, m), j) for j, m, c, _ in rows if j != i and m >= 1000 and (place == c or place in wild or c in wild) and min(n, m) / max(n, m) >= 0.98]
            expected |= {(i, j, k + 1) for k, (_, _, j) in enumerate(sorted(fits)[:5])}
    assert {tuple(r) for r in reconcile.dateless_neighbours(df).collect()} == expected and len(expected) > 300


def test_typo_pairs_equal_a_comparison_of_all_names(spark):
    import random
    from difflib import SequenceMatcher

    rng, keys = random.Random(6), set()
    while len(keys) < 260:
        word = "".join(rng.choice("abcde ") for _ in range(rng.randrange(6, 34))).strip()
        keys.add(word)
        for _ in range(2):
            at = rng.randrange(len(word) + 1)
            keys.add(rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice("abcde") + word[at:], word[:at] + "x" + word[at + 1 :], word[:at] + word[at:][::-1]]))
    keys |= {"", "short", "東京電力株式会社", "東京電力株式会杜"}
    df = spark.createDataFrame(list(enumerate(sorted(keys))), "id long, key string")
    latin = [k for k in sorted(keys) if len(k) >= 6 and k.isascii()]
    expected = {(a, b) for i, a in enumerate(latin) for b in latin[i + 1 :] if a.count(" ") == b.count(" ") and SequenceMatcher(None, a, b).ratio() >= 0.9}
    found = {(r.a, r.b) for r in similar.typo_pairs(df).collect()}
    assert found == expected and len(expected) > 150
    candidates = similar.typo_candidates(df).count()
    assert candidates < len(latin) ** 2 / 4


def test_register_keeps_whole_rows_that_share_a_new_key(spark):
    known, incoming = (spark.createDataFrame(rows, "id long, k string") for rows in ([(1, "a"), (2, "a")], [(1, "a"), (3, "b"), (4, "b"), (5, "a"), (6, "c")]))
    assert sorted(tuple(r) for r in mutations.register(known, incoming, "k").collect()) == [(1, "a"), (2, "a"), (3, "b"), (4, "b"), (6, "c")]


def test_typo_candidates_of_random_names_are_few(spark):
    """Names that share nothing but an alphabet: hardly any two are candidates, and no gram that many have is joined on."""
    import random

    rng = random.Random(11)
    keys = ["".join(rng.choice("abcdefghijklmnop") for _ in range(20)) for _ in range(2000)]
    keys += [k[:3] + k[4:] for k in keys[:50]] + [k[:9] + "zz" + k[9:] for k in keys[:50]] + [k[2:] + "yx" for k in keys[50:60]]
    found = similar.typo_candidates(spark.createDataFrame([(k,) for k in keys], "key string"))
    assert found.count() == 50 * 3 + 10
    join = found._jdf.queryExecution().optimizedPlan().toString()
    assert "digest" in join and "gram" not in join


def test_reconcile_derives_its_rows_once(spark, monkeypatch):
    """All passes read rows written once, without those that none of them takes."""
    written, own = [], dedup.cut
    monkeypatch.setattr(dedup, "cut", lambda df: written.append(own(df)) or written[-1])
    rows = ledger(spark, dict(), dict(layoff_date=day(20)), dict(edited=True), dict(layoff_date=None), dict(job_count=0))
    assert marks(dedup.reconcile(rows)) == {(2, 1)}
    assert sorted(r.id for r in written[0].select("id").collect()) == [1, 2] and "excerpt" not in written[0].columns
