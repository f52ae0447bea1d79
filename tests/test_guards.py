"""Verdicts of the ingest guards, one text per branch."""

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import guards

NEGATED = {
    "The outage isn't in any way linked to 500 cuts at Acme": False, "The outage was not in fact linked to 500 job cuts": True, "It was not in any way linked to 500 cuts": False, "It is never really tied to the 500 posts": True, "This had nothing to do with the 500 posts": True,
    "Its 500 exits are unrelated to trade": True, "Acme denied reports\nof 500 layoffs.": True, "Acme debunked talk of 500 exits": True, "Acme rejected the rumours about 500 posts": True, "Acme rules out 500 exits": True,
    "No plans for 500 layoffs": True, "There are no mass layoffs among the 500": True, "At Acme, 500 layoffs are not expected": True, "Acme is not considering any layoffs for its 500 staff": True, "Baseless claims of 500 exits": True,
    "Acme cut 500 jobs. No layoffs are planned next year.": False, "Acme cut 500 jobs!": False, "Acme denied 1,500 layoffs": False, "Acme denied 5000 layoffs": False, "Acme denied 500,000 exits": False, "": False, None: False,
}
OFFERS = {
    "Acme offers voluntary exit to 500 employees": True, "Acme extended early retirement to 500 people": True, "A buyout was put to 500 people": True, "Acme mulls a buyout for 500": True, "Buyout packages to 500 employees": True,
    "Some 500 staff are eligible": True, "500 empleados son elegibles": True, "500 Mitarbeiter sind berechtigt": True, "Acme ofreció bajas voluntarias a 500": True, "500 in the voluntary redundancy scheme were offered": False,
    "Acme offered voluntary redundancy scheme terms to 500": True, "500 accepted the buyouts offered": False, "500 took the buyout offered": False, "Acme offers buyouts; 500 will leave": False, "500 jobs go": False, "Acme offers buyouts to 500 and lays off 500": False, None: False,
}
DISCIPLINED = {
    "500 officers dismissed for misconduct": True, "500 officers penalised": True, "500 went in a cleansing drive": True, "500 absent without official leave": True, "500 sanctioned for grave offences": True, "500 failed drug tests": True,
    "500 dismissed for misconduct amid cost savings": False, "500 laid off for misconduct": False, "500 gone over corruption and the budget": True, "500 gone over the budget, corrupt": False, "500 gone": False, None: False,
}
VERDICTS = {
    "Acme cuts 500 jobs": ("event", None), "recorta 500 empleos desde 2024": ("retrospective", None), "Seit 2024 hat Acme 500 Stellen gestrichen": ("retrospective", None), "Its only major cut since 2020: 500 jobs.": ("event", None),
    "Its biggest round of cuts since 2020: 500 jobs.": ("event", None), "La mayor desde 2020: 500 empleos": ("event", None), "Die größte Welle seit 2020: 500 Stellen": ("event", None), "Acme shed 500 since last spring": ("retrospective", None),
    "Acme shed 500 since then": ("retrospective", None), "It has let go 500 people since spring": ("retrospective", None), "After rounds of layoffs 500 are gone": ("retrospective", None), "The 500 are the latest in a wave": ("retrospective", None),
    "Back in 2011 Acme shed 500": ("retrospective", None), "En lo que va del año, 500 salidas": ("retrospective", None), "Bislang fielen 500 Stellen weg": ("retrospective", None), "In den letzten zwei Jahren gingen 500": ("retrospective", None),
    "Desde hace dos años, 500 salidas": ("retrospective", None), "Seit Anfang des Jahres gingen 500": ("retrospective", None), "This took the tally of cut posts to some 500": ("retrospective", None), "In total, about 500 went": ("retrospective", None),
    "Insgesamt rund 500 Stellen": ("retrospective", None), "En total unos 500 puestos": ("retrospective", None), "The toll steigt auf mehr als 500 Stellen": ("retrospective", None), "Its workforce has shrunk by about 500": ("retrospective", None),
    "A net of 500 left": ("retrospective", None), "It cut 30 more jobs, bringing the total to 500.": ("incremental", 30), "Acme streicht 40 weitere Stellen, insgesamt 500": ("incremental", 40), "Acme recorta 60 puestos, un total de 500": ("incremental", 60),
    "Another 500 jobs since 2025": ("event", None), "500 weitere Stellen seit 2025": ("event", None), "Acme cut 500 on Monday after several rounds of cuts": ("event", None), "Acme recorta 500 hoy, acumulado": ("event", None),
    "Acme sheds 500 effective June 3 this year to date": ("event", None), "Acme kündigte am Montag 500 an, bisher": ("event", None), "Cut 500 since 2025. Then it cut 500 at once.": ("event", None), "So far this year 500 went, 2024 among them": ("retrospective", None),
    "So far this year 500 went, 12 workers today": ("incremental", 12), "It has cut 12k": ("event", None), "Over the past two\nyears it cut 500 roles": ("retrospective", None), "": ("event", None), None: ("event", None),
}


@pytest.fixture(scope="module")
def judged(spark):
    texts = list(dict.fromkeys([*NEGATED, *OFFERS, *DISCIPLINED, *VERDICTS]))
    df = spark.createDataFrame([(t, 500) for t in texts], "text string, n long")
    n, text = F.col("n"), F.col("text")
    return {r.text: r for r in df.select("text", guards.held_by_negation(n, text).alias("held"), guards.only_an_offer(n, text).alias("offer"), guards.disciplinary(n, text).alias("discipline"), guards.retrospective(n, text).alias("verdict")).collect()}


@pytest.mark.parametrize(("table", "column"), [(NEGATED, "held"), (OFFERS, "offer"), (DISCIPLINED, "discipline")])
def test_guards(judged, table, column):
    assert {t: judged[t][column] for t in table} == table


def test_verdicts(judged):
    assert {t: tuple(judged[t].verdict) for t in VERDICTS} == VERDICTS


SPANNED = {
    "会社は人員削減を行う": [("人員削減", "人員削減")], "人 員\n削　減と早期退職": [("人 員\n削　減", "人員削減"), ("早期退職", "早期退職")], "ﾘｽﾄﾗの発表": [("ﾘｽﾄﾗ", "リストラ")], "정리 해고": [("정리 해고", "정리해고")],
    "\u1100\u1161\u11b7\u110b\u116f\u11ab 발표": [("\u1100\u1161\u11b7\u110b\u116f\u11ab", "감원")], "대감원": [], "감 원": [], "감원, 감원": [("감원", "감원"), ("감원", "감원")], "절감 원가": [], "plain text": [], "": [], None: [],
    "x" * 5000 + "구조조정": [("구조조정", "구조조정")],
}


def test_every_span_cuts_out_its_word(spark):
    import unicodedata

    from ledgerlark.functions import spans

    df = spark.createDataFrame([(t,) for t in SPANNED], "text string")
    found = {r.text: r.s for r in df.select("text", spans.reduction_spans(F.col("text")).alias("s")).collect()}
    for text, expected in SPANNED.items():
        assert [(text[s.start : s.end], s.word) for s in found[text]] == expected
        for s in found[text]:
            assert "".join(unicodedata.normalize("NFKC", text[s.start : s.end]).split()) == s.word and (s.language, s.tier) == spans.VOCABULARY[s.word]


def test_guards_search_a_text_once_for_each_pattern(spark):
    """Searches over arrays are shared by no optimiser: each place of the count is found by three of them, however often it is read."""
    df = spark.range(1).selectExpr("id AS n", "string(id) AS t")
    plan = lambda c: df.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    n, t = F.col("n"), F.col("t")
    assert plan(guards.retrospective(n, t)["verdict"]).count("regexp_extract_all(") <= 12
    assert max(plan(guard(n, t)).count("regexp_extract_all(") for guard in (guards.only_an_offer, guards.disciplinary)) == 3
