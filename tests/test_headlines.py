"""Golden headlines, releases and lines."""

import pytest
from pyspark.sql import functions as F

from tidewire import rules
from tidewire.functions import release as R
from tidewire.functions import squawk as S
from tidewire.functions import text as T
from tidewire.operators import follow, score

EXAMPLES = [
    ("n4", "investing.com", -9, "Week ahead: what to watch in markets", None),
    ("n3", "seekingalpha", -8, "3 reasons Tyson Foods could be poised to benefit from new rules", ["TSN"]),
    ("n2", "yahoo", -7, "Stock Market Midday, Aug. 28: Stocks edge higher on Fed's clear inflation message", None),
    ("5", "reuters", -6, "OPEC+ announces surprise production cut of 1 million barrels per day", ["CL"]),
    ("n1", "fool.com blog", -5, "Will Nvidia stock soar after Aug. 26? Here's what history shows", ["NVDA"]),
    ("3", "bloomberg", -4, "Ukrainian strikes halt shipments from Russian Black Sea grain ports; wheat exports at decade low", ["ZW"]),
    ("2", "reuters", -3, "Nvidia (NVDA) guides Q3 revenue to $108 billion but sees gross margin falling to 71-72%", ["NVDA"]),
    ("4", "truthsocial", -2, "Trump authorizes legal documents to let farmers and ranchers process their own food", ["TSN"]),
    ("1", "reuters", -1, "Fed Chair Warsh says central bank still has work to do on inflation; 2-year yield jumps 11 basis points", ["ZT", "SPY"]),
    ("n5", "cnbc", -1, "Fed Chair Warsh says the central bank still has work to do on inflation", ["SPY"]),
]
PLAIN = {"n4": (0, 0), "n3": (3, 1), "n2": (0, 0), "5": (58, 3), "n1": (0, 0), "3": (58, 3), "2": (39.08, 2), "4": (43.7, 2), "1": (56.2, 3), "n5": (42.5, 2)}
WATCHED = {"n3": (15, 1), "2": (51.08, 3), "4": (55.7, 3), "1": (68.2, 4), "n5": (54.5, 3), "5": (58, 3)}


@pytest.fixture(scope="module")
def items(spark):
    rows = [(k, i, s, 60.0 * at, h, tags) for k, (i, s, at, h, tags) in enumerate(EXAMPLES)]
    return spark.createDataFrame(rows, "seq long, id string, source string, ts double, headline string, symbols array<string>").withColumns({"body": F.lit(""), "url": F.lit("")})


def test_scores(items):
    got = {r.id: (round(r.score, 6), r.priority) for r in score.score_news(items).collect()}
    assert got == PLAIN
    cfg = rules.NewsConfig(watchlist=("NVDA", "TSN", "SPY"))
    got = {r.id: (round(r.score, 6), r.priority) for r in score.score_news(items, cfg).collect()}
    assert {k: got[k] for k in WATCHED} == WATCHED


def test_reasons(items):
    got = {r.id: r.reason for r in score.score_news(items).collect()}
    assert got["n4"] == "no market-relevant category matched"
    assert got["n3"] == "cat=policy_regulatory; src x0.50; noise:could,3 reasons"
    assert got["5"].startswith("cat=geopolitics_supply; src x1.00; surprise:surprise")


def test_stale(items):
    out = score.score_news(items, rules.NewsConfig(), F.lit(1800.0 - 60.0)).collect()
    assert {r.id for r in out if r.reason.startswith("stale")} == {"5", "3", "2", "4", "1", "n3", "n5"}


def test_follow(spark, items):
    cfg = rules.FollowConfig(news=rules.NewsConfig(watchlist=("NVDA", "TSN", "SPY")))
    ticks = spark.createDataFrame([], "symbol string, seq long, ts double, price double, volume double")
    alerts, dropped = follow.follow(spark, items, ticks, cfg)
    assert sorted(r.item.id for r in alerts.collect()) == ["1", "2", "3", "4", "5"]
    assert {r.headline[:20]: r.reason[:12] for r in dropped.collect()}["Fed Chair Warsh says"] == "duplicate of"
    lines, histogram = follow.replay(spark, items, watchlist=("NVDA", "TSN", "SPY"))
    assert lines.count() == 5
    assert histogram.first().reason == "no market-relevant category matched"


def value(spark, c, *args):
    return spark.range(1).select(c(*[F.lit(a) for a in args]).alias("x")).first().x


@pytest.mark.parametrize(("text", "region"), [("Ukrainian strikes on Russian ports", "UA"), ("prices fell versus prior month", ""), ("They told us so", "US"), ("German output", "DE")])
def test_region(spark, text, region):
    assert value(spark, S.region, text) == region


def line(spark, headline, symbols=(), width=S.WIDTH):
    df = spark.createDataFrame([(headline, "reuters", list(symbols))], "headline string, source string, symbols array<string>")
    return S.with_tape_line(df, width=width).first()


def test_lines(spark):
    r = line(spark, "Fed Chair Warsh says central bank still has work to do on inflation")
    assert (r.body, r.region) == ("FED'S WARSH: CENTRAL BANK STILL HAS WORK TO DO ON INFLATION", "US")
    r = line(spark, "ECB's Lagarde: we are not pre-committing")
    assert (r.org, r.speaker) == ("ECB", "LAGARDE")
    assert line(spark, "Federal Reserve Board announces a new payments system").org == ""
    assert line(spark, "US CPI rose 0.4 percent").body == "CPI ROSE 0.4%"
    assert line(spark, "Guidance cut", ["ABC", "DEF"]).body == "ABC/DEF: GUIDANCE CUT"
    long = line(spark, "word " * 60, width=40).body
    assert long.endswith("...") and len(long) <= 43
    assert value(spark, S.strip_cruft, "BREAKING: OPEC cuts output - Reuters") == "OPEC cuts output"
    assert value(spark, S.compress, "raises $108 billion, up 11 basis points versus expectations") == "raises USD 108BLN, up 11 BPS VS. EXP."
    assert value(spark, lambda a: S.render(a, F.lit("US"), F.lit(4), F.lit(3661.0)), "BODY") == "01:01:01 *(US) BODY"
    assert value(spark, lambda a: S.spoken(a, F.lit("")), "RATES UP 11 BPS") == "Rates up 11 basis points"


def release(spark, headline):
    df = spark.createDataFrame([(headline,)], "h string").withColumn("i", R.indicator(F.col("h"))).withColumn("r", R.parse(F.col("h"), F.col("i")))
    return df.select("i", "r.*", R.body(F.col("r")).alias("body"), R.priority(F.col("r.indicator"), F.col("r.actual"), F.col("r.expected")).alias("p"), R.surprise_sigma(F.col("r.indicator"), F.col("r.actual"), F.col("r.expected")).alias("sigma")).first()


def test_releases(spark):
    r = release(spark, "US CPI rose 0.4% m/m vs expectations of 0.2%, prior 0.3%")
    assert (r.actual, r.expected, r.prior, r.period) == (0.4, 0.2, 0.3, "M/M")
    assert r.body == "CPI M/M 0.4% VS. EXP. 0.2% (PREV. 0.3%)" and r.p == rules.CRITICAL and round(r.sigma, 6) == 2
    r = release(spark, "nonfarm Payrolls came in at 142 vs 165 expected")
    assert (r.actual, r.expected) == (142, 165)
    assert release(spark, "CPI report due Thursday").body is None or release(spark, "CPI report due Thursday").actual is None
    assert release(spark, "US core cpi rose 0.3%").i == "core cpi"
    assert release(spark, "gdp at 1,250").actual == 1.25


def test_numbers(spark):
    for x, places, want in ((0.25, 1, "0.2"), (100.5, 0, "100"), (1.005, 2, "1.00"), (1234567.891, 2, "1234567.89")):
        assert value(spark, lambda v, p=places: T.fixed(v, p), x) == want


def test_phrases(spark):
    hits = lambda t: value(spark, lambda x: T.phrase_hits(x, ("cpi", "rate cut", "opec+", "opec", "basis point", "basis points")), t)
    assert hits("recipient écpi") == [] and hits("rate cuts and cpis") == ["cpi", "rate cut"]
    assert hits("opec+ basis points") == ["opec+", "opec", "basis point", "basis points"]


def test_dates_and_markup(spark):
    at = value(spark, T.parse_date, "Sat, 29 Aug 2026 10:30:00 GMT")
    assert at == value(spark, T.parse_date, "2026-08-29T10:30:00Z") == value(spark, T.parse_date, "29 Aug 2026 06:30:00 -0400")
    assert value(spark, T.parse_date, "2026-08-29T10:30:00-04:00") == at  # offsets of ISO dates are left aside
    assert value(spark, T.parse_date, "garbage") is None
    assert value(spark, T.clean_markup, " <b>A</b>&eacute; &amp;lt;\n x ") == "Aé &lt; x" or value(spark, T.clean_markup, " <b>A</b>&eacute; &amp;lt;\n x ") == "A é &lt; x"
