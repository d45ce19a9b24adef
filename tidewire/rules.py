"""Rule tables and thresholds. They are data: pass other tables to the builders to change what is scored and how."""

from __future__ import annotations

from dataclasses import dataclass, field

DROP, LOW, NORMAL, IMPORTANT, CRITICAL = range(5)
PRIORITY_NAMES = ("DROP", "LOW", "NORMAL", "IMPORTANT", "CRITICAL")

# Trust weight by a substring of the source's name; the longest that occurs wins.
SOURCE_TIERS = {
    "reuters": 1.00, "bloomberg": 1.00, "dowjones": 1.00, "ap": 1.00, "federalreserve.gov": 1.00, "bls.gov": 1.00,
    "sec.gov": 1.00, "treasury.gov": 1.00, "opec.org": 1.00, "company-ir": 1.00, "ecb": 1.00, "boe": 1.00,
    "census.gov": 1.00, "eia.gov": 1.00, "nasdaqtrader": 1.00, "truthsocial": 0.95,
    "cnbc": 0.85, "wsj": 0.90, "ft": 0.90, "barrons": 0.80, "axios": 0.80, "politico": 0.80, "nytimes": 0.70,
    "bbc": 0.70, "guardian": 0.65,
    "yahoo": 0.60, "marketwatch": 0.65, "investing.com": 0.55, "zacks": 0.55, "seekingalpha": 0.50,
    "zerohedge": 0.40, "reddit": 0.25, "x.com": 0.30, "twitter": 0.30, "blog": 0.25,
}
DEFAULT_SOURCE_WEIGHT = 0.45

# Category, weight, phrases.
CATEGORIES = (
    ("systemic_credit", 50, (
        "bank run", "bailout", "insolvent", "insolvency", "receivership", "circuit breaker", "trading halted",
        "halts trading", "suspends redemptions", "sovereign default", "defaults on", "files for bankruptcy",
        "chapter 11", "counterparty", "margin call", "liquidity crisis", "credit event")),
    ("central_bank", 48, (
        "rate hike", "rate cut", "raise rates", "cut rates", "hike rates", "interest rate decision", "fomc",
        "jackson hole", "fed chair", "federal reserve", "ecb", "bank of japan", "boj", "pboc", "central bank",
        "quantitative tightening", "quantitative easing", "emergency meeting", "basis point", "basis points",
        "hawkish", "dovish", "policy statement", "dot plot", "yield curve control")),
    ("macro_data", 44, (
        "cpi", "core cpi", "ppi", "pce", "inflation report", "nonfarm payrolls", "non-farm payrolls", "jobs report",
        "unemployment rate", "gdp", "retail sales", "jobless claims", "ism", "pmi", "consumer confidence")),
    ("geopolitics_supply", 42, (
        "airstrike", "missile strike", "invasion", "blockade", "embargo", "export ban", "sanctions",
        "strait of hormuz", "opec+", "opec", "production cut", "output cut", "supply disruption", "pipeline attack",
        "port closed", "shipments halted", "halt shipments", "halts shipments", "halt exports", "halts exports",
        "grain corridor", "grain ports", "black sea", "drone strike", "drone attack", "attack on", "attacks on",
        "export terminal", "refinery fire", "seizes", "closes airspace", "declares war", "ceasefire", "nuclear")),
    ("policy_regulatory", 34, (
        "executive order", "tariff", "tariffs", "antitrust", "breaks up", "doj sues", "ftc sues", "sec charges",
        "indicted", "export controls", "price cap", "nationalize", "windfall tax", "ban on", "authorizes",
        "authorizing", "monopoly", "new rules", "rule change", "import quota", "export quota", "subsidy",
        "deregulation")),
    ("earnings_guidance", 32, (
        "cuts guidance", "raises guidance", "guides below", "guides above", "profit warning", "misses estimates",
        "beats estimates", "tops estimates", "withdraws guidance", "revenue forecast", "gross margin", "earnings",
        "guides", "sees revenue", "sees full-year", "cuts outlook", "raises outlook", "quarterly results",
        "preliminary results")),
    ("mna", 26, (
        "to acquire", "acquisition of", "merger with", "takeover bid", "buyout offer", "all-cash offer", "stake in",
        "spin off", "spinoff", "deal collapses", "walks away from")),
    ("company_event", 20, (
        "ceo resigns", "cfo resigns", "steps down", "recall", "data breach", "fda approval", "fda rejects",
        "clinical trial", "strike action", "layoffs", "plant fire", "outage", "cyberattack", "short seller report")),
)

# Phrases that raise, lower or end a headline's score.
SURPRISE = (
    "unexpected", "unexpectedly", "surprise", "shock", "emergency", "worse than expected", "better than expected",
    "well above", "well below", "record", "highest since", "lowest since", "first time since", "decade low",
    "decade high", "multi-year low", "multi-year high", "breaking", "just in", "confirms", "announces", "signs",
    "authorizes", "orders", "declares", "halts", "suspends", "abruptly",
)
NOISE = (
    "what to expect", "what to watch", "preview", "history shows", "here's what", "here is what", "could", "may be",
    "might", "analysts say", "analyst says", "strategist says", "opinion", "op-ed", "explainer", "how to",
    "best stocks", "stocks to buy", "3 reasons", "5 reasons", "why you should", "outlook for", "poised to",
    "set to benefit", "in focus", "things to know", "recap", "wrap", "closing bell", "midday", "premarket movers",
    "takeaways", "explainer:", "analysis:", "opinion:", "comment:", "week ahead", "look ahead", "reportedly", "rumor",
    "speculation", "denies report", "according to sources",
)
ADMIN = (
    "announces approval", "approval of the application", "approval of application", "enforcement action",
    "announces termination", "terminates enforcement", "task force", "leadership and objectives", "appoints",
    "reappoints", "names as", "elects", "board of directors", "annual report", "requests comment", "seeks comment",
    "call for papers", "working paper", "conference", "symposium", "agenda", "advisory council",
    "statistical release schedule", "technical note", "revised schedule",
)
BOILERPLATE = (
    "media advisory", "speaking engagement", "speech schedule", "latest numbers", "key takeaways", "takeaways from",
    "here are", "what we learned", "in charts", "in pictures", "live updates", "podcast", "newsletter", "watch live",
    "your questions answered", "quiz", "obituary", "review of the week", "best of", "how to watch",
)
SURPRISE_BONUS, NOISE_PENALTY, ADMIN_PENALTY = 12, 14, 30

# Words that shingles leave out.
STOP_WORDS = (
    "a", "an", "the", "of", "to", "in", "on", "for", "at", "by", "and", "or", "as", "is", "are", "was", "were", "be",
    "been", "it", "its", "with", "from", "that", "this", "after", "over", "amid", "says", "said", "new",
)

# Regions by institution, by keyword (region, keyword, whole word) and by source.
REGION_BY_ORG = {
    "FED": "US", "TREASURY": "US", "WHITE HOUSE": "US", "SEC": "US", "BLS": "US", "CENSUS": "US", "EIA": "US",
    "USDA": "US", "FDA": "US", "ECB": "EU", "EU COMMISSION": "EU", "BOE": "UK", "BOJ": "JP", "PBOC": "CN",
    "SNB": "CH", "RBA": "AU", "BOC": "CA", "CBRT": "TR", "OPEC": "OPEC", "IMF": "IMF", "NATO": "NATO",
}
REGION_KEYWORDS = (
    ("OPEC", "opec", True), ("IMF", "imf", True), ("NATO", "nato", True), ("US", "united states", True),
    ("US", "u.s.", False), ("US", "us", True), ("US", "washington", True), ("US", "white house", True),
    ("US", "congress", True), ("US", "trump", True), ("US", "fed", True), ("EU", "euro zone", True),
    ("EU", "eurozone", True), ("EU", "european union", True), ("EU", "brussels", True), ("EU", "ecb", True),
    ("DE", "german", False), ("FR", "france", True), ("FR", "french", True), ("IT", "italy", True),
    ("ES", "spain", True), ("UK", "britain", True), ("UK", "british", True), ("UK", "london", True),
    ("UK", "uk", True), ("UK", "gilt", False), ("CN", "china", True), ("CN", "chinese", True),
    ("CN", "beijing", True), ("JP", "japan", False), ("JP", "tokyo", True), ("RU", "russia", False),
    ("RU", "moscow", True), ("RU", "kremlin", True), ("UA", "ukrain", False), ("UA", "kyiv", True),
    ("IN", "india", True), ("BR", "brazil", True), ("IL", "israel", False), ("IR", "iran", False),
    ("SA", "saudi", False), ("TR", "turkey", True), ("CA", "canada", True), ("AU", "australia", True),
    ("MX", "mexico", True), ("KR", "korea", False),
)
REGION_BY_SOURCE = {
    "federalreserve.gov": "US", "bls.gov": "US", "census.gov": "US", "sec.gov": "US", "eia.gov": "US",
    "nasdaqtrader": "US", "treasury.gov": "US", "ecb": "EU", "boe": "UK", "bbc": "UK", "guardian": "UK",
}

# Institutions by pattern, and the words around a speaker.
ORG_ALIASES = (
    (r"federal reserve|fed(?:eral)?\b", "FED"), (r"european central bank|ecb", "ECB"), (r"bank of england|boe", "BOE"),
    (r"bank of japan|boj", "BOJ"), (r"people's bank of china|pboc", "PBOC"), (r"swiss national bank|snb", "SNB"),
    (r"reserve bank of australia|rba", "RBA"), (r"bank of canada|boc", "BOC"), (r"white house", "WHITE HOUSE"),
    (r"treasury", "TREASURY"), (r"opec\+?", "OPEC"), (r"\bimf\b|international monetary fund", "IMF"),
    (r"\bnato\b", "NATO"), (r"\becb\b", "ECB"),
)
TITLES = (
    r"chair(?:man|woman|person)?|president|governor|deputy governor|vice chair|chief(?: economist)?|secretary|official|"
    r"policymaker|member|minister|spokesman|spokeswoman|spokesperson|ceo|cfo"
)
TELL_VERBS = r"tells?|told"
SAY_VERBS = (
    r"says?|said|adds|added|warns?|warned|notes?|noted|comments?|commented|reiterates?|reiterated|states?|stated|"
    r"argues?|argued|signals?|signalled|signaled|expresses|expressed|voices?|voiced|flags?|flagged|urges?|urged|"
    r"advocates?|advocated|stresses|stressed|insists?|insisted|repeats?|repeated|denies|denied"
)
NOT_A_NAME = r"board|bank|committee|council|group|staff|office|system|branch|inc|corp|holdings|department|ministry"

# What shortens a headline, in order.
COMPRESSIONS = (
    (r"\bbasis points?\b|\bbps\b", "BPS"), (r"\bpercentage points?\b", "PPTS"), (r"\bpercent\b", "%"),
    (r"\btrillions?\b|\btn\b", "TRLN"), (r"\bbillions?\b|\bbn\b", "BLN"), (r"\bmillions?\b|\bmn\b", "MLN"),
    (r"\bthousands?\b", "K"), (r"\bbarrels per day\b|\bbarrels/day\b", "BPD"),
    (r"\byear[- ]on[- ]year\b|\byear[- ]over[- ]year\b", "Y/Y"),
    (r"\bmonth[- ]on[- ]month\b|\bmonth[- ]over[- ]month\b", "M/M"), (r"\bquarter[- ]on[- ]quarter\b", "Q/Q"),
    (r"\bversus\b|\bcompared (?:to|with)\b", "VS."),
    (r"\bexpectations?\b|\bexpected\b|\bestimates?\b|\bforecasts?\b", "EXP."), (r"\bprevious(?:ly)?\b|\bprior\b", "PREV."),
    (r"\bfourth quarter\b", "Q4"), (r"\bthird quarter\b", "Q3"), (r"\bsecond quarter\b", "Q2"),
    (r"\bfirst quarter\b", "Q1"), (r"\bfull[- ]year\b", "FY"), (r"\bgross domestic product\b", "GDP"),
    (r"\bconsumer price index\b", "CPI"), (r"\bproducer price index\b", "PPI"), (r"\bnon[- ]?farm payrolls?\b", "NFP"),
    (r"\bfederal open market committee\b", "FOMC"), (r"\binterest rates?\b", "RATES"), (r"\bunited states\b", "US"),
    (r"\bunited kingdom\b", "UK"),
)
MONEY_UNITS = (("trillion", "TRLN"), ("tn", "TRLN"), ("billion", "BLN"), ("bn", "BLN"), ("million", "MLN"), ("mn", "MLN"))
TRAILER = (
    r"\s*[-|–—]\s*(reuters|cnbc|bloomberg|marketwatch|yahoo finance|the guardian|bbc(?: news)?|financial times|ft\.com|"
    r"barron's|axios|investing\.com|the new york times)\s*$"
)
LEADER = r"^(breaking|just in|update \d*|exclusive|live|watch|urgent)\s*[:\-–]\s*"
SPOKEN = (
    ("BPS", "basis points"), ("BLN", " billion"), ("MLN", " million"), ("TRLN", " trillion"), ("EXP.", "expected"),
    ("PREV.", "previous"), ("VS.", "versus"), ("Y/Y", "year on year"), ("M/M", "month on month"),
    ("Q/Q", "quarter on quarter"), ("BPD", "barrels per day"),
)

# Indicators with their usual surprise and market weight, and the patterns of a release.
INDICATORS = {
    "cpi": (0.10, 1.00), "core cpi": (0.10, 1.00), "pce": (0.10, 0.95), "core pce": (0.10, 1.00), "ppi": (0.20, 0.70),
    "nfp": (60.0, 1.00), "nonfarm payrolls": (60.0, 1.00), "unemployment rate": (0.10, 0.85),
    "average hourly earnings": (0.10, 0.75), "gdp": (0.40, 0.85), "retail sales": (0.40, 0.75),
    "jobless claims": (15.0, 0.55), "ism manufacturing": (1.50, 0.70), "ism services": (1.50, 0.75),
    "pmi": (1.50, 0.60), "consumer confidence": (3.00, 0.50), "durable goods": (1.50, 0.50),
    "housing starts": (60.0, 0.40), "trade balance": (5.00, 0.35), "crude inventories": (2.00, 0.60),
    "industrial production": (0.30, 0.45),
}
DEFAULT_INDICATOR = (1.0, 0.45)
NUMBER = r"[-+]?\d+(?:[.,]\d+)?"
ACTUAL = rf"(?:rose|fell|rises|falls|came in at|printed at|at|was|of)\s+({NUMBER})\s*(%|k|m|bln|mln)?"
EXPECTED = rf"(?:vs\.?|versus|against)?\s*(?:exp\.?|expected|expectations? of|forecasts? of|consensus(?: of)?|estimates? of)\s*({NUMBER})"
EXPECTED_AFTER = rf"({NUMBER})\s*%?\s*(?:expected|forecast|consensus|estimate)"
PRIOR = rf"(?:prev\.?|previous(?:ly)?|prior|last month|last reading)\s*(?:of|was|:)?\s*({NUMBER})"
PERIOD = r"\b(m/m|y/y|q/q|mom|yoy|qoq)\b"


@dataclass(frozen=True)
class NewsConfig:
    important: float = 50.0
    critical: float = 68.0
    emit: float = 38.0
    max_age_s: float = 1800.0
    similarity: float = 0.62
    containment: float = 0.80
    ttl_s: float = 2700.0
    watchlist: tuple[str, ...] = ()
    watchlist_bonus: float = 12.0


@dataclass(frozen=True)
class MoveConfig:
    windows_s: tuple[float, ...] = (60.0, 300.0)
    min_z: float = 4.0
    min_abs_ret: float = 0.005
    hard_ret: float = 0.02
    min_volume_ratio: float = 1.8
    require_volume: bool = True
    cooldown_s: float = 120.0
    warmup: int = 30
    history_s: float = 3600.0
    alpha: float = 0.06
    zeros: bool = False  # whether a price of 0 is measured, as IEEE 754 has it


@dataclass(frozen=True)
class FollowConfig:
    news: NewsConfig = field(default_factory=NewsConfig)
    move: MoveConfig = field(default_factory=MoveConfig)
    correlate_s: float = 300.0
    ring: int = 16
    min_priority: int = IMPORTANT
