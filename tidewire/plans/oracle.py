"""The queries in SQL, from the same rule tables. Boundaries are written without look-behind, for ASCII texts."""

from __future__ import annotations

import re

from .. import rules
from . import inputs as I
from .queries import WATCHLIST

q = I.quote


def _esc(s: str) -> str:
    return "".join(f"\\{c}" if not (c.isalnum() or c in " '") else c for c in s)


def _has(p: str, t: str = "t") -> str:
    return f"(contains({t}, {q(p)}) AND regexp_matches({t}, {q(f'(^|[^0-9A-Za-z_]){_esc(p)}s?($|[^0-9A-Za-z_])')}))"


def _hits(phrases, t: str = "t") -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_has(p, t)} THEN {q(p)} END" for p in phrases) + "], lambda x: x IS NOT NULL)"


def _case(pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def _weight(source: str) -> str:
    keys = sorted(rules.SOURCE_TIERS, key=len, reverse=True)
    return _case([(f"contains(lower({source}), {q(k)})", str(rules.SOURCE_TIERS[k])) for k in keys], str(rules.DEFAULT_SOURCE_WEIGHT))


def _max(text: str, pattern: str, keep: str = "true") -> str:
    return f"list_max(list_filter(list_transform(regexp_extract_all({text}, {q(pattern)}, 1), lambda x: CAST(x AS DOUBLE)), lambda x: {keep}))"


_MONEY = r"\$\s?(\d+(?:\.\d+)?)\s?(billion|bn|trillion|tn|million|mn)"
_MAGNITUDE = f"""
m AS (
  SELECT *, greatest(least(15.0, coalesce(pct, 0) * 2.0), least(15.0, coalesce(bps, 0) / 5.0), CASE WHEN usd >= 1e9 THEN least(12.0, 4.0 + usd / 1e11) ELSE 0 END) AS bonus,
         greatest(coalesce(pct, 0), coalesce(bps / 100.0, 0)) AS largest
  FROM (SELECT *, {_max("t", r"(\d+(?:\.\d+)?)\s?(?:%|percent|pct)", f"x < 40.0")} AS pct, {_max("t", r"(\d+(?:\.\d+)?)\s?(?:bps|basis points?)")} AS bps,
    list_max(list_transform(range(1, len(regexp_extract_all(t, {q(_MONEY)}, 1)) + 1), lambda i: CAST(regexp_extract_all(t, {q(_MONEY)}, 1)[i] AS DOUBLE) *
      CASE regexp_extract_all(t, {q(_MONEY)}, 2)[i] WHEN 'million' THEN 1e6 WHEN 'mn' THEN 1e6 WHEN 'billion' THEN 1e9 WHEN 'bn' THEN 1e9 ELSE 1e12 END)) AS usd FROM u)
)"""

_SYMBOLS = r"list_distinct(regexp_extract_all(headline, '\(([A-Z]{1,5})\)', 1))"


def _score(cfg: rules.NewsConfig | None = None, now: str = "ts") -> str:
    """CTEs up to `s`: every headline with its score, priority, categories, magnitude, reason."""
    cfg = cfg or rules.NewsConfig()
    cats = ", ".join(f"len({_hits(p)}) AS n_{n}" for n, _, p in rules.CATEGORIES)
    base = "greatest(" + ", ".join(f"CASE WHEN n_{n} > 0 THEN {w} + least(6.0, 2.0 * (n_{n} - 1)) ELSE 0 END" for n, w, _ in rules.CATEGORIES) + ")"
    names = "list_filter([" + ", ".join(f"CASE WHEN n_{n} > 0 THEN {q(n)} END" for n, _, _ in rules.CATEGORIES) + "], lambda x: x IS NOT NULL)"
    watch = f"CASE WHEN list_has_any({_SYMBOLS}, {I._LIST(cfg.watchlist)}) THEN least(100.0, fresh + {cfg.watchlist_bonus}) ELSE fresh END" if cfg.watchlist else "fresh"
    return f"""
WITH {I.HEADLINES_SQL},
u AS (SELECT DISTINCT headline, lower(headline) AS t FROM h),
{_MAGNITUDE},
p AS (SELECT *, {_hits(rules.BOILERPLATE)} AS boiler, {cats}, {_hits(rules.SURPRISE)} AS surprise, {_hits(rules.NOISE)} AS noise, {_hits(rules.ADMIN)} AS admin FROM m),
b AS (SELECT *, {names} AS cats, {base} AS base FROM p),
w AS (SELECT seq, source, ts, b.*, {_weight("source")} AS weight, greatest(0.0, {now} - ts) AS age FROM h JOIN b USING (headline)),
f AS (
  SELECT *, CASE WHEN len(boiler) > 0 THEN 'boilerplate' WHEN len(cats) = 0 THEN 'none' WHEN age >= {cfg.max_age_s} THEN 'stale' ELSE 'scored' END AS state,
    least(100.0, greatest(0.0, (base + CASE WHEN len(surprise) > 0 THEN {rules.SURPRISE_BONUS} ELSE 0 END + bonus - {rules.NOISE_PENALTY} * least(2, len(noise))
      - CASE WHEN len(admin) > 0 THEN {rules.ADMIN_PENALTY} ELSE 0 END + 6.0 * (len(cats) - 1)) * weight * (1.0 - age / {cfg.max_age_s} * 0.5))) AS fresh
  FROM w
),
g AS (SELECT *, CASE WHEN state = 'scored' THEN {watch} ELSE 0.0 END AS score FROM f),
s AS (
  SELECT *, CAST(CASE WHEN state <> 'scored' THEN 0 WHEN score >= {cfg.critical} THEN 4 WHEN score >= {cfg.important} THEN 3 WHEN score >= {cfg.emit} THEN 2 ELSE 1 END AS INTEGER) AS priority,
    CASE state WHEN 'boilerplate' THEN 'boilerplate: ' || boiler[1] WHEN 'none' THEN 'no market-relevant category matched' WHEN 'stale' THEN 'stale (' || printf('%.0f', age / 60) || 'm old)'
      ELSE concat_ws('; ', 'cat=' || array_to_string(cats, '+'), 'src x' || printf('%.2f', weight), CASE WHEN len(surprise) > 0 THEN 'surprise:' || surprise[1] END,
        CASE WHEN bonus <> 0 THEN 'magnitude+' || printf('%.0f', bonus) END, CASE WHEN len(noise) > 0 THEN 'noise:' || array_to_string(noise[1:2], ',') END,
        CASE WHEN len(admin) > 0 THEN 'admin:' || admin[1] END, CASE WHEN age > 60 THEN 'age ' || printf('%.0f', age / 60) || 'm' END) END AS reason
  FROM g
)
"""


_NAMES = I._LIST(rules.PRIORITY_NAMES)


def _region(t: str, source: str, default: str) -> str:
    found = []
    for order, (name, word, whole) in enumerate(rules.REGION_KEYWORDS):
        tail = "(?:$|[^0-9A-Za-z_])" if whole else ""
        p = f"(?s)^(.*?(?:^|[^0-9A-Za-z_])){_esc(word)}{tail}"
        found.append(f"CASE WHEN contains({t}, {q(word)}) AND regexp_matches({t}, {q(p)}) THEN {{'at': length(regexp_extract({t}, {q(p)}, 1)), 'ord': {order}, 'r': {q(name)}}} END")
    hint = _case([(f"contains(lower({source}), {q(k)})", q(v)) for k, v in rules.REGION_BY_SOURCE.items()], default) if source else default
    return f"coalesce(list_min(list_filter([{', '.join(found)}], lambda x: x IS NOT NULL)).r, {hint})"


_ORG = "|".join(f"(?:{p})" for p, _ in rules.ORG_ALIASES)
# RE2 has no look-ahead: what isn't a name is sorted out after the match.
_SPEAKER = (
    rf"(?i)^(?:(?-i:[A-Z][\w.'-]+)\s+){{0,2}}({_ORG})(?:'s)?\s+(?:(?:{rules.TITLES})\s+)*((?-i:[A-Z][\w.'-]+(?:\s+[A-Z][\w.'-]+)?))\s*"
    rf"(?:(?:{rules.TELL_VERBS})\s+(?-i:[A-Z][\w.&'-]+)\s+(?:that\s+)?|(?:{rules.SAY_VERBS})\s+(?:that\s+)?|:\s*)(.+)$"
)


def _org(x: str) -> str:
    pairs = [(f"regexp_full_match({x}, {q(p)}) OR regexp_full_match({x}, {q('(?:' + p + ")'s")})", q(n)) for p, n in rules.ORG_ALIASES]
    return _case([*pairs, *((f"regexp_matches({x}, {q(p)})", q(n)) for p, n in rules.ORG_ALIASES)], "''")


def _speaker(t: str, name: str) -> str:
    """CTE `name` of (k, org, speaker, rest) from a CTE of distinct texts t(k)."""
    return f"""
{name}0 AS (SELECT k, regexp_extract(k, {q(_SPEAKER)}, 1) AS o, trim(regexp_extract(k, {q(_SPEAKER)}, 2)) AS who, trim(regexp_extract(k, {q(_SPEAKER)}, 3)) AS said FROM {t}),
{name}1 AS (SELECT *, {_org("lower(trim(o))")} AS org0 FROM {name}0),
{name}2 AS (SELECT *, o <> '' AND org0 <> '' AND len(regexp_split_to_array(said, '\\s+')) >= 3 AND NOT regexp_matches(lower(who), {q(f'^(?:{rules.NOT_A_NAME})([^0-9a-z_]|$)')}) AS good FROM {name}1),
{name} AS (SELECT k, CASE WHEN good THEN org0 ELSE '' END AS org, CASE WHEN good THEN upper(who) ELSE '' END AS speaker, CASE WHEN good THEN said ELSE k END AS rest FROM {name}2)"""


def _strip(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, {q(rules.TRAILER)}, '', 'i'), {q(rules.LEADER)}, '', 'i'))"


def _compress(x: str) -> str:
    amount = r"\$\s?(\d[\d,.]*)\s*"
    for unit, short in rules.MONEY_UNITS:
        x = f"regexp_replace({x}, {q(amount + unit)}, {q(f'USD {chr(92)}1{short}')}, 'gi')"
    x = f"regexp_replace({x}, {q(amount)}, {q('USD ' + chr(92) + '1')}, 'gi')"
    for p, short in rules.COMPRESSIONS:
        x = f"regexp_replace({x}, {q(p)}, {q(short)}, 'gi')"
    x = f"regexp_replace({x}, '\\s+', ' ', 'g')"
    return f"trim(regexp_replace({x}, '(\\d)\\s+%', '\\1%', 'g'))"


_TAPE = f"""
WITH {I.HEADLINES_SQL},
v AS (SELECT DISTINCT headline, source, {_SYMBOLS} AS syms0 FROM h),
w AS (SELECT headline, source, list_filter(regexp_extract_all(headline, '\\(([A-Z]{{1,5}})\\)', 1), lambda x: true) AS syms, {_strip("headline")} AS clean FROM v),
k0 AS (SELECT DISTINCT clean AS k FROM w),
{_speaker("k0", "sp")},
x AS (SELECT w.*, org, speaker, upper({_compress("rest")}) AS plain,
        coalesce(CASE WHEN org = '' THEN NULL ELSE {_case([(f"org = {q(k)}", q(v)) for k, v in rules.REGION_BY_ORG.items()], "NULL")} END, {_region("lower(clean)", "source", "''")}) AS region
      FROM w JOIN sp ON w.clean = sp.k),
y AS (SELECT *, CASE WHEN org <> '' THEN org || '''S ' || speaker || ': ' || plain
        WHEN region <> '' AND starts_with(plain, region) AND (length(plain) = length(region) OR regexp_matches(substr(plain, length(region) + 1, 1), '[\\s,:-]'))
          THEN regexp_replace(substr(plain, length(region) + 1), '^[\\s,:-]*', '') ELSE plain END AS b0 FROM x),
z AS (SELECT *, CASE WHEN len(syms) > 0 AND org = '' AND NOT starts_with(b0, array_to_string(syms[1:3], '/')) THEN array_to_string(syms[1:3], '/') || ': ' || b0 ELSE b0 END AS b1 FROM y),
line AS (SELECT headline, source, region, org, speaker, CASE WHEN length(b1) > 108 THEN regexp_replace(b1[1:108], ' [^ ]*$', '') || '...' ELSE b1 END AS body FROM z)
"""


def _spoken(x: str) -> str:
    for a, b in rules.SPOKEN:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


_BY_LENGTH = sorted(rules.INDICATORS, key=len, reverse=True)
_INDICATOR = _case([(f"contains(t, {q(n)}) AND regexp_matches(t, {q(f'(^|[^0-9a-z_]){n}($|[^0-9a-z_])')})", q(n)) for n in _BY_LENGTH], "''")


def _num(p: str) -> str:
    return f"TRY_CAST(replace(nullif(regexp_extract(headline, {q(p)}, 1, 'i'), ''), ',', '.') AS DOUBLE)"


def _shown(v: str) -> str:
    t = f"CASE WHEN abs({v}) < 100 THEN printf('%.1f', {v}) ELSE printf('%.0f', {v}) END"
    return f"(CASE WHEN contains({t}, '.') THEN regexp_replace({t}, '\\.?0+$', '') ELSE {t} END || unit)"


_PERIOD = f"replace(replace(replace(upper(regexp_extract(headline, {q(rules.PERIOD)}, 1, 'i')), 'MOM', 'M/M'), 'YOY', 'Y/Y'), 'QOQ', 'Q/Q')"
_RELEASE = f"""
WITH {I.HEADLINES_SQL},
u AS (SELECT DISTINCT headline, lower(headline) AS t FROM h),
i AS (SELECT *, {_INDICATOR} AS indicator FROM u),
r AS (SELECT headline, indicator, {_PERIOD} AS period, {_num(rules.ACTUAL)} AS actual,
        CASE WHEN regexp_matches(headline, {q(rules.EXPECTED)}, 'i') THEN {_num(rules.EXPECTED)} ELSE {_num(rules.EXPECTED_AFTER)} END AS expected,
        {_num(rules.PRIOR)} AS prior, coalesce(upper(nullif(regexp_extract(headline, {q(rules.ACTUAL)}, 2, 'i'), '')), '%') AS unit
      FROM i WHERE indicator <> ''),
k AS (SELECT seq, r.* FROM h JOIN r USING (headline) WHERE actual IS NOT NULL)
"""
_SIGMA = _case([(f"indicator = {q(k)}", str(v[0])) for k, v in rules.INDICATORS.items()], "1.0")
_MARKET = _case([(f"indicator = {q(k)}", str(v[1])) for k, v in rules.INDICATORS.items()], "0.45")

_STOP = I._LIST(rules.STOP_WORDS)
_STORIES = f"""
w AS (SELECT doc_id AS seq, doc_id * 60.0 AS ts, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9$%.]+'), lambda x: NOT list_contains({_STOP}, x) AND length(x) > 1) AS w FROM documents),
d AS (SELECT seq, ts, CASE WHEN len(w) < 2 THEN list_distinct(w) ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w)
"""
_PAIRS = """e AS (SELECT seq, ts, len(s) AS n, unnest(s) AS g FROM d),
p AS (SELECT a.seq, b.seq AS earlier, a.n AS n1, b.n AS n2, count(*) AS inter FROM e a JOIN e b ON a.g = b.g AND b.seq < a.seq AND a.ts - b.ts <= 2700 GROUP BY ALL),
x AS (SELECT *, inter / (n1 + n2 - inter) AS j, inter / least(n1, n2) AS c FROM p)"""

_M = I.MOVES
_ANCHORS = "\n".join(
    f"""  last_value(price) OVER (PARTITION BY symbol ORDER BY us RANGE BETWEEN {int(_M.history_s * 1e6)} PRECEDING AND {int(w * 1e6)} PRECEDING) AS anchor_{w:g},
  coalesce(sum(volume) OVER (PARTITION BY symbol ORDER BY us RANGE BETWEEN {int(w * 1e6) - 1} PRECEDING AND CURRENT ROW), 0) AS volume_{w:g},"""
    for w in _M.windows_s
)
_TICKS = f"""
{I.TICKS_SQL},
a AS (SELECT *,
{_ANCHORS}
  row_number() OVER o AS rn, ts - lag(ts) OVER o AS dt, ln(price / lag(price) OVER o) AS lr
  FROM t WINDOW o AS (PARTITION BY symbol ORDER BY us, seq))"""


def _step(extra: str = "", carry: str = "") -> str:
    """The clipped average of one tick on the state r before it."""
    cap = "4.0 * sqrt(greatest(r.var, 1e-18) * a.dt)"
    lr = f"CASE WHEN r.n = 0 THEN a.lr ELSE greatest(-{cap}, least({cap}, a.lr)) END"
    vol = "CASE WHEN r.n > 0 AND r.vol > 0 THEN least(a.volume, 4.0 * r.vol * a.dt) ELSE a.volume END"
    return f"""CASE WHEN r.n = 0 THEN (a.lr * a.lr) / a.dt ELSE r.var + {_M.alpha} * (({lr}) * ({lr}) / a.dt - r.var) END AS var,
    CASE WHEN r.n = 0 THEN a.volume / a.dt ELSE r.vol + {_M.alpha} * (({vol}) / a.dt - r.vol) END AS vol, r.n + 1 AS n"""


_EWMA = f"""
WITH RECURSIVE {_TICKS},
r AS (
  SELECT symbol, seq, rn, 0.0::DOUBLE AS var, 0.0::DOUBLE AS vol, 0::BIGINT AS n FROM a WHERE rn = 1
  UNION ALL
  SELECT a.symbol, a.seq, a.rn, {_step()} FROM r JOIN a ON a.symbol = r.symbol AND a.rn = r.rn + 1
)
"""


def _window(k: int, w: float) -> str:
    ret, z = f"((price - anchor_{w:g}) / anchor_{w:g})", f"(abs(ln(price / anchor_{w:g})) / (sigma * sqrt({w})))"
    ratio = f"(CASE WHEN vol0 * {w} > 0 THEN volume_{w:g} / (vol0 * {w}) ELSE 0 END)"
    return f"""coalesce(n >= {_M.warmup} AND anchor_{w:g} IS NOT NULL AND abs({ret}) >= {_M.min_abs_ret} AND (abs({ret}) >= {_M.hard_ret} OR ({z} >= {_M.min_z} AND {ratio} >= {_M.min_volume_ratio}))
      AND ts - (CASE WHEN {ret} > 0 THEN up ELSE down END) >= greatest({_M.cooldown_s}, {w}), false) AS ok{k}, {ret} AS ret{k}, {z} AS z{k}, {ratio} AS ratio{k}"""


_MOVES = f"""
WITH RECURSIVE {_TICKS},
r AS (
  SELECT symbol, seq, rn, ts, price, 0.0::DOUBLE AS var, 0.0::DOUBLE AS vol, 0::BIGINT AS n, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, 0 AS last,
         0 AS fired, 0.0::DOUBLE AS ret, 0.0::DOUBLE AS z, 0.0::DOUBLE AS volume_ratio, 0.0::DOUBLE AS price_from, false AS reversal FROM a WHERE rn = 1
  UNION ALL
  SELECT symbol, seq, rn, ts, price, var, vol, n, CASE WHEN fired > 0 AND ret > 0 THEN ts ELSE up END, CASE WHEN fired > 0 AND ret <= 0 THEN ts ELSE down END,
         CASE WHEN fired = 0 THEN last WHEN ret > 0 THEN 1 ELSE -1 END, fired, ret, z, volume_ratio, price_from, fired > 0 AND last <> 0 AND last <> CASE WHEN ret > 0 THEN 1 ELSE -1 END
  FROM (
    SELECT *, CASE fired WHEN 1 THEN ret1 WHEN 2 THEN ret2 ELSE 0 END AS ret, CASE fired WHEN 1 THEN z1 WHEN 2 THEN z2 ELSE 0 END AS z,
           CASE fired WHEN 1 THEN ratio1 WHEN 2 THEN ratio2 ELSE 0 END AS volume_ratio, CASE fired WHEN 1 THEN anchor_21600 WHEN 2 THEN anchor_86400 ELSE 0 END AS price_from
    FROM (
      SELECT *, CASE WHEN ok1 AND NOT (ok2 AND abs(ret2) > abs(ret1)) THEN 1 WHEN ok2 THEN 2 ELSE 0 END AS fired
      FROM (
        SELECT *, {_window(1, _M.windows_s[0])}, {_window(2, _M.windows_s[1])}
        FROM (SELECT a.symbol, a.seq, a.rn, a.ts, a.price, a.anchor_21600, a.anchor_86400, a.volume_21600, a.volume_86400, sqrt(greatest(r.var, 1e-18)) AS sigma, r.vol AS vol0, r.up, r.down, r.last, {_step()}
              FROM r JOIN a ON a.symbol = r.symbol AND a.rn = r.rn + 1)
      )
    )
  )
),
mv AS (SELECT symbol, seq, ts, CASE fired WHEN 1 THEN {_M.windows_s[0]} ELSE {_M.windows_s[1]} END::DOUBLE AS window_s, ret, z, volume_ratio, price_from, price AS price_to, reversal FROM r WHERE fired > 0)
"""
_MOVE_ROWS = "SELECT symbol, seq, window_s, round(ret, 6) AS ret, round(z, 6) AS z, round(volume_ratio, 6) AS volume_ratio, price_from, price_to, reversal FROM mv"
_NEWS = "nw AS (SELECT seq, ts, symbol FROM t), ns AS (SELECT DISTINCT seq, ts, unnest([symbol, 'purchase']) AS symbol, unnest([0, 1]) AS pos FROM nw)"


def oracle_sql() -> dict[str, str]:
    sql = {
        "score_headlines": _score() + "SELECT seq, round(score, 6) AS score, priority, CASE WHEN state IN ('scored', 'stale') THEN array_to_string(cats, '+') ELSE '' END AS categories, round(CASE WHEN state IN ('scored', 'stale') THEN largest ELSE 0 END, 6) AS magnitude, reason FROM s",
        "priority_histogram": _score() + f"SELECT {_NAMES}[priority + 1] AS priority, count(*) AS n, round(sum(round(score, 6)), 6) AS total FROM s GROUP BY 1",
        "category_explode": _score() + "SELECT category, count(*) AS n, max(priority) AS top FROM (SELECT unnest(cats) AS category, priority FROM s WHERE state IN ('scored', 'stale')) GROUP BY category",
        "source_weight_lookup": f"WITH {I.HEADLINES_SQL} SELECT source, count(*) AS n, {_weight('source')}::DOUBLE AS weight FROM h GROUP BY source",
        "magnitude_bonus": f"WITH {I.HEADLINES_SQL}, u AS (SELECT DISTINCT headline, lower(headline) AS t FROM h), {_MAGNITUDE} SELECT seq, round(bonus, 6)::DOUBLE AS bonus, round(largest, 6)::DOUBLE AS largest FROM h JOIN m USING (headline)",
        "symbol_extract": f"WITH {I.HEADLINES_SQL} SELECT seq, array_to_string(list_concat(CASE WHEN seq % 3 = 0 THEN ['ACME'] ELSE [] END, list_filter(regexp_extract_all(headline, '\\(([A-Z]{{1,5}})\\)', 1), lambda x: NOT (seq % 3 = 0 AND x = 'ACME'))), ',') AS symbols FROM h",
        "watchlist_boost": _score(rules.NewsConfig(watchlist=WATCHLIST)) + f"SELECT seq, round(score, 6) AS score, priority FROM s WHERE len({_SYMBOLS}) > 0",
        "staleness_decay": _score(rules.NewsConfig(max_age_s=50_000_000.0), str(I.NOW)) + "SELECT seq, round(score, 6) AS score, priority, starts_with(reason, 'stale') AS stale FROM s",
        "region_detect": f"WITH {I.HEADLINES_SQL}, v AS (SELECT DISTINCT headline, source FROM h), w AS (SELECT *, {_region('lower(headline)', 'source', q('XX'))} AS region FROM v) SELECT seq, region FROM h JOIN w USING (headline, source)",
        "speaker_split": f"WITH {I.HEADLINES_SQL}, k0 AS (SELECT DISTINCT headline AS k FROM h), {_speaker('k0', 'sp')} SELECT seq, org, speaker, rest FROM h JOIN sp ON h.headline = sp.k",
        "strip_cruft": f"WITH {I.HEADLINES_SQL} SELECT seq, {_strip('headline')} AS clean FROM h",
        "compress_text": f"WITH {I.HEADLINES_SQL}, u AS (SELECT DISTINCT headline FROM h), w AS (SELECT headline, {_compress('headline')} AS short FROM u) SELECT seq, short FROM h JOIN w USING (headline)",
        "tape_lines": _TAPE + "SELECT seq, body, region, org, speaker FROM h JOIN line USING (headline, source)",
        "rendered_lines": _TAPE + f"""SELECT seq, strftime(make_timestamp(CAST((ts + seq % 86400) * 1000000 AS BIGINT)), '%H:%M:%S') || ' ' || CASE WHEN seq % 5 >= 4 THEN '*' ELSE '-' END || CASE WHEN region <> '' THEN '(' || region || ') ' ELSE '' END || body AS line,
  replace(CASE WHEN region <> '' THEN region || '. ' ELSE '' END || upper(sp[1:1]) || lower(sp[2:]), '  ', ' ') AS spoken FROM (SELECT *, {_spoken('body')} AS sp FROM h JOIN line USING (headline, source))""",
        "log_lines": _TAPE + f"SELECT strftime(make_timestamp(CAST(ts * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') AS iso, {_NAMES}[1 + seq % 5] AS priority, region, org, speaker, body, array_to_string(regexp_extract_all(headline, '\\(([A-Z]{{1,5}})\\)', 1), ',') AS symbols, source, '' AS url, 'news_critical' AS note FROM h JOIN line USING (headline, source)",
        "find_indicator": f"WITH {I.HEADLINES_SQL}, u AS (SELECT DISTINCT headline, lower(headline) AS t FROM h), i AS (SELECT headline, {_INDICATOR} AS indicator FROM u) SELECT seq, indicator FROM h JOIN i USING (headline)",
        "release_parse": _RELEASE + "SELECT seq, indicator, period, actual, expected, prior, unit FROM k",
        "release_priority": _RELEASE + f""", z AS (SELECT *, coalesce(abs(actual - expected) / {_SIGMA}, 0.0) AS sigma0, {_MARKET} AS market FROM k)
SELECT seq, round(actual - expected, 6) AS surprise, round(sigma0, 6) AS sigma, CAST(CASE WHEN sigma0 * market >= 1.8 THEN 4 WHEN sigma0 * market >= 0.8 THEN 3 WHEN market >= 0.8 THEN 2 ELSE 1 END AS INTEGER) AS priority,
  concat_ws(' ', upper(indicator), nullif(upper(period), ''), {_shown('actual')}, 'VS. EXP. ' || {_shown('expected')}, '(PREV. ' || {_shown('prior')} || ')') AS body FROM z""",
        "drop_reason_topk": _score() + "SELECT trim(split_part(split_part(reason, ':', 1), ';', 1)) AS reason, count(*) AS n, min(seq) AS first_seen FROM s WHERE priority < 2 GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 8",
        "shingle_similarity_pairs": f"WITH {_STORIES}, {_PAIRS} SELECT seq, earlier, inter, round(j, 6) AS jaccard, round(c, 6) AS containment FROM x WHERE j >= 0.62 OR c >= 0.8",
        "dedup_greedy": f"""WITH RECURSIVE {_STORIES}, {_PAIRS},
o AS MATERIALIZED (SELECT d.seq, coalesce(es, []) AS es, row_number() OVER (ORDER BY d.seq) AS rn FROM d LEFT JOIN (SELECT seq, list(earlier ORDER BY earlier) AS es FROM x WHERE j >= 0.62 OR c >= 0.8 GROUP BY seq) USING (seq)),
r AS (
  SELECT 0::BIGINT AS rn, NULL::BIGINT AS seq, NULL::BIGINT AS duplicate_of, []::BIGINT[] AS gone
  UNION ALL
  SELECT rn, seq, dup, CASE WHEN dup IS NULL THEN gone ELSE list_append(gone, seq) END
  FROM (SELECT o.rn, o.seq, r.gone, list_filter(o.es, lambda k: NOT list_contains(r.gone, k))[1] AS dup FROM r JOIN o ON o.rn = r.rn + 1)
)
SELECT seq, coalesce(duplicate_of, -1) AS duplicate_of FROM r WHERE rn > 0""",
        "html_clean": "WITH c AS (SELECT page_id, regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g') AS x FROM pages), e AS (SELECT page_id, regexp_replace(regexp_replace("
        + "replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&')"
        + ", '\\s+', ' ', 'g'), '^ | $', '', 'g') AS y FROM c) SELECT page_id, sha256(y) AS sha256, CAST(length(y) AS INTEGER) AS n FROM e",
        "stable_id": "SELECT page_id, sha1('wire|' || coalesce(nullif(CASE WHEN page_id % 2 = 0 THEN url ELSE '' END, ''), nullif(CASE WHEN page_id % 3 = 0 THEN url END, ''), html, ''))[1:16] AS id FROM pages",
        "parse_dates": "SELECT o_orderkey, CAST(f AS INTEGER) AS form, CASE WHEN f < 4 THEN epoch(o_orderdate) END::DOUBLE AS at FROM orders, range(6) AS x(f)",
        "feed_parse": """WITH s AS (SELECT 'feed' || s_suppkey AS source, s_name AS n, s_suppkey AS k FROM supplier),
i AS (
  SELECT source, sha1(source || '|g' || k)[1:16] AS id, n || ' <b> up' AS headline, 1788013800.0 AS ts, 'Body of ' || k AS body, 'http://e.example/' || k AS url, 0 AS pos FROM s WHERE k % 3 <> 0 AND k % 10 <> 7
  UNION ALL SELECT source, sha1(source || '|a' || k)[1:16], n, 1787999400.0, 'S ' || k, 'http://a.example/' || k, 0 FROM s WHERE k % 3 = 0
  UNION ALL SELECT source, sha1(source || '|No date ' || k)[1:16], 'No date ' || k, 1234.0, '', '', 1 FROM s WHERE k % 3 = 0
) SELECT source, id, headline, ts::DOUBLE AS ts, body, url, CAST(pos AS INTEGER) AS pos FROM i""",
        "bar_parse": """WITH s AS (SELECT s_name AS symbol, s_suppkey AS k FROM supplier WHERE s_suppkey % 9 <> 4)
SELECT symbol, 60.0::DOUBLE AS ts, k::DOUBLE AS price, 5.0::DOUBLE AS volume FROM s WHERE k % 4 <> 1 UNION ALL SELECT symbol, 180.0, k + 1.0, 0.0 FROM s""",
        "ticker_parse": """WITH p AS (SELECT event_type AS symbol, event_id AS seq, event_id + 0.5 AS price, CAST(floor(event_id / 3) AS BIGINT) AS trade FROM events WHERE event_id % 11 <> 5),
l AS (SELECT *, lag(trade) OVER (PARTITION BY symbol ORDER BY seq) AS b FROM p)
SELECT symbol, seq, price::DOUBLE AS price, 2.0::DOUBLE AS volume FROM l WHERE trade = 0 OR b IS NULL OR trade <> b""",
        "seen_anti_join": "SELECT DISTINCT event_type AS source, user_id AS id FROM events WHERE user_id % 4 <> 0",
        "ewma_baseline": _EWMA + "SELECT symbol, seq, n, round(sqrt(greatest(var, 0)), 6) AS sigma_per_s, round(vol, 6) AS vol_per_s FROM r",
        "asof_anchor": f"WITH {_TICKS} SELECT symbol, seq, anchor_21600, anchor_86400 FROM a",
        "window_volume": f"WITH {_TICKS} SELECT symbol, seq, volume_21600, volume_86400 FROM a",
        "quick_moves": _MOVES + _MOVE_ROWS,
        "live_moves": _MOVES + _MOVE_ROWS,
        "move_news_correlation": _MOVES + f""", {_NEWS}, l AS (SELECT m.symbol, m.seq, m.ts, max(struct_pack(ts := ns.ts, seq := ns.seq)) AS x FROM mv m LEFT JOIN ns ON ns.symbol = m.symbol AND ns.ts <= m.ts GROUP BY ALL)
SELECT symbol, seq, coalesce(CASE WHEN ts - x.ts <= 21600 THEN x.seq END, -1) AS news_seq FROM l""",
        "news_move_correlation": _MOVES + f""", {_NEWS}, l AS (SELECT ns.seq, ns.pos, ns.ts, max(struct_pack(ts := m.ts, seq := m.seq)) AS x FROM ns JOIN mv m ON ns.symbol = m.symbol AND m.ts < ns.ts GROUP BY ALL),
b AS (SELECT seq, arg_min(x.seq, pos) AS move_seq FROM l WHERE ts - x.ts <= 86400 GROUP BY seq)
SELECT nw.seq, coalesce(move_seq, -1) AS move_seq FROM nw LEFT JOIN b USING (seq)""",
        "recent_k_ring": f"WITH {I.TICKS_SQL} SELECT symbol, seq, price FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) AS n FROM t) WHERE n <= 16",
        "latest_n": f"WITH {I.TICKS_SQL} SELECT seq, symbol FROM (SELECT * FROM t ORDER BY ts DESC, seq DESC LIMIT 50) ORDER BY ts, seq",
        "speech_order": "SELECT event_id AS seq, CAST(event_id % 5 AS INTEGER) AS priority, event_type AS spoken, CAST(row_number() OVER (PARTITION BY event_id % 5 ORDER BY event_id) AS INTEGER) AS place FROM events WHERE event_id % 5 >= 3 AND event_id % 6 <> 0",
    }
    sql |= _registry()
    return sql


def _registry() -> dict[str, str]:
    from ..sources.registry import SOURCES

    rows = ", ".join(f"({q(k)}, {q(n)}, {p}, {str(pr).lower()}, {str(re_).lower()})" for k, n, _, p, _, pr, re_, _ in SOURCES)
    base = f"WITH s(key, name, poll_s, prim, reachable) AS (VALUES {rows})"
    return {
        "source_registry": base + " SELECT key, count(*) AS n, min(poll_s)::DOUBLE AS poll_s, bool_or(reachable) AS reachable, bool_or(prim) AS primary FROM s GROUP BY key",
        "source_health": base
        + """, k AS (SELECT *, row_number() OVER (ORDER BY name) AS k FROM s), g AS (SELECT page_id % 29 + 1 AS k, count(*) AS n FROM pages GROUP BY 1),
c AS (SELECT k.name, k.reachable, coalesce(CASE WHEN k.k % 5 = 0 THEN 0 ELSE g.n END, 0) AS n, g.n IS NOT NULL AND k.k % 7 <> 0 AS answered FROM k LEFT JOIN g USING (k)),
z AS (SELECT *, CASE WHEN answered AND n > 0 THEN 'OK' WHEN answered THEN 'EMPTY' WHEN reachable THEN 'FAIL' ELSE 'DEAD' END AS status FROM c)
SELECT name, n, status, status IN ('EMPTY', 'FAIL') AS failure FROM z""",
    }
