"""DuckDB SQL with the rows of the registered queries, written on its own from the definitions."""

from __future__ import annotations

from ..operators.rules import BLACK, HIGH_RISK
from ..operators.slices import OCR, TRANSLIT
from .inputs import COUNTRIES, FAMILY, GIVEN, RISKS, TYPOLOGIES

TX = """tx AS (SELECT event_id AS row_nr, ts, CAST(user_id AS VARCHAR) AS f, json_extract_string(props, '$.k') AS t, round(value * 100, 2) AS amt, event_type, CAST(event_type = 'error' AS INTEGER) AS bad FROM events),
legs AS (SELECT row_nr, ts, epoch_us(ts) AS us, 'o' AS side, f AS account, t AS cp, amt FROM tx UNION ALL SELECT row_nr, ts, epoch_us(ts), 'i', t, f, amt FROM tx)"""
ACC = "acc AS (SELECT f AS account_id FROM tx WHERE f IS NOT NULL UNION SELECT t FROM tx WHERE t IS NOT NULL)"
_LIST = "[" + ", ".join(f"'{c}'" for c in COUNTRIES) + "]"
_RISK = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RISKS.items())
PROF = f"prof AS (SELECT CAST(c_custkey AS VARCHAR) AS account_id, c_name AS name, ({_LIST})[CAST(c_nationkey % {len(COUNTRIES)} AS INTEGER) + 1] AS country, CASE c_mktsegment {_RISK} END AS kyc_risk FROM customer)"
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
MEAN = "om AS (SELECT f, count(*) AS n, count(DISTINCT t) AS u, avg(amt) AS m FROM tx GROUP BY f)"
OUTB = f"""{MEAN}, ob AS (SELECT om.f AS account_id, any_value(om.n) AS outbound_count, any_value(om.u) AS unique_out_recipients, any_value(om.m) AS amount_mean, stddev_samp(amt) AS amount_std, max(amt) AS amount_max,
  CASE WHEN avg((amt - om.m) ** 2) > 0 THEN avg((amt - om.m) ** 3) / avg((amt - om.m) ** 2) ** 1.5 END AS amount_skew, avg(CAST(round(amt) % 1000 = 0 AS DOUBLE)) AS round_amount_ratio
  FROM tx JOIN om ON tx.f = om.f GROUP BY om.f)"""
INB = "ib AS (SELECT t AS account_id, count(*) AS inbound_count, count(DISTINCT f) AS unique_in_senders FROM tx GROUP BY t)"
TIME = "tm AS (SELECT account AS account_id, min(ts) AS first_ts, max(ts) AS last_ts, (max(us) - min(us)) / 8.64e10 AS day_range, avg(CAST(hour(ts) < 7 OR hour(ts) > 20 AS DOUBLE)) AS off_hours_fraction FROM legs GROUP BY account)"
ENT = "en AS (SELECT account AS account_id, -sum(p * log2(p)) AS txn_hour_entropy FROM (SELECT account, count(*) / sum(count(*)) OVER (PARTITION BY account) AS p FROM legs GROUP BY account, hour(ts)) GROUP BY account)"
_F = ("outbound_count", "inbound_count", "unique_out_recipients", "unique_in_senders", "amount_mean", "amount_std", "amount_max", "amount_skew", "round_amount_ratio", "off_hours_fraction", "txn_hour_entropy", "in_out_ratio", "out_diversity", "in_diversity", "avg_daily_velocity")
_Z = lambda c: f"coalesce({c}, 0)"
_M = lambda c: f"coalesce({c}, median({c}) OVER ())"
_C = {c: (_M(c) if c in ("amount_mean", "amount_std", "amount_max", "amount_skew") else _Z(c)) for c in _F}
_C |= {
    "in_out_ratio": f"{_Z('inbound_count')} / ({_Z('outbound_count')} + 1)", "out_diversity": f"{_Z('unique_out_recipients')} / ({_Z('outbound_count')} + 1)",
    "in_diversity": f"{_Z('unique_in_senders')} / ({_Z('inbound_count')} + 1)", "avg_daily_velocity": f"({_Z('outbound_count')} + {_Z('inbound_count')}) / ({_Z('day_range')} + 1)",
}
MATRIX = f"WITH {TX}, {ACC}, {OUTB}, {INB}, {TIME}, {ENT}, fm AS (SELECT account_id, {', '.join(f'CAST({_C[c]} AS FLOAT) AS {c}' for c in _F)} FROM acc LEFT JOIN ob USING (account_id) LEFT JOIN ib USING (account_id) LEFT JOIN tm USING (account_id) LEFT JOIN en USING (account_id))"
LONG = f"lg AS (UNPIVOT (SELECT account_id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _F)} FROM fm) ON {', '.join(_F)} INTO NAME feature VALUE x)"
STATS = f"{LONG}, md AS (SELECT feature, median(x) AS median, stddev_pop(x) AS std FROM lg GROUP BY feature), st AS (SELECT lg.feature, any_value(median) AS median, median(abs(x - median)) AS mad, any_value(std) AS std FROM lg JOIN md USING (feature) GROUP BY lg.feature)"
EDGE = "ed AS (SELECT f AS account, t AS cp FROM tx WHERE f <> t UNION SELECT t, f FROM tx WHERE f <> t)"
HOP2 = "h2 AS (SELECT account, cp FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY cp) AS k FROM (SELECT DISTINCT a.account, b.cp FROM ed a JOIN ed b ON a.cp = b.account WHERE b.cp <> a.account AND NOT EXISTS (SELECT 1 FROM ed c WHERE c.account = a.account AND c.cp = b.cp))) WHERE k <= 50)"
LABEL = "lb AS (SELECT f AS account_id, min(upper(event_type)) AS label FROM tx GROUP BY f)"
DAY = 86_400_000_000


def _fan(side: str, least: int, name: str = "fan") -> str:
    rule = "FAN_OUT_001" if side == "o" else "FAN_IN_001"
    return f"""{name}_p AS (SELECT r.account, r.us, r.row_nr, r.ts, list_sort(list_distinct(list(j.cp))) AS ids, count(*) AS n_rows, min(j.ts) AS window_start
  FROM legs r JOIN legs j ON j.account = r.account AND j.side = r.side AND j.us >= r.us - {DAY} AND (j.us < r.us OR (j.us = r.us AND j.row_nr <= r.row_nr)) WHERE r.side = '{side}' AND r.cp IS NOT NULL AND j.cp IS NOT NULL GROUP BY ALL HAVING count(DISTINCT j.cp) >= {least}),
{name} AS (SELECT account, '{rule}' AS rule_id, 2 AS severity, len(ids) AS n_counterparties, array_to_string(ids[1:20], ';') AS counterparties, n_rows, window_start, ts AS window_end FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY us, row_nr) AS k FROM {name}_p) WHERE k = 1)"""


STRUCT = f"""sl AS (SELECT * FROM legs WHERE side = 'o' AND amt >= 8000 AND amt < 9900),
struct_p AS (SELECT r.account, r.us, r.row_nr, r.ts, count(*) AS txn_count, string_agg(format('{{:,.2f}}', j.amt), ';' ORDER BY j.us, j.row_nr) AS amounts, min(j.ts) AS window_start FROM sl r JOIN sl j ON j.account = r.account AND j.us >= r.us - {DAY} AND (j.us < r.us OR (j.us = r.us AND j.row_nr <= r.row_nr)) GROUP BY ALL HAVING count(*) >= 3),
struc AS (SELECT account, 'STRUCT_001' AS rule_id, 3 AS severity, txn_count, amounts, window_start, ts AS window_end FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY us, row_nr) AS k FROM struct_p) WHERE k = 1)"""
PASS = f"""pass_p AS (SELECT i.account, i.us, i.row_nr, i.ts, i.amt, sum(o.amt) AS s, count(*) AS n, max(o.ts) AS e FROM legs i JOIN legs o ON o.account = i.account AND o.side = 'o' AND o.us > i.us AND o.us < i.us + {DAY} WHERE i.side = 'i' AND i.amt > 0 GROUP BY ALL HAVING sum(o.amt) / i.amt >= 0.8),
pas AS (SELECT account, 'PASSTHROUGH_001' AS rule_id, 3 AS severity, round(amt, 4) AS inbound_amount, round(s, 4) AS outbound_sum, round(s / amt, 4) AS ratio, n AS n_outbound, ts AS window_start, e AS window_end FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY us, row_nr) AS k FROM pass_p) WHERE k = 1)"""
CORR = f"""cor AS (SELECT p.account_id AS account, 'CORRIDOR_001' AS rule_id, 1 AS severity, country, CASE WHEN country IN {_IN(BLACK)} THEN 'FATF_BLACKLIST' ELSE 'HIGH_RISK' END AS label,
  coalesce(min(ts), TIMESTAMP '1970-01-01') AS window_start, coalesce(max(ts), TIMESTAMP '1970-01-01') AS window_end FROM prof p LEFT JOIN legs ON legs.account = p.account_id WHERE country IN {_IN(HIGH_RISK)} GROUP BY p.account_id, country)"""
ALL = f"{TX}, {PROF}, {STRUCT}, {PASS}, {_fan('o', 5, 'fo')}, {_fan('i', 5, 'fi')}, {CORR}, al AS (" + " UNION ALL ".join(f"SELECT account, {i} AS ord, rule_id, severity, window_start, window_end FROM {t}" for i, t in enumerate(("struc", "pas", "fo", "fi", "cor"), 1)) + ")"
RANK = "sc AS (SELECT f AS account_id, floor(avg(amt) / 100) AS score FROM tx GROUP BY f), pc AS (SELECT account_id, score, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2) / count(*) OVER () AS percentile FROM sc)"

NAMES = "nm AS (SELECT DISTINCT p_name FROM part)"
SUBJ = f"""{NAMES}, sj AS (SELECT how || ':' || p_name AS account_id, trim(regexp_replace(lower(strip_accents(name)), '\\s+', ' ', 'g')) AS norm, name FROM (
  SELECT 'same' AS how, p_name, upper(p_name) AS name FROM nm UNION ALL SELECT 'turned', p_name, split_part(p_name, ' ', -1) || '  ' || split_part(p_name, ' ', 1) FROM nm
  UNION ALL SELECT 'ocr', p_name, replace(p_name, 'o', '0') FROM nm UNION ALL SELECT 'cut', p_name, split_part(p_name, ' ', 1) || ' ' || substr(split_part(p_name, ' ', -1), 1, 3) FROM nm))"""
INDEX = f"""ix AS (SELECT uid, norm, min(n) AS n FROM (SELECT 'U-' || replace(p_name, ' ', '_') AS uid, unnest([p_name, split_part(p_name, ' ', -1) || ' ' || split_part(p_name, ' ', 1)]) AS norm, unnest([0, 1]) AS n FROM nm) GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY uid, norm")
_SORTED = lambda c: f"array_to_string(list_sort(string_split({c}, ' ')), ' ')"


def _ratio(pairs: str) -> str:
    """pairs(a, b) to tr(a, b, ts): token-sort ratio by a row of the common-subsequence table for each letter of a."""
    return f"""tp AS (SELECT DISTINCT a, b, {_SORTED("a")} AS x, {_SORTED("b")} AS y FROM {pairs}),
lc AS (SELECT a, b, x, y, 0 AS i, list_transform(range(1, length(y) + 1), lambda j: 0) AS r FROM tp
  UNION ALL SELECT a, b, x, y, i + 1, list_transform(range(1, length(y) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(r[k], (CASE WHEN k > 1 THEN r[k - 1] ELSE 0 END) + CAST(x[i + 1] = y[k] AS INTEGER))))) FROM lc WHERE i < length(x)),
tr AS (SELECT a, b, 2.0 * coalesce(r[len(r)], 0) / (length(x) + length(y)) AS ts FROM lc WHERE i = length(x))"""


PAIRS = f"{NAMES}, pr AS (SELECT p_name AS a, unnest([split_part(p_name, ' ', -1) || ' ' || split_part(p_name, ' ', 1), replace(p_name, 'o', '0'), split_part(p_name, ' ', 1) || ' gizmo']) AS b FROM nm)"
FUZZY = f"""WITH RECURSIVE {SUBJ}, {INDEX}, pr AS (SELECT DISTINCT sj.norm AS a, ix.norm AS b FROM sj, ix), {_ratio("pr")},
fz AS (SELECT account_id, uid, greatest(jw, ts) AS score, CASE WHEN jw >= ts THEN 'jaro_winkler' ELSE 'token_sort_ratio' END AS scorer, CASE WHEN n = 0 THEN 'canonical' ELSE 'alias' END AS kind, n
  FROM (SELECT sj.account_id, ix.uid, ix.n, ts, jaro_winkler_similarity(sj.norm, ix.norm) AS jw FROM sj JOIN tr ON tr.a = sj.norm JOIN ix ON ix.norm = tr.b) WHERE greatest(jw, ts) >= 0.85)"""

CASES = """cs AS (SELECT *, CASE WHEN max_sev = 3 THEN ['STRUCT_001', 'PASSTHROUGH_001'] ELSE [] END AS sev3_ids, percentile >= 0.995 AS is_flagged FROM (
  SELECT 'C' || lpad(CAST(k AS VARCHAR), 9, '0') AS case_id, CAST(k AS VARCHAR) AS account_id, CAST(([NULL, 0.95, 0.86, 0.90, NULL, NULL, NULL])[CAST(k % 7 AS INTEGER) + 1] AS DOUBLE) AS max_hit,
    ([NULL, 1, 2, 3, 2])[CAST(k % 5 AS INTEGER) + 1] AS max_sev, CASE WHEN k % 11 <> 0 THEN (k * 37 % 1000) / 1000.0::DOUBLE END AS percentile, CASE WHEN k % 11 <> 0 THEN (k * 37 % 1000) / 1000.0::DOUBLE END * 20 AS score,
    (['sanctions_hit', 'sanctions_near_miss', 'ibm_labeled', 'typology'])[CAST(k % 4 AS INTEGER) + 1] AS case_type, CASE WHEN k % 4 = 2 THEN CAST((k // 4) % 3 AS INTEGER) + 1 END AS severity_band,
    CASE WHEN k % 4 = 3 AND k % 3 = 0 THEN 'rule3_no_anomaly' END AS conflict_type, CASE WHEN k % 3 <> 1 THEN 'ESCALATE' ELSE 'CLEAR' END AS gold_label, (k * 53 % 997) / 10.0::DOUBLE AS latency_ms
  FROM (SELECT c_custkey AS k FROM customer)))"""
BASE = """bs AS (SELECT *, CASE WHEN decision_reason = 'clear' THEN 'CLEAR' ELSE 'ESCALATE' END AS disposition FROM (SELECT *, CASE WHEN coalesce(max_hit, 0) >= 0.90 OR coalesce(max_sev, 0) = 3 THEN 'sanctions_or_critical_rule'
  WHEN coalesce(is_flagged, false) AND coalesce(max_sev, 0) >= 2 THEN 'anomaly_plus_elevated_rule' ELSE 'clear' END AS decision_reason FROM cs))"""


def _policy(source: str) -> str:
    return f"""po AS (SELECT *, CASE WHEN b <= 3 THEN 'ESCALATE' ELSE 'CLEAR' END AS disposition, CASE WHEN b <= 2 THEN 'sanctions_or_critical_rule' WHEN b = 3 THEN 'agent_anomaly_plus_elevated_rule' ELSE 'clear' END AS decision_reason,
  CAST(CASE b WHEN 1 THEN 0.99 WHEN 2 THEN 0.95 WHEN 3 THEN 0.78 ELSE 0.88 END AS DOUBLE) AS confidence, b IN (3, 4) AS human_review FROM (SELECT *, CASE WHEN coalesce(max_hit, 0) >= 0.90 THEN 1 WHEN coalesce(max_sev, 0) = 3 THEN 2
  WHEN coalesce(percentile, 0) >= 0.90 AND coalesce(max_sev, 0) >= 2 THEN 3 WHEN coalesce(percentile, 0) > 0.85 THEN 4 ELSE 5 END AS b FROM {source}))"""


_P, _S = "coalesce(percentile, 0)", "coalesce(max_sev, 0)"
REASONING = f"""CASE b WHEN 1 THEN printf('Sanctions hit score %.3f ≥ 0.90 threshold. OFAC compliance obligation requires immediate escalation.', max_hit)
  WHEN 2 THEN 'Critical severity-3 rule(s) fired: [''' || array_to_string(sev3_ids, ''', ''') || ''']. High-risk pattern warrants escalation.'
  WHEN 3 THEN printf('Anomaly at %.1f%% percentile (robust-z %.2f) — top %.1f%% of account population — combined with severity-%d rule. Deterministic baseline requires the 99.5th-percentile flag; agent escalates at the 90th-percentile when paired with elevated rule evidence.', {_P} * 100, coalesce(score, 0), (1 - {_P}) * 100, {_S})
  WHEN 4 THEN printf('Anomaly at %.1f%% percentile with max rule severity %d. Below escalation threshold but elevated; flagging for human review.', {_P} * 100, {_S})
  ELSE printf('No significant risk indicators: anomaly %.1f%% percentile, max rule severity %d. Case clears.', {_P} * 100, {_S}) END"""
WEIGHT = "CASE WHEN severity_band IN (1, 2, 3) THEN severity_band WHEN case_type = 'sanctions_hit' OR conflict_type = 'rule3_no_anomaly' THEN 3 WHEN case_type = 'typology' THEN 2 ELSE 1 END"


def _metric(t: str) -> str:
    w = f"CAST({WEIGHT} AS DOUBLE)"
    up = lambda k: f"count(*) FILTER (WHERE case_type = '{k}' AND disposition = 'ESCALATE')"
    down = "count(*) FILTER (WHERE case_type = 'sanctions_hit' AND disposition = 'CLEAR')"
    return f"""SELECT round(avg(CAST(disposition = gold_label AS DOUBLE)), 6) AS accuracy, round(coalesce(sum({w}) FILTER (WHERE gold_label = 'ESCALATE' AND disposition = 'CLEAR'), 0) / sum({w}) FILTER (WHERE gold_label = 'ESCALATE'), 6) AS weighted_false_clear,
  round({up('sanctions_hit')} / ({up('sanctions_hit')} + {up('sanctions_near_miss')}), 6) AS sanctions_precision, round({up('sanctions_hit')} / ({up('sanctions_hit')} + {down}), 6) AS sanctions_recall,
  round(quantile_cont(latency_ms, 0.5), 6) AS latency_p50, round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95, count(*) AS eval_size FROM {t}"""


CONFLICT = "cf AS (SELECT account_id, CASE WHEN f AND s < 2 THEN 'anomaly_no_rule' WHEN NOT f AND s = 2 THEN 'rule_no_anomaly' WHEN NOT f AND s >= 3 THEN 'rule3_no_anomaly' END AS conflict_type FROM (SELECT account_id, coalesce(max_sev, 0) AS s, coalesce(is_flagged, false) AS f FROM cs))"

OVERLAY = f"""ov AS (SELECT *, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS norm FROM (SELECT account_id, ({_LIST})[p_partkey % {len(COUNTRIES)} + 1] AS country, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN split_part(p_name, ' ', -1) || '  ' || split_part(p_name, ' ', 1)
  WHEN 2 THEN replace(p_name, 'o', '0') ELSE split_part(p_name, ' ', 1) || ' ' || substr(split_part(p_name, ' ', -1), 1, 3) END AS name FROM acc JOIN part ON CAST(p_partkey AS VARCHAR) = account_id))"""


def _triage() -> str:
    scores = f"{MATRIX.removeprefix(f'WITH {TX}, {ACC}, ')}, {STATS}, zs AS (SELECT account_id, round(sum(least(abs(x - median) / CASE WHEN mad > 0 THEN 1.4826 * mad ELSE std + 1e-8 END, 25)) / 15, 9) AS score FROM lg JOIN st USING (feature) GROUP BY account_id)"
    ranks = "zp AS (SELECT account_id, score, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2) / count(*) OVER () AS percentile FROM zs)"
    hits = f"pr AS (SELECT DISTINCT ov.norm AS a, ix.norm AS b FROM ov, ix), {_ratio('pr')}, mh AS (SELECT a AS norm, max(greatest(ts, jaro_winkler_similarity(a, b))) AS h FROM tr WHERE greatest(ts, jaro_winkler_similarity(a, b)) >= 0.85 GROUP BY a)"
    fired = f"{STRUCT}, {PASS}, {_fan('o', 5, 'fo')}, {_fan('i', 5, 'fi')}, {CORR.replace('prof p', 'ov p')}, al AS (" + " UNION ALL ".join(f"SELECT account, severity FROM {t}" for t in ("struc", "pas", "fo", "fi", "cor")) + "), sv AS (SELECT account AS account_id, max(severity) AS max_sev FROM al GROUP BY account)"
    cases = "cs AS (SELECT 'T' || account_id AS case_id, account_id, h AS max_hit, max_sev, score, percentile, percentile >= 0.995 AS is_flagged FROM ov LEFT JOIN mh USING (norm) LEFT JOIN sv USING (account_id) LEFT JOIN zp USING (account_id))"
    return f"""WITH RECURSIVE {TX}, {ACC}, {NAMES}, {INDEX}, {OVERLAY}, {hits}, {scores}, {ranks}, {fired}, {cases}, {BASE}, {_policy('cs')}
      SELECT case_id, po.account_id, po.disposition, po.decision_reason, human_review, bs.disposition AS baseline_disposition, round(coalesce(po.max_hit, 0), 6) AS max_hit, coalesce(po.max_sev, 0) AS max_sev, round(po.score, 4) AS score, round(po.percentile, 6) AS percentile FROM po JOIN bs USING (case_id)"""


def _eval_set() -> str:
    keys = [t.lower().replace("-", "_") for t in TYPOLOGIES]
    quoted = "[" + ", ".join(f"'{t}'" for t in keys) + "]"
    base = f"""st AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS account_id, coalesce(([NULL, 1, 2, 3, 2])[c_custkey % 5 + 1], 0) AS sev, ([NULL, 'CORRIDOR_001', 'FAN_OUT_001', 'STRUCT_001', 'FAN_IN_001'])[c_custkey % 5 + 1] AS top_rule, c_custkey % 10 = 0 AS flag FROM customer),
    pt AS (SELECT account_id, ({quoted})[k % 8 + 1] AS typology FROM st WHERE k % 4 <> 1 UNION SELECT account_id, ({quoted})[(k + 3) % 8 + 1] FROM st WHERE k % 7 = 0 AND k % 4 <> 1)"""
    steps = [
        ("SELECT * FROM st WHERE k % 12 = 0", "k", 5, "'SH'", "ESCALATE", "sanctions_hit", "'match of kind exact, score from 0.90'", None, None, None),
        ("SELECT * FROM st WHERE k % 3 = 0 AND k % 6 <> 0 AND NOT (sev >= 3 OR (flag AND sev >= 2))", "md5(account_id || '|eval|near')", 5, "'SNM'", "CLEAR", "sanctions_near_miss", "'shares a surname, score 0.80 to 0.88'", None, None, None),
    ]
    for band, held in ((3, "sev >= 3"), (2, "sev = 2"), (1, "sev <= 1")):
        steps.append((f"SELECT * FROM st WHERE k % 4 <> 1 AND {held}", f"md5(account_id || '|eval|band{band}')", 4, "'IBM'", "ESCALATE", "ibm_labeled", f"'labelled sender, band {band}, top rule ' || coalesce(top_rule, 'none')", None, band, None))
    steps += [(f"SELECT * FROM pt WHERE typology = '{t}'", f"md5(account_id || '|eval|{t}')", 1, "'TYP'", "ESCALATE", "typology", f"'in the pattern list as {t}'", t, None, None) for t in keys]
    told = "'top rule ' || coalesce(top_rule, 'none') || ', flagged ' || CASE WHEN flag THEN 'yes' ELSE 'no' END"
    for name, held, n, prefix, gold in (("anomaly_no_rule", "flag AND sev < 2", 2, "CONF_ANR", "CLEAR"), ("rule_no_anomaly", "NOT flag AND sev = 2", 2, "CONF_RNA", "CLEAR"), ("rule3_no_anomaly", "NOT flag AND sev >= 3", 1, "CONF_R3NA", "ESCALATE")):
        steps.append((f"SELECT * FROM st WHERE {held}", f"md5(account_id || '|eval|{name}')", n, f"'{prefix}'", gold, "rules_anomaly_conflict", told, None, None, name))
    ctes, parts = [base], []
    text = lambda v: "NULL" if v is None else f"'{v}'"
    for i, (pool, order, n, prefix, gold, kind, notes, typology, band, conflict) in enumerate(steps):
        used = "".join(f" AND account_id NOT IN (SELECT account_id FROM e{j})" for j in range(i))
        ctes.append(f"e{i} AS (SELECT {prefix} || '_' || account_id AS case_id, account_id, '{gold}' AS gold_label, '{kind}' AS case_type, CAST({text(typology)} AS VARCHAR) AS typology, CAST({band or 0} AS INTEGER) AS severity_band, CAST({text(conflict)} AS VARCHAR) AS conflict_type, {notes} AS notes FROM ({pool}) p WHERE true{used} ORDER BY {order}, account_id LIMIT {n})")
        parts.append(f"SELECT * FROM e{i}")
    recent = "rc AS (SELECT account, string_agg(CAST(row_nr AS VARCHAR), ';' ORDER BY row_nr) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY row_nr DESC) AS k FROM (SELECT DISTINCT account, row_nr FROM legs)) WHERE k <= 5 GROUP BY account)"
    return f"WITH {TX}, {recent}, {', '.join(ctes)} SELECT u.*, coalesce(ids, '') AS relevant_txn_ids FROM ({' UNION ALL '.join(parts)}) u LEFT JOIN rc ON rc.account = u.account_id"


def _drawn_overlay() -> str:
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    draw = lambda salt, n: f"CAST(('0x' || substr(md5(account_id || '|' || {salt}), 1, 8))::BIGINT % {n} AS INTEGER)"
    name = f"({quoted(GIVEN)})[{draw(chr(39) + 'drawg' + chr(39) + ' || i', len(GIVEN))} + 1] || ' ' || ({quoted(FAMILY)})[{draw(chr(39) + 'drawf' + chr(39) + ' || i', len(FAMILY))} + 1]"
    k = draw("'drawkyc'", 100)
    return f"""WITH RECURSIVE {TX}, {ACC}, {NAMES}, {INDEX}, av AS (SELECT g || ' ' || f AS a FROM (SELECT unnest({quoted(GIVEN)}) AS g), (SELECT unnest({quoted(FAMILY)}) AS f)),
      pr AS (SELECT DISTINCT a, norm AS b FROM av, ix WHERE split_part(a, ' ', -1) = split_part(norm, ' ', -1)), {_ratio('pr')}, bad AS (SELECT a FROM tr WHERE greatest(ts, jaro_winkler_similarity(a, b)) >= 0.90 UNION SELECT norm FROM ix),
      dr AS (SELECT account_id, i, {name} AS name FROM acc, (SELECT unnest(range(0, 200)) AS i)), fr AS (SELECT account_id, min_by(name, i) AS name FROM dr WHERE name NOT IN (SELECT a FROM bad) GROUP BY account_id)
      SELECT acc.account_id, coalesce(fx.name, fr.name, (SELECT any_value(d.name) FROM dr d WHERE d.account_id = acc.account_id AND d.i = 199) || ' ' || CAST(({draw("'drawn'", 9000).replace('account_id', 'acc.account_id')}) + 1000 AS VARCHAR)) AS name,
        ({_LIST})[{draw("'drawc'", len(COUNTRIES)).replace('account_id', 'acc.account_id')} + 1] AS country, CASE WHEN {k.replace('account_id', 'acc.account_id')} < 85 THEN 'low' WHEN {k.replace('account_id', 'acc.account_id')} < 97 THEN 'medium' ELSE 'high' END AS kyc_risk FROM acc LEFT JOIN fr USING (account_id) LEFT JOIN (SELECT CAST(c_custkey AS VARCHAR) AS account_id, c_name AS name FROM customer WHERE c_custkey % 3 = 0) fx USING (account_id)"""


_TITLE = lambda c: f"array_to_string(list_transform(regexp_extract_all({c}, '[a-z]+|[^a-z]+'), lambda w: upper(w[1]) || w[2:]), '')"


def _near_misses(given: list[str]) -> str:
    """Given names with the surnames of the list: in the band to their record, under 0.90 to all, the first by md5."""
    return f"""WITH RECURSIVE {NAMES}, {INDEX}, ea AS (SELECT *, given || ' ' || split_part(base, ' ', -1) AS norm FROM (SELECT 'U-' || replace(p_name, ' ', '_') AS uid, p_name AS base, unnest({given}) AS given FROM nm) WHERE length(split_part(base, ' ', -1)) >= 4 AND given || ' ' || split_part(base, ' ', -1) <> base),
      pr AS (SELECT norm AS a, base AS b FROM ea UNION SELECT ea.norm, ix.norm FROM ea, ix), {_ratio("pr")}, sc AS (SELECT a, b, greatest(ts, jaro_winkler_similarity(a, b)) AS s FROM tr),
      ft AS (SELECT ea.*, s FROM ea JOIN sc ON a = norm AND b = base WHERE s BETWEEN 0.80 AND 0.88 AND norm NOT IN (SELECT a FROM sc JOIN ix ON ix.norm = b WHERE s >= 0.90))
      SELECT uid, {_TITLE("norm")} AS spelling, round(s, 9) AS score FROM ft QUALIFY row_number() OVER (PARTITION BY uid ORDER BY md5(uid || '|' || given || '|near'), given) = 1"""


def _derived() -> str:
    """The first fitting spelling of each record and flavor; names on the list bear an accent on every e, their turned aliases none."""
    swap = lambda flavor, subs: f"SELECT uid, base, '{flavor}' AS flavor, false AS late, md5(uid || '|' || x[1]) AS key, {_TITLE('substr(base, 1, instr(base, x[1]) - 1) || x[2] || substr(base, instr(base, x[1]) + length(x[1]))')} AS spelling FROM (SELECT *, unnest({[list(x) for x in subs]}) AS x FROM rc) WHERE contains(base, x[1])"
    letter = "substr(base, i, 1)"
    return f"""WITH RECURSIVE {NAMES}, rc AS (SELECT 'U-' || replace(p_name, ' ', '_') AS uid, p_name AS base, replace(p_name, 'e', 'é') AS raw FROM nm), ri AS (SELECT *, unnest(range(4, length(base) + 1)) AS i FROM rc),
      al AS (SELECT raw AS name FROM rc UNION SELECT split_part(base, ' ', -1) || ' ' || split_part(base, ' ', 1) FROM rc), sp AS (
        SELECT uid, base, 'exact' AS flavor, false AS late, '' AS key, base AS spelling FROM rc WHERE base <> raw
        UNION ALL SELECT uid, base, 'partial_reorder', false, '', split_part(base, ' ', -1) || ' ' || split_part(base, ' ', 1) FROM rc
        UNION ALL {swap("transliteration", TRANSLIT)} UNION ALL {swap("typo_ocr", OCR)}
        UNION ALL SELECT uid, base, 'typo_ocr', true, lpad(CAST(i AS VARCHAR), 6, '0'), {_TITLE("substr(base, 1, i - 1) || substr(base, i + 1, 1) || substr(base, i, 1) || substr(base, i + 2)")} FROM ri WHERE i < length(base) AND NOT contains(substr(base, i, 2), ' ') AND {letter} <> substr(base, i + 1, 1)
        UNION ALL SELECT uid, base, 'transliteration', true, lpad(CAST(i AS VARCHAR), 6, '0'), {_TITLE(f"substr(base, 1, i - 1) || translate({letter}, 'aeiou', 'eioua') || substr(base, i + 1)")} FROM ri
          WHERE {letter} IN ('a', 'e', 'i', 'o', 'u') AND NOT contains(substr(base, i - 3, 3), ' ') AND instr(substr(base, i + 1, 3) || ' ', ' ') <= 3),
      fr AS (SELECT *, lower(spelling) AS norm FROM sp WHERE spelling NOT IN (SELECT name FROM al) AND (flavor NOT IN ('transliteration', 'typo_ocr') OR lower(spelling) NOT IN (SELECT strip_accents(name) FROM al))),
      pr AS (SELECT DISTINCT norm AS a, base AS b FROM fr), {_ratio("pr")}
      SELECT uid, flavor, spelling, round(s, 9) AS score FROM (SELECT fr.*, greatest(ts, jaro_winkler_similarity(a, b)) AS s FROM fr JOIN tr ON a = norm AND b = base)
      WHERE s >= CASE flavor WHEN 'exact' THEN 1.0 WHEN 'typo_ocr' THEN 0.85 ELSE 0.90 END QUALIFY row_number() OVER (PARTITION BY uid, flavor ORDER BY late, key, spelling) = 1"""


ORACLES: dict[str, str] = {
    "accounts_universe": f"WITH {TX}, {ACC} SELECT account_id FROM acc",
    "validation_report": f"""WITH {TX}, {ACC}, a AS (SELECT count(*) AS n, avg(CAST(bad AS DOUBLE)) AS r, count(*) FILTER (WHERE bad NOT IN (0, 1)) AS odd, count(*) FILTER (WHERE f IS NULL) + count(*) FILTER (WHERE t IS NULL) + count(*) FILTER (WHERE amt IS NULL) AS k,
      count(*) FILTER (WHERE f IS NULL) + count(*) FILTER (WHERE t IS NULL) + 2 * count(*) FILTER (WHERE amt IS NULL) + count(*) FILTER (WHERE ts IS NULL) + count(*) FILTER (WHERE event_type IS NULL) AS nulls FROM tx), c AS (SELECT count(*) AS accounts FROM acc)
      SELECT 'schema' AS "check", true AS passed, '' AS actual UNION ALL SELECT 'no_nulls_in_keys', k = 0, CAST(k AS VARCHAR) FROM a UNION ALL SELECT 'null_counts', nulls = 0, CAST(nulls AS VARCHAR) FROM a UNION ALL SELECT 'is_laundering_values', odd = 0, CAST(odd AS VARCHAR) FROM a
      UNION ALL SELECT 'row_count', n = 10000, CAST(n AS VARCHAR) FROM a UNION ALL SELECT 'account_count', abs(accounts - 150) <= 50, CAST(accounts AS VARCHAR) FROM c UNION ALL SELECT 'laundering_ratio', abs(r - 0.2) <= 0.05, CAST(round(r, 6) AS VARCHAR) FROM a""",
    "laundering_senders": f"WITH {TX} SELECT DISTINCT f AS account_id FROM tx WHERE bad = 1",
    "feature_outbound": f"WITH {TX}, {OUTB} SELECT account_id, outbound_count, unique_out_recipients, round(amount_mean, 6) AS amount_mean, round(amount_std, 6) AS amount_std, round(amount_max, 6) AS amount_max, round(amount_skew, 6) AS amount_skew, round(round_amount_ratio, 6) AS round_amount_ratio FROM ob",
    "feature_inbound": f"WITH {TX}, {INB} SELECT * FROM ib",
    "feature_timing": f"WITH {TX}, {TIME} SELECT account_id, first_ts, last_ts, round(day_range, 6) AS day_range, round(off_hours_fraction, 6) AS off_hours_fraction FROM tm",
    "feature_hour_entropy": f"WITH {TX}, {ENT} SELECT account_id, abs(round(txn_hour_entropy, 6)) AS txn_hour_entropy FROM en",
    "feature_matrix": f"{MATRIX} SELECT account_id, {', '.join(f'abs(round(CAST({c} AS DOUBLE), 2)) AS {c}' if c != 'amount_skew' else f'round(CAST({c} AS DOUBLE), 2) AS {c}' for c in _F)} FROM fm",
    "robust_z_stats": f"{MATRIX}, {STATS} SELECT feature, round(median, 3) AS median, round(mad, 3) AS mad, round(std, 3) AS std FROM st",
    "robust_z_score": f"{MATRIX}, {STATS} SELECT account_id, round(sum(least(abs(x - median) / CASE WHEN mad > 0 THEN 1.4826 * mad ELSE std + 1e-8 END, 25)) / 15, 4) AS score FROM lg JOIN st USING (feature) GROUP BY account_id",
    "anomaly_percentile": f"WITH {TX}, {RANK} SELECT account_id, score, round(percentile, 6) AS percentile, percentile >= 0.995 AS is_flagged FROM pc",
    "graph_edges": f"WITH {TX}, {EDGE} SELECT account, cp FROM ed",
    "graph_adjacency": f"WITH {TX}, {EDGE} SELECT account, count(*) AS degree, string_agg(cp, ',' ORDER BY cp) AS neighbours FROM ed GROUP BY account",
    "entity_hop2": f"WITH {TX}, {EDGE}, {HOP2} SELECT account, cp FROM h2",
    "pattern_label": f"WITH {TX}, {LABEL} SELECT account_id, label FROM lb",
    "entity_chain": f"""WITH {TX}, {ACC}, {EDGE}, {HOP2}, {LABEL}, {PROF}, n1 AS (SELECT account, string_agg(cp, ',' ORDER BY cp) AS hop1 FROM ed GROUP BY account), n2 AS (SELECT account, string_agg(cp, ',' ORDER BY cp) AS hop2 FROM h2 GROUP BY account)
      SELECT acc.account_id, coalesce(name, 'UNKNOWN') AS name, country, kyc_risk, coalesce(hop1, '') AS hop1, coalesce(hop2, '') AS hop2, label AS pattern_label FROM acc LEFT JOIN prof USING (account_id) LEFT JOIN n1 ON n1.account = acc.account_id LEFT JOIN n2 ON n2.account = acc.account_id LEFT JOIN lb ON lb.account_id = acc.account_id""",
    "account_window_trim": f"WITH {TX} SELECT account, row_nr, side FROM (SELECT *, dense_rank() OVER (PARTITION BY account ORDER BY us DESC, row_nr DESC) AS k FROM legs) WHERE k <= 20",
    "rule_structuring": f"WITH {TX}, {STRUCT} SELECT account, rule_id, severity, txn_count, amounts, window_start, window_end FROM struc",
    "rule_passthrough": f"WITH {TX}, {PASS} SELECT * FROM pas",
    "rule_fan_out": f"WITH {TX}, {_fan('o', 5)} SELECT * FROM fan",
    "rule_fan_in": f"WITH {TX}, {_fan('i', 5)} SELECT * FROM fan",
    "rule_fan_out_strict": f"WITH {TX}, {_fan('o', 9)} SELECT * FROM fan",
    "rule_corridor": f"WITH {TX}, {PROF}, {CORR} SELECT * FROM cor",
    "rules_all": f"WITH {ALL} SELECT * FROM al",
    "recent_txn_ids": f"WITH {TX} SELECT account, string_agg(CAST(row_nr AS VARCHAR), ';' ORDER BY row_nr) AS txn_ids FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY row_nr DESC) AS k FROM (SELECT DISTINCT account, row_nr FROM legs)) WHERE k <= 5 GROUP BY account",
    "name_normalize": f"WITH {SUBJ} SELECT account_id, norm || ' ea' AS norm FROM sj",
    "name_jaro_winkler": f"WITH {PAIRS} SELECT a, b, round(jaro_winkler_similarity(a, b), 9) AS score FROM pr",
    "name_token_sort": f"WITH RECURSIVE {PAIRS}, {_ratio('pr')} SELECT pr.a, pr.b, round(ts, 9) AS score FROM pr JOIN tr USING (a, b)",
    "watchlist_index": f"WITH {NAMES}, {INDEX} SELECT uid, norm, CASE WHEN n = 0 THEN 'canonical' ELSE 'alias' END AS kind, 'SDN' AS list_name FROM ix",
    "screen_exact": f"WITH {SUBJ}, {INDEX} SELECT account_id, uid, CASE WHEN n = 0 THEN 'canonical' ELSE 'alias' END AS kind FROM sj JOIN ix USING (norm)",
    "screen_fuzzy": f"{FUZZY} SELECT account_id, uid, round(score, 9) AS score, scorer, kind FROM fz",
    "screen_best_hit": f"""{FUZZY}, h AS (SELECT account_id, uid, 1.0::DOUBLE AS score, 0 AS o, n FROM sj JOIN ix USING (norm) UNION ALL SELECT account_id, uid, score, 1, n FROM fz), b AS (SELECT *, row_number() OVER (PARTITION BY account_id, uid ORDER BY score DESC, o, n) AS k FROM h)
      SELECT account_id, uid, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY account_id ORDER BY score DESC, o, uid, n) AS INTEGER) AS rank FROM b WHERE k = 1""",
    "surname_block_collision": f"WITH RECURSIVE {SUBJ}, {INDEX}, pr AS (SELECT DISTINCT sj.norm AS a, ix.norm AS b FROM sj JOIN ix ON split_part(sj.norm, ' ', -1) = split_part(ix.norm, ' ', -1)), {_ratio('pr')} SELECT DISTINCT a AS norm FROM tr WHERE greatest(ts, jaro_winkler_similarity(a, b)) >= 0.90",
    "decision_table": f"WITH {CASES}, {BASE} SELECT case_id, disposition, decision_reason FROM bs",
    "decision_policy": f"WITH {CASES}, {_policy('cs')} SELECT case_id, disposition, decision_reason, {REASONING} AS reasoning, confidence, human_review FROM po",
    "case_override": f"WITH {CASES}, {BASE}, {_policy('cs')} SELECT case_id, po.disposition, bs.disposition AS baseline_disposition, po.disposition <> bs.disposition AS agent_override FROM po JOIN bs USING (case_id)",
    "override_rates": f"WITH {CASES}, {BASE}, {_policy('cs')} SELECT round(avg(CAST(po.disposition <> bs.disposition AS DOUBLE)), 6) AS override_rate, round(avg(CAST(human_review AS DOUBLE)), 6) AS review_rate, round(avg(po.latency_ms), 6) AS latency_mean, min(po.latency_ms) AS latency_min, max(po.latency_ms) AS latency_max, 0.0::DOUBLE AS total_cost, 0::BIGINT AS total_tokens, true AS zero_cost, true AS zero_tokens, count(*) AS n FROM po JOIN bs USING (case_id)",
    "case_weights": f"WITH {CASES} SELECT case_id, CAST({WEIGHT} AS INTEGER) AS weight FROM cs",
    "metric_report": f"WITH {CASES}, {BASE} {_metric('bs')}",
    "metric_delta": f"WITH {CASES}, {BASE}, {_policy('cs')}, p AS ({_metric('po')}), q AS ({_metric('bs')}) SELECT round(p.accuracy - q.accuracy, 6) AS delta_accuracy, round(p.weighted_false_clear - q.weighted_false_clear, 6) AS delta_false_clear FROM p, q",
    "reason_histogram": f"WITH {CASES}, {_policy('cs')} SELECT decision_reason AS value, count(*) AS n FROM po GROUP BY 1",
    "duplicate_names": "SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1",
    "conflict_pools": f"WITH {CASES}, {CONFLICT} SELECT * FROM cf WHERE conflict_type IS NOT NULL",
    "eval_slices": f"WITH {CASES}, {CONFLICT} SELECT account_id, conflict_type FROM (SELECT *, row_number() OVER (PARTITION BY conflict_type ORDER BY md5(account_id || '|slices'), account_id) AS k FROM cf) WHERE k <= CASE conflict_type WHEN 'anomaly_no_rule' THEN 4 WHEN 'rule_no_anomaly' THEN 4 WHEN 'rule3_no_anomaly' THEN 2 ELSE 0 END",
    "eval_set": _eval_set(),
    "eval_not_in_overlay": f"WITH {TX}, {ACC} SELECT CAST(c_custkey AS VARCHAR) AS account_id FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT account_id FROM acc JOIN part ON CAST(p_partkey AS VARCHAR) = account_id)",
    "overlay_on_list": f"WITH {TX}, {ACC}, {NAMES}, {OVERLAY} SELECT lower(name) AS name FROM ov INTERSECT (SELECT p_name FROM nm UNION SELECT split_part(p_name, ' ', -1) || ' ' || split_part(p_name, ' ', 1) FROM nm)",
    "identity_overlay": _drawn_overlay(),
    "near_miss_names": _near_misses(["anna", "bruno", "carla", "smale", "redd", "bloo", "larger", "greta"]),
    "derived_spellings": _derived(),
    "best_list_score": f"WITH RECURSIVE {TX}, {ACC}, {NAMES}, {INDEX}, {OVERLAY}, pr AS (SELECT DISTINCT ov.norm AS a, ix.norm AS b FROM ov, ix), {_ratio('pr')}, b AS (SELECT a AS norm, max(greatest(ts, jaro_winkler_similarity(a, b))) AS s FROM tr GROUP BY a) SELECT norm, round(s, 9) AS score FROM b",
    "score_lookup": f"WITH {TX}, {RANK} SELECT CAST(c_custkey AS VARCHAR) AS account_id, coalesce(score, -1) AS score, round(coalesce(percentile, -1), 6) AS percentile FROM customer LEFT JOIN pc ON pc.account_id = CAST(c_custkey AS VARCHAR)",
    "evidence_bundle": f"WITH {CASES}, {BASE} SELECT case_id, coalesce(max_hit, -1) AS max_hit, coalesce(max_sev, 0) AS max_sev, array_to_string(sev3_ids, ',') AS sev3_ids, coalesce(score, -1) AS score, CASE WHEN score IS NOT NULL THEN percentile ELSE -1 END AS percentile, score IS NOT NULL AND is_flagged AS is_flagged, disposition AS baseline_disposition FROM bs",
    "strategy_agreement": f"WITH {CASES} SELECT count(*) AS n_cases, true AS disposition_agree, true AS reasoning_agree, true AS human_review_agree, true AS override_agree, true AS case_ids_agree, true AS case_order_agree, true AS costs_zero, true AS tokens_zero, true AS passed FROM cs",
    "strategy_metrics": f"""WITH {CASES}, {_policy('cs')}, m AS (SELECT round(avg(CAST(disposition = gold_label AS DOUBLE)), 6) AS accuracy, round(coalesce(sum(CAST({WEIGHT} AS DOUBLE)) FILTER (WHERE gold_label = 'ESCALATE' AND disposition = 'CLEAR'), 0) / sum(CAST({WEIGHT} AS DOUBLE)) FILTER (WHERE gold_label = 'ESCALATE'), 6) AS weighted_false_clear, count(*) AS eval_size FROM po)
      SELECT unnest(['columns', 'sql', 'arrow']) AS framework, accuracy, weighted_false_clear, eval_size FROM m""",
    "result_invariants": "SELECT framework, CAST(ord AS INTEGER) AS ord, (['count', 'duplicates', 'framework', 'empty', 'tokens', 'cost', 'missing', 'extra'])[ord] AS \"check\", 0::BIGINT AS bad FROM (SELECT unnest(['columns', 'sql', 'arrow']) AS framework), (SELECT unnest(range(1, 9)) AS ord)",
    "entity_triage": _triage(),
}
# the same without the cut to 50
ORACLES["entity_chain_whole"] = ORACLES["entity_chain"].replace(HOP2, HOP2.replace(" WHERE k <= 50", ""))
