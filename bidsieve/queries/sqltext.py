"""SQL shared by oracles."""

from __future__ import annotations

from ..functions.text import plain_fold
from ..operators.scoring import Profile
from .duplicates import VECTOR
from .scalars import fold_sql

DAYS = "(epoch(deadline - TIMESTAMP '1998-06-01') / 86400.0)"
DEADLINE = f"CASE WHEN deadline IS NULL THEN 0.35 WHEN {DAYS} < 0 THEN 0.0 WHEN {DAYS} < 5 THEN 0.15 * {DAYS} / 5 WHEN {DAYS} < 12 THEN 0.15 + 0.85 * ({DAYS} - 5) / 7 WHEN {DAYS} <= 45 THEN 1.0 WHEN {DAYS} <= 180 THEN 1.0 - 0.7 * ({DAYS} - 45) / 135 ELSE 0.2 END::DOUBLE"
AMOUNT = "(budget * CASE currency WHEN 'TND' THEN 1.0::DOUBLE WHEN 'EUR' THEN 3.35::DOUBLE WHEN 'USD' THEN 3.1::DOUBLE WHEN 'XOF' THEN 0.0051::DOUBLE ELSE 1.0::DOUBLE END)"
BUDGET = f"CASE WHEN budget IS NULL THEN 0.5 WHEN {AMOUNT} < 50000 THEN 0.1 * {AMOUNT} / 50000 WHEN {AMOUNT} < 250000 THEN 0.1 + 0.9 * ({AMOUNT} - 50000) / 200000 WHEN {AMOUNT} <= 5000000 THEN 1.0 WHEN {AMOUNT} <= 25000000 THEN 1.0 - 0.5 * ({AMOUNT} - 5000000) / 20000000 ELSE 0.35 END::DOUBLE"
LOCATION = "CASE lower(country) WHEN 'france' THEN 0.75 WHEN 'morocco' THEN 0.8 WHEN 'algeria' THEN 0.75 WHEN 'egypt' THEN 0.6 ELSE 0.3 END::DOUBLE"
ORGANIZATION = "CASE buyer WHEN 'Customer#000000001' THEN 1.0 WHEN 'Customer#000000002' THEN 0.95 ELSE 0.4 END::DOUBLE"
PROCEDURE = "CASE procedure WHEN 'open' THEN 1.0 WHEN 'restricted' THEN 0.8 WHEN 'negotiated' THEN 0.6 WHEN 'framework_agreement' THEN 0.9 ELSE 0.5 END::DOUBLE"
_P = Profile()
_TERMS = [(f"t{i}", name, weight, plain_fold(t)) for i, (name, weight, t) in enumerate((n, w, t) for n, w, some in _P.fields for t in some)]
_HELD = "contains(' ' || {0} || ' ', ' {1} ')"
_KEYWORDS = " + ".join(f"CASE WHEN {_HELD.format('b.f', plain_fold(k))} THEN {w}::DOUBLE ELSE 0 END" for k, w in _P.keywords.items())
_VETO = " OR ".join(_HELD.format("b.f", plain_fold(k)) for k in _P.excluded)
#: Criterion, its value and its weight, in the profile's order.
VALUES = [("field_of_work", "v_field", 0.38), ("deadline_proximity", "v_deadline", 0.22), ("keywords", "v_keywords", 0.13), ("budget", "v_budget", 0.09), ("location", "v_location", 0.13), ("organization", "v_organization", 0.05)]
FIELD_OF_WORK = f"""terms_(term_id, field, weight, tf) AS (VALUES {', '.join(f"('{i}', '{n}', {w}::DOUBLE, '{t}')" for i, n, w, t in _TERMS)}),
blobs_ AS (SELECT notice_id, {fold_sql('title')} || ' ' || {fold_sql('sector')} || ' ' || {fold_sql('buyer')} AS f FROM notices),
folded AS (SELECT 'n' || notice_id AS id, f FROM blobs_ UNION ALL SELECT term_id, tf FROM terms_), {VECTOR},
near_ AS (SELECT a.id, b.id AS term_id, greatest(0, least(1, sum(a.weight * b.weight))) AS near FROM vectors a JOIN vectors b ON a.term = b.term AND a.id[1] = 'n' AND b.id[1] = 't' GROUP BY 1, 2),
fields_ AS (SELECT b.notice_id, t.field, t.weight, bool_or({_HELD.format('b.f', "' || tf || '")}) AS held, max(coalesce(n.near, 0)) AS near
  FROM blobs_ b CROSS JOIN terms_ t LEFT JOIN near_ n ON n.id = 'n' || b.notice_id AND n.term_id = t.term_id GROUP BY 1, 2, 3),
best_ AS (SELECT notice_id, max(weight * CASE WHEN held THEN 1 ELSE near END) AS best FROM fields_ GROUP BY 1)"""
SCORED = f"""{FIELD_OF_WORK},
valued AS (SELECT n.*, CASE WHEN best < 0.15 THEN 0 ELSE best END::DOUBLE AS v_field, {DEADLINE} AS v_deadline, CASE WHEN {_VETO} THEN 0 ELSE least(1, ({_KEYWORDS}) / 6) END::DOUBLE AS v_keywords, {_VETO} AS veto,
  {BUDGET} AS v_budget, {LOCATION} AS v_location, {ORGANIZATION} AS v_organization FROM notices n JOIN blobs_ b USING (notice_id) JOIN best_ USING (notice_id)),
scored AS (SELECT *, CASE WHEN veto THEN 'out_of_scope' WHEN score >= 0.75 THEN 'highly_relevant' WHEN score >= 0.5 THEN 'relevant' ELSE 'low_relevance' END AS band FROM (
  SELECT *, CASE WHEN veto THEN 0 ELSE round(({' + '.join(f'{v} * {w}::DOUBLE' for _, v, w in VALUES)}) / ({' + '.join(f'{w}::DOUBLE' for _, _, w in VALUES)}), 6) END::DOUBLE AS score FROM valued))"""
