"""Token queries."""

from __future__ import annotations

from postmill.operators.tokens import token_outcomes
from postmill.plans import fixtures as fx
from postmill.plans.registry import query


@query(
    "t3_token_outcomes",
    """WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY ts_s, seq) AS k FROM fx_tokens),
       s AS (SELECT handle, 0::bigint AS k, 0::bigint AS seq, 0::bigint AS ts_s, ''::varchar AS kind, NULL::bigint AS created, ''::varchar AS outcome FROM (SELECT DISTINCT handle FROM r)
         UNION ALL SELECT r.handle, r.k, r.seq, r.ts_s, r.kind,
           CASE WHEN coalesce(r.ts_s - s.created <= 900, false) THEN CASE r.kind WHEN 'issue' THEN s.created END ELSE CASE r.kind WHEN 'issue' THEN r.ts_s ELSE s.created END END,
           CASE WHEN coalesce(r.ts_s - s.created <= 900, false) THEN CASE r.kind WHEN 'issue' THEN 'still_valid' ELSE 'ok' END
                ELSE CASE r.kind WHEN 'issue' THEN 'issued' ELSE 'refused' END END
         FROM s JOIN r ON r.handle = s.handle AND r.k = s.k + 1)
       SELECT seq, handle, ts_s, kind, outcome FROM s WHERE k > 0""",
)
def t3(spark, sf):
    return token_outcomes(fx.fx_tokens(spark, sf))
