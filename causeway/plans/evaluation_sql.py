"""SQL pieces that several queries' oracles share."""

from __future__ import annotations

from ..functions.text import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
TOKENS = f"list_filter(regexp_extract_all(strip_accents(lower({{0}})), '[\\p{{{{L}}}}\\p{{{{N}}}}_]{{{{2,}}}}'), lambda x: x NOT IN ({_STOP}))"


def tfidf_sql(table: str, key: str, text: str, min_df: int, max_df: float) -> str:
    """Common table expressions that end in vec(key, term, weight)."""
    return f"""t0 AS (SELECT {key}, {TOKENS.format(text)} AS t FROM {table}), t1 AS (SELECT {key}, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM t0),
      t2 AS (SELECT {key}, term, count(*) AS tf FROM t1 GROUP BY ALL), n AS (SELECT count(*) AS n FROM {table}),
      voc AS (SELECT term, ln((1 + any_value(n.n)) / (1 + count(*))) + 1 AS idf FROM t2, n GROUP BY term HAVING count(*) >= {min_df} AND count(*) <= {max_df} * any_value(n.n)),
      t3 AS (SELECT {key}, term, (1 + ln(tf)) * idf AS w FROM t2 JOIN voc USING (term)), vec AS (SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM t3)"""
