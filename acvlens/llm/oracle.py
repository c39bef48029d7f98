"""DuckDB SQL of the operators that SQL can express, over whole tables."""

from __future__ import annotations

from .secret_scan import BASE, RULES, Rule

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


CONTAMINATION = f"""WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, {_words('text')} AS w FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_words('text')} AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0
), grams AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM d, (SELECT DISTINCT n FROM wins) l, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n
), hits AS (
  SELECT g.r, g.i, g.n, wins.item FROM grams g JOIN wins ON wins.k = g.k AND wins.n = g.n
), pos AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) u GROUP BY r
), its AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, item FROM hits) u GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(pos.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(its.names, '')) AS items_sha256,
  coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON pos.r = d.r LEFT JOIN its ON its.r = d.r"""


def _spans(rule: Rule, number: int) -> str:
    p = rule.pattern.replace("'", "''")
    lengths = "list_sum(list_transform({}, lambda x: length(x)))"
    before = f"{lengths.format('gap[1:i]')} + coalesce({lengths.format('m[1:i - 1]')}, 0)"
    return f"""SELECT r, {before} AS since, {number} AS rule, {before} + length(m[i]) AS upto
  FROM (SELECT r, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {rule.group}) AS c,
          regexp_split_to_array(t, '{p}') AS gap FROM d) u, unnest(range(1, len(m) + 1)) AS t(i)
  WHERE length(c[i]) >= {max(1, rule.least)}"""


def secrets_sql(rules: tuple[Rule, ...] = RULES) -> str:
    kinds = ", ".join(f"'{r.kind}'" for r in rules)
    line = f"string_agg(list_extract([{kinds}], rule + 1) || ':' || since || ':' || upto, ',' ORDER BY since, rule, upto)"
    counts = ", ".join(f"CAST(count(*) FILTER (rule = {k}) AS BIGINT) AS n_{r.kind}" for k, r in enumerate(BASE))
    return f"""WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents
), s AS ({' UNION ALL '.join(_spans(r, k) for k, r in enumerate(rules))}
)
SELECT any_value(d.doc_id) AS doc_id, {counts},
  sha256(coalesce({line} FILTER (rule < {len(BASE)}), '')) AS base_sha256, coalesce({line} FILTER (rule >= 0), '') AS spans
FROM d LEFT JOIN s ON s.r = d.r GROUP BY d.r"""


_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _terms(text: str) -> str:
    return (f"list_transform(regexp_extract_all(coalesce({text}, ''), '{_TERMS}'), "
            f"lambda x: translate(x, '{_UPPER}', '{_LOWER}'))")


SEARCH = f"""WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, {_terms('text')} AS t FROM documents
), b AS (
  SELECT item_id, row_number() OVER () AS q, {_terms('text')} AS t FROM benchmark
), total AS (
  SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(len(t)) AS BIGINT) AS big_l FROM d WHERE len(t) > 0
), q AS (
  SELECT q, term, count(*) AS times FROM (SELECT q, unnest(t) AS term FROM b) u GROUP BY ALL
), post AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) u
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), freq AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM post, total GROUP BY term, big_n
), scored AS (
  SELECT q.q, p.r, sum(q.times * f.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * len(d.t) * big_n) // big_l)))) AS score
  FROM q JOIN post p ON p.term = q.term JOIN freq f ON f.term = q.term JOIN d ON d.r = p.r, total GROUP BY q.q, p.r
), ranked AS (
  SELECT q, r, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
  FROM scored JOIN d USING (r) WHERE score > 0
)
SELECT b.item_id, CAST(rank AS INTEGER) AS rank, d.doc_id, CAST(score AS BIGINT) AS score
FROM ranked JOIN b USING (q) JOIN d USING (r) WHERE rank <= 10"""


ORACLE_SQL = {"op1_decontamination": CONTAMINATION, "op2_secret_scan": secrets_sql(),
              "op12_ranked_search": SEARCH}
