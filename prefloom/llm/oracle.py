"""DuckDB SQL of the queries that SQL can express."""

from prefloom.llm import pareto_mix, quality_table

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_STOP = ", ".join("'" + w + "'" for w in quality_table.stop_words())
_OTHER_LANG = "(coalesce(lang NOT IN (" + ", ".join(f"'{x}'" for x in quality_table.STOP_LANGUAGES) + "), false))"


def _rule(r) -> str:
    bounds = [f"coalesce(CAST({r.part} AS DOUBLE) / nullif({r.whole}, 0) {sign} {bound}, false)"
              for sign, bound in ((">=", r.least), ("<=", r.most)) if bound is not None]
    return "(" + " AND ".join(bounds) + (f" OR {_OTHER_LANG})" if r.part == "n_stop_words" else ")")


_RULES = " AND ".join(map(_rule, quality_table.RULES))

QUALITY = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS words FROM documents
), windows AS (
  SELECT r, i, [words[i], words[i + 1], words[i + 2]] AS win
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, count(*) AS n_repeat_words
  FROM (SELECT DISTINCT r, i + k AS at FROM twice, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY r
), line AS (
  SELECT w.r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM w, unnest(string_split(t, chr(10))) AS u(l) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY w.r
), f AS (
  SELECT doc_id, lang, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(words, lambda x: x IN ({_STOP}))) AS n_stop_words
  FROM w LEFT JOIN covered USING (r) LEFT JOIN line USING (r)
), b AS (
  SELECT *, n_words < {quality_table.MIN_WORDS}
            OR 100 * n_repeat_words > {quality_table.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_RULES} AS kept FROM b
"""

_LEVEL = """
sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS th, CAST(len({words}) AS BIGINT) AS size,
         row_number() OVER (PARTITION BY source, doc_id, md5(coalesce(text, ''))) AS rep FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, [{weights}][(source_rank - 1) % {n} + 1] AS weight, {most}.0 * source_size AS most FROM per
), levels AS (
  SELECT *, ({share} * sum(source_size) OVER () - coalesce(sum(most) OVER before, 0.0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS level
  FROM weighed WINDOW before AS (ORDER BY most / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT level FROM levels WHERE level * weight <= most ORDER BY most / weight, source_rank LIMIT 1
), target AS (
  SELECT source, source_rank, source_size,
         CASE WHEN (SELECT level FROM level) IS NULL THEN most
              ELSE least(most, (SELECT level FROM level) * weight) END AS target
  FROM weighed
)"""

MIX = "WITH " + _LEVEL.format(
    words=_WORDS, weights=", ".join(f"{w}.0::DOUBLE" for w in pareto_mix.WEIGHTS), n=len(pareto_mix.WEIGHTS),
    most=pareto_mix.MOST_COPIES, share=f"{pareto_mix.SHARE}::DOUBLE") + f""", ranked AS (
  SELECT doc_id, th, rep, size, source_rank, source_size, target, copies, copies - floor(copies) AS p,
         target - floor(copies) * source_size AS open_size,
         (CAST(('0x' || substr(md5(concat_ws(':', '{pareto_mix.SEED}', CAST(doc_id AS VARCHAR), th)), 1, 13))::BIGINT AS DOUBLE)
          + 0.5) / 4503599627370496.0 AS u
  FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS copies
        FROM sized JOIN target ON sized.source IS NOT DISTINCT FROM target.source)
), odds AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1.0 - u)) / (p / (1.0 - p)) END AS odds FROM ranked
), run AS (
  SELECT *, CASE WHEN p > 0 AND size > 0 THEN
    sum(size) OVER (PARTITION BY source_rank ORDER BY odds, doc_id, th, rep ROWS UNBOUNDED PRECEDING) <= open_size END AS inside FROM odds
), gap AS (
  SELECT source_rank, max(open_size) - coalesce(sum(size) FILTER (inside), 0) AS gap FROM run GROUP BY source_rank
), fill AS (
  SELECT source_rank, odds, doc_id, th, rep FROM (
    SELECT *, row_number() OVER (PARTITION BY source_rank ORDER BY abs(size - gap), odds, doc_id, th, rep) AS k
    FROM run JOIN gap USING (source_rank) WHERE NOT inside AND abs(size - gap) < gap) WHERE k = 1
)
SELECT run.doc_id, size, source_size, target,
       CAST(size * (floor(copies) + CASE WHEN inside OR fill.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run LEFT JOIN fill ON run.source_rank = fill.source_rank AND run.odds = fill.odds
                       AND run.doc_id = fill.doc_id AND run.th = fill.th AND run.rep = fill.rep
"""

_EDGES = """
  SELECT * FROM (VALUES
    -- role initial (null: any), state before, state after, letters, cost
    (NULL, 'e', 'e', 'D', 3), (NULL, 's', 's', 'D', 3), (NULL, 'u', 'u', 'D', 3), (NULL, 'a', 'a', 'D', 3),
    ('s', 'e', 's', 'K', 0), ('u', 'e', 'u', 'K', 0), ('u', 's', 'u', 'K', 0), ('u', 'a', 'u', 'K', 0), ('a', 'u', 'a', 'K', 0),
    ('u', 'u', 'u', 'IK', 2), ('a', 'e', 'a', 'IK', 2), ('a', 's', 'a', 'IK', 2), ('a', 'a', 'a', 'IK', 2),
    (NULL, 'e', 'u', 'R', 2), (NULL, 's', 'u', 'R', 2), (NULL, 'a', 'u', 'R', 2), (NULL, 'u', 'a', 'R', 2),
    (NULL, 'u', 'u', 'IR', 4), (NULL, 'e', 'a', 'IR', 4), (NULL, 's', 'a', 'IR', 4), (NULL, 'a', 'a', 'IR', 4)
  ) AS t(initial, before, after, letters, price)"""

REPAIR = rf"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b, 1, 1, 1, 1, 1, 1, 1, 1],
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS b))
), hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(place, ''), lambda c: ascii(c)::BIGINT)),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS hit
  FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place
        FROM conversations), crc_table
), damaged AS (
  SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role,
         CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hit, (SELECT unnest([1, 2]) AS copy) WHERE hit <> 0 AND (copy = 1 OR hit = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         left(role, 1) AS initial, right(rtrim(text, E' \t\n\x0b\x0c\r'), 1) AS ending FROM damaged
), coded AS (
  SELECT *, ending = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         ending NOT IN ('.', '!', '?') AS cut, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
         count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated,
         count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM coded GROUP BY conv_id
), edges AS ({_EDGES}
), walk AS (
  SELECT conv_id, 0::BIGINT AS i, 'e' AS state, {{'cost': 0, 'audit': '', 'rows': ''}} AS best FROM counted
  UNION ALL
  SELECT w.conv_id, w.i + 1, e.after, min({{
      'cost': w.best.cost + e.price + CASE WHEN e.letters <> 'D' AND c.cut THEN 1 ELSE 0 END,
      'audit': w.best.audit || e.letters,
      'rows': w.best.rows
        || CASE WHEN e.letters LIKE 'I%' THEN CASE WHEN w.state = 'u' THEN 'assistant:' ELSE 'user:' END || chr(10) ELSE '' END
        || CASE WHEN e.letters = 'D' THEN ''
                WHEN e.letters LIKE '%K' THEN c.role || ':' || c.text || chr(10)
                WHEN e.after = 'u' THEN 'user:' || c.text || chr(10) ELSE 'assistant:' || c.text || chr(10) END}})
  FROM walk w JOIN coded c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.i = w.i + 1
              JOIN edges e ON e.before = w.state AND (e.initial IS NULL OR e.initial = c.initial)
                          AND (e.letters = 'D' OR NOT (c.blank OR c.again))
  GROUP BY w.conv_id, w.i, e.after
), closed AS (
  SELECT w.conv_id, min({{
      'cost': w.best.cost + CASE state WHEN 's' THEN 4 WHEN 'u' THEN 2 ELSE 0 END,
      'audit': w.best.audit || CASE state WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END,
      'rows': w.best.rows || CASE state WHEN 's' THEN 'user:' || chr(10) || 'assistant:' || chr(10)
                                        WHEN 'u' THEN 'assistant:' || chr(10) ELSE '' END}}) AS best
  FROM walk w JOIN counted n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = n.n GROUP BY w.conv_id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
       coalesce(best.audit, '') AS audit,
       sha256(coalesce(left(best.rows, greatest(length(best.rows) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted n ON n.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN closed c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
"""

ORACLE_SQL = {"op6_pareto_mix": MIX, "op10_quality_table": QUALITY, "op11_conversation_repair": REPAIR}
