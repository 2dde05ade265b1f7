"""SQL for DuckDB of the queries that SQL can express."""

from __future__ import annotations

from .chat import Template


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _chat() -> str:
    t = Template()
    escaped = "replace(text, '\\', '\\\\')"
    for c in t.controls:
        escaped = f"replace({escaped}, {_text(c)}, {_text(c[0] + chr(92) + c[1:])})"
    sizes = " ".join(f"WHEN {_text(role)} THEN {len(a) + len(b)}" for role, (a, b) in t.markers.items())
    return f"""WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
  SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), ordered AS (
  SELECT *, row_number() OVER w - 1 AS i, lag(role) OVER w AS before, length({escaped}) + CASE role {sizes} END AS size
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), told AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss, CAST(sum(size) AS BIGINT) AS formatted_chars,
    CAST(min(i) FILTER (NOT CASE role WHEN 'system' THEN before IS NULL WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant')
      WHEN 'assistant' THEN coalesce(before, '') = 'user' ELSE false END) AS INTEGER) AS bad, arg_max(role, i) AS last
  FROM ordered GROUP BY conv_id
) SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
  bad IS NULL AND last = 'assistant' AS valid,
  CASE WHEN bad IS NULL AND last = 'assistant' THEN NULL ELSE coalesce(bad, CAST(n_turns AS INTEGER)) END AS error_turn FROM told"""


_QUALITY = r"""WITH docs AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT doc_id, host, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS raw FROM docs
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM split)
), repeated AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), covered AS (
  SELECT doc_id, CAST(sum(least(8, coalesce(after - i, 8))) AS BIGINT) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM repeated) GROUP BY doc_id
), normal AS (
  SELECT doc_id, host, list_transform(raw, lambda x: trim(regexp_replace(regexp_replace(lower(x), '[\x09\x0B-\x0D]', ' ', 'g'), ' {2,}', ' ', 'g'))) AS own FROM split
), lines AS (
  SELECT doc_id, host, line, count(*) AS k FROM (SELECT doc_id, host, unnest(own) AS line FROM normal) GROUP BY ALL
), hosts AS (
  SELECT host, count(DISTINCT doc_id) AS n FROM docs GROUP BY host
), frequent AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT doc_id) AS d FROM lines GROUP BY host, line) JOIN hosts USING (host)
  WHERE d > 50 AND d > 0.001 * n
), gone AS (
  SELECT doc_id, CAST(sum(k * len(string_split(line, ' '))) AS BIGINT) AS n FROM lines JOIN frequent USING (host, line) GROUP BY doc_id
), told AS (
  SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(raw) - len(list_distinct(raw)) AS BIGINT) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words, least(coalesce(g.n, 0), len(words)) AS n_removed_words
  FROM split s LEFT JOIN covered c USING (doc_id) LEFT JOIN gone g USING (doc_id)
) SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_removed_words >= 0.3 * n_words AS kept FROM told"""


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_formatting": _chat(), "op7_quality_rules": _QUALITY}
