"""DuckDB SQL for those training-data queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"\x20\x09-\x0D"

OP6 = rf"""WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
  keyed AS (SELECT *, translate(regexp_replace(line, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS key FROM lines),
  held AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
  marked AS (SELECT k.*, h.key IS NOT NULL AND doc_id <> keeper AS gone FROM keyed k LEFT JOIN held h USING (key))
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id"""

_DIGIT_BITS = ", ".join(f"'{n:04b}'" for n in range(16))
_FIVE = " + ".join(f"{1 << (4 - k)} * substr(bits, 5 * i + {k + 1}, 1)::BIGINT" for k in range(5))

OP3 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
  b AS (SELECT *, array_to_string(list_transform(string_split(sha1(html), ''), lambda d: ([{_DIGIT_BITS}])[strpos('0123456789abcdef', d)]), '') AS bits FROM p)
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_FIVE}, 1)), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b"""

_GAMMA = "(1.01::DOUBLE / 0.99)"
_METRICS = (
    ("symbols", "1000 * n_symbols / greatest(word_chars, 1)", 10.0),
    ("dup_lines", "1000 * n_dup_lines / (n_lines + 10)", 100.0),
    ("repeats", "1000 * n_repeat_words / greatest(n_words, 1)", 150.0),
    ("stutter", "1000 * n_stutter / greatest(n_words, 1)", 50.0),
    ("word_length", "1000 * word_chars / greatest(n_words, 1)", 500.0),
)
#: An exponential tail through median and upper quartile, exceeded by one in ten thousand.
_REACH = "(ln(0.25::DOUBLE * 10000) / ln(0.5::DOUBLE / 0.25))"
_VALUES = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{m}' AS metric, ({v})::DOUBLE AS value, {s} AS slack FROM good" for m, v, s in _METRICS)


def _quantiles(keys: str) -> str:
    by = ", ".join(filter(None, [keys, "metric"]))
    parts = ", ".join(f"min(CASE WHEN upto >= docs * {q} THEN v END) AS {n}" for q, n in (("0.25::DOUBLE", "q1"), ("0.5::DOUBLE", "q2"), ("0.75::DOUBLE", "q3")))
    return f"""SELECT {by}, max(docs) AS docs, {parts} FROM (
      SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY bucket NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY {by}) AS docs,
        coalesce(pow({_GAMMA}, bucket) * 2 / (1 + {_GAMMA}), 0.0) AS v FROM (SELECT {by}, bucket, count(*) AS n FROM buckets GROUP BY ALL)) GROUP BY {by}"""


def _shrunk(q: str) -> str:
    language = f"((f1.docs * f1.{q} + 100.0::DOUBLE * f0.{q}) / (f1.docs + 100.0::DOUBLE))"
    return f"((f2.docs * f2.{q} + 100.0::DOUBLE * {language}) / (f2.docs + 100.0::DOUBLE)) AS {q}"


OP8 = rf"""WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS words FROM documents),
  u AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
  g AS (SELECT doc_id, i, lag(word) OVER d AS before, word, concat_ws(' ', word, lead(word, 1) OVER d, lead(word, 2) OVER d, lead(word, 3) OVER d, lead(word, 4) OVER d) AS gram,
      lead(word, 4) OVER d IS NOT NULL AS whole FROM u WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
  r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g WHERE whole) WHERE n > 1),
  cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(5) AS t(k) GROUP BY doc_id),
  stutter AS (SELECT doc_id, count(*) FILTER (WHERE before = word) AS n FROM g GROUP BY doc_id),
  lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
  dups AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^{_SPACE}]') GROUP BY doc_id),
  counted AS (SELECT w.doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
      (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dups.n, 0)::BIGINT AS n_dup_lines,
      coalesce(cover.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(stutter.n, 0) AS n_stutter
    FROM w LEFT JOIN dups USING (doc_id) LEFT JOIN cover USING (doc_id) LEFT JOIN stutter USING (doc_id)),
  based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted),
  good AS (SELECT * FROM based WHERE NOT base_failed),
  v AS ({_VALUES}),
  buckets AS (SELECT *, CASE WHEN value > 0 THEN ceil(round(ln(value) / ln({_GAMMA}), 9)) END AS bucket FROM v),
  f0 AS ({_quantiles('')}), f1 AS ({_quantiles('lang')}), f2 AS ({_quantiles('lang, source')}),
  judged AS (SELECT doc_id, bool_and(value <= round(q3 + (q3 - q2) * {_REACH} + slack, 6) AND (metric <> 'word_length' OR value >= round(q1 - (q2 - q1) * {_REACH} - slack, 6))) AS inside FROM (
    SELECT v.*, {_shrunk('q1')}, {_shrunk('q2')}, {_shrunk('q3')}
    FROM v JOIN f0 USING (metric) JOIN f1 ON f1.metric = v.metric AND f1.lang IS NOT DISTINCT FROM v.lang
      JOIN f2 ON f2.metric = v.metric AND f2.lang IS NOT DISTINCT FROM v.lang AND f2.source IS NOT DISTINCT FROM v.source) v GROUP BY doc_id)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(inside, true) AS kept
  FROM based LEFT JOIN judged USING (doc_id)"""

SQL = {"op3_warc": OP3, "op6_linededup": OP6, "op8_rules": OP8}
