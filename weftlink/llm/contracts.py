"""What SQL can say of the operators' results, as queries of their own with their SQL.

Each query runs its operator over the whole table and returns the columns that DuckDB can compute
another way; op1's and op10's SQL is for their whole results.  Rows are told apart by their place.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROWS = "d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents)"
_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
_PLACED = f"w AS (SELECT r, doc_id, list_element(words, CAST(i AS INT)) AS word, i FROM (SELECT r, doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM (SELECT r, doc_id, {_WORDS} AS words FROM d) x) y)"

MIX = f"""WITH {_ROWS}, s AS (SELECT r, doc_id, source, len({_WORDS}) AS size FROM d), t AS (SELECT source, CAST(sum(size) AS BIGINT) AS total FROM s GROUP BY source),
  k AS (SELECT source, total, list_element([5, 2, 1], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)) AS weight FROM t),
  l AS (SELECT *, 2.0 * total / weight AS level FROM k),
  f AS (SELECT level, (1.5 * sum(total) OVER () - coalesce(sum(2.0 * total) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS water FROM l),
  h AS (SELECT arg_min(water, level) AS water FROM f WHERE water < level)
  SELECT s.doc_id, CAST(s.size AS BIGINT) AS size, l.total AS source_size, round(CAST(CASE WHEN h.water IS NULL THEN 2.0 * l.total ELSE least(2.0 * l.total, h.water * l.weight) END AS DOUBLE), 3) AS target FROM s JOIN l ON l.source IS NOT DISTINCT FROM s.source LEFT JOIN h ON TRUE"""

QUALITY = f"""WITH {_ROWS}, {_PLACED}, g AS (SELECT r, i, concat_ws(' ', word, lead(word) OVER o, lead(word, 2) OVER o) AS gram, lead(word, 2) OVER o IS NOT NULL AS whole FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
  c AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) > 1 AS twice FROM g WHERE whole), p AS (SELECT r, count(DISTINCT i + j) AS n FROM c CROSS JOIN (VALUES (0), (1), (2)) k(j) WHERE twice GROUP BY r),
  b AS (SELECT d.r, doc_id, len({_WORDS}) AS n_words, length(array_to_string({_WORDS}, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, coalesce(p.n, 0) AS n_repeat_words FROM d LEFT JOIN p ON p.r = d.r)
  SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b"""


def _spans(kind: str, pattern: str, keep: str) -> str:
    """(r, a, z, rank of the kind, kind) of the matches m of a pattern, by what stands between them."""
    return f"""SELECT r, a, a + length(m) AS z, '{kind}' AS kind FROM (SELECT r, m, sum(length(gap)) OVER o + coalesce(sum(length(m)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM
    (SELECT r, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gaps FROM d) x) y WINDOW o AS (PARTITION BY r ORDER BY i)) v WHERE {keep}"""


_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
SECRETS = f"""WITH {_ROWS}, s AS ({_spans('assign', _ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 2)) >= 8")} UNION ALL {_spans('access', 'AKIA[A-Z0-9]+', 'length(m) >= 16')} UNION ALL {_spans('hex', '[0-9a-f]+', 'length(m) >= 32')}),
  g AS (SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(concat(kind, ':', CAST(CAST(a AS BIGINT) AS VARCHAR), ':', CAST(CAST(z AS BIGINT) AS VARCHAR)), ',' ORDER BY a, CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 ELSE 2 END) AS spans FROM s GROUP BY r)
  SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN g ON g.r = d.r"""

EDITS = f"""WITH {_ROWS}, n AS (SELECT doc_id, text, length(text) AS n_chars, coalesce(lead(text) OVER (ORDER BY doc_id NULLS FIRST, text), first_value(text) OVER (ORDER BY doc_id NULLS FIRST, text)) AS after FROM d)
  SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, sha256(concat(substr(text, 1, n_chars - n_chars // 2), substr(after, 1, n_chars // 2))) AS edited_sha256 FROM n"""

#: crc32 of an id's decimal digits, by bytes.
_CRC = "xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, list_element(t.t, CAST(xor(c, b) & 255 AS INT) + 1))))"
_LOWER = f"translate(text, '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')"
BASE_SCORES = f"""WITH {_ROWS}, t AS (SELECT list(x ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], [1, 2, 3, 4, 5, 6, 7, 8]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x FROM range(256) r(i)) q),
  e AS (SELECT r, doc_id, coalesce({_CRC} % 7, -1) = 2 AS held_out, list_concat({_WORDS.replace('text', _LOWER)}, [' ']) AS words FROM d CROSS JOIN t), k AS (SELECT r, held_out, unnest(words) AS word FROM e), c AS (SELECT word, count(*) AS c FROM k WHERE NOT held_out GROUP BY word), n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c),
  s AS (SELECT r, count(*) AS n_tokens, count(c.c) AS n_known, sum(log10((coalesce(c.c, 0) + 1) / CAST(n.n + n.v + 1 AS DOUBLE))) AS base FROM k LEFT JOIN c ON c.word = k.word CROSS JOIN n GROUP BY r)
  SELECT doc_id, held_out, n_tokens, n_known, n.n AS train_tokens, round(base, 4) AS base_score FROM e JOIN s ON s.r = e.r CROSS JOIN n"""

REPEATS = f"""WITH {_ROWS.replace('doc_id,', 'doc_id, coalesce(CAST(doc_id AS BIGINT), 9223372036854775807) AS id,')}, {_PLACED.replace('doc_id', 'id')}, x AS (SELECT r, {_WORDS} AS words FROM d),
  p AS (SELECT w.r, w.id, w.i, md5(array_to_string(words[w.i:w.i + 49], ' ')) AS h FROM w JOIN x ON x.r = w.r WHERE w.i + 49 <= len(words)), q AS (SELECT r, i, min(id) OVER (PARTITION BY h) < id AS dup FROM p),
  c AS (SELECT w.r, w.i, w.word, max(CASE WHEN q.dup THEN w.i END) OVER (PARTITION BY w.r ORDER BY w.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM w LEFT JOIN q ON q.r = w.r AND q.i = w.i),
  g AS (SELECT r, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY r)
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g ON g.r = d.r"""

NEAR = f"""WITH RECURSIVE {_ROWS}, u AS (SELECT text, min(coalesce(CAST(doc_id AS BIGINT), 9223372036854775807)) AS first, count(*) AS copies, row_number() OVER (ORDER BY text) AS t FROM d GROUP BY text), a AS (SELECT t, copies, {_WORDS} AS words FROM u),
  g AS (SELECT t, copies, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[i:i + 4], ' ') END AS gram FROM (SELECT t, copies, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM a WHERE len(words) > 0) z),
  tf AS (SELECT t, gram, count(*) AS tf, min(copies) AS copies FROM g GROUP BY t, gram), n AS (SELECT count(*) AS n, greatest(2.0, 0.005 * count(*)) AS floor FROM d), df AS (SELECT gram, sum(copies) AS df FROM tf GROUP BY gram),
  wt AS (SELECT t, tf.gram, tf * CASE WHEN df > floor THEN 0.8 + 0.2 * ln(n / CAST(df AS DOUBLE)) / ln(n / floor) ELSE 1.0 END AS w FROM tf JOIN df ON df.gram = tf.gram CROSS JOIN n), total AS (SELECT t, sum(w) AS w FROM wt GROUP BY t),
  pr AS (SELECT a.t AS a, b.t AS b, sum(least(a.w, b.w)) AS shared FROM wt a JOIN wt b ON a.gram = b.gram AND a.t < b.t GROUP BY a.t, b.t), lk AS (SELECT a, b FROM pr JOIN total x ON x.t = a JOIN total y ON y.t = b WHERE shared / (x.w + y.w - shared) >= 0.8 - 1e-12),
  e AS (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk), c(t, root) AS (SELECT t, t FROM u UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.t), o AS (SELECT c.t, min(v.first) AS class FROM c JOIN u v ON v.t = c.root GROUP BY c.t)
  SELECT d.doc_id, CASE WHEN o.class < 9223372036854775807 THEN o.class END AS class_id, u.copies FROM d JOIN u ON u.text = d.text JOIN o ON o.t = u.t"""


def queries(of: dict[str, Callable[[SparkSession, str], DataFrame]]) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries, from the registered ones of the operators."""
    def part(name: str, *columns: str, digits: tuple[str, int] | None = None) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            rows = of[name](spark, sf_dir).select("doc_id", *columns)
            return rows if digits is None else rows.withColumn(digits[0], F.round(*digits))

        return run

    return {
        "mix_targets": part("op2_pareto_mix", "size", "source_size", "target", digits=("target", 3)),
        "quality_counts": part("op4_mcd_quality", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"),
        "secret_base_spans": part("op5_linked_secrets", "n_assign", "n_access", "n_hex", "base_sha256"),
        "edited_texts": part("op6_spotsigs", "n_chars", "edited_sha256"),
        "base_scores": part("op7_pitman_yor", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", digits=("base_score", 4)),
    }


def oracle_sql() -> dict[str, str]:
    return {"mix_targets": MIX, "quality_counts": QUALITY, "secret_base_spans": SECRETS, "edited_texts": EDITS, "base_scores": BASE_SCORES, "op1_weighted_minhash": NEAR, "op10_recompression": REPEATS}
