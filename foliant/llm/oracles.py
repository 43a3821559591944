"""DuckDB SQL for the queries that it can express, over whole tables and texts; strings stand where the operators hash."""

from foliant.llm import folding, op4_quality, op6_jaccard, op9_decontamination, op10_templates, op11_infill, op12_codes, op13_warc

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"
_ALPHANUMERIC = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str, kind: str = _WORD) -> str:
    return f"regexp_extract_all({text}, '{kind}')"


def _classes(texts: str) -> str:
    """CTEs that end in cls (grp, t, label) for the texts (grp, t) of the table ``texts``: near copies have one label. All pairs
    that share a window are compared here, whatever their sketches."""
    return f"""kw AS (SELECT grp, t, md5(t) AS own, {_words("t")} AS w FROM (SELECT DISTINCT grp, t FROM {texts})),
  ks AS (SELECT grp, own, list_distinct(list_transform(range(1, greatest(len(w) - {folding.SHINGLE - 2}, 2)), lambda i: array_to_string(w[i:i + {folding.SHINGLE - 1}], ' '))) AS s FROM kw WHERE len(w) > 0),
  kx AS (SELECT grp, own, len(s) AS n, unnest(s) AS g FROM ks),
  kp AS (SELECT a.grp, a.own, b.own AS f_own FROM kx a JOIN kx b ON a.grp IS NOT DISTINCT FROM b.grp AND a.g = b.g AND a.own > b.own GROUP BY a.grp, a.own, b.own, a.n, b.n HAVING 100 * count(*) >= {folding.PERCENT} * (a.n + b.n - count(*))),
  kl AS (SELECT grp, own, min(f_own) AS label FROM kp GROUP BY grp, own),
  cls AS (SELECT kw.grp, kw.t, coalesce(up.label, kl.label, kw.own) AS label FROM kw LEFT JOIN kl ON kw.grp IS NOT DISTINCT FROM kl.grp AND kw.own = kl.own LEFT JOIN kl up ON kl.grp IS NOT DISTINCT FROM up.grp AND kl.label = up.own)"""


LINE_FREQUENCY = f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_words("coalesce(text, '')")} AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
  win AS (SELECT doc_id, i, array_to_string(w[i:i + {op4_quality.WINDOW - 1}], ' ') AS s FROM d, unnest(range(1, len(w) - {op4_quality.WINDOW - 2})) u(i)),
  twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
  rep AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM twice, range({op4_quality.WINDOW}) r(j) GROUP BY doc_id),
  line AS (SELECT doc_id, source, t, x, trim(regexp_replace(lower(x), '{_SPACE}', ' ', 'g'), ' ') AS h FROM (SELECT doc_id, source, t, unnest(lines) AS x FROM d) WHERE regexp_matches(x, '{_WORD}')),
  dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines FROM line GROUP BY doc_id),
  often AS (SELECT source, h FROM line GROUP BY source, h HAVING count(DISTINCT t) > {op4_quality.LINE_DOCS}),
  holder AS (SELECT DISTINCT line.source AS grp, t, line.h FROM line JOIN often ON line.source IS NOT DISTINCT FROM often.source AND line.h = often.h),
  {_classes("holder")},
  freq AS (SELECT holder.grp AS source, h FROM holder JOIN cls ON holder.grp IS NOT DISTINCT FROM cls.grp AND holder.t = cls.t GROUP BY holder.grp, h HAVING count(DISTINCT label) > {op4_quality.LINE_DOCS}),
  gone AS (SELECT doc_id, sum(len({_words("x")}))::BIGINT AS words_removed FROM line JOIN freq ON line.source IS NOT DISTINCT FROM freq.source AND line.h = freq.h GROUP BY doc_id),
  b AS (SELECT d.doc_id, len(w) AS n_words, length(translate(t, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ', '')) AS word_chars, length(t) - length(translate(t, '{op4_quality.SYMBOLS}', '')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(words_removed, 0) AS words_removed
    FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id)),
  f AS (SELECT *, n_words < {op4_quality.MIN_WORDS} OR 100 * n_repeat_words > {op4_quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b)
  SELECT *, NOT base_failed AND NOT (words_removed > 0 AND (n_words - words_removed < {op4_quality.LEFT_WORDS} OR n_words - words_removed < {op4_quality.LEFT_SHARE}::DOUBLE * n_words)) AS kept FROM f"""

PARTENUM_JOIN = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce({_words(_LOWER.format("text"))}, []) AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {op6_jaccard.SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {op6_jaccard.SHINGLE - 2}), lambda i: array_to_string(w[i:i + {op6_jaccard.SHINGLE - 1}], ' '))) END AS s FROM d),
  x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {op6_jaccard.PERCENT} * (a.n + b.n - count(*))),
  e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
  r(doc_id, reached) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a)
  SELECT doc_id, len(s) AS n_shingles, component_id FROM s JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) USING (doc_id)"""

POSITIONAL_INDEX = f"""WITH d AS (SELECT doc_id, coalesce({_words(_LOWER.format("text"), _ALPHANUMERIC)}, []) AS w FROM documents),
  b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words(_LOWER.format("text"), _ALPHANUMERIC)} AS w FROM benchmark),
  q AS (SELECT DISTINCT item, least(len(w), {op9_decontamination.WINDOW}) AS n, array_to_string(w[i:i + {op9_decontamination.WINDOW - 1}], ' ') AS s FROM b, unnest(range(1, greatest(len(w) - {op9_decontamination.WINDOW - 2}, 2))) u(i) WHERE len(w) > 0),
  n AS (SELECT DISTINCT n FROM q),
  win AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM d, n, unnest(range(1, len(w) - n + 2)) u(i)),
  found AS (SELECT doc_id, item, win.n, i FROM win JOIN q ON win.n = q.n AND win.s = q.s),
  hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM found, range({op9_decontamination.WINDOW}) r(j) WHERE j < n GROUP BY doc_id),
  items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY doc_id)
  SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

LINE_TEMPLATES = f"""WITH d AS (SELECT doc_id, text, coalesce(text, '') AS t FROM documents),
  raw AS (SELECT doc_id, t, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
  line AS (SELECT *, list_transform(string_split(trim(regexp_replace(x, '{_SPACE}', ' ', 'g'), ' '), ' '), lambda v: CASE WHEN regexp_matches(v, '[0-9]') THEN '{op10_templates.ANY}' ELSE v END) AS m FROM raw),
  held AS (SELECT DISTINCT t, m, (len(m) || ' ' || array_to_string(m[1:{op10_templates.LEADING}], ' ')) AS leaf FROM line WHERE m[1] <> ''),
  busy AS (SELECT leaf FROM held GROUP BY leaf HAVING count(DISTINCT t) >= {op10_templates.MIN_DOCS}),
  lines AS (SELECT leaf, m, count(*) AS docs FROM held JOIN busy USING (leaf) GROUP BY leaf, m),
  tok AS (SELECT leaf, m, docs, unnest(m) AS token, generate_subscripts(m, 1) AS pos FROM lines),
  fixed AS (SELECT leaf, pos, token FROM tok WHERE token <> '{op10_templates.ANY}' GROUP BY leaf, pos, token HAVING sum(docs) >= {op10_templates.MIN_DOCS}),
  kept AS (SELECT leaf, m, leaf || chr(10) || string_agg(pos || ' ' || token, chr(10) ORDER BY pos) AS template FROM tok JOIN fixed USING (leaf, pos, token) GROUP BY leaf, m HAVING count(*) >= {op10_templates.SIMILARITY}::DOUBLE * len(m)),
  holder AS (SELECT DISTINCT 0 AS grp, t, template FROM held JOIN kept USING (leaf, m)),
  {_classes("holder")},
  recur AS (SELECT template FROM holder JOIN cls USING (t) GROUP BY template HAVING count(DISTINCT label) >= {op10_templates.MIN_DOCS}),
  out AS (SELECT doc_id, x, i, kept.m IS NOT NULL AS gone FROM line LEFT JOIN (SELECT m FROM kept JOIN recur USING (template)) kept ON line.m = kept.m)
  SELECT doc_id, CASE WHEN bool_or(gone) THEN coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone), '') ELSE any_value(text) END AS text, count(*) FILTER (regexp_matches(x, '{_WORD}')) AS n_lines,
    count(*) FILTER (gone) AS n_dropped, coalesce(sum(len({_words("x")})) FILTER (gone), 0)::BIGINT AS dropped_words FROM out JOIN d USING (doc_id) GROUP BY doc_id"""

INFILL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('{op11_infill.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
  r AS (SELECT doc_id, t, n, {", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))} FROM d),
  c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '{op11_infill.PREFIX}') OR contains(t, '{op11_infill.SUFFIX}') OR contains(t, '{op11_infill.MIDDLE}') OR h3 % 100 >= {100 - op11_infill.PLAIN_PERCENT} THEN 'plain'
      WHEN h4 % 100 < {op11_infill.SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM r),
  p AS (SELECT *, substr(t, 1, a) AS x, substr(t, a + 1, b - a) AS y, substr(t, b + 1) AS z FROM c)
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '{op11_infill.PREFIX}' || x || '{op11_infill.SUFFIX}' || z || '{op11_infill.MIDDLE}' || y WHEN 'spm' THEN '{op11_infill.SUFFIX}' || z || '{op11_infill.PREFIX}' || x || '{op11_infill.MIDDLE}' || y ELSE t END) AS output_sha256,
    sha256(t) AS restored_sha256 FROM p"""

_DIST = "list_sum(list_transform(range(1, len(x) + 1), lambda j: (x[j] - c[j]) * (x[j] - c[j])))"
_ASSIGN = "{1} AS (SELECT vec_id, p, arg_min(e, d * {2} + e) AS e, min(d) AS d FROM (SELECT v.vec_id, v.p, b.e, {3} AS d FROM v JOIN {0} b USING (p)) GROUP BY vec_id, p)"
_MOVE = """{1}_s AS (SELECT v.p, a.e, j, sum(x[j])::BIGINT AS t, count(*) AS n FROM v JOIN {1} a USING (vec_id, p), unnest(range(1, len(x) + 1)) u(j) GROUP BY v.p, a.e, j),
  {1}_m AS (SELECT p, e, list((t - ((t % n) + n) % n) // n ORDER BY j) AS c FROM {1}_s GROUP BY p, e),
  {2} AS (SELECT p, e, coalesce(m.c, b.c) AS c FROM {0} b LEFT JOIN {1}_m m USING (p, e))"""


def _lloyd(rounds: int) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(_ASSIGN.format(f"b{i}", f"a{i}", op12_codes.ENTRIES, _DIST))
        if i < rounds:
            steps.append(_MOVE.format(f"b{i}", f"a{i}", f"b{i + 1}"))
    return ",\n  ".join(steps)


VECTOR_CODES = f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda y: floor({op12_codes.SCALE} * y::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0),
  v AS (SELECT vec_id, p, q[len(q) // {op12_codes.PARTS} * p + 1:len(q) // {op12_codes.PARTS} * (p + 1)] AS x FROM k, range({op12_codes.PARTS}) r(p)),
  b0 AS (SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, x AS c FROM v WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {op12_codes.ENTRIES})),
  {_lloyd(op12_codes.ROUNDS)},
  coded AS (SELECT vec_id, string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{op12_codes.ROUNDS} GROUP BY vec_id),
  digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{op12_codes.ROUNDS})
  SELECT vec_id, lower(code) AS code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN k USING (vec_id), digest"""

WARC_MEMBERS = f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
  f AS (SELECT *, CASE WHEN payload_bytes >= {op13_warc.MIN_PAYLOAD} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
  SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f"""
