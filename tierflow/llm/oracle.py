"""Checking SQL of the training-data queries, where SQL can express them."""

from __future__ import annotations

from tierflow.llm import systematic_mix as mix
from tierflow.llm.quality_rules import THRESHOLDS, stop_forms

WORD = r"[^\x20\x09-\x0D]+"


def quality_rules() -> str:
    limits = [f"{t.measure} >= {t.low}" for t in THRESHOLDS if t.low is not None]
    limits += [f"{t.measure} <= {t.high}" for t in THRESHOLDS if t.high is not None]
    stop = ", ".join(f"'{w}'" for w in stop_forms())
    ratio = lambda a, b: f"case when {b} = 0 then 0.0 else {a}::double / {b} end"
    return f"""
WITH src AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '{WORD}') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM src),
placed AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM parts),
starts AS (
  SELECT r, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS g
  FROM placed WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM starts WHERE g IS NOT NULL) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 5) AS g(k) GROUP BY r),
base AS (
  SELECT doc_id, len(w)::bigint AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols,
         (len(l) - len(list_distinct(l)))::bigint AS n_dup_lines, coalesce(n, 0)::bigint AS n_repeat_words,
         len(list_filter(w, lambda x: x IN ({stop})))::bigint AS n_stop, len(l)::bigint AS n_lines,
         (length(t) - length(replace(t, '!', '')))::bigint AS n_shouts
  FROM parts LEFT JOIN covered USING (r)),
rates AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         {ratio("word_chars", "n_words")} AS mean_word_chars, {ratio("n_symbols", "word_chars")} AS symbol_ratio,
         {ratio("n_dup_lines", "n_lines")} AS dup_line_ratio, {ratio("n_repeat_words", "n_words")} AS repeat_ratio,
         {ratio("n_stop", "n_words")} AS stop_ratio, {ratio("n_shouts", "n_words")} AS shout_ratio
  FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(limits)} AS kept, n_stop, n_lines, n_shouts
FROM rates"""


def systematic_mix() -> str:
    number = lambda x: f"('0x' || substr(md5({x}), 1, 15))::bigint"
    weights = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mix.WEIGHTS))
    return f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint AS size FROM documents),
per AS (
  SELECT source, sum(size)::bigint AS source_size, count(*) AS docs,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mix.WEIGHTS)} {weights} END AS w
  FROM d GROUP BY source),
lim AS (SELECT *, {mix.MOST_COPIES} * source_size AS cap FROM per),
run AS (
  SELECT *, (sum(source_size) OVER ())::bigint - coalesce(sum(cap) OVER o, 0)::bigint AS rest,
         (sum(w) OVER ())::bigint - coalesce(sum(w) OVER o, 0)::bigint AS open
  FROM lim WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
shares AS (SELECT *, rest::double / open AS share, cap <= (rest::double / open) * w AS capped FROM run),
goal AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap::double
              ELSE (SELECT share FROM shares WHERE NOT capped ORDER BY cap / w, source NULLS LAST LIMIT 1) * w END AS target
  FROM shares),
classed AS (
  SELECT *, 8 * k + ((n << 3) >> k) - 8 AS class, {number("concat_ws('|', 0, doc_id, size)")} AS o
  FROM (SELECT *, size + 1 AS n, length(bin(size + 1)) - 1 AS k FROM d)),
parted AS (
  SELECT *, o % ceil(count(*) OVER (PARTITION BY source, class) / {float(mix.SLICE_ROWS)})::bigint AS part FROM classed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, part, o, doc_id NULLS LAST) AS i FROM parted),
rated AS (
  SELECT p.*, source_size, target,
         CASE WHEN source_size = 0 THEN 0 ELSE least({mix.MOST_COPIES * mix.UNIT}, floor(target * {mix.UNIT} / source_size))::bigint END AS rate,
         {number("concat_ws('|', 0, coalesce('s' || p.source, ''))")} % {mix.UNIT} AS u
  FROM placed p JOIN goal g ON p.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       ((i * rate + u) // {mix.UNIT} - ((i - 1) * rate + u) // {mix.UNIT}) * size AS taken
FROM rated"""


def extendible(limit: int) -> str:
    return f"""
WITH d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::bigint AS bytes,
         lpad(bin(('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 15))::bigint), 60, '0') AS bits FROM documents),
nodes AS (
  SELECT substr(bits, 1, depth) AS prefix, depth::integer AS depth, sum(bytes)::bigint AS bytes, count(*) AS n
  FROM d, range(0, 61) AS g(depth) GROUP BY ALL),
shards AS (
  SELECT a.* FROM nodes a LEFT JOIN nodes p ON p.depth = a.depth - 1 AND p.prefix = substr(a.prefix, 1, a.depth - 1)
  WHERE (a.bytes <= {limit} OR a.n = 1) AND (a.depth = 0 OR (p.bytes > {limit} AND p.n > 1)))
SELECT doc_id, d.bytes, prefix AS shard, depth AS shard_depth, shards.bytes AS shard_bytes
FROM d JOIN shards ON substr(bits, 1, depth) = prefix"""


CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) g(i)),
n AS (
  SELECT *, row_number() OVER o - 1 AS i, lag(role) OVER o AS before, lead(role) OVER o IS NULL AS final,
         replace(replace(text, '\', '\\'), '<|', '<\|') AS inside
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>' || role || chr(10) || inside || '<|im_end|>' || chr(10)))::bigint AS formatted_chars,
       min(i) FILTER (NOT fits) IS NULL AND bool_or(final AND role = 'assistant') AS valid,
       min(i) FILTER (NOT fits)::bigint AS first_error
FROM (SELECT *, coalesce(before, 'start') || '>' || role IN ('start>system', 'start>user', 'system>user', 'user>assistant',
             'assistant>user', 'assistant>tool', 'tool>assistant', 'tool>tool') AS fits FROM n)
GROUP BY conv_id"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::integer AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""

NEAR_DUPLICATES = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
x AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
g AS (
  SELECT doc_id, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS s
  FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
sh AS (
  SELECT DISTINCT doc_id, s FROM g WHERE s IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 75 * (any_value(na.n) + any_value(nb.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, c.b AS component_id, w.doc_id = c.b AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) c ON c.a = w.doc_id"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, octet_length(encode(h))::bigint AS payload_bytes,
       (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ('0b' || substr(b, 5 * i + 1, 5))::integer, 1), '' ORDER BY i)
        FROM (SELECT string_agg(lpad(bin(('0x' || substr(sha1(h), 4 * j + 1, 4))::integer), 16, '0'), '' ORDER BY j) AS b FROM range(10) r(j)), range(32) g(i)) AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM m"""

FILL_IN_MIDDLE = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(doc_id::varchar, '')) AS h
  FROM documents),
numbers AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::ubigint AS h1, ('0x' || h[9:16])::ubigint AS h2, ('0x' || h[17:24])::ubigint AS h3, ('0x' || h[25:32])::ubigint AS h4
  FROM units),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1))::bigint AS i, greatest(h1 % (n + 1), h2 % (n + 1))::bigint AS j,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers),
parts AS (
  SELECT *, array_to_string(u[1:i], '') AS head, array_to_string(u[i + 1:j], '') AS middle, array_to_string(u[j + 1:], '') AS tail FROM cuts)
SELECT doc_id, n::bigint AS n, form, CASE WHEN form <> 'plain' THEN length(head) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || middle ELSE '<S>' || tail || '<P>' || head || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""

DECONTAMINATION = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT coalesce(item_id::varchar, '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
sizes AS (SELECT item, w, least(10, len(w)) AS k FROM items WHERE len(w) > 0),
starts AS (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM sizes),
windows AS (SELECT DISTINCT item, k, array_to_string(w[p:p + k - 1], ' ') AS gram FROM starts),
kinds AS (SELECT DISTINCT k FROM windows),
places AS (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM docs JOIN kinds ON len(w) >= k),
grams AS (SELECT rid, k, p, array_to_string(w[p:p + k - 1], ' ') AS gram FROM places),
found AS (SELECT rid, item, k, p FROM grams JOIN windows USING (k, gram)),
hits AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(p, p + k)) AS place FROM (SELECT DISTINCT rid, k, p FROM found)) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (rid) LEFT JOIN named USING (rid)
"""
