"""DuckDB SQL for the queries that SQL can express on whole tables."""

from . import lines, resample

QUALITY_RULES = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
    row_number() OVER () AS r
  FROM documents
),
win AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)
),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cover AS (
  SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
),
ln AS (
  SELECT r, host, t, len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words,
    trim(regexp_replace(regexp_replace(lower(x), '\p{{Nd}}', '0', 'g'), '[^\p{{L}}\p{{M}}0]+', ' ', 'g')) AS line
  FROM (SELECT r, host, t, unnest(l) AS x FROM d)
),
held AS (SELECT host, line, count(DISTINCT t) AS documents FROM ln WHERE line <> '' GROUP BY ALL),
hosts AS (SELECT host, count(DISTINCT t) AS total FROM d GROUP BY ALL),
frequent AS (
  SELECT host, line FROM held JOIN hosts USING (host)
  WHERE documents >= {lines.MIN_DOCUMENTS} AND 100 * documents >= {lines.HOST_PERCENT} * total
),
gone AS (SELECT r, sum(words) AS removed FROM ln JOIN frequent USING (host, line) GROUP BY r),
base AS (
  SELECT d.r, doc_id, len(w)::BIGINT AS n_words,
    length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
    coalesce(gone.removed, 0)::BIGINT AS removed_words
  FROM d LEFT JOIN cover ON cover.r = d.r LEFT JOIN gone ON gone.r = d.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words,
  (n_words < {lines.MIN_WORDS} OR 100 * n_repeat_words > {lines.MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {lines.MIN_WORDS} OR 100 * n_repeat_words > {lines.MAX_REPEAT_PERCENT} * n_words)
    AND 100 * (n_words - removed_words) >= {lines.KEEP_PERCENT} * n_words AS kept
FROM base
"""

_ESCAPED = r"regexp_replace({}, '([\\<\[{}])', '\\\1', 'g')"
_CHAT_SEGMENT = f"'<|turn|>' || {_ESCAPED.format('role', chr(92) + 'n')} || chr(10) || {_ESCAPED.format('text', '')} || '<|end|>' || chr(10)"

CHAT_FORMAT = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
),
s AS (
  SELECT *, length({_CHAT_SEGMENT}) AS chars FROM t
),
p AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto
  FROM s
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  (count(*) FILTER (role = 'assistant'))::BIGINT AS n_examples,
  coalesce(sum(upto) FILTER (role = 'assistant'), 0)::BIGINT AS example_chars
FROM p GROUP BY conv_id
"""

EXACT_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e, row_number() OVER () AS r
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
p AS (
  SELECT q.vec_id AS query_id, q.r, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0
),
o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS place FROM p)
SELECT query_id, place::INTEGER AS rank, vec_id, score FROM o WHERE place <= 5
"""

# a crc32 step for each byte, by a table made from the polynomial
_CRC_TABLE = """
crc_table AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS entries
  FROM (SELECT unnest(range(256))::BIGINT AS i)
)"""
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {bytes}),
    lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])))"""

# the cheapest of several ways, each a cost, an audit and the repaired lines
_LEAST = "list_sort(list_filter([{}], lambda x: x.c IS NOT NULL))[1]"


def _way(cost: str, letter: str, rest: str, line: str = "") -> str:
    lines = f"list_prepend({line}, {rest}.l)" if line else f"{rest}.l"
    return f"{{{{'c': {rest}.c + {cost}, 'a': '{letter}' || {rest}.a, 'l': {lines}}}}}".replace("{{", "{").replace("}}", "}")


def _row(state: str, to: str, role: str, system: bool = False) -> str:
    """The best edit of a row in a state, before any insertion."""
    stays = "CASE WHEN f IN ('blank', 'duplicate') THEN NULL WHEN f = 'truncated' THEN 5 ELSE 0 END"
    ways = [
        _way("2", "D", f"p.{state}"),
        _way(f"CASE WHEN i = '{role[0]}' THEN {stays} END", "K", f"p.{to}", "role || ':' || text"),
        _way(f"1 + {stays}", "R", f"p.{to}", f"'{role}:' || text"),
    ]
    if system:
        ways.append(_way(f"CASE WHEN i = 's' THEN {stays} END", "K", "p.vs", "role || ':' || text"))
    return _LEAST.format(", ".join(ways))


def _inserted(state: str, to: str, role: str) -> str:
    return _LEAST.format(f"b.{state}, {_way('5', 'I', to, chr(39) + role + ':' + chr(39))}")


CONVERSATION_REPAIR = rf"""
WITH RECURSIVE {_CRC_TABLE},
t AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
),
dealt AS (
  SELECT conv_id, turn, role, text,
    {_CRC.format(bytes="list_transform(string_split(k, ''), lambda x: ord(x)::BIGINT)")} % 20 AS kind
  FROM t, crc_table
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM dealt WHERE kind <> 0
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged
),
rows_of AS (
  SELECT *, substr(role, 1, 1) AS i,
    CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS f,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS pos,
    count(*) OVER (PARTITION BY conv_id) AS n FROM placed
),
stated AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (f = 'blank') AS blank,
    count(*) FILTER (f = 'duplicate') AS duplicate, count(*) FILTER (f = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS pair FROM rows_of) GROUP BY conv_id
),
p AS (
  SELECT conv_id, n + 1 AS pos, {{'c': 0::BIGINT, 'a': '', 'l': []::VARCHAR[]}} AS v0,
    {{'c': 10::BIGINT, 'a': 'II', 'l': ['user:', 'assistant:']}} AS vs,
    {{'c': 5::BIGINT, 'a': 'I', 'l': ['assistant:']}} AS vu, {{'c': 0::BIGINT, 'a': '', 'l': []::VARCHAR[]}} AS va
  FROM (SELECT DISTINCT conv_id, n FROM rows_of)
  UNION ALL
  SELECT conv_id, pos, {_inserted("b0", "vu", "user")}, {_inserted("bs", "vu", "user")}, vu, {_inserted("ba", "vu", "user")}
  FROM (
    SELECT *, {_inserted("bu", "b.ba", "assistant")} AS vu FROM (
      SELECT r.conv_id, r.pos, {_row("v0", "vu", "user", system=True)} AS b0, {_row("vs", "vu", "user")} AS bs,
        {_row("vu", "va", "assistant")} AS bu, {_row("va", "vu", "user")} AS ba
      FROM p JOIN rows_of r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.pos = p.pos - 1
    ) AS b
  ) AS b
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v0.c, 0)::BIGINT AS cost, coalesce(v0.a, '') AS audit,
  sha256(coalesce(array_to_string(v0.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN stated ON stated.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM o.conv_id AND p.pos = 1
"""

_FEATURES = """
  SELECT r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
    || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM {}"""
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HEX = "instr('123456789ABCDEF', h[{}])"

IMPORTANCE_RESAMPLING = rf"""
WITH {_CRC_TABLE},
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, '{resample.WORD}') AS w FROM documents
),
b AS (SELECT row_number() OVER () AS r, regexp_extract_all({_LOWERED}, '{resample.WORD}') AS w FROM benchmark),
df AS ({_FEATURES.format("d")}),
bf AS ({_FEATURES.format("b")}),
named AS (SELECT DISTINCT g FROM (SELECT g FROM df UNION ALL SELECT g FROM bf)),
bytes_of AS (
  SELECT g, list_transform(range(1, len(h), 2), lambda i: ({_HEX.format("i")} * 16 + {_HEX.format("i + 1")})::BIGINT) AS x
  FROM (SELECT g, hex(encode(g)) AS h FROM named)
),
bucket AS (SELECT g, {_CRC.format(bytes="x")} % {resample.BUCKETS} AS k FROM bytes_of, crc_table),
s AS (SELECT k, count(*) AS s FROM df JOIN bucket USING (g) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM bf JOIN bucket USING (g) GROUP BY k),
gain AS (
  SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + {resample.BUCKETS})::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bf) + {resample.BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM (SELECT unnest(range({resample.BUCKETS})) AS k) LEFT JOIN s USING (k) LEFT JOIN t USING (k)
),
weighed AS (SELECT r, count(*) AS n, sum(gain) AS weight FROM df JOIN bucket USING (g) JOIN gain USING (k) GROUP BY r),
keyed AS (
  SELECT doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(sha256('{resample.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8), ''),
      lambda c: instr('123456789abcdef', c)::BIGINT)), lambda a, c: a * 16 + c) AS h
  FROM d LEFT JOIN weighed USING (r)
),
scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score,
    words >= {resample.LEAST_WORDS} AS able FROM keyed
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST) AS place,
    {resample.PERCENT} * count(*) OVER (PARTITION BY able) // 100 AS drawn FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= drawn THEN place END::BIGINT AS rank FROM placed
"""
