"""DuckDB SQL for the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP2 = f"""
WITH lines AS (SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)),
keyed AS (SELECT *, translate(trim(line, {_SPACE}), '{_UPPER}', '{_LOWER}') AS key FROM lines),
shared AS (SELECT key FROM keyed WHERE key <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(s.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (s.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN shared s ON s.key = k.key GROUP BY 1
"""

OP7 = rf"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {_SPACE}) <> '') AS l FROM documents),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
twice AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM twice GROUP BY 1),
base AS (SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed FROM w LEFT JOIN repeats r USING (doc_id)),
hosts AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS bad FROM base GROUP BY 1),
moments AS (SELECT sum(bad) / sum(n) AS m, sum(bad * bad / n) / sum(n) AS square, count(*) / sum(n) AS noise FROM hosts),
prior AS (SELECT m, greatest(m * (1 - m) / greatest(square - m * m - m * (1 - m) * noise, 1e-9) - 1, 1) AS strength FROM moments),
rates AS (SELECT host, (bad + m * strength) / (n + strength) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.75 AS kept, round(rate, 6) AS host_rate FROM base JOIN rates USING (host)
"""

OP8 = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS x FROM w, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS i)),
later AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY x) AS first FROM windows) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM later),
words AS (SELECT doc_id, p, w[p] AS word FROM w, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""

OP9 = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_transform({_WORDS}, lambda x: translate(x, '{_UPPER}', '{_LOWER}')) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 1, CAST(len(w) > 0 AS INT) + 1))) AS i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(doc_id, coalesce(min(reach.b), doc_id)) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = doc_id GROUP BY 1
"""

_ESCAPED = r"replace(replace({0}, '\', '\\'), '<|', '<\|')"
OP10 = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(length('<|im_start|>') + length(replace({_ESCAPED.format('role')}, chr(10), '\n')) + length({_ESCAPED.format('text')}) + length('<|im_end|>') + 2) AS BIGINT) AS formatted_chars
FROM t GROUP BY 1
"""


def _op11(k: int = 8, rounds: int = 10) -> str:
    """Lloyd's rounds, one after the other."""
    far = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, min({{'d': CAST({far} AS BIGINT), 'c': c.c}}) AS m FROM kept x, c{i} c GROUP BY 1)")
        if i < rounds:
            mean = "(s - ((s % n) + n) % n) // n"
            steps.append(f"s{i} AS (SELECT m.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{i} JOIN kept USING (r), range(1, 65) t(i) GROUP BY 1, 2)")
            steps.append(f"m{i} AS (SELECT c, list(CAST({mean} AS BIGINT) ORDER BY i) AS v FROM s{i} GROUP BY 1)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN m{i} m USING (c))")
    return f"""
WITH kept AS MATERIALIZED (
SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v FROM kept QUALIFY c < {k}),
{", ".join(steps)}
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} c ON c.c = m.c
"""


OP11 = _op11()

_CRC_STEP = "CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END"

OP12 = f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda a, b: {_CRC_STEP}, i)) AS t),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents),
counted AS (SELECT id, run, count(*) AS times FROM runs WHERE length(run) >= 6 GROUP BY 1, 2),
bytes AS (SELECT *, hex(encode(id || ':' || run)) AS x FROM counted),
hashed AS (SELECT run, times, xor(list_reduce(list_transform(range(1, len(x), 2), lambda i: CAST('0x' || x[i:i + 1] AS BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS h FROM bytes, crc),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, times FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY 1 HAVING sum(times) >= 5),
less AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS part FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b USING (i, part) WHERE a.word <> b.word UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON b.word = a.part UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON b.word = a.part),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS most, arg_min(other, (-other_n, other)) AS form FROM near GROUP BY 1),
told AS MATERIALIZED (SELECT word, CASE WHEN most >= 5 * n THEN form END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * n THEN most END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS spot FROM told UNION ALL SELECT chain.word, told.form FROM chain JOIN told ON told.word = chain.spot WHERE told.form IS NOT NULL),
roots AS (SELECT chain.word, spot AS root FROM chain JOIN told ON told.word = chain.spot WHERE told.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM told JOIN roots USING (word)
"""
