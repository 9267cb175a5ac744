"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BENCHMARK_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = rf"""
WITH items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BENCHMARK_WORD}') AS w
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS win
  FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM items WHERE len(w) > 0)
), d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BENCHMARK_WORD}') AS w
  FROM documents
), widths AS (
  SELECT DISTINCT n FROM item_windows
), doc_windows AS (
  SELECT rid, n, i, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, widths WHERE len(w) >= n)
), hits AS (
  SELECT rid, i, n, item FROM doc_windows JOIN item_windows USING (n, win)
), words AS (
  SELECT rid, count(DISTINCT i + k) AS n_hit FROM hits, range(10) AS o(k) WHERE k < n GROUP BY rid
), found AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN found USING (rid)
"""

URL_FILTERS = rf"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1) ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), lowered AS (
  SELECT page_id, translate(coalesce(host, ''), '{UPPER}', '{LOWER}') AS host, coalesce(path, '') AS path
  FROM parts
), rules(rule_host, rule_path, action) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
         ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), numbered AS (
  SELECT row_number() OVER () AS rid, * FROM lowered
), best AS (
  SELECT rid, arg_max(rule_host || rule_path, [length(rule_host), length(rule_path)]) AS rule,
         arg_max(action, [length(rule_host), length(rule_path)]) AS action
  FROM numbered JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY rid
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM numbered LEFT JOIN best USING (rid)
"""

LINE_QUALITY = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS w
  FROM documents
), wins AS (
  SELECT rid, i, list_slice(w, i, i + 7) AS win
  FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM wins) WHERE n > 1
), repeated AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(8) AS o(k) GROUP BY rid
), lines AS (
  SELECT rid, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS worded,
         length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS letters,
         length(line) - length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) + 1 AS blanks,
         (length(line) - length(replace(line, ' | ', ''))) // 3 + (length(line) - length(replace(line, ' > ', ''))) // 3
         + (length(line) - length(replace(line, ' » ', ''))) // 3 + (length(line) - length(replace(line, ' · ', ''))) // 3 AS marks,
         length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols,
         (length(line) - length(replace(line, '!!', ''))) // 2 AS shouts
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
), judged AS (
  SELECT *, letters > 0 AND (marks >= 2 OR symbols * 100 >= letters * 10
    OR (shouts >= 3 AND shouts * 100 >= blanks * 20)
    OR (blanks >= 25 AND NOT regexp_matches(line, '[.!?:;…。！？：；｡؟؛۔।॥։።፣፤፥፧፨၊။។៕།༎]'))
    OR blanks < 25 AND regexp_matches(lower(line), 'all rights reserved|cookie policy|privacy policy|terms of service|terms of use|enable javascript|click here|subscribe to our|sign up for|log in to|skip to content|powered by|follow us on|share this page')) AS bad
  FROM lines
), per_line AS (
  SELECT rid, count(*) FILTER (worded) - count(DISTINCT line) FILTER (worded) AS n_dup_lines,
         coalesce(sum(letters) FILTER (bad), 0) AS lost
  FROM judged GROUP BY rid
), measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         n_dup_lines::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, lost
  FROM d LEFT JOIN per_line USING (rid) LEFT JOIN repeated USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost * 100 <= word_chars * 50 AS kept
FROM measured
"""

# The mix as one running sum per source, without the runs that Spark cuts it into.
MIXING = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || source, 'z') AS key,
         len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS o
  FROM documents
), sources AS (
  SELECT key, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY key) - 1) % 3] AS weight
  FROM d GROUP BY key
), ranked AS (
  SELECT *, source_size / weight AS ratio, sum(source_size) OVER () AS words, sum(weight) OVER () AS weights,
         coalesce(sum(source_size) OVER o, 0) AS words_before, coalesce(sum(weight) OVER o, 0) AS weights_before
  FROM sources
  WINDOW o AS (ORDER BY source_size / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (words::BIGINT * 150 / 100 - words_before::BIGINT * 2) / (weights - weights_before)::BIGINT AS level FROM ranked
), level AS (
  SELECT arg_min(level, row(ratio, key)) AS level FROM levels WHERE level <= ratio * 2
), targets AS (
  SELECT key, source_size, CASE WHEN l.level IS NULL THEN source_size * 2.0::DOUBLE
         ELSE least(weight * l.level, (source_size * 2)::DOUBLE) END AS target
  FROM sources, level l
), house AS (
  SELECT greatest(1, ceil(sum(target) / 10000))::BIGINT AS block FROM targets
), dealt AS (
  SELECT key, source_size, target, block > 1 AND target < block * 100 AS small,
         CASE WHEN block > 1 AND target < block * 100 THEN 1 ELSE block END AS block_words
  FROM targets, house WHERE target > 0
), sized AS (
  SELECT key, target, block_words, small, ceil(source_size / block_words)::BIGINT AS n_blocks,
         round(sum(target) OVER (PARTITION BY small) / block_words)::BIGINT AS seats
  FROM dealt
), quotients AS (
  SELECT key, n_blocks, block_words, seats, k,
         row_number() OVER (PARTITION BY small ORDER BY target / (k * 2 + 1) DESC, key, k) - 1 AS seat
  FROM (SELECT *, unnest(range(0, n_blocks * 2)) AS k FROM sized)
), turns AS (
  SELECT key, n_blocks, block_words, ('0x' || substr(md5('17:' || key), 1, 8))::BIGINT % n_blocks AS entry,
         count(*) // n_blocks AS laps, count(*) % n_blocks AS rest
  FROM quotients WHERE seat < seats GROUP BY key, n_blocks, block_words
), placed AS (
  SELECT *, sum(size) OVER (PARTITION BY key ORDER BY o, rid) - size AS start FROM d
)
SELECT doc_id, size, source_size, target,
       (coalesce(size * laps
        + greatest(0, least(start + size, least((entry + rest) * block_words, source_size)) - greatest(start, entry * block_words))
        + greatest(0, least(start + size, (entry + rest - n_blocks) * block_words) - start), 0))::BIGINT AS taken
FROM placed JOIN targets USING (key) LEFT JOIN turns USING (key)
"""

TOOL_CALLS = r"""
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, length(text) AS n, text,
         'call_' || conv_id || '_' || turn AS call_id,
         CASE WHEN length(text) % 19 = 0 THEN 'guess' WHEN length(text) % 2 = 0 THEN 'search' ELSE 'summarise' END AS name,
         list_filter([CASE WHEN turn >= 2 THEN turn - 2 END, CASE WHEN turn >= 4 AND length(text) % 5 = 0 THEN turn - 4 END,
                      CASE WHEN length(text) % 23 = 0 THEN turn + 1 END], lambda x: x IS NOT NULL) AS needs
  FROM conversations WHERE role = 'user'
), results AS (
  SELECT conv_id, turn, 'call_' || conv_id || '_' || (turn - 1) AS call_id, text AS content
  FROM conversations WHERE role = 'assistant'
), named AS (
  SELECT conv_id, turn, unnest(needs) AS need FROM calls
), linked AS (
  SELECT m.*, p.turn IS NOT NULL AS known
  FROM named m LEFT JOIN (SELECT conv_id, turn FROM calls) p ON p.conv_id = m.conv_id AND p.turn = m.need
), ways AS (
  SELECT conv_id, turn, 0 AS level FROM calls
  UNION
  SELECT l.conv_id, l.turn, level + 1 FROM linked l JOIN ways w ON l.known AND w.conv_id = l.conv_id AND w.turn = l.need
), levels AS (
  SELECT conv_id, turn, max(level) AS level FROM ways GROUP BY ALL
), lost AS (
  SELECT conv_id, turn, count(*) AS missing FROM linked WHERE NOT known GROUP BY ALL
), checked AS (
  SELECT *, CASE WHEN n % 7 = 0 THEN json_object('query', text)
                 WHEN n % 11 = 0 THEN json_object('limit', n::VARCHAR, 'query', text)
                 WHEN n % 13 = 0 THEN json_object('deep', true, 'limit', n, 'query', text)
                 WHEN n % 17 = 0 THEN NULL
                 ELSE json_object('limit', n, 'query', text) END::VARCHAR AS arguments,
         CASE WHEN n % 7 != 0 AND n % 11 != 0 AND n % 13 != 0 AND n % 17 = 0 THEN 'not_json'
              WHEN n % 19 = 0 THEN 'unknown_tool'
              WHEN n % 7 = 0 THEN 'missing:limit' WHEN n % 11 = 0 THEN 'type:limit'
              WHEN n % 13 = 0 THEN 'extra:deep' ELSE '' END AS errors
  FROM calls JOIN levels USING (conv_id, turn) LEFT JOIN lost USING (conv_id, turn)
)
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id,
       c.turn AS turn, r.turn AS result_turn,
       CASE WHEN c.turn IS NULL THEN 'no_call' WHEN r.turn IS NULL THEN 'no_result'
            WHEN r.turn <= c.turn THEN 'early' ELSE 'linked' END AS state,
       level, coalesce(missing, 0)::BIGINT AS missing, coalesce(errors, '') AS errors,
       coalesce(c.turn IS NOT NULL AND r.turn > c.turn AND errors = '' AND coalesce(missing, 0) = 0, false) AS valid,
       '{"arguments":' || coalesce(arguments, 'null') || ',"content":' || coalesce(to_json(content)::VARCHAR, 'null')
       || ',"id":"' || coalesce(c.call_id, r.call_id) || '","level":' || coalesce(level::VARCHAR, 'null')
       || ',"name":' || coalesce('"' || name || '"', 'null') || '}' AS message
FROM checked c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
"""

SUBSTRING_DEDUP = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS w
  FROM documents
), windows AS (
  SELECT rid, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS win
  FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), repeated AS (
  SELECT rid, i FROM windows JOIN (SELECT win FROM windows GROUP BY win HAVING count(*) > 1) USING (win)
), gone AS (
  SELECT DISTINCT rid, i + k AS i FROM repeated, range(35) AS o(k)
), lost AS (
  SELECT rid, list(i) AS gone FROM gone GROUP BY rid
), kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS words
  FROM (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d JOIN lost USING (rid)) ANTI JOIN gone USING (rid, i)
  GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE coalesce(words, '') END) AS kept_sha256
FROM d LEFT JOIN lost USING (rid) LEFT JOIN kept USING (rid)
"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf(*values: str) -> str:
    return "sha256(" + " || ".join(map(_field, values)) + ")"


MERKLE = f"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
), d AS (
  SELECT row_number() OVER () AS rid, coalesce('=' || lang, '') AS grp, *,
         list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                     lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)) AS crc
  FROM documents, crc_table
), placed AS (
  SELECT rid, doc_id, grp, leaf, presented,
         row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM (SELECT rid, doc_id, grp, {_leaf("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
               CASE WHEN xor(crc, 4294967295) % 7 = 0
                    THEN {_leaf("doc_id", "source", "lang", "(n_chars + 1)", "text")}
                    ELSE {_leaf("doc_id", "source", "lang", "n_chars", "text")} END AS presented
        FROM d)
), nodes(grp, lvl, pos, n, h) AS (
  SELECT grp, 0, pos, count(*) OVER (PARTITION BY grp), leaf FROM placed
  UNION ALL
  SELECT grp, any_value(lvl) + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY grp, pos // 2
), subroots AS (
  SELECT grp, h AS subroot, lvl AS height, row_number() OVER (ORDER BY grp) - 1 AS place
  FROM nodes WHERE n = 1
), crown(lvl, pos, n, h) AS (
  SELECT 0, place, count(*) OVER (), subroot FROM subroots
  UNION ALL
  SELECT any_value(lvl) + 1, pos // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY pos))
  FROM crown WHERE n > 1 GROUP BY pos // 2
), whole AS (
  SELECT h AS root, lvl AS crown_height FROM crown WHERE n = 1
), steps AS (
  SELECT rid, grp, height, place, pos, unnest(range(height + crown_height)) AS lvl
  FROM placed JOIN subroots USING (grp), whole
), turns AS (
  SELECT rid, grp, lvl, lvl - height AS above,
         CASE WHEN lvl < height THEN pos >> lvl ELSE place >> (lvl - height) END AS at
  FROM steps
), siblings AS (
  SELECT t.rid, t.lvl, t.at % 2 = 1 AS second, coalesce(n.h, c.h, '') AS h
  FROM turns t
  LEFT JOIN nodes n ON t.above < 0 AND n.grp = t.grp AND n.lvl = t.lvl AND n.pos = xor(t.at, 1)
  LEFT JOIN crown c ON t.above >= 0 AND c.lvl = t.above AND c.pos = xor(t.at, 1)
), folds(rid, lvl, h) AS (
  SELECT rid, 0::BIGINT, presented FROM placed
  UNION ALL
  SELECT f.rid, f.lvl + 1, sha256(CASE WHEN s.second THEN s.h || f.h ELSE f.h || s.h END)
  FROM folds f JOIN siblings s ON s.rid = f.rid AND s.lvl = f.lvl
), folded AS (
  SELECT rid, arg_max(h, lvl) AS folded_root FROM folds GROUP BY rid
), proofs AS (
  SELECT rid, string_agg(h, '' ORDER BY lvl) AS proof FROM siblings GROUP BY rid
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root,
       folded_root = root AS verified
FROM placed JOIN subroots USING (grp) JOIN folded USING (rid) LEFT JOIN proofs USING (rid), whole
"""

PHRASES = rf"""
WITH pieces AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), grams AS (
  SELECT lang, list_slice(w, i, i + size - 1) AS g
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words), range(1, 6) AS o(size)
  WHERE i + size - 1 <= len(w)
), f AS (
  SELECT lang, g, count(*) AS a FROM grams GROUP BY lang, g HAVING count(*) >= 100
), inner_phrases AS (
  SELECT lang, a, list_slice(g, i, i + size - 1) AS g
  FROM f, range(2, 5) AS o(size), range(1, 5) AS s(i)
  WHERE size < len(g) AND i + size - 1 <= len(g)
), covers AS (
  SELECT lang, g, max(a) AS longer FROM inner_phrases GROUP BY lang, g
), kept AS (
  SELECT lang, g, a FROM f LEFT JOIN covers USING (lang, g)
  WHERE len(g) > 1 AND (longer IS NULL OR 100 * longer < 100 * a)
), cuts AS (
  SELECT lang, g, a, k, list_slice(g, 1, k) AS first, list_slice(g, k + 1, len(g)) AS rest
  FROM kept, range(1, 5) AS o(k) WHERE k < len(g)
), scored AS (
  SELECT c.lang, c.g, c.a, k, x.a AS l, y.a AS r, n,
         ((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.first JOIN f y ON y.lang = c.lang AND y.g = c.rest
  JOIN totals t ON t.lang = c.lang
), lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS place FROM scored
), listed AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM lowest WHERE place = 1
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM listed)
WHERE rank <= 2000
"""
