"""The named queries in DuckDB SQL, written from the definitions alone."""

from __future__ import annotations

from passagedex.registry import ONE_QUERY

SPACE = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


def _tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{SPACE}'), lambda t: t <> '')"


def _fold(text: str) -> str:
    return f"array_to_string({_tokens(text)}, ' ')"


def _strip(text: str) -> str:
    return f"""replace(replace(replace({text}, '<a href="', ''), '">', ' '), '</a>', '')"""


def _key(pos: str) -> str:
    return f"'documents//' || doc_id || '#' || lpad(CAST({pos} AS VARCHAR), 6, '0')"


_SENTENCES = "array_to_string(string_split(line, '. '), ' ')"

LINES = """
lines AS (
  SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents
)"""

PASSAGES = f"""{LINES},
paragraphs AS (
  SELECT doc_id, lang, source, lower(l[1]) AS title, unnest(l[2:]) AS line,
         generate_subscripts(l[2:], 1) AS pos
  FROM lines
),
p AS (
  SELECT doc_id, lang, source, {_key("0")} AS doc_key, CAST(doc_id AS VARCHAR) AS id,
         CAST(0 AS INTEGER) AS passage_pos, 'title' AS type, lower(l[1]) AS text,
         CAST(NULL AS VARCHAR) AS title
  FROM lines
  UNION ALL
  SELECT * FROM (
    SELECT doc_id, lang, source, {_key("pos")} AS doc_key, CAST(doc_id AS VARCHAR) AS id,
           CAST(pos AS INTEGER) AS passage_pos, 'paragraph' AS type,
           {_fold("lower(" + _strip(_SENTENCES) + ")")} AS text, title
    FROM paragraphs
  ) WHERE text <> ''
)"""

STATS = f"""{PASSAGES},
t AS (SELECT doc_key, {_tokens("text")} AS tokens FROM p),
lengths AS (SELECT doc_key, CAST(len(tokens) AS INTEGER) AS doc_len FROM t),
tf AS (
  SELECT term, doc_key, CAST(count(*) AS INTEGER) AS tf
  FROM (SELECT doc_key, unnest(tokens) AS term FROM t) GROUP BY term, doc_key
),
postings AS (SELECT term, doc_key, tf, doc_len FROM tf JOIN lengths USING (doc_key)),
corpus AS (
  SELECT count(*) AS n, CAST(sum(doc_len) AS BIGINT) AS total_len, avg(doc_len) AS avgdl
  FROM lengths
),
term_odds AS (
  SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS odds
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), corpus
),
mean_odds AS (SELECT avg(odds) AS mean FROM term_odds),
idf AS (
  SELECT term, df, CASE WHEN odds >= 0 THEN odds ELSE 0.25::DOUBLE * mean END AS idf
  FROM term_odds, mean_odds
),
weights AS (
  SELECT term, doc_key,
         idf * tf * 2.5::DOUBLE
         / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avgdl)) AS weight
  FROM postings JOIN idf USING (term), corpus
)"""

BENCHMARK = "SELECT item_id AS query_id, text FROM benchmark"

PADDED = """SELECT 'text-' || item_id AS query_id, text FROM benchmark
  UNION ALL SELECT 'page-' || page_id, url FROM pages"""


def _terms(asked: str) -> str:
    return f"""asked AS ({asked}),
qterms AS (
  SELECT query_id, term, count(*) AS qtf
  FROM (SELECT query_id, unnest({_tokens("lower(text)")}) AS term FROM asked)
  GROUP BY query_id, term
)"""


def _scores(asked: str) -> str:
    return f"""{STATS},
{_terms(asked)},
scores AS (
  SELECT query_id, doc_key, sum(qtf * weight) AS score
  FROM qterms JOIN weights USING (term) GROUP BY query_id, doc_key
)"""


def _top(asked: str, k: int) -> str:
    """Every passage ranked for every query, unmatched ones at zero."""
    return f"""{_scores(asked)},
every AS (
  SELECT query_id, doc_key, coalesce(score, 0) AS score
  FROM (SELECT query_id, doc_key FROM asked, p) LEFT JOIN scores USING (query_id, doc_key)
),
top AS (
  SELECT query_id, doc_key, score, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (
      PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_key) AS rank
    FROM every
  ) WHERE rank <= {k}
)"""


_HITS = "SELECT query_id, rank, round(score, 4) AS score, doc_key FROM top"

# The mean is taken over terms; a term in most passages gets a quarter of it.
_TERM_IDF = f"""WITH {PASSAGES},
uses AS (SELECT doc_key, unnest({_tokens("text")}) AS term FROM p),
counted AS (SELECT term, count(DISTINCT doc_key) AS df FROM uses GROUP BY term),
sized AS (SELECT count(*) AS n_passages FROM p),
odds AS (
  SELECT term, df, ln(n_passages - df + 0.5) - ln(df + 0.5) AS raw_idf
  FROM counted CROSS JOIN sized
),
average AS (SELECT avg(raw_idf) AS mean_idf FROM odds)
SELECT term, df, round(CASE WHEN raw_idf >= 0 THEN raw_idf ELSE 0.25 * mean_idf END, 6) AS idf
FROM odds CROSS JOIN average"""

_REBUILT_IDF = f"""WITH {PASSAGES},
held AS (SELECT DISTINCT doc_key, unnest({_tokens("text")}) AS term FROM p),
odds AS (
  SELECT term, count(*) AS df,
         ln((SELECT count(*) FROM p) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw_idf
  FROM held GROUP BY term
)
SELECT term, df,
       round(CASE WHEN raw_idf < 0 THEN 0.25 * (SELECT avg(raw_idf) FROM odds) ELSE raw_idf END, 6) AS idf
FROM odds"""

# Few words, in most rows each: written out word by word instead of by postings.
_DESCRIBED = """WITH p AS (
  SELECT 'documents//' || doc_id || '#000000' AS doc_key,
         string_split('document in language ' || lang
                      || CASE WHEN n_chars > 1000 THEN ' of length' ELSE '' END, ' ') AS words
  FROM documents
),
sizes AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM p),
odds AS (
  SELECT word, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS odds
  FROM (SELECT unnest(words) AS word FROM p), sizes GROUP BY word
),
idf AS (
  SELECT word, CASE WHEN odds >= 0 THEN odds ELSE 0.25 * (SELECT avg(odds) FROM odds) END AS idf
  FROM odds
),
asked AS (
  SELECT DISTINCT start || lang AS query_id FROM documents,
    (SELECT unnest(['', 'length ', 'document ', 'documents written in ', 'no-']) AS start)
),
terms AS (SELECT query_id, unnest(string_split(query_id, ' ')) AS word FROM asked),
scored AS (
  SELECT query_id, doc_key,
         sum(CASE WHEN list_contains(words, word)
                  THEN idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(words) / avgdl)) ELSE 0 END)
         AS score
  FROM terms LEFT JOIN idf USING (word), p, sizes GROUP BY query_id, doc_key
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, round(score, 4) AS score, doc_key
FROM (SELECT *, row_number() OVER (
        PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_key) AS rank FROM scored)
WHERE rank <= 10"""

_SHOWN = """CASE WHEN type = 'title' THEN 'Title: ' || text
  ELSE 'Title: ' || title || chr(10) || 'Content: ' || text END"""


def _encoded(words: str) -> str:
    """Average over all words of (hex digit - 7.5), per digit position of their MD5."""
    return f"""
  SELECT key, pos, CAST(avg(instr('0123456789abcdef', substr(digest, pos, 1)) - 8.5) AS FLOAT)
         AS value
  FROM (SELECT key, md5(word) AS digest FROM {words}), (SELECT unnest(range(1, 33)) AS pos)
  GROUP BY key, pos"""


def _sq(a: str, b: str) -> str:
    return (
        f"list_sum(list_transform(list_zip({a}, {b}), "
        "lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"
    )


_NEAREST_FIVE = f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, round(distance, 4) AS distance, doc_key
FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_key) AS rank
  FROM (
    SELECT q.vec_id AS query_id, v.vec_id AS doc_key,
           {_sq("q.embedding", "v.embedding")} AS distance
    FROM embeddings q, embeddings v
  )
) WHERE rank <= 5"""

_DIR = "'source=' || source"

ORACLES: dict[str, str] = {
    "normalize_text": f"SELECT doc_id, {_fold('lower(text)')} AS text FROM documents",
    "tokenize": f"""
        SELECT doc_id, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos, unnest(w) AS token
        FROM (SELECT doc_id, {_tokens("text")} AS w FROM documents)""",
    "detokenize": f"SELECT doc_id, {_fold('text')} AS text FROM documents",
    "preview": """
        SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...'
                            ELSE text END AS preview
        FROM documents""",
    "strip_anchors": f"SELECT page_id, {_strip('html')} AS text FROM pages",
    "title_passages": f"""WITH {PASSAGES}
        SELECT doc_key, id, passage_pos, type, text, title FROM p WHERE type = 'title'""",
    "paragraph_passages": f"""WITH {PASSAGES}
        SELECT doc_key, id, passage_pos, type, text, title FROM p WHERE type = 'paragraph'""",
    "flatten_passages": f"""WITH {PASSAGES}
        SELECT doc_key, id, passage_pos, type, text, title FROM p""",
    "format_passage": f"WITH {PASSAGES} SELECT doc_key, {_SHOWN} AS result FROM p",
    "doc_lengths": f"WITH {STATS} SELECT doc_key, doc_len FROM lengths",
    "corpus_stats": f"""WITH {STATS}
        SELECT n AS n_docs, total_len, round(avgdl, 6) AS avgdl FROM corpus""",
    "term_frequencies": f"WITH {STATS} SELECT term, doc_key, tf, doc_len FROM postings",
    "document_frequencies": f"WITH {STATS} SELECT term, df FROM term_odds",
    "bm25_idf": _TERM_IDF,
    "bm25_weights": f"WITH {STATS} SELECT term, doc_key, round(weight, 6) AS weight FROM weights",
    "index_statistics": f"""WITH {STATS}
        SELECT n AS document_count, n > 0 AS has_index, round(avgdl, 6) AS average_document_length
        FROM corpus""",
    "query_terms": f"WITH {_terms(BENCHMARK)} SELECT query_id, term, qtf FROM qterms",
    "bm25_scores": f"""WITH {_scores(BENCHMARK)}
        SELECT query_id, doc_key, round(score, 4) AS score FROM scores""",
    "bm25_top1query": f"""WITH {_top(f"SELECT 'q' AS query_id, '{ONE_QUERY}' AS text", 10)}
        SELECT rank, round(score, 4) AS score, doc_key FROM top""",
    "bm25_topk": f"WITH {_top(BENCHMARK, 10)} {_HITS}",
    "bm25_topk_records": f"""WITH {_top(BENCHMARK, 5)}
        SELECT query_id, rank, round(score, 4) AS score, {_fold("text")} AS document,
               id, type, text, title
        FROM top JOIN p USING (doc_key)""",
    "bm25_formatted": f"""WITH {_top(BENCHMARK, 5)}
        SELECT query_id, rank, round(score, 4) AS score, doc_key, {_SHOWN} AS result
        FROM top JOIN p USING (doc_key)""",
    "bm25_topk_padded": f"WITH {_top(PADDED, 10)} {_HITS}",
    "bm25_topk_pruned": f"WITH {_top(BENCHMARK, 10)} {_HITS}",
    "bm25_topk_blocks": f"WITH {_top(BENCHMARK, 10)} {_HITS}",
    "bm25_topk_negative_mean": _DESCRIBED,
    "index_roundtrip": f"WITH {_top(BENCHMARK, 10)} {_HITS}",
    "index_rebuild_from_passages": _REBUILT_IDF,
    "index_append": f"""WITH {_top(BENCHMARK, 10)}
        SELECT query_id, rank, round(score, 4) AS score, id, text
        FROM top JOIN p USING (doc_key)""",
    "scan_bz2_jsonl": f"""WITH {LINES}
        SELECT {_DIR} AS rel_dir, CAST(doc_id AS VARCHAR) AS id, l[1] AS title,
               array_to_string(list_transform(l[2:], lambda x: replace(x, '. ', '|')), chr(10))
               AS text
        FROM lines""",
    "scan_json_arrays": f"""WITH {LINES}
        SELECT CAST(doc_id AS VARCHAR) AS id, l[1] AS title,
               array_to_string(list_transform(l[2:], lambda x: replace(x, '. ', '|')), chr(10))
               AS text
        FROM lines""",
    "scan_indented_arrays": f"""WITH {LINES}
        SELECT CAST(doc_id AS VARCHAR) AS id, l[1] AS title,
               array_to_string(list_transform(l[2:], lambda x: replace(x, '. ', '|')), chr(10))
               AS text
        FROM lines""",
    "quarantine_malformed": f"""
        SELECT {_DIR} AS rel_dir, state, count(*) AS n_articles,
               CAST(sum(CASE WHEN state = 'usable' THEN doc_id ELSE 0 END) AS BIGINT) AS id_sum
        FROM (SELECT *, CASE WHEN lang IN ('de', 'fr') THEN 'quarantined' ELSE 'usable' END
                     AS state FROM documents)
        GROUP BY source, state""",
    "ingest_by_source_dir": f"""WITH {LINES}
        SELECT {_DIR} AS rel_dir, CAST(doc_id AS VARCHAR) AS id, l[1] AS title FROM lines""",
    "passages_per_file": f"""WITH {PASSAGES}
        SELECT CASE WHEN grouping(source) = 0 THEN {_DIR} END AS rel_dir, count(*) AS n_passages
        FROM p GROUP BY ROLLUP (source)""",
    "incremental_files": f"""WITH {PASSAGES}
        SELECT CAST(CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS INTEGER) AS batch_id,
               count(*) AS n_passages
        FROM p GROUP BY 1""",
    "quarantine_damaged_files": f"""WITH {PASSAGES}
        SELECT CAST(CASE WHEN lang = 'fr' THEN 1 ELSE 0 END AS INTEGER) AS batch_id,
               count(*) AS n_passages,
               CAST(CASE WHEN lang = 'fr' THEN 0 ELSE 1 END AS BIGINT) AS n_damaged
        FROM p GROUP BY 1, 3""",
    "new_files_anti": """
        SELECT DISTINCT 'second/source=' || source AS rel_dir FROM documents WHERE lang <> 'en'""",
    "l2_distance": f"""
        SELECT a.vec_id, round({_sq("a.embedding", "b.embedding")}, 6) AS distance
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "knn_l2_topk": _NEAREST_FIVE,
    "knn_blocks": _NEAREST_FIVE,
    "knn_formatted": f"""WITH {PASSAGES},
        words AS (SELECT doc_key AS key, unnest({_tokens("text")}) AS word FROM p),
        asked_words AS (
          SELECT item_id AS key, unnest({_tokens("lower(text)")}) AS word FROM benchmark),
        coded AS ({_encoded("words")}),
        coded_p AS (
          SELECT doc_key, coalesce(any_value(v), [0::FLOAT for i in range(32)]) AS v
          FROM p LEFT JOIN (SELECT key, list(value ORDER BY pos) AS v FROM coded GROUP BY key)
            ON key = doc_key
          GROUP BY doc_key),
        coded_q AS (
          SELECT key AS query_id, list(value ORDER BY pos) AS v
          FROM ({_encoded("asked_words")}) GROUP BY key),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_key) AS rank
          FROM (SELECT query_id, doc_key, {_sq("coded_q.v", "coded_p.v")} AS distance
                FROM coded_q, coded_p))
        SELECT query_id, CAST(rank AS INTEGER) AS rank, round(distance, 4) AS distance, doc_key,
               {_SHOWN} AS result
        FROM ranked JOIN p USING (doc_key) WHERE rank <= 5""",
    "vectors_roundtrip": """
        SELECT vec_id AS doc_key, CAST(i AS INTEGER) AS pos,
               round(CAST(embedding[i + 1] AS DOUBLE), 6) AS value,
               CAST(label AS VARCHAR) AS text, CAST(len(embedding) AS INTEGER) AS dimension
        FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings)""",
    "mean_pool": """
        SELECT label, CAST(i AS INTEGER) AS pos,
               round(avg(CAST(embedding[i + 1] AS DOUBLE)), 6) AS value
        FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings)
        GROUP BY label, i""",
    "embed_corpus": f"""WITH words AS (
          SELECT doc_id AS key, unnest({_tokens("lower(text)")}) AS word FROM documents)
        SELECT key AS doc_id, CAST(pos - 1 AS INTEGER) AS pos,
               round(CAST(value AS DOUBLE), 6) AS value
        FROM ({_encoded("words")})""",
    "embed_pooled": f"""WITH words AS (
          SELECT doc_id AS key, unnest(list_slice({_tokens("lower(text)")}, 1, 32)) AS word
          FROM documents)
        SELECT key AS doc_id, CAST(pos - 1 AS INTEGER) AS pos,
               round(CAST(value AS DOUBLE), 6) AS value
        FROM ({_encoded("words")})""",
}
