"""DuckDB SQL that says what some of the queries return."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_LETTERS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOW = lambda x: f"translate(coalesce({x}, ''), '{UPPER}', '{LOWER}')"
_CONTROL = r"'<turn:|</turn>|<\|(?:image|audio|document|other):|### (?:Assistant|User|System|Human):'"
_ESCAPED = lambda x: f"(length({x}) + length({x}) - length(replace({x}, '\\', '')) + len(regexp_extract_all({x}, {_CONTROL})))"

CHAT = f"""WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(16 + {_ESCAPED('role')} + length(role) - length(replace(role, '>', '')) + {_ESCAPED('text')}) AS BIGINT) AS formatted_chars FROM m GROUP BY conv_id"""


def _covered(n: int) -> str:
    return f"g{n} AS (SELECT doc_id, i, hash(list_slice(w, i, i + {n - 1})) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM w WHERE len(w) >= {n})), r{n} AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g{n}) WHERE c > 1), c{n} AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(i, i + {n})) AS p FROM r{n}) GROUP BY 1)"


REPETITION = f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents), {_covered(8)}, {_covered(5)}, {_covered(201)},
l AS (SELECT doc_id, x, p FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS p FROM w) WHERE regexp_matches(x, {_SPACED})), dl AS (SELECT doc_id, count(*) - count(DISTINCT x) AS c FROM l GROUP BY 1),
b AS (SELECT w.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(dl.c, 0) AS n_dup_lines, coalesce(c8.c, 0) AS n_repeat_words, coalesce(c5.c, 0) AS n_covered, coalesce(c201.c, 0) AS long_ FROM w LEFT JOIN dl ON dl.doc_id = w.doc_id LEFT JOIN c8 ON c8.doc_id = w.doc_id LEFT JOIN c5 ON c5.doc_id = w.doc_id LEFT JOIN c201 ON c201.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * n_covered <= 40 * n_words AND long_ = 0) AS kept FROM b"""

WARC = """WITH d AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages), f AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM f"""

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW('text')}, {_SPACED}) AS w FROM documents), s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2), e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1, 2"""

BENCHMARK = f"""WITH bw AS (SELECT item_id, regexp_extract_all({_LOW('text')}, {_LETTERS}) AS w FROM benchmark), win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win), dw AS (SELECT doc_id, regexp_extract_all({_LOW('text')}, {_LETTERS}) AS w FROM documents),
occ AS (SELECT x.doc_id, x.i, x.n, win.item_id FROM (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw CROSS JOIN lens WHERE len(w) >= n)) x JOIN win ON win.n = x.n AND win.s = x.s),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY 1), it AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM occ) GROUP BY 1)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM dw LEFT JOIN h ON h.doc_id = dw.doc_id LEFT JOIN it ON it.doc_id = dw.doc_id"""
