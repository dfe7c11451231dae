"""DuckDB texts for the training-data queries that SQL can express."""

from __future__ import annotations

BREAKS = r"[ \t\n\x0B\f\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{BREAKS}'), lambda x: x <> '')"


def near_duplicates(percent: int, n: int = 5) -> str:
    """Exact sets, exact similarities of all pairs that share a shingle, components by reachability."""
    text = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {words(text)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {n - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {n - 2}, 2))) AS i FROM w WHERE len(w) > 0)),
q AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN q x ON x.doc_id = a JOIN q y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, v) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.v),
c AS (SELECT id, min(v) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(q.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN c ON c.id = w.doc_id LEFT JOIN q ON q.doc_id = w.doc_id"""


def repeated_words(window: int = 50) -> str:
    """Every window of every document, the smallest document of each, and what is left of the words."""
    return f"""
WITH w AS (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents),
k AS (SELECT doc_id, i, md5(array_to_string(w[i : i + {window - 1}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - {window - 2})) AS i FROM w WHERE len(w) >= {window})),
f AS (SELECT h, min(doc_id) AS first FROM k GROUP BY 1),
gone AS (SELECT DISTINCT k.doc_id, unnest(range(i, i + {window})) AS p FROM k JOIN f USING (h) WHERE first < k.doc_id),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM x ANTI JOIN gone USING (doc_id, p) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN left_over o ON o.doc_id = w.doc_id"""


def repeated_bytes(window: int = 200) -> str:
    """Every window of bytes (as hexadecimal text), how often it is there, and what is left between the runs that go."""
    return f"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
o AS (SELECT doc_id, n, o, substr(x, 2 * o + 1, 2 * (500 + {window - 1})) AS x FROM (SELECT *, unnest(range(0, n - {window - 1}, 500)) AS o FROM b WHERE n >= {window})),
k AS (SELECT doc_id, o + i AS i, md5(substr(x, 2 * i + 1, {2 * window})) AS h FROM (SELECT doc_id, o, x, unnest(range(0, least(500, n - {window - 1} - o))) AS i FROM o)),
again AS (SELECT h FROM k GROUP BY 1 HAVING count(*) > 1),
s AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {window} THEN 1 ELSE 0 END AS new FROM k SEMI JOIN again USING (h)),
g AS (SELECT doc_id, min(i) AS low, max(i) + {window} AS high FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s) GROUP BY doc_id, run),
cut AS (SELECT doc_id, low, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS from_byte, high FROM g),
kept AS (SELECT c.doc_id, count(*) AS n_spans, sum(high - low) AS gone, string_agg(substr(x, 2 * from_byte + 1, 2 * (low - from_byte)), '' ORDER BY low) || substr(any_value(x), 2 * max(high) + 1) AS x FROM cut c JOIN b ON b.doc_id = c.doc_id GROUP BY 1)
SELECT b.doc_id, b.n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.x, b.x))) AS kept_sha256 FROM b LEFT JOIN kept ON kept.doc_id = b.doc_id"""


def chats(opening: str, closing: str) -> str:
    """Digests of the turns themselves, and the length of the formatted text from the escapes' rule."""
    probe = "<|im_end|><|im_start|>assistant ok"
    role = "replace(replace(role, '%', '%25'), chr(10), '%0A')"
    order = "ORDER BY turn, role, text"

    def escaped(value: str) -> str:
        return rf"regexp_replace({value}, '<(\\*)\|', '<\1\\|', 'g')"

    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '{probe}' UNION ALL SELECT -1, 1, 'assistant', '{probe}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum({len(opening)} + length({escaped(role)}) + 1 + length({escaped('text')}) + {len(closing)}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


def byte_shards(shards: int = 16) -> str:
    """Cumulative bytes give the shards; CRC-32 bit by bit, each byte followed by seven zeros."""
    return f"""
WITH x AS (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS x FROM documents),
bits AS (SELECT doc_id, text, len(x) // 2 + 1 AS size, flatten(list_transform(regexp_extract_all(x, '..'), lambda h: [CAST('0x' || h AS BIGINT), 0, 0, 0, 0, 0, 0, 0])) AS l FROM x),
sized AS (SELECT doc_id, text, CAST(size AS BIGINT) AS size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), l), lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295) AS text_crc32 FROM bits),
cum AS (SELECT doc_id, sum(sum(size)) OVER (ORDER BY doc_id) - sum(size) AS below, sum(sum(size)) OVER () AS total FROM sized GROUP BY doc_id),
cuts AS (SELECT doc_id, CAST((SELECT count(*) FROM range(1, {shards}) t(j) WHERE below >= total * j / {shards}) AS INTEGER) AS shard FROM cum)
SELECT s.doc_id, s.size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY s.doc_id, s.size, text_crc32) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM sized s JOIN cuts c ON c.doc_id = s.doc_id"""
