"""SQL for the dealt operators that SQL can express, written from the contract."""

from __future__ import annotations

# A-Z lowered and nothing else: the texts' other letters stay as they are.
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BLANK_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op1_decontaminate": f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
spots AS (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS place0 FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, list_slice(w, place0, place0 + 12) AS win FROM spots),
docs AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
sizes AS (SELECT DISTINCT len(win) AS size FROM windows),
runs AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS place0, w FROM docs, sizes WHERE len(w) >= size),
hits AS (SELECT doc_id, place0, size, item FROM (SELECT doc_id, place0, size, list_slice(w, place0, place0 + size - 1) AS win FROM runs) JOIN windows USING (win)),
hit_words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(place0, place0 + size)) AS place FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)""",
    "op2_near_dup": f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_BLANK_WORDS.format("coalesce(text, '')")} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, list_slice(w, place0, place0 + 2) AS s
             FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS place0 FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)""",
    "op10_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, url FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
firsts AS (SELECT payload_digest, min(page_id) AS leader FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN leader <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN leader <> page_id THEN leader END AS refers_to
FROM (SELECT d.*, CASE WHEN payload_bytes >= 100 THEN leader END AS leader FROM d LEFT JOIN firsts USING (payload_digest))""",
    "op12_prefix_trie": """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, r, x) AS turns FROM t GROUP BY conv_id),
-- crc32 bit by bit: the reflected polynomial of zlib
crc AS (SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
        lambda a, c: list_reduce(list_prepend(xor(a, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda b, z: xor(b >> 1, 3988292384 * (b & 1)))), 4294967295::BIGINT) % 9 AS h FROM own),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(list_slice(b.turns, 1, c.h), []), list_slice(c.turns, c.h + 1, len(c.turns))) AS turns
            FROM crc c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
prefixes AS (SELECT conv_id, d, list_slice(turns, 1, d) AS seq FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT d, seq, min(conv_id) AS conv_id, count(*) AS n_convs FROM prefixes GROUP BY d, seq),
children AS (SELECT d - 1 AS d, list_slice(seq, 1, d - 1) AS seq, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
ends AS (SELECT len(turns) AS d, turns AS seq, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM rebuilt GROUP BY 1, 2),
own_sums AS (SELECT n.d, n.seq, CASE WHEN c.n_children IS NULL THEN 1 ELSE 0 END AS leaf,
             CASE WHEN n.d > 0 THEN (n.n_convs - 1) * strlen(n.seq[n.d].x) ELSE 0 END AS saved FROM nodes n LEFT JOIN children c ON c.d = n.d AND c.seq = n.seq),
sums AS (SELECT a AS d, list_slice(seq, 1, a) AS seq, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
         FROM (SELECT seq, leaf, saved, unnest(range(0, d + 1)) AS a FROM own_sums) GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens,
       sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.seq = list_slice(n.seq, 1, n.d - 1) LEFT JOIN children c ON c.d = n.d AND c.seq = n.seq
JOIN sums s ON s.d = n.d AND s.seq = n.seq LEFT JOIN ends e ON e.d = n.d AND e.seq = n.seq""",
    "op13_ngram_join": f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_BLANK_WORDS.format("coalesce(text, '')")} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, list_slice(w, place0, place0 + 4) AS s
             FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS place0 FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM least LEFT JOIN sizes USING (doc_id)""",
}
