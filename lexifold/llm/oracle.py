"""The same results in DuckDB SQL, for the queries that SQL can express."""

from __future__ import annotations

# CRC-32 of a blob: the table follows from the reversed polynomial, one step per byte.
CRC_TABLE = """
crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b::BIGINT] || range(8), lambda c, k:
      CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) AS r(b)))
"""


def crc32(hexed: str) -> str:
    octets = f"list_transform(regexp_extract_all({hexed}, '..'), lambda o: ('0x' || o)::BIGINT)"
    step = "xor(c >> 8, t[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce([4294967295::BIGINT] || {octets}, lambda c, b: {step}), 4294967295)"


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, {LOWER} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""

SHARD = f"""
WITH {CRC_TABLE},
d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {crc32("hex(encode(coalesce(text, '')))")} AS text_crc32
  FROM documents, crc_table),
p AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS start,
    sum(size) OVER () AS total FROM d),
s AS (SELECT *, (start * 16 // total)::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY start) - 1 AS slot, NULL::INT AS grown_shard FROM s
"""

# Every window in line with a shared shingle, its weighted Jaccard similarity to the item, the best one of each pair.
DECONTAMINATE = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM documents),
items AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM benchmark),
sized AS (SELECT item_id, w, len(w) AS m, least(len(w), 5) AS k FROM items WHERE len(w) > 0),
item_shingles AS (
  SELECT item_id, m, k, unnest(range(0, m - k + 1)) AS place, w FROM sized),
item_grams AS (SELECT item_id, m, k, place, array_to_string(w[place + 1 : place + k], ' ') AS gram FROM item_shingles),
doc_places AS (
  SELECT doc_id, w, n, k, unnest(range(0, n - k + 1)) AS pos FROM (
    SELECT doc_id, w, len(w) AS n, k FROM words, (SELECT DISTINCT k FROM sized) WHERE len(w) >= k)),
doc_grams AS (SELECT doc_id, n, k, pos, array_to_string(w[pos + 1 : pos + k], ' ') AS gram FROM doc_places),
windows AS (
  SELECT DISTINCT doc_id, item_id, m, k, least(greatest(pos - place, 0), greatest(n - m, 0)) AS start
  FROM doc_grams JOIN item_grams USING (k, gram)),
window_grams AS (
  SELECT v.doc_id, v.item_id, v.start, v.m, g.gram, count(*) AS a
  FROM windows v JOIN doc_grams g ON v.doc_id = g.doc_id AND v.k = g.k
    AND g.pos >= v.start AND g.pos + v.k <= v.start + v.m
  GROUP BY ALL),
item_bags AS (SELECT item_id, gram, count(*) AS b FROM item_grams GROUP BY ALL),
shared AS (
  SELECT doc_id, item_id, start, sum(least(a, b)) AS common
  FROM window_grams JOIN item_bags USING (item_id, gram) GROUP BY ALL),
totals AS (SELECT doc_id, item_id, start, any_value(m) AS m, sum(a) AS a FROM window_grams GROUP BY ALL),
scored AS (
  SELECT doc_id, item_id, start, m, common / (a + m - k + 1 - common) AS similarity
  FROM shared JOIN totals USING (doc_id, item_id, start) JOIN (SELECT item_id, k FROM sized) USING (item_id)),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r
  FROM scored WHERE similarity >= 0.8)
SELECT doc_id, item_id, start::INT AS start_word, least(m, len(w))::INT AS window_words,
  round(similarity, 6) AS similarity
FROM best JOIN words USING (doc_id) WHERE r = 1
"""

# Links by comparing all pairs, classes by following links.
VECTOR_DEDUP = """
WITH RECURSIVE u AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM u WHERE len(e) > 0),
ok AS (SELECT * FROM n WHERE size > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.95),
reach AS (SELECT vec_id, vec_id AS r FROM ok UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r),
c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY 1),
d AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
  vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN c USING (vec_id) LEFT JOIN d USING (vec_id)
"""


def vector_codes(parts: int = 4, width: int = 16, entries: int = 256, rounds: int = 4) -> str:
    """One pair of steps per round: nearest entries, then floored means."""
    scaled = "list_transform(embedding, lambda x: floor(1024 * x::DOUBLE))"
    steps = [
        f"""kept AS (SELECT vec_id, label, {scaled} AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, part, v[part * {width} + 1 : part * {width} + {width}] AS x FROM kept, range({parts}) AS r(part)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {entries}),
b0 AS (SELECT part, entry, x AS c FROM p JOIN first USING (vec_id))"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (
  SELECT vec_id, part, min((list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c))::BIGINT * {entries} + entry) AS d
  FROM p JOIN b{r} USING (part) GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""m{r} AS (
  SELECT part, entry, list(floor(s / n) ORDER BY i) AS c FROM (
    SELECT part, d % {entries} AS entry, i, sum(x[i + 1]) AS s, count(*) AS n
    FROM a{r} JOIN p USING (vec_id, part), range({width}) AS r(i) GROUP BY ALL) GROUP BY ALL),
b{r + 1} AS (SELECT part, entry, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} USING (part, entry))""")
    return f"""WITH {", ".join(steps)},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', d % {entries}), '' ORDER BY part) AS code, sum(d // {entries})::BIGINT AS error
  FROM a{rounds} GROUP BY 1),
books AS (
  SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY part, entry)) AS codebooks_sha256
  FROM b{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), books
"""


WORDS = r"regexp_extract_all(%s, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')" % LOWER

RESAMPLE = f"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, {WORDS} AS w FROM documents),
e AS (SELECT {WORDS} AS w FROM benchmark),
dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(w) AS w FROM d) GROUP BY ALL),
ew AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM e) GROUP BY ALL),
b AS (
  SELECT w, {crc32("hex(encode(w))")} % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM dw UNION SELECT w FROM ew), crc_table),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN b USING (w) GROUP BY 1),
t AS (SELECT bucket, sum(n) AS t FROM ew JOIN b USING (w) GROUP BY 1),
g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000))))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)),
m AS (SELECT doc_id, sum(dw.n * gain)::BIGINT AS total FROM dw JOIN b USING (w) JOIN g USING (bucket) GROUP BY 1),
x AS (
  SELECT doc_id, len(w) AS n_features, CASE WHEN len(w) = 0 THEN 0 ELSE floor(coalesce(total, 0)::DOUBLE / len(w)) END::BIGINT AS weight,
    ('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT AS h
  FROM d LEFT JOIN m USING (doc_id)),
z AS (SELECT doc_id, n_features, weight, weight + floor(-1000.0 * ln(-ln((h + 0.5) / 4294967296.0)))::BIGINT AS score FROM x),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM z WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank
FROM z LEFT JOIN r USING (doc_id)
"""

ORACLE = {
    "op6_decontaminate": DECONTAMINATE,
    "op7_shard": SHARD,
    "op10_exact_dedup": EXACT_DEDUP,
    "op11_vector_dedup": VECTOR_DEDUP,
    "op12_vector_codes": vector_codes(),
    "op13_resample": RESAMPLE,
}
