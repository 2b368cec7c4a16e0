"""DuckDB SQL for the queries whose results SQL can express."""

from __future__ import annotations

# The mix: level of the water, then one draw from an MD5 sum per document.
OP2 = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT source, source_size, 3.0::DOUBLE * source_size AS cap,
         CAST([1, 2, 3][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]
              AS DOUBLE) AS weight
  FROM per_source),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER w, 0.0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0)) AS level
  FROM weighted
  WINDOW w AS (ORDER BY cap / weight, source ASC NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
         least(cap, max(level) OVER () * weight) AS target
  FROM levels),
rated AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12)
              AS BIGINT) / 281474976710656.0::DOUBLE AS draw
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
       size * (CAST(floor(rate) AS BIGINT)
               + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM rated
"""

OP7 = r"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i
        FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT row, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT row, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
        FROM words, lengths WHERE len(w) >= n)),
found AS (SELECT row, i, places.n, item FROM places JOIN windows USING (win)
          WHERE places.n = windows.n),
hit AS (
  SELECT row, count(DISTINCT j) AS n_hit
  FROM (SELECT row, unnest(generate_series(i, i + n - 1)) AS j FROM found) GROUP BY row),
named AS (
  SELECT row, count(DISTINCT item) AS n_items,
         array_to_string(list_sort(list(DISTINCT item)), ',') AS ids
  FROM found GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit USING (row) LEFT JOIN named USING (row)
"""

# Lines as sorted word lists; prefixes by document frequency find the candidates.
OP1 = r"""
WITH texts AS (
  SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT doc_id, text, line, list_distinct(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS body,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM texts)),
placed AS (
  SELECT doc_id, line, w, len(w) AS n,
         row_number() OVER (ORDER BY doc_id NULLS LAST, text, line) AS place
  FROM lines WHERE len(w) > 0),
words AS (SELECT place, n, unnest(w) AS word FROM placed),
rare AS (SELECT word, count(*) AS f FROM words GROUP BY word),
prefixes AS (
  SELECT place, word FROM words JOIN rare USING (word)
  QUALIFY row_number() OVER (PARTITION BY place ORDER BY f, word)
          <= n - CAST(ceil(n * 4 / 5) AS BIGINT) + 1),
pairs AS (
  SELECT DISTINCT x.place AS a, y.place AS b
  FROM prefixes x JOIN prefixes y ON x.word = y.word AND x.place < y.place),
late AS (
  SELECT DISTINCT b FROM (
    SELECT b, x.n + y.n AS total, len(list_intersect(x.w, y.w)) AS common
    FROM pairs JOIN placed x ON x.place = a JOIN placed y ON y.place = b
    WHERE 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n))
  WHERE 5 * common >= 4 * (total - common)),
gone AS (
  SELECT doc_id, count(*) AS n_removed,
         string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS removed_lines
  FROM placed JOIN late ON place = b GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END
                      AS BIGINT) AS n_lines,
       CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(removed_lines, '') AS removed_lines
FROM documents d LEFT JOIN gone ON d.doc_id IS NOT DISTINCT FROM gone.doc_id
"""

# Spans by their words in place of hashes.
OP5 = r"""
WITH pieces AS (
  SELECT doc_id, text, unnest(p) AS body, generate_subscripts(p, 1) AS place
  FROM (SELECT DISTINCT doc_id, text,
               regexp_extract_all(text, '[^.!?\n]*([.!?]+|\n)|[^.!?\n]+') AS p
        FROM documents WHERE text IS NOT NULL)),
worded AS (
  SELECT doc_id, text, place,
         regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM pieces),
numbered AS (
  SELECT doc_id, text, w, row_number() OVER (PARTITION BY doc_id, text ORDER BY place) - 1 AS i
  FROM worded WHERE len(w) > 0),
grown AS (
  SELECT s.doc_id, s.text, s.i AS first, e.i AS last, sum(len(e.w)) OVER g AS n,
         string_agg(array_to_string(e.w, ' '), '|') OVER g AS span
  FROM numbered s JOIN numbered e
    ON s.doc_id = e.doc_id AND s.text = e.text AND e.i BETWEEN s.i AND s.i + 20
  WINDOW g AS (PARTITION BY s.doc_id, s.text, s.i ORDER BY e.i)),
spans AS (
  SELECT * FROM grown WHERE n >= 20 AND last > first
  QUALIFY row_number() OVER (PARTITION BY doc_id, text, first ORDER BY last) = 1
       OR row_number() OVER (PARTITION BY doc_id, text, last ORDER BY first DESC) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY span ORDER BY doc_id NULLS LAST, text, first) AS r
  FROM spans),
gone AS (
  SELECT doc_id, text, count(*) AS n, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, text, unnest(generate_series(first, last)) AS i
        FROM ranked WHERE r > 1) GROUP BY doc_id, text),
counts AS (SELECT doc_id, text, count(*) AS n FROM numbered GROUP BY doc_id, text)
SELECT d.doc_id, CAST(coalesce(counts.n, 0) AS BIGINT) AS n_sentences,
       CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed,
       coalesce(gone.ids, '') AS removed_sentences
FROM documents d LEFT JOIN counts USING (doc_id, text) LEFT JOIN gone USING (doc_id, text)
"""

# Exact Jaccard over all pairs that share a shingle, then connected components.
OP10 = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i
        FROM worded WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id != y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach(a, b) AS (
  SELECT a, b FROM links
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, CAST(least(doc_id, coalesce(m, doc_id)) AS BIGINT) AS class_id
FROM documents LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)
"""


def _rounds(n: int) -> str:
    """Assignment a0 .. a<n> and centroids c1 .. c<n> of the clustering, as common tables."""
    steps = []
    for r in range(n + 1):
        steps.append(f"""a{r} AS (
  SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT rid, c, CAST(sum((x - m) * (x - m)) AS BIGINT) AS d
    FROM v JOIN c{r} USING (i) GROUP BY 1, 2) GROUP BY 1)""")
        if r < n:
            steps.append(f"""c{r + 1} AS (
  SELECT old.c, old.i, coalesce((s - ((s % n) + n) % n) // n, m) AS m FROM c{r} AS old
  LEFT JOIN (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
             FROM a{r} JOIN v USING (rid) GROUP BY 1, 2) AS new USING (c, i))""")
    return ",\n".join(steps)


OP13 = f"""
WITH good AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(
           embedding, lambda x: CAST(floor(256.0::DOUBLE * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(
    embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS (SELECT rid, unnest(generate_series(1, 64)) AS i, unnest(e) AS x FROM good),
started AS (
  SELECT rid, row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')),
                                 e) - 1 AS c FROM good),
c0 AS (SELECT c, i, x AS m FROM started JOIN v USING (rid) WHERE c < 40),
{_rounds(5)},
named AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256
          FROM c5 GROUP BY 1)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance,
       CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a5 JOIN good USING (rid) JOIN named USING (c)
"""

OP11 = """
WITH own AS (
  SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
           ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
hashed AS (
  SELECT c, t, xor(4294967295::BIGINT, list_reduce(
      [4294967295::BIGINT] || list_transform(string_split(CAST(c AS VARCHAR), ''),
                                             lambda x: CAST(ascii(x) AS BIGINT)),
      lambda crc, b: list_reduce([xor(crc, b)] || CAST(range(8) AS BIGINT[]),
        lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT)
                     ELSE a >> 1 END))) % 9 AS h
  FROM own),
convs AS (
  SELECT a.c, coalesce(b.t, [])[1:a.h] || a.t[a.h + 1:] AS t
  FROM hashed a LEFT JOIN own b ON b.c = a.c - a.c % 5),
nodes AS (
  SELECT p, len(p) AS d, min(c) AS conv_id, count(*) AS n, coalesce(string_agg(
           CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n_turns = len(p)), '') AS ends
  FROM (SELECT c, len(t) AS n_turns, t[1:unnest(range(len(t) + 1))] AS p FROM convs) GROUP BY p),
children AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
valued AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children,
         CASE WHEN d > 0 THEN (n - 1) * strlen(p[d].text) ELSE 0 END AS own
  FROM nodes LEFT JOIN children USING (p)),
below AS (
  SELECT p, sum(own) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
  FROM (SELECT own, n_children, p[1:unnest(range(d + 1))] AS p FROM valued) GROUP BY p)
SELECT v.conv_id, v.d AS depth, up.conv_id AS parent_conv_id, v.n AS n_convs, v.n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
       sha256(v.ends) AS ends_sha256
FROM valued v JOIN below USING (p) LEFT JOIN nodes up ON v.d > 0 AND up.p = v.p[1:v.d - 1]
"""

ORACLES = {
    "op1_line_dedup": OP1,
    "op2_mix_sources": OP2,
    "op5_sentence_spans": OP5,
    "op7_decontaminate": OP7,
    "op10_near_duplicates": OP10,
    "op11_prefix_trie": OP11,
    "op13_cluster_vectors": OP13,
}
