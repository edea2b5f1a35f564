"""The queries that SQL can express, for DuckDB over the same tables."""

#: Words of a text as the operators take them.
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SPANS = rf"""
WITH segments AS (
  SELECT doc_id, unnest(s) AS segment, generate_subscripts(s, 1) AS k
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?\n]+|[^.!?\n]+') AS s FROM documents)
), numbered AS (
  SELECT doc_id, k, segment, w, sum(CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i
  FROM (SELECT doc_id, k, segment, {WORDS.replace('text', 'segment')} AS w FROM segments)
), sentences AS (
  SELECT doc_id, i, array_to_string(w, ' ') AS words, len(w) AS n,
         sum(len(w)) OVER (PARTITION BY doc_id ORDER BY i) AS upto, count(*) OVER (PARTITION BY doc_id) AS m
  FROM numbered WHERE len(w) > 0
), reach AS (
  SELECT a.doc_id, a.i AS a, b.i AS b FROM sentences a JOIN sentences b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 29
  WHERE (b.i - a.i >= 2 AND b.upto - a.upto + a.n >= 10) OR b.upto - a.upto + a.n >= 30
), runs AS (
  SELECT doc_id, a, min(b) AS b FROM reach GROUP BY doc_id, a UNION SELECT doc_id, max(a), b FROM reach GROUP BY doc_id, b
), spans AS (
  SELECT r.doc_id, r.a, r.b, string_agg(s.words, ' ' ORDER BY s.i) AS content
  FROM runs r JOIN sentences s ON s.doc_id = r.doc_id AND s.i BETWEEN r.a AND r.b GROUP BY r.doc_id, r.a, r.b
), later AS (
  SELECT doc_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, a, b) AS rn FROM spans) WHERE rn > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(CAST(a AS BIGINT), CAST(b AS BIGINT) + 1)) AS i FROM later
), kept AS (
  SELECT n.doc_id, string_agg(n.segment, '' ORDER BY n.k) AS text
  FROM numbered n ANTI JOIN gone g ON n.doc_id = g.doc_id AND n.i = g.i GROUP BY n.doc_id
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_sentences, coalesce(g.n, 0) AS n_removed, coalesce(k.text, '') AS text
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM sentences GROUP BY doc_id) s USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
LEFT JOIN kept k USING (doc_id)
"""

DECONTAMINATION = f"""
WITH items AS (SELECT item_id, {WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM items WHERE len(w) > 0)
), docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
grams AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), found AS (SELECT g.doc_id, g.k, g.n, w.item FROM grams g JOIN windows w ON g.n = w.n AND g.phrase = w.phrase),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h USING (doc_id) LEFT JOIN named i USING (doc_id)
"""

EXACT = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM (
  SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, sha256(t) AS sha
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents))
"""

NEAR = f"""
WITH RECURSIVE words AS (SELECT doc_id, {WORDS} AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN [array_to_string(w[k:k + 4], ' ') FOR k IN range(1, len(w) - 3)]
                                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM words
), named AS (SELECT doc_id, s, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS set_id FROM sets),
rows AS (SELECT set_id, len(s) AS n, unnest(s) AS shingle FROM named WHERE doc_id = set_id),
links AS (
  SELECT a.set_id AS a, b.set_id AS b FROM rows a JOIN rows b ON a.shingle = b.shingle AND a.set_id < b.set_id
  GROUP BY a.set_id, b.set_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
hang (set_id, other) AS (SELECT a, a FROM edges UNION SELECT h.set_id, e.b FROM hang h JOIN edges e ON h.other = e.a),
groups AS (SELECT set_id, min(other) AS class_id FROM hang GROUP BY set_id),
counts AS (SELECT a AS set_id, count(*) AS n FROM edges GROUP BY a)
SELECT doc_id, coalesce(g.class_id, n.set_id) AS class_id, n.set_id, coalesce(c.n, 0) AS n_links
FROM named n LEFT JOIN groups g USING (set_id) LEFT JOIN counts c USING (set_id)
"""

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Checksums: `crc` has the remainder of each byte, `far` those of each byte of a state that 64 zero bytes follow.
_SHIFT = "lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
CRCS = f"""
  SELECT [list_reduce(list_concat([CAST(i AS BIGINT)], range(8)), {_SHIFT}) FOR i IN range(256)] AS crc,
         [[list_reduce(list_concat([CAST(i AS BIGINT) << 8 * j], range(512)), {_SHIFT}) FOR i IN range(256)] FOR j IN range(4)] AS far"""


def _crc(spelled: str) -> str:
    """The unsigned checksum of the bytes that a hexadecimal column spells: stretches of 64 bytes each, put together, then the rest."""
    def through(state: str, text: str) -> str:
        return f"""list_reduce(list_concat([{state}], [CAST('0x' || {text}[2 * k + 1:2 * k + 2] AS BIGINT) FOR k IN range(len({text}) // 2)]),
          lambda a, b: xor(a >> 8, crc[xor(a, b) % 256 + 1]))"""

    stretches = f"[{through('CAST(0 AS BIGINT)', 's')} FOR s IN [{spelled}[128 * i + 1:128 * i + 128] FOR i IN range(len({spelled}) // 128)]]"
    moved = " , ".join(f"far[{j + 1}][(a >> {8 * j}) % 256 + 1]" for j in range(4))
    joined = "xor(xor(xor(xor({}, {}), {}), {}), b)".format(*moved.split(" , "))
    whole = f"list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {stretches}), lambda a, b: {joined})"
    return f"xor({through(whole, f'{spelled}[128 * (len({spelled}) // 128) + 1:]')}, 4294967295)"


def _said(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE octet_length(encode(CAST({column} AS VARCHAR))) || ':' || {column} END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_said(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _climb(name: str, start: str, nodes: str) -> str:
    """A recursive table that climbs from `start` (id, tree, place, folded, proof) to the top of the trees in `nodes`."""
    return f"""
{name} AS (
  SELECT id, tree, 0 AS level, place, folded, proof FROM {start}
  UNION ALL
  SELECT c.id, c.tree, c.level + 1, c.place // 8, sha256(string_agg(CASE WHEN n.place = c.place THEN c.folded ELSE n.digest END, '' ORDER BY n.place)),
         c.proof || string_agg(CASE WHEN n.place = c.place THEN '' ELSE n.digest END, '' ORDER BY n.place)
  FROM {name} c JOIN {nodes} n ON n.tree = c.tree AND n.level = c.level AND n.place // 8 = c.place // 8 WHERE n.width > 1
  GROUP BY c.id, c.tree, c.level, c.place, c.folded, c.proof
)"""


def _nodes(name: str, ground: str) -> str:
    return f"""
{name} AS (
  SELECT tree, 0 AS level, place, digest, width FROM {ground}
  UNION ALL
  SELECT tree, level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (width + 7) // 8 FROM {name} WHERE width > 1 GROUP BY tree, level, place // 8, width
)"""


MERKLE = f"""
WITH RECURSIVE crcs AS MATERIALIZED ({CRCS}),
leaves AS (
  SELECT row_number() OVER () AS id, doc_id, lang, {_leaf('text')} AS leaf,
         CASE WHEN {_crc('h')} % 3 = 0 THEN {_leaf(LOWER.format('text'))} ELSE {_leaf('text')} END AS folded
  FROM (SELECT *, hex(encode(CAST(doc_id AS VARCHAR))) AS h FROM documents), crcs
), langs AS (SELECT lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) AS tree FROM (SELECT DISTINCT lang FROM documents)),
ground AS (
  SELECT l.*, l.leaf AS digest, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS place, count(*) OVER (PARTITION BY tree) AS width
  FROM leaves l JOIN langs g ON l.lang IS NOT DISTINCT FROM g.lang
), {_nodes('nodes', 'ground')},
subroots AS (SELECT 0 AS tree, tree - 1 AS place, digest, count(*) OVER () AS width FROM nodes WHERE width = 1), {_nodes('tops', 'subroots')},
below AS (SELECT id, tree, place, folded, '' AS proof FROM ground), {_climb('low', 'below', 'nodes')},
above AS (SELECT id, 0 AS tree, tree - 1 AS place, folded, proof FROM (SELECT *, max(level) OVER (PARTITION BY id) AS m FROM low) WHERE level = m), {_climb('high', 'above', 'tops')},
ended AS (SELECT id, folded, proof FROM (SELECT *, max(level) OVER (PARTITION BY id) AS m FROM high) WHERE level = m)
SELECT g.doc_id, g.leaf, s.digest AS subroot, r.digest AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = r.digest AS verified
FROM ground g JOIN ended e USING (id) JOIN subroots s ON s.place = g.tree - 1, (SELECT digest FROM tops WHERE width = 1) r
"""


def _drawn(path: str, child: str, weight: str) -> str:
    return f"-ln((CAST('0x' || md5({path} || '/' || {child} || ':' || k)[1:13] AS BIGINT) + 0.5e0) / 4503599627370496e0) / {weight}"


SHARDING = f"""
WITH crcs AS MATERIALIZED ({CRCS}),
shards AS (
  SELECT n, s AS shard, CASE WHEN s < 16 THEN 'region' || (s * 2) // 16 ELSE 'region-of-' || s END AS region, CASE WHEN s < 16 THEN 'rack' || (s * 4) // 16 ELSE 'rack-of-' || s END AS rack
  FROM (SELECT unnest([16, 17]) AS n), (SELECT unnest(range(17)) AS s) WHERE s < n
), keys AS (SELECT DISTINCT coalesce(CAST(doc_id AS VARCHAR), '-') AS k FROM documents),
regions AS (
  SELECT k, n, arg_min(region, t) AS region FROM (
    SELECT k, n, region, {_drawn("''", 'region', 'w')} AS t FROM keys, (SELECT n, region, count(*) AS w FROM shards GROUP BY n, region)) GROUP BY k, n
), racks AS (
  SELECT k, n, region, arg_min(rack, t) AS rack FROM (
    SELECT k, n, region, rack, {_drawn("'/' || region", 'rack', 'w')} AS t FROM regions JOIN (SELECT n, region, rack, count(*) AS w FROM shards GROUP BY n, region, rack) USING (n, region)) GROUP BY k, n, region
), placed AS (
  SELECT k, n, arg_min(shard, t) AS shard FROM (
    SELECT k, n, shard, {_drawn("'/' || region || '/' || rack", 'shard', '1e0')} AS t FROM racks JOIN shards USING (n, region, rack)) GROUP BY k, n
)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(a.shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY a.shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(b.shard AS INTEGER) AS grown_shard
FROM (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '-') AS k, len(h) // 2 + 1 AS size, {_crc('h')} AS text_crc32
      FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), crcs)
JOIN placed a USING (k) JOIN placed b USING (k) WHERE a.n = 16 AND b.n = 17
"""

SEARCH = f"""
WITH queries AS (
  SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({WORDS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term
), docs AS (SELECT row_number() OVER () AS id, doc_id, {WORDS} AS w FROM documents),
size AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM docs WHERE len(w) > 0),
counts AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM docs) SEMI JOIN queries USING (term) GROUP BY id, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, size GROUP BY term),
scores AS (
  SELECT item_id, c.id, CAST(sum(q.times * g.w * (1000000000 * c.tf // (1000 * c.tf + 12 * (75 + 25 * len(d.w) * s.n // s.l)))) AS BIGINT) AS score
  FROM queries q JOIN counts c USING (term) JOIN weights g USING (term) JOIN docs d ON c.id = d.id, size s GROUP BY item_id, c.id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scores JOIN docs USING (id) WHERE score > 0) WHERE rank <= 20
"""
