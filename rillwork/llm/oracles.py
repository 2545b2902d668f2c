"""DuckDB SQL that gives the rows of the queries straight from their definition."""

from rillwork.llm.mixing import FLATTEN, MARGINS, MOST_ROUNDS, NONE, OTHER, RATE, ROUNDS, STORE_EVERY, TOLERANCE, TOPICS

# Characters that count as white space, and the letters that are lower-cased.
BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINE_DEDUP = f"""
WITH whole AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM whole),
keyed AS (SELECT *, translate(trim(line, {BLANK}), '{UPPER}', '{LOWER}') AS key FROM lines),
common AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
judged AS (
  SELECT k.*, c.keeper IS NOT NULL AND k.doc_id <> c.keeper AS lost FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

# Words as the contract has them; RE2 reads the class as code points.
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), '{u}', '{l}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(
    u=UPPER, l=LOWER)

DECONTAMINATION = f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
pattern AS (
  SELECT DISTINCT item_id, len(w) AS size, array_to_string(w, ' ') AS key FROM item WHERE len(w) BETWEEN 1 AND 12
  UNION ALL
  SELECT DISTINCT item_id, 13, array_to_string(w[s:s + 12], ' ') FROM
    (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS s FROM item WHERE len(w) >= 13)),
size AS (SELECT DISTINCT size FROM pattern),
place AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM doc, size),
hit AS (
  SELECT doc_id, s, p.size, item_id FROM place JOIN pattern p
  ON p.size = place.size AND p.key = array_to_string(w[s:s + place.size - 1], ' ')),
word AS (SELECT DISTINCT doc_id, unnest(range(s, s + size)) AS pos FROM hit),
covered AS (SELECT doc_id, count(*) AS n_hit FROM word GROUP BY doc_id),
owner AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN owner USING (doc_id)
"""

_PLAIN = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

SUBSTRING_DEDUP = f"""
WITH doc AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
win AS (
  SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS key
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM doc WHERE len(w) >= 20)),
earliest AS (SELECT key, min((doc_id, s)) AS first FROM win GROUP BY key HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS pos
  FROM win JOIN earliest USING (key) WHERE (doc_id, s) <> first),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS pos FROM doc),
kept AS (
  SELECT doc_id, count(*) FILTER (g.pos IS NOT NULL) AS n_removed,
    string_agg(x, ' ' ORDER BY word.pos) FILTER (g.pos IS NULL) AS text
  FROM word LEFT JOIN gone g USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""

NEAR_DEDUP = f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[s:s + 2], ' ')) AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS s FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingle a JOIN shingle b USING (x) WHERE a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b
  WHERE 100 * c >= 85 * (p.n + q.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM doc
  UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
part AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM part LEFT JOIN size USING (doc_id)
"""

TOP_K = """
WITH whole AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

WARC = """
WITH page AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
mark AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS payload_digest, payload FROM page),
holder AS (SELECT payload, max(page_id) AS holder FROM mark WHERE payload_bytes >= 1000 GROUP BY payload)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM mark LEFT JOIN holder USING (payload)
"""

# Lines with a word, and the words of each text; the rules beyond the base follow.
QUALITY_RULES = f"""
WITH whole AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
doc AS (
  SELECT doc_id, text, {_PLAIN} AS w,
    [x FOR x IN string_split(text, chr(10)) IF trim(x, {BLANK}) <> ''] AS lines FROM whole),
win AS (
  SELECT doc_id, s, array_to_string(w[s:s + 2], ' ') AS key
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM doc WHERE len(w) >= 3)),
again AS (SELECT doc_id, key FROM win GROUP BY ALL HAVING count(*) > 1),
word AS (SELECT DISTINCT doc_id, unnest(range(s, s + 3)) AS pos FROM win JOIN again USING (doc_id, key)),
repeats AS (SELECT doc_id, count(*) AS n FROM word GROUP BY doc_id),
measured AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines,
    len([x FOR x IN lines IF ltrim(x, {BLANK})[1] IN ('-', '*', '•', '‣')]) AS n_bullets,
    len([x FOR x IN lines IF rtrim(x, {BLANK}) LIKE '%...' OR rtrim(x, {BLANK}) LIKE '%…']) AS n_cut,
    len([x FOR x IN w IF regexp_matches(x, '\\pL')]) AS n_letter
  FROM doc LEFT JOIN repeats USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR NOT word_chars BETWEEN 3 * n_words AND 10 * n_words
    OR 10 * n_symbols > n_words OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)
    OR 100 * n_bullets > 90 * n_lines OR 100 * n_cut > 30 * n_lines OR 100 * n_letter < 80 * n_words) AS kept
FROM measured
"""

COLLOCATIONS = f"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS part
  FROM documents),
run AS (SELECT lang, regexp_extract_all(part, '[^\\x20\\x09]+') AS w FROM piece),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM run GROUP BY lang),
place AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS s FROM run),
gram AS (
  SELECT lang, w[s:s + size - 1] AS p, count(*) AS f
  FROM place, (SELECT unnest(range(1, 6)) AS size) WHERE s + size - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
candidate AS (SELECT * FROM gram WHERE len(p) > 1),
cut AS (
  SELECT lang, p, f, unnest(range(1, len(p))) AS k FROM candidate c
  WHERE NOT EXISTS (
    SELECT 1 FROM candidate x WHERE x.lang = c.lang AND len(x.p) > len(c.p) AND x.f >= c.f AND
      contains(' ' || array_to_string(x.p, ' ') || ' ', ' ' || array_to_string(c.p, ' ') || ' '))),
scored AS (
  SELECT c.lang, c.p, c.f AS a, k, x.f AS l, y.f AS r, n,
    CAST((1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cut c JOIN gram x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN gram y ON y.lang = c.lang AND y.p = c.p[k + 1:]
    JOIN total t ON t.lang = c.lang),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS nth FROM scored),
ranked AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank
  FROM lowest WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

HARD_NEGATIVES = """
WITH given AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM given q JOIN given c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
near AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM scored WHERE same),
hard AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM near JOIN scored USING (anchor_id)
  WHERE nth <= 5 AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM hard WHERE rank <= 10
"""


def _mixing() -> str:
    counts = {name: f"len(regexp_extract_all(coalesce(text, ''), '{p}'))" for name, p in TOPICS.items()}
    most = f"greatest({', '.join(counts.values())})"
    topic = f"CASE WHEN {most} = 0 THEN '{OTHER}' " + "".join(
        f"WHEN {c} = {most} THEN '{name}' " for name, c in counts.items()) + "END"
    steps = [f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, {topic} AS topic,
    len({_PLAIN}) AS tokens,
    CAST('0x' || substr(md5('mix:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
  FROM documents),
cell AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM doc GROUP BY ALL),
total AS (SELECT sum(tokens) AS t FROM cell)"""]
    for m in MARGINS:
        steps.append(f"""
{m}_power AS (SELECT {m}, pow(sum(tokens), {FLATTEN}) AS p FROM cell GROUP BY {m}),
{m}_goal AS (SELECT {m}, t * p / (SELECT sum(p) FROM {m}_power) AS goal FROM {m}_power, total)""")
    goals = ", ".join(f"{m}_goal.goal AS {m}_goal" for m in MARGINS)
    joins = " ".join(f"JOIN {m}_goal USING ({m})" for m in MARGINS)
    kept = "source, lang, topic, tokens, " + ", ".join(f"{m}_goal" for m in MARGINS)
    inner = "(SELECT * FROM round WHERE NOT done)"
    for m in MARGINS:
        inner = f"""(
      SELECT nth, done, {kept}, coalesce(raked * {m}_goal / nullif(sum(raked) OVER (PARTITION BY {m}), 0), 0) AS raked FROM {inner})"""
    off = ", ".join(f"abs(sum(raked) OVER (PARTITION BY {m}) - {m}_goal) / {m}_goal" for m in MARGINS)
    # Round after round until the margins hold, looked at as often as the operator does.
    steps.append(f"""
round AS (
  SELECT 0 AS nth, false AS done, source, lang, topic, tokens, {goals}, tokens AS raked FROM cell {joins}
  UNION ALL
  SELECT nth + 1, nth + 1 >= {MOST_ROUNDS} OR (nth + 1 >= {ROUNDS} AND (nth + 1) % {STORE_EVERY} = 0 AND max(off) OVER () <= {TOLERANCE}), {kept}, raked
  FROM (SELECT *, greatest({off}) AS off FROM {inner}))""")
    steps.append(f"""
chance AS (
  SELECT source, lang, topic, {RATE} * coalesce(raked / nullif(tokens, 0), 0) AS times FROM round WHERE done)""")
    return ",".join(steps) + """
SELECT doc_id, source, lang, topic, tokens, round(least(1.0::DOUBLE, times), 6) AS probability,
  round(greatest(1.0::DOUBLE, times), 6) AS weight, draw < times AS sampled
FROM doc JOIN chance USING (source, lang, topic)
"""


MIXING = _mixing()
