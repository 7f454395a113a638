"""SQL that the queries must equal, where SQL can express them."""

from __future__ import annotations

_WORDS = r"'[^\x20\x09-\x0D]+'"

# --- op1 ---


def _strength(children: str, name: str) -> str:
    """Prior strength by the method of moments from a table of (n, k)."""
    return f"""{name}_sums AS (SELECT count(*)::DOUBLE AS m, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, sum(n::DOUBLE*n) AS nn, sum(k::DOUBLE*k/n) AS kk FROM {children}),
{name} AS (SELECT CASE WHEN n IS NULL OR n - nn/n <= 0 OR (kk - k*k/n - (m-1)*(k/n)*(1-k/n))/(n - nn/n) <= 0 THEN 1000.0
  ELSE least(1000.0, greatest(1.0, (k/n)*(1-k/n)/((kk - k*k/n - (m-1)*(k/n)*(1-k/n))/(n - nn/n)) - 1)) END AS s FROM {name}_sums)"""


OP1 = f"""WITH parsed AS (
 SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
labelled AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
outcomes AS (SELECT host, good FROM parsed JOIN labelled ON doc_id = try_cast(nullif(regexp_extract(path, '/([0-9]+)', 1), '') AS BIGINT)),
hosts AS (SELECT host, array_to_string(string_split(host,'.')[-2:], '.') AS domain, list_extract(string_split(host,'.'), -1) AS suffix,
  count(*) AS n, sum(good)::BIGINT AS k FROM outcomes GROUP BY host),
domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM domains GROUP BY ALL),
{_strength("suffixes", "s0")},
{_strength("domains", "s1")},
{_strength("hosts", "s2")},
overall AS (SELECT coalesce(sum(k)::DOUBLE/sum(n), 0.5) AS p FROM suffixes),
tops AS (SELECT suffix, (k + s0.s*p)/(n + s0.s) AS up FROM suffixes, s0, overall),
middle AS (SELECT domain, (k + s1.s*up)/(n + s1.s) AS up FROM domains JOIN tops USING (suffix), s1),
means AS (SELECT host, n, (k + s2.s*up)/(n + s2.s) AS mean, n + s2.s AS weight FROM hosts JOIN middle USING (domain), s2),
bounds AS (SELECT host, n, mean - 1.645*sqrt(mean*(1-mean)/(weight+1)) AS bound FROM means),
backed AS (SELECT host, coalesce(middle.up, tops.up, p) AS mean FROM (SELECT DISTINCT host, array_to_string(string_split(host,'.')[-2:], '.') AS domain,
  list_extract(string_split(host,'.'), -1) AS suffix FROM parsed) LEFT JOIN middle USING (domain) LEFT JOIN tops USING (suffix), overall),
unseen AS (SELECT host, mean - 1.645*sqrt(mean*(1-mean)/(s2.s+1)) AS bound FROM backed, s2),
ruled AS (SELECT *, CASE
  WHEN (host='example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host='example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host='org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host='net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parsed)
SELECT page_id, ruled.host, path, rule,
 CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN coalesce(bounds.bound, unseen.bound) >= 0.5 THEN 'allow' ELSE 'block' END AS verdict, coalesce(n, 0) AS n_outcomes
FROM ruled LEFT JOIN bounds ON ruled.host = bounds.host JOIN unseen ON ruled.host = unseen.host"""

# --- op9 ---


def _sainte_lague(items: str, group: str, key: str, weight: str, seats: str, out: str, name: str) -> str:
    """Seats by highest quotients target/(2s+1): every quotient that could win is listed and ranked."""
    over = f"PARTITION BY {group}" if group else ""
    return f"""{name}_a AS (SELECT *, sum(CASE WHEN {weight} > 0 THEN 1 ELSE 0 END) OVER ({over}) / 2.0 AS half, CAST(sum({weight}) OVER ({over}) AS DOUBLE) AS total FROM {items}),
{name}_b AS (SELECT *, CASE WHEN {seats} > half AND {weight} > 0 THEN greatest(0, floor({weight}::DOUBLE/(total/({seats}-half)) + 0.5)::BIGINT - 1) ELSE 0 END AS low,
  CASE WHEN {weight} > 0 AND {seats} > 0 THEN floor({weight}::DOUBLE/(total/({seats}+half)) + 0.5)::BIGINT + 1 ELSE 0 END AS high FROM {name}_a),
{name}_c AS (SELECT *, {seats} - sum(low) OVER ({over}) AS spare FROM {name}_b),
{name}_d AS (SELECT *, unnest(range(low, greatest(low, high))) AS j FROM {name}_c),
{name}_e AS (SELECT *, row_number() OVER ({over} ORDER BY {weight}::DOUBLE/(2*j+1) DESC, {key} NULLS LAST) AS place FROM {name}_d),
{name}_f AS (SELECT {group + ", " if group else ""}{key}, count(*) AS won FROM {name}_e WHERE place <= spare GROUP BY ALL),
{name} AS (SELECT c.* EXCLUDE (half, total, low, high, spare), (low + coalesce(won, 0))::BIGINT AS {out} FROM {name}_c c LEFT JOIN {name}_f f
  ON {" AND ".join(f"c.{x} IS NOT DISTINCT FROM f.{x}" for x in [*filter(None, group.split(", ")), key])})"""


_DIGEST = "md5('1:' || coalesce(doc_id::VARCHAR, 'null'))"
OP9 = f"""WITH sizes AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {_WORDS})), 0)::BIGINT AS size, {_DIGEST} AS digest FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM sources),
levels AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER below, 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0)) AS level FROM weighed
  WINDOW below AS (ORDER BY cap/weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals0 AS (SELECT source, source_size, least(cap::DOUBLE, (max(level) OVER ()) * weight) AS target FROM levels),
goals1 AS (SELECT *, floor(sum(target) OVER () / 32 + 0.5)::BIGINT AS all_blocks FROM goals0),
{_sainte_lague("goals1", "", "source", "target", "all_blocks", "source_blocks", "goals")},
dealt AS (SELECT doc_id, g.source, size, source_size, target, source_blocks,
  ('0x' || substr(digest, 1, 8))::BIGINT % greatest(1, least(1024, ceil(source_size/100000.0)))::BIGINT AS bucket,
  ('0x' || substr(digest, 9, 8))::BIGINT % greatest(1, ceil(source_size/102400000.0))::BIGINT AS shard,
  ('0x' || substr(digest, 17, 8))::BIGINT AS dice FROM sizes JOIN goals g ON sizes.source IS NOT DISTINCT FROM g.source),
shards0 AS (SELECT source, bucket, shard, source_blocks, sum(size)::BIGINT AS shard_size FROM dealt GROUP BY ALL),
buckets0 AS (SELECT source, bucket, source_blocks, sum(shard_size)::BIGINT AS bucket_size FROM shards0 GROUP BY ALL),
{_sainte_lague("buckets0", "source", "bucket", "bucket_size", "source_blocks", "bucket_blocks", "buckets")},
shards1 AS (SELECT s.source, s.bucket, shard, shard_size, bucket_blocks FROM shards0 s JOIN buckets b ON s.source IS NOT DISTINCT FROM b.source AND s.bucket = b.bucket),
{_sainte_lague("shards1", "source, bucket", "shard", "shard_size", "bucket_blocks", "blocks", "shards")},
placed AS (SELECT d.*, blocks, shard_size, least(blocks * 32, shard_size * 2) AS quota,
  coalesce(sum(size) OVER (PARTITION BY d.source, d.bucket, d.shard ORDER BY dice, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM dealt d JOIN shards s ON d.source IS NOT DISTINCT FROM s.source AND d.bucket = s.bucket AND d.shard = s.shard)
SELECT doc_id, source, size, source_size, target, blocks,
 (CASE WHEN shard_size > 0 THEN (quota // shard_size) * size + greatest(0, least(size, quota - (quota // shard_size) * shard_size - start)) ELSE 0 END)::BIGINT AS taken FROM placed"""

# --- op6 ---

_CONTENT = "coalesce(text, '')"
OP6 = f"""WITH items AS (SELECT conv_id, turn, role, text,
  CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
  CASE role WHEN 'user' THEN conv_id::VARCHAR || ':' || turn::VARCHAR WHEN 'assistant' THEN conv_id::VARCHAR || ':' || (turn - 1)::VARCHAR END AS call_id FROM conversations),
links AS (SELECT conv_id, call_id, min(turn) FILTER (kind = 'call') AS first_turn, count(*) FILTER (kind = 'result') AS n_results FROM items WHERE call_id IS NOT NULL GROUP BY ALL),
joined AS (SELECT items.*, first_turn, n_results, CASE WHEN kind = 'result' AND first_turn IS NOT NULL THEN first_turn END AS call_turn
  FROM items LEFT JOIN links ON items.conv_id = links.conv_id AND items.call_id = links.call_id)
SELECT conv_id, turn, 0 AS place, role, kind, call_id,
 CASE WHEN kind = 'call' AND first_turn <> turn THEN 'duplicate' WHEN kind = 'call' AND n_results = 0 THEN 'unanswered' WHEN kind = 'result' AND first_turn IS NULL THEN 'orphan' ELSE 'ok' END AS state,
 call_turn,
 CASE WHEN kind = 'call' THEN concat_ws('; ', CASE WHEN length({_CONTENT}) < 50 THEN 'text is below 50' WHEN length({_CONTENT}) > 400 THEN 'text is above 400' END, CASE WHEN turn < 0 THEN 'turn is below 0' END) ELSE '' END AS errors,
 row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(call_turn, turn), CASE WHEN call_turn IS NULL THEN 0 ELSE 1 END, turn, role, text) - 1 AS position,
 CASE kind WHEN 'call' THEN '{{"arguments":{{"text":' || to_json({_CONTENT})::VARCHAR || ',"turn":' || turn::VARCHAR || '}},"id":' || to_json(call_id)::VARCHAR || ',"name":"reply","role":' || to_json(role)::VARCHAR || '}}'
  WHEN 'result' THEN '{{"content":' || to_json({_CONTENT})::VARCHAR || ',"id":' || to_json(call_id)::VARCHAR || ',"role":' || to_json(role)::VARCHAR || '}}'
  ELSE '{{"content":' || to_json({_CONTENT})::VARCHAR || ',"role":' || to_json(role)::VARCHAR || '}}' END AS json
FROM joined"""

# --- op2, op4: sets of shingles, of words, joined on each of them; for small tables ---


def _shingles(words: str) -> str:
    return f"list_distinct(CASE WHEN len({words}) = 0 THEN [] WHEN len({words}) < 5 THEN [array_to_string({words}, ' ')] ELSE [array_to_string({words}[i:i+4], ' ') for i in range(1, len({words}) - 3)] END)"


OP2 = f"""WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
sets AS (SELECT doc_id, {_shingles("w")} AS s FROM worded),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM tokens x JOIN tokens y USING (t) WHERE x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON other = links.a)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)"""

OP4 = f"""WITH lines AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10)))))::INT AS line, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL),
worded AS (SELECT doc_id, line, regexp_extract_all(t, {_WORDS}) AS w FROM lines),
sets AS (SELECT doc_id, line, row_number() OVER (ORDER BY doc_id, line) AS k, list_distinct(w) AS s FROM worded WHERE len(w) > 0),
tokens AS (SELECT k, len(s) AS n, unnest(s) AS t FROM sets),
gone AS (SELECT DISTINCT k FROM (SELECT x.k FROM tokens x JOIN tokens y ON x.t = y.t AND y.k < x.k
  GROUP BY x.k, y.k, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*)))),
per AS (SELECT doc_id, count(*) AS n_lines, count(gone.k) AS n_removed, string_agg(CASE WHEN gone.k IS NOT NULL THEN line::VARCHAR END, ',' ORDER BY line) AS removed
  FROM sets LEFT JOIN gone USING (k) GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed FROM documents LEFT JOIN per USING (doc_id)"""
