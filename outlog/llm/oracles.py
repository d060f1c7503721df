"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

SPACE = r"'[\x20\x09-\x0D]'"
SPACES = r"'[\x20\x09-\x0D]+'"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# the 256 entries of the reflected CRC-32 (polynomial 0xEDB88320), made by its rule
CRC = """crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS c
    FROM range(256) r(i)) b)"""


def crc32(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes; needs the table ``crc``."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda a, x: xor(a >> 8, crc.t[(xor(a, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"


def words(text: str) -> str:
    """The words of a text that is not null, in order."""
    return f"list_filter(regexp_split_to_array({text}, {SPACES}), lambda x: x <> '')"


def oracles() -> dict[str, str]:
    fixed = [("block", "example.com/de/"), ("allow", "example.net/en/"), ("allow", "org/fr/"), ("block", "net/")]
    fits = {r: f"(host = '{r.split('/')[0]}' OR ends_with(host, '.{r.split('/')[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}')" for _, r in fixed}
    rule = "CASE " + " ".join(f"WHEN {fits[r]} THEN '{r}'" for _, r in fixed) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits[r]} THEN '{v}'" for v, r in fixed) + " WHEN mined_rule IS NULL THEN 'allow' ELSE 'block' END"
    part = "list_transform(list_filter(string_split({}, '{}'), lambda x: x <> ''), lambda x: {})"
    # every subset of the distinguishable tokens of every bad page is counted over all labelled pages
    urls = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url,
                  {LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
j AS (SELECT page_id, host, path, list_sort(list_distinct(
        {part.format("host", ".", "'h:' || x")}
        || {part.format("regexp_replace(path, '[0-9]+', '0', 'g')", "/", "'p:' || x")}
        || {part.format("regexp_extract(url, '(?s)^[^?#]*[?]([^#]*)', 1)", "&", "'q:' || string_split(x, '=')[1]")})) AS tokens FROM p),
l AS (SELECT tokens, quality = 0 OR toxic = 1 AS bad FROM j JOIN labels ON doc_id = page_id),
s AS (SELECT tokens, row_number() OVER () AS sid, sum(CAST(bad AS BIGINT)) AS bad, count(*) AS n FROM l WHERE bad IS NOT NULL GROUP BY tokens),
total AS (SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad FROM s),
own AS (SELECT token, list(sid ORDER BY sid) AS sids FROM (SELECT sid, unnest(tokens) AS token FROM s) u GROUP BY token),
kept AS (SELECT list(token) AS ts FROM (SELECT min(token) AS token FROM own GROUP BY sids) k),
b AS (SELECT list_filter(tokens, lambda x: list_contains(kept.ts, x)) AS ts FROM s, kept WHERE bad > 0),
m AS (SELECT ts, unnest(range(1, CAST(pow(2, len(ts)) AS BIGINT))) AS mask FROM b),
c AS (SELECT DISTINCT list_filter(ts, lambda x, i: (mask >> (i - 1)) % 2 = 1) AS need FROM m),
f AS (SELECT need, CAST(sum(s.bad) AS DOUBLE) AS bad, CAST(sum(s.n) AS DOUBLE) AS n FROM c JOIN s ON list_has_all(s.tokens, c.need) GROUP BY need),
r AS (SELECT need, f.bad / f.n AS confidence, f.bad / total.n AS support FROM f, total
      WHERE f.bad >= 4 AND f.bad / f.n >= 0.6 AND f.bad * total.n - f.n * total.bad >= 1.96 * sqrt(f.n * total.bad * (total.n - total.bad))),
rules AS (SELECT *, array_to_string(need, ' ') AS mined_rule FROM r
          WHERE NOT EXISTS (SELECT 1 FROM r o WHERE len(o.need) < len(r.need) AND list_has_all(r.need, o.need))),
hit AS (SELECT tokens, mined_rule, confidence,
               row_number() OVER (PARTITION BY tokens ORDER BY confidence DESC, support DESC, mined_rule DESC) AS place
        FROM (SELECT DISTINCT tokens FROM j) d JOIN rules ON list_has_all(tokens, need))
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, mined_rule, confidence
FROM j LEFT JOIN (SELECT * FROM hit WHERE place = 1) h USING (tokens)"""

    near = f"""
WITH RECURSIVE d AS (SELECT doc_id, {words(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
z AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
sized AS (SELECT g.doc_id, g.g, z.n FROM g JOIN z USING (doc_id)),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS i FROM sized a JOIN sized b
         ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY 1, 2),
one AS (SELECT a, b FROM pairs WHERE 100 * i >= 80 * (m + n - i)),
link AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
reach AS (SELECT doc_id, doc_id AS top FROM documents UNION SELECT b, top FROM reach JOIN link ON a = doc_id),
comp AS (SELECT doc_id, min(top) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN comp USING (doc_id) LEFT JOIN z USING (doc_id)"""

    quality = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {words("coalesce(text, '')")} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS five FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d) u),
again AS (SELECT doc_id, i FROM v QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1),
rep AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM again) u GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(text, {SPACE}, '', 'g')) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
             length(regexp_replace(text, '[0-9\\x20\\x09-\\x0D]', '', 'g')) AS n_nondigits FROM d LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 2 * n_words
            OR word_chars > 15 * n_words OR 2 * n_nondigits < word_chars) AS kept FROM f"""

    exact = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), {SPACE}, '', 'g')) AS h FROM documents),
k AS (SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY length(text) DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY h) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k"""

    trie = f"""
WITH {CRC},
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
                 md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m,
                 length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, {crc32("CAST(c AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id AS c FROM turns) i, crc),
parts AS (SELECT c, 0 AS part, pos, m, chars FROM ids JOIN turns ON conv_id = c - c % 100 AND pos <= h
          UNION ALL SELECT c, 1, pos, m, chars FROM ids JOIN turns ON conv_id = c AND pos > h),
seq AS (SELECT c, row_number() OVER w AS d, md5(string_agg(m, '') OVER w) AS k, chars FROM parts WINDOW w AS (PARTITION BY c ORDER BY part, pos)),
path AS (SELECT c, 0 AS d, '' AS k, CAST(NULL AS VARCHAR) AS up, 0 AS chars FROM ids
         UNION ALL SELECT c, d, k, coalesce(lag(k) OVER (PARTITION BY c ORDER BY d), ''), chars FROM seq),
nodes AS (SELECT k, any_value(d) AS d, any_value(up) AS up, min(c) AS conv_id, count(*) AS n, any_value(chars) AS chars FROM path GROUP BY k),
kids AS (SELECT up AS k, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
under AS (SELECT DISTINCT a.k, b.k AS below FROM path a JOIN path b ON a.c = b.c AND b.d >= a.d),
sub AS (SELECT under.k, count(*) FILTER (WHERE kids.n IS NULL) AS leaves, sum((nodes.n - 1) * chars) AS saved
        FROM under JOIN nodes ON nodes.k = below LEFT JOIN kids ON kids.k = below GROUP BY under.k),
ends AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS h
         FROM (SELECT *, max(d) OVER (PARTITION BY c) AS total FROM path) t WHERE d = total GROUP BY k)
SELECT nodes.conv_id, CAST(nodes.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, nodes.n AS n_convs,
       coalesce(kids.n, 0) AS n_children, sub.leaves AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens,
       coalesce(ends.h, sha256('')) AS ends_sha256
FROM nodes JOIN sub USING (k) LEFT JOIN kids USING (k) LEFT JOIN ends USING (k) LEFT JOIN nodes up ON up.k = nodes.up"""

    shards = f"""
WITH {CRC},
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, {crc32("coalesce(text, '')")} AS text_crc32,
             coalesce('=' || source, '-') AS src, md5('17:' || coalesce('=' || CAST(doc_id AS VARCHAR), '-')) AS k FROM documents, crc),
r AS (SELECT *, (row_number() OVER (PARTITION BY src ORDER BY k) - 0.5e0) / count(*) OVER (PARTITION BY src) AS frac FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY frac, src, k) - 1 AS pos, count(*) OVER () AS n FROM r),
s AS (SELECT *, pos * 24 // n AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, pos - (shard * n + 23) // 24 AS slot,
       CAST(NULL AS INTEGER) AS grown_shard FROM s"""

    return {"op7_sharding": shards, "op1_url_filters": urls, "op5_minhash": near, "op6_quality": quality, "op11_exact_dedup": exact, "op12_prefix_trie": trie}
