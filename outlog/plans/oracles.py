"""Equivalent SQL for the registered queries (DuckDB dialect, tables pre-registered as views).

Each statement recomputes its query from the base tables with plain SQL: windows, joins,
recursive CTEs.  The Spark side never runs these; they are the independent check.
"""

from __future__ import annotations

LINES = """
lines AS (
  SELECT doc_id, source, CAST(unnest(generate_series(0, len(ls) - 1)) AS INTEGER) AS line_no,
         unnest(ls) AS message
  FROM (SELECT doc_id, source, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ls
        FROM documents) s
),
tl AS (SELECT *, regexp_replace(message, '[^a-zA-Z]', '', 'g') AS template FROM lines)"""

CONV_TEMPLATES = """
clines AS (
  SELECT conv_id, turn, unnest(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS message
  FROM conversations
),
ct AS (SELECT DISTINCT regexp_replace(message, '[^a-zA-Z]', '', 'g') AS word FROM clines)"""

EVLINES = """
evl AS (
  SELECT event_id,
         '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '] [' || upper(event_type) || '] user '
             || CAST(user_id AS VARCHAR) || ' props ' || props AS value
  FROM events
)"""

# embeddings as doubles, the 4 x 4 codebook sampled by seeded hash, and each row's BMU
EMB = """
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
cb AS (
  SELECT CAST(row_number() OVER (ORDER BY h, vec_id) - 1 AS INTEGER) AS node, v
  FROM (SELECT vec_id, v,
               CAST('0x' || substr(md5('7:' || CAST(vec_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 AS h
        FROM e ORDER BY h, vec_id LIMIT 16) s
),
dd AS (SELECT e.vec_id, cb.node, list_distance(e.v, cb.v) AS dist FROM e, cb),
b AS (
  SELECT vec_id, node AS bmu, dist FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, node) AS rn FROM dd) t
  WHERE rn = 1
)"""

# feedback requests from labels x documents, validated and inserted
FEEDBACK = """
val AS (
  SELECT CAST(l.doc_id AS VARCHAR) AS predict_id, d.text AS message, l.quality = 0 AS reported_anomaly_status,
         d.source AS customer_id,
         CASE WHEN length(d.text) > 2000 THEN 'message_too_long' END AS reject_reason
  FROM labels l JOIN documents d USING (doc_id)
),
ins AS (
  SELECT CAST(row_number() OVER (ORDER BY predict_id) AS INTEGER) AS id, *
  FROM val WHERE reject_reason IS NULL
),
fp AS (SELECT DISTINCT message FROM ins WHERE reported_anomaly_status)"""

FOLLOWERS = " UNION ALL ".join(
    f"SELECT template AS word, lead(template, {k}) OVER (PARTITION BY doc_id ORDER BY line_no) AS context FROM tl"
    for k in range(1, 6))


def _map_epoch(k: int, sigma: float) -> str:
    """One batch epoch of a 4 x 4 map, lines as weights, Gaussian neighbourhood: m{k-1} -> m{k}."""
    return f"""
b{k} AS MATERIALIZED (SELECT template, n, node AS bmu FROM (
  SELECT t.template, t.n, c.node, row_number() OVER (PARTITION BY t.template ORDER BY list_distance(t.v, c.v), c.node) AS rn
  FROM tv t, m{k - 1} c) d WHERE rn = 1),
s{k} AS (SELECT b.bmu, x.i, sum(b.n * x.x) AS s FROM b{k} b JOIN tx x USING (template) GROUP BY 1, 2),
n{k} AS (SELECT bmu, sum(n) AS n FROM b{k} GROUP BY 1),
h{k} AS (SELECT a.range AS j, c.range AS bb, exp(-CAST((a.range // 4 - c.range // 4) ** 2 + (a.range % 4 - c.range % 4) ** 2 AS DOUBLE)
                                                 / {2 * sigma ** 2!r}) AS h FROM range(16) a, range(16) c),
e{k} AS (SELECT h.j, sum(h.h * n.n) AS den FROM h{k} h JOIN n{k} n ON h.bb = n.bmu GROUP BY 1),
w{k} AS (SELECT h.j, s.i, sum(h.h * s.s) AS num FROM h{k} h JOIN s{k} s ON h.bb = s.bmu GROUP BY 1, 2),
m{k} AS MATERIALIZED (SELECT CAST(j AS INTEGER) AS node, list(num / den ORDER BY i) AS v FROM w{k} JOIN e{k} USING (j) GROUP BY j)"""


def scored_lines(dim: int, epochs: int) -> str:
    """Templates by their neighbours' mean seeded vectors, a fitted 4 x 4 map, every line's distance."""
    steps = [2.0 - 1.5 * t / (epochs - 1) for t in range(epochs)]
    return LINES + f""",
tc AS MATERIALIZED (SELECT template, count(*) AS n FROM tl GROUP BY template),
fw AS ({FOLLOWERS}),
cn AS (SELECT word, context, count(*) AS n FROM (
         SELECT word, context FROM fw WHERE context IS NOT NULL
         UNION ALL SELECT context AS word, word AS context FROM fw WHERE context IS NOT NULL) u GROUP BY 1, 2),
hw AS MATERIALIZED (
  SELECT template, i, CAST('0x' || substr(md5('1:' || template || ':' || CAST(i AS VARCHAR)), 1, 5) AS BIGINT) AS h
  FROM tc, range(0, {dim}) r(i)),
sw AS (SELECT cn.word AS template, hw.i, sum(cn.n * hw.h) AS s, sum(cn.n) AS m
       FROM cn JOIN hw ON hw.template = cn.context GROUP BY 1, 2),
tx AS MATERIALIZED (
  SELECT hw.template, hw.i, (CAST(coalesce(sw.s, hw.h) AS DOUBLE) / CAST(coalesce(sw.m, 1) AS DOUBLE) / 1048576 - 0.5) / {dim} AS x
  FROM hw LEFT JOIN sw ON sw.template = hw.template AND sw.i = hw.i),
tv AS MATERIALIZED (SELECT template, any_value(tc.n) AS n, list(x ORDER BY i) AS v FROM tx JOIN tc USING (template) GROUP BY template),
m0 AS (SELECT CAST(row_number() OVER (ORDER BY n DESC, template) - 1 AS INTEGER) AS node, v
       FROM tv ORDER BY n DESC, template LIMIT 16),""" + ",".join(_map_epoch(k + 1, s) for k, s in enumerate(steps)) + f""",
bt AS MATERIALIZED (
  SELECT template, node AS bmu, dist FROM (
    SELECT *, row_number() OVER (PARTITION BY template ORDER BY dist, node) AS rn FROM (
      SELECT t.template, c.node, list_distance(t.v, c.v) AS dist FROM tv t, m{epochs} c) d) t WHERE rn = 1
),
sl AS MATERIALIZED (SELECT tl.*, bt.bmu, bt.dist FROM tl JOIN bt USING (template)),
mx AS (SELECT max(dist) AS m FROM sl),
st AS (SELECT avg(dist / m) AS mean, stddev_pop(dist / m) AS std FROM sl, mx),
thr AS (SELECT 3.1 * std + mean AS thr FROM st)"""


# per-line predictions of the map fitted for two epochs
PRED = scored_lines(8, 2) + "," + FEEDBACK.rstrip() + """,
pr AS (
  SELECT sl.doc_id, sl.line_no, sl.source, sl.message,
         sha256('v1:batch-0:' || CAST(sl.doc_id AS VARCHAR) || ':' || CAST(sl.line_no AS VARCHAR)) AS predict_id,
         sl.dist / mx.m AS anomaly_score, 1 AS elast_alert, 'batch-0' AS inference_batch_id,
         'localhost' AS predictor_namespace, replace(url_encode(sl.message), '%2F', '/') AS e_message,
         CASE WHEN sl.dist / mx.m > thr.thr AND sl.message IN (SELECT message FROM fp) THEN 1 ELSE 0 END AS suppressed,
         CASE WHEN sl.dist / mx.m > thr.thr AND sl.message NOT IN (SELECT message FROM fp) THEN 1 ELSE 0 END AS anomaly,
         CASE WHEN sl.dist / mx.m > thr.thr THEN 1 ELSE 0 END AS over
  FROM sl, mx, thr
)"""


def _w(*parts: str) -> str:
    return "WITH " + ",".join(p.strip().rstrip(",") for p in parts)


def _rate(minutes: int) -> str:
    return f"""
SELECT event_type, time_bucket(INTERVAL '{minutes} minutes', ts) AS window_start, count(*) AS n,
       round(count(*) / {60.0 * minutes}, 6) AS rate
FROM events GROUP BY 1, 2"""


def _greedy(cand_sql: str, key: str | None, gap_s: int, extra_cols: str = "") -> str:
    """Greedy minimum-gap selection as a recursive CTE (one row per step per key)."""
    part = f"PARTITION BY {key}" if key else ""
    same = f"AND c.{key} = s.{key}" if key else ""
    k0 = f"{key}, " if key else ""
    kn = f"n.{key}, " if key else ""
    ks = f"s.{key}, " if key else ""
    return f"""
WITH RECURSIVE cand AS ({cand_sql}),
sel AS (
  SELECT {k0}event_id, ts FROM (
    SELECT *, row_number() OVER ({part} ORDER BY ts, event_id) AS rn FROM cand) h WHERE rn = 1
  UNION ALL
  SELECT {kn}n.event_id, n.ts FROM sel s,
    LATERAL (SELECT * FROM cand c WHERE c.ts >= s.ts + INTERVAL {gap_s} SECOND {same}
             ORDER BY c.ts, c.event_id LIMIT 1) n
)
SELECT {ks}s.event_id, s.ts{extra_cols} FROM sel s JOIN cand c ON s.event_id = c.event_id"""


def oracles() -> dict[str, str]:
    q: dict[str, str] = {}
    q["log_lines"] = _w(LINES) + " SELECT doc_id, line_no, source, message, template FROM tl"
    q["template_counts"] = _w(LINES) + " SELECT template, count(*) AS n FROM tl GROUP BY template"
    q["common_log_parse"] = _w(EVLINES, """
tok AS (SELECT event_id, string_split(value, ' ') AS t FROM evl)""") + r"""
SELECT event_id,
       try_strptime(regexp_replace(t[1], '^\[|\]$', '', 'g'), '%Y-%m-%dT%H:%M:%S.%f') AS ts,
       regexp_replace(t[2], '^\[|\]$', '', 'g') AS severity,
       array_to_string(t[3:], ' ') AS message,
       regexp_replace(array_to_string(t[3:], ' '), '[^a-zA-Z]', '', 'g') AS template
FROM tok"""
    q["strip_prefix"] = _w(EVLINES) + """
SELECT event_id,
       CASE WHEN len(string_split(value, '] ')) > 1 THEN string_split(value, '] ')[2] ELSE value END AS message,
       CASE WHEN len(string_split(value, '] ')) > 1 THEN value END AS orig_message
FROM evl"""
    q["json_flatten"] = """
SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS props_k FROM events"""
    q["to_str_fill"] = """
SELECT d.doc_id, coalesce(d.lang, 'EMPTY') AS lang_s, coalesce(CAST(d.n_chars AS VARCHAR), 'EMPTY') AS n_chars_s,
       coalesce(CAST(l.quality AS VARCHAR), 'EMPTY') AS quality_s, coalesce(CAST(l.toxic AS VARCHAR), 'EMPTY') AS toxic_s
FROM documents d LEFT JOIN labels l USING (doc_id)"""
    q["percent_encode"] = _w(LINES) + """
SELECT doc_id, line_no, replace(url_encode(message), '%2F', '/') AS e_message FROM tl"""
    q["window_read"] = """
SELECT event_id, ts, user_id, event_type FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-12 12:00:00' AND TIMESTAMP '2024-01-15 12:00:00'
  AND event_type ILIKE '%err%'
ORDER BY ts DESC, event_id LIMIT 300"""
    q["date_partition_counts"] = "SELECT strftime(ts, '%Y.%m.%d') AS dt, count(*) AS n FROM events GROUP BY 1"

    q["bmu_search"] = _w(EMB) + " SELECT vec_id, CAST(bmu AS INTEGER) AS bmu, round(dist, 6) AS dist FROM b"
    q["score_stats"] = _w(EMB) + """
SELECT round(max(dist), 6) AS max_dist, round(avg(dist / m), 6) AS mean, round(stddev_pop(dist / m), 6) AS std,
       round(min(dist / m), 6) AS min
FROM b, (SELECT max(dist) AS m FROM b) mx"""
    q["threshold_flag"] = _w(EMB, """
mx AS (SELECT max(dist) AS m FROM b),
st AS (SELECT avg(dist / m) AS mean, stddev_pop(dist / m) AS std FROM b, mx)""") + """
SELECT vec_id, round(dist / m, 6) AS anomaly_score,
       CAST(CASE WHEN dist / m > 3.1 * std + mean THEN 1 ELSE 0 END AS INTEGER) AS anomaly
FROM b, mx, st"""
    q["cosine_bmu"] = _w(EMB, """
cd AS (SELECT e.vec_id, cb.node,
              1 - list_inner_product(e.v, cb.v) / (sqrt(list_inner_product(e.v, e.v)) * sqrt(list_inner_product(cb.v, cb.v))) AS d
       FROM e, cb)""") + """
SELECT vec_id, CAST(node AS INTEGER) AS bmu, round(d, 6) AS cos_dist FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, node) AS rn FROM cd) t WHERE rn = 1"""
    q["umatrix"] = _w(EMB, "g AS (SELECT node, node // 4 AS gx, node % 4 AS gy, v FROM cb)") + """
SELECT a.node, CAST(a.gx AS INTEGER) AS gx, CAST(a.gy AS INTEGER) AS gy,
       round(sum(list_distance(a.v, c.v)), 6) AS umatrix, count(*) AS neighbours
FROM g a JOIN g c ON abs(a.gx - c.gx) <= 1 AND abs(a.gy - c.gy) <= 1 AND a.node <> c.node
GROUP BY a.node, a.gx, a.gy"""
    q["bmu_hits"] = _w(EMB) + " SELECT CAST(bmu AS INTEGER) AS bmu, count(*) AS hits FROM b GROUP BY bmu"
    q["distance_histogram"] = _w(EMB, "r AS (SELECT min(dist) AS lo, max(dist) AS hi FROM b)") + """
SELECT CAST(least(floor(coalesce((dist - lo) / ((hi - lo) / 10.0), 0.0)) + 1, 10) AS INTEGER) AS bucket,
       count(*) AS n
FROM b, r GROUP BY 1"""
    q["som_epoch"] = _w(EMB, """
ex AS (SELECT vec_id, unnest(generate_series(0, len(v) - 1)) AS i, unnest(v) AS x FROM e),
bs AS (SELECT bmu, count(*) AS n FROM b GROUP BY bmu),
s AS (SELECT b.bmu, ex.i, sum(ex.x) AS s FROM ex JOIN b USING (vec_id) GROUP BY b.bmu, ex.i),
nodes AS (SELECT range AS node, range // 4 AS gx, range % 4 AS gy FROM range(16)),
h AS (SELECT a.node AS j, c.node AS bb,
             exp(-sqrt(CAST((a.gx - c.gx) * (a.gx - c.gx) + (a.gy - c.gy) * (a.gy - c.gy) AS DOUBLE)) / 2) AS h
      FROM nodes a, nodes c),
num AS (SELECT h.j, s.i, sum(h.h * s.s) AS num FROM h JOIN s ON h.bb = s.bmu GROUP BY h.j, s.i),
den AS (SELECT h.j, sum(h.h * bs.n) AS den FROM h JOIN bs ON h.bb = bs.bmu GROUP BY h.j)""") + """
SELECT CAST(num.j AS INTEGER) AS node, CAST(num.i AS INTEGER) AS dim, round(num / den, 6) AS w
FROM num JOIN den USING (j)"""

    def epoch(k: int) -> str:
        """One batch-SOM epoch: codebook cb{k-1} (node, v) -> cb{k}."""
        p = k - 1
        return f"""
d{k} AS (SELECT e.vec_id, c.node, list_distance(e.v, c.v) AS dist FROM e, cb{p} c),
b{k} AS (SELECT vec_id, node AS bmu FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, node) AS rn FROM d{k}) t WHERE rn = 1),
s{k} AS (SELECT b{k}.bmu, ex.i, sum(ex.x) AS s FROM ex JOIN b{k} USING (vec_id) GROUP BY b{k}.bmu, ex.i),
n{k} AS (SELECT bmu, count(*) AS n FROM b{k} GROUP BY bmu),
num{k} AS (SELECT h.j, s{k}.i, sum(h.h * s{k}.s) AS num FROM h JOIN s{k} ON h.bb = s{k}.bmu GROUP BY h.j, s{k}.i),
den{k} AS (SELECT h.j, sum(h.h * n{k}.n) AS den FROM h JOIN n{k} ON h.bb = n{k}.bmu GROUP BY h.j),
w{k} AS (SELECT num{k}.j AS node, num{k}.i AS i, num / den AS w FROM num{k} JOIN den{k} USING (j)),
cb{k} AS (SELECT CAST(node AS INTEGER) AS node, list(w ORDER BY i) AS v FROM w{k} GROUP BY node)"""

    q["som_fit_exp"] = _w(EMB, """
cb0 AS (SELECT node, v FROM cb),
ex AS (SELECT vec_id, unnest(generate_series(0, len(v) - 1)) AS i, unnest(v) AS x FROM e),
nodes AS (SELECT range AS node, range // 4 AS gx, range % 4 AS gy FROM range(16)),
h AS (SELECT a.node AS j, c.node AS bb,
             exp(-sqrt(CAST((a.gx - c.gx) * (a.gx - c.gx) + (a.gy - c.gy) * (a.gy - c.gy) AS DOUBLE)) / 2) AS h
      FROM nodes a, nodes c)""", epoch(1), epoch(2)) + """
SELECT CAST(node AS INTEGER) AS node, CAST(i AS INTEGER) AS dim, round(w, 6) AS w FROM w2"""

    q["detector_small_map"] = _w(scored_lines(25, 10)) + """
SELECT doc_id, line_no, sha256('v1:b0:' || CAST(doc_id AS VARCHAR) || ':' || CAST(line_no AS VARCHAR)) AS predict_id,
       CAST(bmu AS INTEGER) AS bmu, round(dist / m, 6) AS anomaly_score,
       CAST(CASE WHEN dist / m > thr THEN 1 ELSE 0 END AS INTEGER) AS anomaly
FROM sl, mx, thr"""
    q["infer_retrain_small_map"] = _w(scored_lines(25, 2)) + """
SELECT doc_id, line_no, sha256('v1.1:b1:' || CAST(doc_id AS VARCHAR) || ':' || CAST(line_no AS VARCHAR)) AS predict_id,
       CAST(bmu AS INTEGER) AS bmu, round(dist / m, 6) AS anomaly_score,
       CAST(CASE WHEN dist / m > thr THEN 1 ELSE 0 END AS INTEGER) AS anomaly
FROM sl, mx, thr WHERE source = (SELECT max(source) FROM documents)"""
    q["flagship_small_map"] = _w(scored_lines(25, 5)) + """
SELECT doc_id, line_no, source, message, template, CAST(bmu AS INTEGER) AS bmu, round(dist / m, 6) AS anomaly_score,
       CAST(CASE WHEN dist / m > thr THEN 1 ELSE 0 END AS INTEGER) AS anomaly
FROM sl, mx, thr ORDER BY round(dist / m, 6) DESC, doc_id, line_no LIMIT 20"""
    q["cooccurrence_counts"] = _w(LINES, f"p AS ({FOLLOWERS})") + """
SELECT word, context, count(*) AS n FROM p WHERE context IS NOT NULL GROUP BY word, context"""
    q["vocabulary"] = _w(LINES) + " SELECT template AS word, count(*) AS n FROM tl GROUP BY template HAVING count(*) >= 2"
    q["new_words"] = _w(LINES, CONV_TEMPLATES) + """
SELECT DISTINCT template AS word FROM tl ANTI JOIN ct ON tl.template = ct.word"""
    q["oov_hash_vectors"] = _w(CONV_TEMPLATES) + """
SELECT word, CAST(i AS INTEGER) AS i,
       round((CAST('0x' || substr(md5('1:' || word || ':' || CAST(i AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 - 0.5) / 8.0, 6) AS x
FROM ct, range(0, 8) r(i)"""
    q["similar_vectors"] = _w(EMB, """
ex AS (SELECT label, unnest(generate_series(0, len(v) - 1)) AS i, unnest(v) AS x FROM e),
cent AS (SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM ex GROUP BY label, i) t GROUP BY label),
sim AS (SELECT cent.label, e.vec_id,
               list_inner_product(cent.c, e.v) / (sqrt(list_inner_product(cent.c, cent.c)) * sqrt(list_inner_product(e.v, e.v))) AS similarity
        FROM cent, e)""") + """
SELECT label, vec_id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS rank FROM sim) t
WHERE rank <= 3"""

    q["feedback_validate"] = _w(FEEDBACK) + """
SELECT predict_id, reported_anomaly_status, customer_id, reject_reason, CAST(length(message) AS INTEGER) AS message_length
FROM val"""
    q["feedback_upsert"] = _w(FEEDBACK) + """
SELECT id, predict_id, reported_anomaly_status, customer_id, CAST(length(message) AS INTEGER) AS message_length FROM ins"""
    q["false_positives"] = _w(FEEDBACK) + """
SELECT md5(message) AS message_md5, CAST(length(message) AS INTEGER) AS message_length FROM fp"""
    q["noise_union"] = _w(LINES, FEEDBACK) + """
SELECT template, count(*) AS n FROM (
  SELECT template FROM tl
  UNION ALL SELECT regexp_replace(message, '[^a-zA-Z]', '', 'g') AS template FROM fp, range(3)) u
GROUP BY template"""
    q["feedback_counts"] = _w(FEEDBACK) + """
SELECT customer_id, reported_anomaly_status, count(*) AS feedback_count FROM ins GROUP BY 1, 2"""
    q["reject_counts"] = _w(FEEDBACK) + """
SELECT reject_reason, count(*) AS errors FROM val WHERE reject_reason IS NOT NULL GROUP BY 1"""

    q["predict_lines"] = _w(PRED) + """
SELECT doc_id, line_no, predict_id, round(anomaly_score, 6) AS anomaly_score, elast_alert, inference_batch_id,
       predictor_namespace, e_message, suppressed, anomaly FROM pr"""
    q["feedback_links"] = _w(PRED) + """
SELECT doc_id, line_no,
       'http://localhost:5001/api/feedback?lad_id=' || predict_id || '&is_anomaly=False&message=' || e_message AS link
FROM pr WHERE anomaly = 1"""
    q["last_anomaly_per_message"] = _w(PRED) + """
SELECT e_message, predict_id AS last_predict_id, round(anomaly_score, 6) AS last_score, occurrences FROM (
  SELECT *, row_number() OVER (PARTITION BY e_message ORDER BY doc_id DESC, line_no DESC) AS rn,
         count(*) OVER (PARTITION BY e_message) AS occurrences
  FROM pr WHERE anomaly = 1) t WHERE rn = 1"""
    q["running_anomaly_count"] = _w(PRED) + """
SELECT doc_id, line_no,
       CAST(sum(anomaly) OVER (PARTITION BY inference_batch_id ORDER BY doc_id, line_no
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running_anomalies
FROM pr"""
    q["anomaly_counts"] = _w(PRED) + """
SELECT inference_batch_id, count(*) AS lines, CAST(sum(anomaly) AS BIGINT) AS anomalies,
       CAST(sum(1 - anomaly - suppressed) AS BIGINT) AS normals, CAST(sum(suppressed) AS BIGINT) AS suppressed,
       round(max(anomaly_score), 6) AS max_score
FROM pr GROUP BY 1"""
    q["normal_share_by_source"] = _w(PRED) + """
SELECT source, round(avg(CASE WHEN anomaly = 0 THEN 1.0 ELSE 0.0 END), 6) AS normal_share,
       round(avg(anomaly_score), 6) AS avg_score, round(any_value(thr.thr), 6) AS threshold
FROM pr, thr GROUP BY source"""
    bounds = ", ".join(f"(CAST({b} AS DOUBLE))" for b in
                       ["0.005", "0.01", "0.025", "0.05", "0.075", "0.1", "0.25", "0.5", "0.75", "1.0",
                        "2.5", "5.0", "7.5", "10.0", "'inf'"]
                      )
    q["anomaly_histogram"] = _w(PRED, """
runs AS (SELECT sum(anomaly) OVER (PARTITION BY inference_batch_id ORDER BY doc_id, line_no
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM pr)""") + f"""
SELECT CAST(le AS DOUBLE) AS le, CAST(sum(CASE WHEN running <= CAST(le AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS count
FROM runs, (VALUES {bounds}) v(le) GROUP BY 1"""
    q["confusion_matrix"] = _w(PRED, """
dp AS (SELECT doc_id, max(over) AS predicted FROM pr GROUP BY doc_id),
j AS (SELECT dp.predicted, CASE WHEN l.quality = 0 THEN 1 ELSE 0 END AS actual FROM dp JOIN labels l USING (doc_id)),
c AS (SELECT CAST(sum(CASE WHEN predicted = 1 AND actual = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
             CAST(sum(CASE WHEN predicted = 1 AND actual = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
             CAST(sum(CASE WHEN predicted = 0 AND actual = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
             CAST(sum(CASE WHEN predicted = 0 AND actual = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM j)""") + """
SELECT tp, fp, fn, tn,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall
FROM c"""

    q["prediction_metrics"] = _w(PRED, """
agg AS (
  SELECT inference_batch_id,
         CAST(count(*) AS DOUBLE) AS loglines_count,
         CAST(sum(CASE WHEN anomaly = 0 AND suppressed = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS anomaly_count_0,
         CAST(sum(anomaly) AS DOUBLE) AS anomaly_count_1,
         CAST(sum(suppressed) AS DOUBLE) AS false_positive_count,
         max(anomaly_score) AS max_score,
         arg_max(anomaly_score, doc_id * 1000000 + line_no) FILTER (WHERE anomaly = 1) AS last_anomaly_score,
         any_value(thr.thr) AS threshold
  FROM pr, thr GROUP BY inference_batch_id)""") + """
SELECT inference_batch_id, metric, round(value, 6) AS value FROM agg
UNPIVOT INCLUDE NULLS (value FOR metric IN (loglines_count, anomaly_count_0, anomaly_count_1, false_positive_count,
                                          max_score, last_anomaly_score, threshold))"""
    q["counter_rate_1m"] = """
WITH m AS (SELECT event_type, time_bucket(INTERVAL '1 minutes', ts) AS minute, count(*) AS n FROM events GROUP BY 1, 2),
c AS (SELECT event_type, minute,
             sum(n) OVER (PARTITION BY event_type ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total
      FROM m),
l AS (SELECT *, lag(total) OVER (PARTITION BY event_type ORDER BY minute) AS pv,
             lag(minute) OVER (PARTITION BY event_type ORDER BY minute) AS pt FROM c)
SELECT event_type, minute, CAST(total AS BIGINT) AS total,
       round(CASE WHEN pv IS NOT NULL THEN (CASE WHEN total >= pv THEN total - pv ELSE total END)
                                            / (epoch(minute) - epoch(pt)) END, 6) AS rate
FROM l"""
    q["rate_1m"] = _rate(1)
    q["rate_5m"] = _rate(5)
    q["increase_8h"] = """
SELECT event_id, event_type,
       count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 8 HOUR PRECEDING AND CURRENT ROW) AS increase_8h
FROM events"""
    q["frequency_alert"] = _greedy("""
SELECT * FROM (SELECT event_id, ts,
       count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 120 SECOND PRECEDING AND CURRENT ROW) AS events_in_timeframe
  FROM events WHERE event_type = 'error') t WHERE events_in_timeframe >= 1""", None, 600, ", c.events_in_timeframe")
    q["frequency_alert_by_user"] = _greedy("""
SELECT * FROM (SELECT user_id, event_id, ts,
       count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW)
         AS events_in_timeframe
  FROM events WHERE event_type = 'error') t WHERE events_in_timeframe >= 2""", "user_id", 86400, ", c.events_in_timeframe")
    q["flatline_alert"] = """
WITH p AS (SELECT event_type, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS p FROM events),
span AS (SELECT min(p) AS lo, max(p) AS hi FROM p),
grid AS (SELECT t.event_type, unnest(generate_series(span.lo, span.hi, 3600)) AS p
         FROM (SELECT DISTINCT event_type FROM events) t, span),
cnt AS (SELECT event_type, p, count(*) AS n FROM p GROUP BY 1, 2)
SELECT g.event_type, make_timestamp(g.p * 1000000) AS period_start, CAST(coalesce(c.n, 0) AS BIGINT) AS events
FROM grid g LEFT JOIN cnt c USING (event_type, p)
WHERE coalesce(c.n, 0) < 1"""
    q["flatline_realert"] = _greedy(f"""
SELECT event_type, period_start AS ts, event_type || '@' || CAST(epoch(period_start) AS BIGINT) AS event_id, events
FROM ({q["flatline_alert"].replace("3600", "900")}) f""", "event_type", 3600, ", c.events") \
        .replace("SELECT s.event_type, s.event_id, s.ts", "SELECT s.event_type, s.ts AS period_start")
    q["realert_suppression"] = _greedy(
        "SELECT user_id, event_id, ts FROM events WHERE event_type = 'error'", "user_id", 86400)

    q["split_80_20"] = _w(LINES, """
sp AS (SELECT doc_id, line_no, source,
              row_number() OVER (PARTITION BY source ORDER BY doc_id, line_no) AS position,
              count(*) OVER (PARTITION BY source) AS n FROM tl)""") + """
SELECT doc_id, line_no, source, position, CAST(CASE WHEN position > round(n * 0.8) THEN 1 ELSE 0 END AS INTEGER) AS is_test
FROM sp"""
    q["validation_labels"] = _w(LINES, """
sp AS (SELECT doc_id, line_no,
              row_number() OVER (PARTITION BY source ORDER BY doc_id, line_no) AS position,
              count(*) OVER (PARTITION BY source) AS n FROM tl)""") + """
SELECT doc_id, line_no,
       CAST(CASE WHEN position > round(n * 0.8)
                  AND 1 + floor(CAST('0x' || substr(md5('42:gate:' || CAST(doc_id AS VARCHAR) || ':' || CAST(line_no AS VARCHAR)), 1, 8) AS BIGINT)
                                / 4294967296.0 * 100) >= 90
                 THEN 1 ELSE 0 END AS INTEGER) AS label
FROM sp"""
    unit = ("CAST('0x' || substr(md5('42:{tag}:' || CAST(doc_id AS VARCHAR) || ':' || CAST(line_no AS VARCHAR)"
            " || ':' || CAST(i AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0")
    q["validation_set"] = _w(LINES, r"""
sp AS (SELECT doc_id, line_no, message,
              row_number() OVER (PARTITION BY source ORDER BY doc_id, line_no) AS position,
              count(*) OVER (PARTITION BY source) AS n FROM tl),
vs AS (SELECT doc_id, line_no, regexp_replace(message, '^\s+|\s+$', '', 'g') AS message,
              CAST(CASE WHEN position > round(n * 0.8)
                         AND 1 + floor(CAST('0x' || substr(md5('42:gate:' || CAST(doc_id AS VARCHAR) || ':' || CAST(line_no AS VARCHAR)), 1, 8) AS BIGINT)
                                       / 4294967296.0 * 100) >= 90
                        THEN 1 ELSE 0 END AS INTEGER) AS label
       FROM sp),
cor AS (SELECT doc_id, line_no, message, length(message) AS L FROM vs WHERE label = 1),
steps AS (SELECT doc_id, line_no, L, unnest(generate_series(0, L - 1)) AS i FROM cor WHERE L > 0),
st2 AS (SELECT doc_id, line_no, i, CAST(floor(""" + unit.format(tag="pos") + r""" * L) AS INTEGER) AS p,
               chr(CAST(65 + floor(""" + unit.format(tag="chr") + r""" * 59) AS INTEGER)) AS c FROM steps),
lastw AS (SELECT doc_id, line_no, p, arg_max(c, i) AS c FROM st2 GROUP BY doc_id, line_no, p),
chars AS (SELECT doc_id, line_no, message, unnest(generate_series(0, L - 1)) AS p FROM cor WHERE L > 0),
rebuilt AS (SELECT ch.doc_id, ch.line_no,
                   string_agg(coalesce(lw.c, substr(ch.message, CAST(ch.p + 1 AS INTEGER), 1)), '' ORDER BY ch.p) AS message
            FROM chars ch LEFT JOIN lastw lw ON ch.doc_id = lw.doc_id AND ch.line_no = lw.line_no AND ch.p = lw.p
            GROUP BY ch.doc_id, ch.line_no)""") + """
SELECT vs.doc_id, vs.line_no, CASE WHEN vs.label = 1 THEN coalesce(r.message, vs.message) ELSE vs.message END AS message,
       vs.label
FROM vs LEFT JOIN rebuilt r ON vs.doc_id = r.doc_id AND vs.line_no = r.line_no"""
    pairs = """
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pd AS (SELECT a.vec_id AS p, b.vec_id AS o, list_distance(a.v, b.v) AS dist FROM e a, e b WHERE a.vec_id <> b.vec_id),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY dist, o) AS rn FROM pd) t WHERE rn <= {k})"""
    q["knn"] = _w(pairs.format(k=5)) + """
SELECT p AS vec_id, o AS neighbour, CAST(rn AS INTEGER) AS rank, round(dist, 6) AS dist FROM nn"""
    q["knn_300"] = _w(pairs.format(k=300)) + """
SELECT p AS vec_id, o AS neighbour, CAST(rn AS INTEGER) AS rank, round(dist, 6) AS dist FROM nn"""
    lof_sql = ("""
kd AS (SELECT p, max(dist) AS kd FROM nn GROUP BY p),
lrd AS (SELECT nn.p, 1.0 / (avg(greatest(kd.kd, nn.dist)) + 1e-10) AS lrd FROM nn JOIN kd ON nn.o = kd.p GROUP BY nn.p),
lf AS (SELECT nn.p, avg(l2.lrd) / any_value(l1.lrd) AS lof
       FROM nn JOIN lrd l2 ON nn.o = l2.p JOIN lrd l1 ON nn.p = l1.p GROUP BY nn.p)""", """
SELECT p AS vec_id, round(lof, 6) AS lof, CAST(CASE WHEN lof > 1.5 THEN -1 ELSE 1 END AS INTEGER) AS label FROM lf""")
    q["lof"] = _w(pairs.format(k=20), lof_sql[0]) + lof_sql[1]
    q["lof_300"] = _w(pairs.format(k=300), lof_sql[0]) + lof_sql[1]
    return q
