"""The named queries once more, as SQL over the same tables."""

from __future__ import annotations

SPLITS = 30
COARSE = 24

OBS = """
obs AS (
  SELECT m.metric, l_returnflag AS submetric, l_shipdate < TIMESTAMP '1998-01-01' AS is_reference,
         l_shipdate AS ts, l_suppkey AS supp,
         CASE m.metric WHEN 'quantity' THEN l_quantity WHEN 'extendedprice' THEN l_extendedprice
                       WHEN 'discount' THEN l_discount ELSE l_tax END AS v
  FROM lineitem
  CROSS JOIN (VALUES ('quantity'), ('extendedprice'), ('discount'), ('tax')) AS m(metric)
)"""

CHANNELS = """
obs AS (
  SELECT vec_id, label = 0 AS is_reference, 'embedding' AS metric,
         'channel_' || (pos - 1) AS submetric, pos - 1 AS pos, embedding[pos]::DOUBLE AS v
  FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)
)"""


def _hist(keys: str, splits: str = str(SPLITS), source: str = "obs", tag: str = "") -> str:
    """CTEs rng/hist: exact histograms of ``source`` per ``keys``, in long form."""
    on = " AND ".join(f"r.{k.strip()} = c.{k.strip()}" for k in keys.split(","))
    return f"""
rng{tag} AS (
  SELECT {keys}, min(v) AS mn, max(v) AS mx, count(*) AS n,
         CASE WHEN max(v) > min(v) THEN (max(v) - min(v)) / {splits}.0::DOUBLE ELSE 0.01::DOUBLE END AS s
  FROM {source} GROUP BY {keys}
), cnt{tag} AS (
  SELECT {keys}, least({splits}, floor((v - mn) / s) + 1)::INT AS bin, count(*) AS c
  FROM {source} JOIN rng{tag} USING ({keys}) GROUP BY ALL
), hist{tag} AS (
  SELECT r.*, b.bin, CASE WHEN b.bin = {splits} THEN mx ELSE mn + b.bin * s END AS x,
         coalesce(c.c, 0) / n::DOUBLE AS p
  FROM rng{tag} r CROSS JOIN (SELECT unnest(range(0, {splits} + 1))::INT AS bin) b
  LEFT JOIN cnt{tag} c ON {on} AND c.bin = b.bin
)"""


SIDE_COLUMNS = "is_reference, metric, submetric"
SIDES = _hist(SIDE_COLUMNS)


def _single(source: str) -> str:
    """Like SIDES, with values and split points in single precision, as float sketches have."""
    return f"""f AS (
  SELECT {SIDE_COLUMNS}, v::FLOAT::DOUBLE AS v FROM {source}
), {_hist(SIDE_COLUMNS, source="f", tag="_even")}, cells AS (
  SELECT *, x::FLOAT::DOUBLE AS lo, lead(x::FLOAT::DOUBLE) OVER w AS hi
  FROM hist_even WHERE bin < {SPLITS} WINDOW w AS (PARTITION BY {SIDE_COLUMNS} ORDER BY bin)
), hits AS (
  SELECT {SIDE_COLUMNS}, c.bin + 1 AS bin, count(*) AS c
  FROM f JOIN cells c USING ({SIDE_COLUMNS})
  WHERE v >= lo AND (hi IS NULL OR v < hi) GROUP BY ALL
), hist AS (
  SELECT {SIDE_COLUMNS}, bin, mn, mx, x, coalesce(c, 0) / n::DOUBLE AS p
  FROM hist_even LEFT JOIN hits USING ({SIDE_COLUMNS}, bin)
)"""

# Both sides on one grid.
def _pairs(keys: str) -> str:
    cols = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""
pq AS (
  SELECT {cols}, a.bin, a.p, b.p AS q
  FROM hist a JOIN hist b USING ({keys}, bin)
  WHERE NOT a.is_reference AND b.is_reference
)"""


PSI_TERM = (
    "(CASE WHEN p = 0 THEN 1e-4::DOUBLE ELSE p END - CASE WHEN q = 0 THEN 1e-4::DOUBLE ELSE q END)"
    " * ln(CASE WHEN p = 0 THEN 1e-4::DOUBLE ELSE p END / CASE WHEN q = 0 THEN 1e-4::DOUBLE ELSE q END)"
)
PSI = f"sum(CASE WHEN bin % 3 = 0 THEN {PSI_TERM} ELSE 0 END)"
CORR = "CASE WHEN isnan(corr(p, q)) THEN NULL ELSE corr(p, q) END"
EUCLID = "sqrt(sum((p - q) * (p - q)))"


def _report(keys: str) -> str:
    """Euclidean and Pearson use bins 0..29, PSI every third of 0..30."""
    return f"""
SELECT {keys}, round({PSI}, 8) AS psi,
       round(corr(p, q) FILTER (bin < {SPLITS}), 8) AS pearson,
       round(sqrt(sum((p - q) * (p - q)) FILTER (bin < {SPLITS})), 8) AS euclidean,
       false AS degenerate
FROM pq GROUP BY {keys}"""


# Distances over a relation d(metric, submetric, bin, p, q).
def _plain(expression: str) -> str:
    return f"SELECT metric, submetric, {expression} AS value FROM d GROUP BY metric, submetric"


NORMED = """
nd AS (
  SELECT metric, submetric, p / sum(p) OVER w AS p, q / sum(q) OVER w AS q
  FROM d WINDOW w AS (PARTITION BY metric, submetric)
)"""

DISTANCES = {
    "euclidean_distance": ("", _plain(EUCLID)),
    "manhattan_distance": ("", _plain("sum(abs(p - q))")),
    "cosine_similarity": ("", _plain("sum(p * q) / sqrt(sum(p * p) * sum(q * q))")),
    "pearson_correlation": ("", _plain(CORR)),
    "spearman_rank_correlation": (
        """rk AS (
  SELECT metric, submetric,
         rank() OVER (PARTITION BY metric, submetric ORDER BY p)
           + (count(*) OVER (PARTITION BY metric, submetric, p) - 1) / 2.0::DOUBLE AS p,
         rank() OVER (PARTITION BY metric, submetric ORDER BY q)
           + (count(*) OVER (PARTITION BY metric, submetric, q) - 1) / 2.0::DOUBLE AS q
  FROM d)""",
        f"SELECT metric, submetric, {CORR} AS value FROM rk GROUP BY metric, submetric",
    ),
    "jensen_shannon_divergence": (
        NORMED,
        """SELECT metric, submetric, sqrt(greatest(0, sum(
             CASE WHEN p = 0 THEN 0 ELSE p * ln(p / ((p + q) / 2)) END
           + CASE WHEN q = 0 THEN 0 ELSE q * ln(q / ((p + q) / 2)) END)) / 2) AS value
FROM nd GROUP BY metric, submetric""",
    ),
    "kullback_leibler_divergence": (
        NORMED,
        """SELECT metric, submetric, CASE WHEN count(*) FILTER (p > 0 AND q = 0) > 0 THEN 'inf'::DOUBLE
       ELSE sum(CASE WHEN p = 0 OR q = 0 THEN 0 ELSE p * ln(p / q) END) END AS value
FROM nd GROUP BY metric, submetric""",
    ),
    "hellinger_distance": (
        "",
        _plain("sqrt(sum((sqrt(p) - sqrt(q)) * (sqrt(p) - sqrt(q)))) / sqrt(2.0::DOUBLE)"),
    ),
    "wasserstein_distance": (
        """sp AS (
  SELECT metric, submetric, p, row_number() OVER (PARTITION BY metric, submetric ORDER BY p) AS r FROM d
), sq AS (
  SELECT metric, submetric, q, row_number() OVER (PARTITION BY metric, submetric ORDER BY q) AS r FROM d)""",
        """SELECT metric, submetric, avg(abs(p - q)) AS value
FROM sp JOIN sq USING (metric, submetric, r) GROUP BY metric, submetric""",
    ),
}

D_FROM_PQ = f"d AS (SELECT metric, submetric, bin, p, q FROM pq WHERE bin < {SPLITS})"

# Current side on 30 bins, reference on 24, both scaled to [0, 1].
MIXED = f"""
{OBS},
cur AS (SELECT * FROM obs WHERE NOT is_reference),
ref AS (SELECT * FROM obs WHERE is_reference),
{_hist("metric, submetric", source="cur", tag="_c")},
{_hist("metric, submetric", str(COARSE), source="ref", tag="_r")},
edges AS (
  SELECT metric, submetric, bin / {SPLITS}.0::DOUBLE AS e FROM hist_c
  UNION SELECT metric, submetric, bin / {COARSE}.0::DOUBLE FROM hist_r
), common AS (
  SELECT metric, submetric, e, row_number() OVER (PARTITION BY metric, submetric ORDER BY e)::INT - 1 AS bin,
         lead(e) OVER (PARTITION BY metric, submetric ORDER BY e) AS e2
  FROM edges
), d AS (
  SELECT c.metric, c.submetric, c.bin, c.e, a.p, b.p AS q
  FROM common c
  JOIN hist_c a ON a.metric = c.metric AND a.submetric = c.submetric
   AND a.bin / {SPLITS}.0::DOUBLE <= c.e AND c.e < (a.bin + 1) / {SPLITS}.0::DOUBLE
  JOIN hist_r b ON b.metric = c.metric AND b.submetric = c.submetric
   AND b.bin / {COARSE}.0::DOUBLE <= c.e AND c.e < (b.bin + 1) / {COARSE}.0::DOUBLE
  WHERE c.e2 IS NOT NULL
)"""

# PSI of a 30-bin and a 24-bin histogram: the latter is read between its edges.
MIXED_PSI = f"""
ks AS (SELECT unnest(range(0, 11))::INT AS k),
mp AS (SELECT metric, submetric, bin // 3 AS k, p FROM hist_c WHERE bin % 3 = 0),
mq AS (
  SELECT lo.metric, lo.submetric, k,
         CASE WHEN (k * {COARSE}) % 10 = 0 THEN lo.p
              ELSE lo.p + (hi.p - lo.p) * (((k * {COARSE}) % 10) / 10.0::DOUBLE) END AS q
  FROM ks JOIN hist_r lo ON lo.bin = (k * {COARSE}) // 10
  LEFT JOIN hist_r hi ON hi.metric = lo.metric AND hi.submetric = lo.submetric AND hi.bin = lo.bin + 1
), pv AS (
  SELECT metric, submetric, sum({PSI_TERM}) AS psi
  FROM mp JOIN mq USING (metric, submetric, k) GROUP BY metric, submetric
)"""


def _mixed_wide() -> str:
    parts, joins, columns = [MIXED, NORMED], [], []
    for name, (extra, body) in DISTANCES.items():
        if extra and extra is not NORMED:
            parts.append(extra)
        parts.append(f"v_{name} AS ({body})")
        joins.append(f"JOIN v_{name} USING (metric, submetric)")
        columns.append(f"round(v_{name}.value, 8) AS {name}")
    parts.append(MIXED_PSI)
    return (
        f"WITH {','.join(parts)} SELECT metric, submetric, {', '.join(columns)}, "
        f"round(psi, 8) AS psi FROM pv {' '.join(joins)}"
    )


CONSTANT = f"""
WITH obs AS (
  SELECT l_quantity::INT AS submetric, l_quantity AS v FROM lineitem
  UNION ALL SELECT -1, l_quantity FROM lineitem
), {_hist("submetric")},
-- A constant sits in bin 1 of edges i/29; its top interval is empty.
edges AS (
  SELECT i / 29.0::DOUBLE AS e FROM (SELECT unnest(range(0, 30)) AS i)
  UNION SELECT i / 30.0::DOUBLE FROM (SELECT unnest(range(0, 31)) AS i)
), common AS (
  SELECT e, lead(e) OVER (ORDER BY e) AS e2 FROM edges
), d AS (
  SELECT k.submetric, c.e, CASE WHEN c.e >= 1 / 29.0::DOUBLE AND c.e < 2 / 29.0::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p, h.p AS q
  FROM common c
  JOIN hist h ON h.submetric = -1 AND h.bin / 30.0::DOUBLE <= c.e AND c.e < (h.bin + 1) / 30.0::DOUBLE
  CROSS JOIN (SELECT DISTINCT submetric FROM rng WHERE submetric <> -1) k
  WHERE c.e2 IS NOT NULL
)
SELECT 'quantity' AS metric, submetric, NULL::DOUBLE AS psi, round(corr(p, q), 8) AS pearson,
       round({EUCLID}, 8) AS euclidean, true AS degenerate
FROM d GROUP BY submetric"""

PSI_VALUES = f"""
WITH {OBS}, rng AS (
  SELECT metric, submetric, is_reference, count(*) AS n,
         CASE WHEN min(v) = max(v) THEN min(v) - 0.5::DOUBLE ELSE min(v) END AS lo,
         CASE WHEN min(v) = max(v) THEN max(v) + 0.5::DOUBLE ELSE max(v) END AS hi
  FROM obs GROUP BY ALL
), edges AS (
  SELECT metric, submetric, is_reference, n, i AS bin, lo + i * ((hi - lo) / 1000.0::DOUBLE) AS e,
         CASE WHEN i = 999 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 1000.0::DOUBLE) END AS e2
  FROM rng, (SELECT unnest(range(0, 1000)) AS i)
), cnt AS (
  SELECT o.metric, o.submetric, o.is_reference, bin, count(*) / (any_value(n) * any_value(e2 - e)) AS dens
  FROM obs o ASOF JOIN edges s
    ON o.metric = s.metric AND o.submetric = s.submetric AND o.is_reference = s.is_reference AND o.v >= s.e
  GROUP BY ALL
), pq AS (
  SELECT metric, submetric, bin,
         greatest(1e-10::DOUBLE, coalesce(max(dens) FILTER (NOT is_reference), 0)) AS p,
         greatest(1e-10::DOUBLE, coalesce(max(dens) FILTER (is_reference), 0)) AS q
  FROM cnt GROUP BY ALL
)
SELECT metric, submetric, round(sum((p - q) * ln(p / q)), 6) AS value FROM pq GROUP BY ALL"""

MICROS = "epoch_us(ts)"

UPLOADS = f"""
up AS (
  SELECT event_id, event_type, user_id::VARCHAR AS sensor_id, {MICROS}::VARCHAR AS timestamp,
         CASE event_type WHEN 'error' THEN 'data' WHEN 'signup' THEN 'logs' ELSE 'stats' END AS file_type
  FROM events
), upp AS (
  SELECT *, '/landing/bundles/' || file_type || '/' || sensor_id || '/' || timestamp || '/' || file_type || '.tar.gz' AS path
  FROM up
)"""

SNAPS = f"""
snaps AS (
  SELECT CASE WHEN user_id = 0 THEN 'reference' ELSE user_id::VARCHAR END AS sensor_id,
         {MICROS}::VARCHAR AS timestamp, event_type, ts,
         CASE WHEN event_type = 'error' THEN 'processing' ELSE 'completed' END AS status,
         'event-' || event_id AS path
  FROM events
), waiting AS (
  SELECT s.* FROM snaps s
  WHERE status = 'completed' AND sensor_id <> 'reference' AND NOT EXISTS (
    SELECT 1 FROM snaps c WHERE c.ts < TIMESTAMP '2024-01-16'
       AND c.sensor_id = s.sensor_id AND c.timestamp = s.timestamp)
), newest AS (
  SELECT * FROM waiting
  QUALIFY row_number() OVER (PARTITION BY sensor_id ORDER BY timestamp DESC, path) = 1
)"""

INVENTORY = f"""
inv AS (
  SELECT user_id::VARCHAR AS sensor_id, {MICROS}::VARCHAR AS timestamp,
         CASE event_type WHEN 'view' THEN 'imgstats' WHEN 'click' THEN 'modelstats'
              WHEN 'purchase' THEN 'samples' WHEN 'signup' THEN 'customstats' END AS metrictype,
         event_type AS metric, json_extract_string(props, '$.k') AS submetric
  FROM events WHERE event_type <> 'error'
), listed AS (
  SELECT *, '/landing/bundles/stats/' || sensor_id || '/' || timestamp || '/' || metrictype || '/'
         || metric || '_' || submetric || '.bin' AS path
  FROM inv
)"""

MONTHS = f"""
{OBS}, months AS (
  SELECT *, CASE WHEN is_reference THEN 'reference' ELSE 'supp-' || supp END AS sensor_id,
         strftime(ts, '%Y-%m') AS month
  FROM obs
)"""

# The snapshots that enter a cycle, and its distances over their histograms.
PICKED = f"""
{MONTHS}, chosen AS (
  SELECT sensor_id, max(month) AS month FROM months
  WHERE sensor_id <> 'reference' AND month >= '2000-01' GROUP BY sensor_id
  UNION ALL SELECT 'reference', max(month) FROM months WHERE sensor_id = 'reference'
), picked AS (SELECT months.* FROM months JOIN chosen USING (sensor_id, month))"""

CYCLE = f""", pq AS (
  SELECT a.metric, a.submetric, a.bin, a.p, b.p AS q
  FROM hist a LEFT JOIN (SELECT * FROM hist WHERE is_reference) b USING (metric, submetric, bin)
  WHERE NOT a.is_reference
)
SELECT 'demo' AS project_id, 1700000000::BIGINT AS last_updated, metric, submetric,
       round({PSI}, 8) AS psi, round(corr(p, q) FILTER (bin < {SPLITS}), 8) AS pearson,
       round(sqrt(sum((p - q) * (p - q)) FILTER (bin < {SPLITS})), 8) AS euclidean
FROM pq GROUP BY metric, submetric"""

SAMPLES = f"""
smp AS (
  SELECT CASE WHEN event_type = 'signup' THEN 'other' ELSE 'demo' END AS project_name,
         user_id::VARCHAR AS sensor_id, strftime(ts, '%Y%m%d') AS timestamp,
         CASE WHEN event_type = 'error' THEN 'processing' ELSE 'completed' END AS status,
         'samples' AS metrictype, event_type AS metric,
         json_extract_string(props, '$.k') AS submetric,
         '/samples/' || event_type || '_' || {MICROS} || '.png' AS url,
         strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ' UTC' AS url_timestamp
  FROM events
)"""


def _project(where: str = "true") -> str:
    docs = where.split(" AND metric")[0]
    return f"""
WITH {SAMPLES}, first AS (
  SELECT status FROM smp WHERE project_name = 'demo' AND {docs}
  ORDER BY timestamp, sensor_id, status LIMIT 1
)
SELECT project_name AS "projectName", (SELECT status FROM first) AS status, sensor_id AS "sensorId",
       timestamp, metrictype, metric, submetric, url, url_timestamp
FROM smp WHERE project_name = 'demo' AND {where}"""


# One cycle per ship year; the baseline is year 0.
HISTORY = f"""
{OBS}, yr AS (
  SELECT metric, submetric, v, CASE WHEN is_reference THEN 0 ELSE year(ts) END AS cycle FROM obs
), {_hist("cycle, metric, submetric", source="yr")}"""

HISTORY_DIST = f"""
{HISTORY}, pq AS (
  SELECT a.cycle, a.metric, a.submetric, a.bin, a.p, b.p AS q
  FROM hist a JOIN hist b USING (metric, submetric, bin)
  WHERE a.cycle <> 0 AND b.cycle = 0
), dist AS (
  SELECT cycle, metric, submetric, round({PSI}, 8) AS psi,
         round(corr(p, q) FILTER (bin < {SPLITS}), 8) AS pearson,
         round(sqrt(sum((p - q) * (p - q)) FILTER (bin < {SPLITS})), 8) AS euclidean
  FROM pq GROUP BY ALL
)"""


def oracle_sql() -> dict[str, str]:
    side_cols = "is_reference, metric, submetric"
    found = {
        "exact_histogram": f"""WITH {OBS}, {SIDES}
SELECT {side_cols}, bin, round(x, 8) AS x, round(p, 8) AS p FROM hist""",
        "single_precision_histogram": f"""WITH {OBS}, {_single("obs")}
SELECT {side_cols}, bin, round(x, 8) AS x, round(p, 8) AS p FROM hist""",
        "sketch_drift": f"WITH {OBS}, {_single('obs')}, {_pairs('metric, submetric')} {_report('metric, submetric')}",
        "drift_report": f"WITH {OBS}, {SIDES}, {_pairs('metric, submetric')} {_report('metric, submetric')}",
        "channel_drift": f"WITH {CHANNELS}, {SIDES}, {_pairs('metric, submetric')} {_report('metric, submetric')}",
        "constant_feature_drift": CONSTANT,
        "rebin": f"""WITH {MIXED}
SELECT metric, submetric, bin, round(e, 8) AS edge, round(p, 8) AS p, round(q, 8) AS q FROM d""",
        "rebinned_distances": _mixed_wide(),
        "normalize_bins": f"""WITH {OBS}, {SIDES}
SELECT {side_cols}, bin, round((x - mn) / (mx - mn), 8) AS edge FROM hist""",
        "common_bins": f"""WITH {MIXED}
SELECT metric, submetric, bin, round(e, 8) AS edge FROM common""",
        "psi_of_values": PSI_VALUES,
        "euclidean_of_values": f"""WITH {CHANNELS},
mean AS (SELECT pos, avg(v) AS m FROM obs WHERE is_reference GROUP BY pos)
SELECT vec_id, round(sqrt(sum((v - m) * (v - m))), 8) AS value
FROM obs JOIN mean USING (pos) GROUP BY vec_id""",
        "distance_by_path": f"""WITH {OBS}, {SIDES}, {_pairs('metric, submetric')}, {D_FROM_PQ},
h AS ({DISTANCES['hellinger_distance'][1]})
SELECT metric || '/' || submetric AS path, round(value, 8) AS value FROM h WHERE metric <> 'tax'""",
        "build_sketches": f"""WITH {MONTHS}
SELECT sensor_id, metric, submetric, count(*) AS n FROM months GROUP BY ALL""",
        "merge_sketches": f"""WITH {OBS}
SELECT {side_cols}, count(*) AS n, round(min(v)::FLOAT::DOUBLE, 4) AS low,
       round(max(v)::FLOAT::DOUBLE, 4) AS high
FROM obs GROUP BY {side_cols}""",
        "sketch_histogram": f"""WITH {OBS}, f AS (
  SELECT is_reference, metric, submetric, v::FLOAT::DOUBLE AS v FROM obs
), {_hist(side_cols, source="f")}
SELECT {side_cols}, bin, round(x, 4) AS x, true AS within_bound FROM hist""",
        "scan_landing": f"WITH {UPLOADS} SELECT event_id, sensor_id, timestamp, file_type FROM upp",
        "valid_uploads": f"""WITH {UPLOADS}
SELECT sensor_id, timestamp, file_type FROM upp WHERE file_type IN ('stats', 'data')""",
        "rejected_uploads": f"""WITH {UPLOADS}
SELECT sensor_id, timestamp, file_type FROM upp WHERE file_type NOT IN ('stats', 'data')""",
        "register_bundles": f"""WITH {UPLOADS}
SELECT sensor_id, timestamp, file_type, path FROM upp
WHERE file_type IN ('stats', 'data') AND event_type <> 'purchase'""",
        "pending_bundles": f"""WITH {UPLOADS}
SELECT sensor_id, timestamp, path FROM upp WHERE file_type = 'stats' AND event_type <> 'purchase'""",
        "expand_bundles": f"""WITH {MONTHS}
SELECT sensor_id, month AS timestamp, 'customstats/' || metric || '_' || submetric || '.bin' AS member
FROM months GROUP BY ALL""",
        "load_sketches": f"""WITH {MONTHS}, s AS (
  SELECT sensor_id, month, metric, submetric, count(*) AS n FROM months GROUP BY ALL
)
SELECT metric, submetric, count(*) AS bundles,
       count(*) FILTER (metric <> 'tax' AND (metric <> 'discount' OR n = 1)) AS readable,
       (sum(n) FILTER (metric <> 'tax' AND (metric <> 'discount' OR n = 1)))::BIGINT AS n
FROM s GROUP BY metric, submetric""",
        "late_snapshots": f"""WITH {MONTHS}, s AS (
  SELECT DISTINCT sensor_id, month, sensor_id = 'reference' AS is_reference,
         CASE WHEN sensor_id = 'reference' OR month >= '2001-01' THEN 0 ELSE 1 END AS cycle FROM months
)
SELECT cycle::BIGINT AS cycle, sensor_id, max(month) AS timestamp, is_reference
FROM (SELECT * FROM s UNION ALL SELECT sensor_id, month, is_reference, 1 FROM s WHERE is_reference)
GROUP BY cycle, sensor_id, is_reference""",
        "stored_reference": f"""WITH {MONTHS}
SELECT metric, submetric, round(min(v::FLOAT::DOUBLE), 2) AS low, round(max(v::FLOAT::DOUBLE), 2) AS high
FROM months WHERE metric = 'extendedprice' AND submetric = 'A' AND sensor_id = 'reference'
  AND month = (SELECT max(month) FROM months WHERE sensor_id = 'reference')
GROUP BY metric, submetric""",
        "stored_samples": f"""WITH {SAMPLES}
SELECT 'demo' AS "projectName", 'completed' AS status, sensor_id AS "sensorId",
       timestamp, metrictype, metric, submetric, url, url_timestamp
FROM smp WHERE metric = 'purchase'""",
        "ingest_stream": f"""WITH {UPLOADS}
SELECT sensor_id, timestamp, file_type, path FROM upp WHERE file_type IN ('stats', 'data')""",
        "inventory": f"""WITH {INVENTORY}
SELECT sensor_id, timestamp, metrictype, metric, submetric, path FROM listed""",
        "snapshot_docs": f"""WITH {INVENTORY}
SELECT sensor_id, timestamp, string_agg(DISTINCT metrictype, ',' ORDER BY metrictype) AS metrictypes,
       count(*)::INT AS n_stats,
       string_agg(path, ',' ORDER BY metrictype, metric, submetric, path) AS paths
FROM listed GROUP BY sensor_id, timestamp""",
        "gather_sketches": f"""WITH {INVENTORY}
SELECT sensor_id, timestamp, metric, submetric, path FROM listed""",
        "snapshot_status": f"WITH {SNAPS} SELECT sensor_id, timestamp, status FROM snaps",
        "latest_per_sensor": f"WITH {SNAPS} SELECT sensor_id, timestamp, path FROM newest",
        "latest_reference": f"""WITH {SNAPS}
SELECT sensor_id, timestamp, path FROM snaps
WHERE sensor_id = 'reference' AND status = 'completed' ORDER BY timestamp DESC, path LIMIT 1""",
        "mark_consumed": f"""WITH {SNAPS}
SELECT sensor_id, timestamp FROM waiting
WHERE sensor_id IN (SELECT sensor_id FROM newest WHERE event_type = 'purchase')""",
        "run_cycle": f"WITH {PICKED}, {_hist(side_cols, source='picked')} {CYCLE}",
        "run_sketch_cycle": f"WITH {PICKED}, {_single('picked')} {CYCLE}",
        "stored_cycle": f"""WITH {MONTHS}, chosen AS (
  SELECT sensor_id, max(month) AS month FROM months GROUP BY sensor_id
), picked AS (SELECT months.* FROM months JOIN chosen USING (sensor_id, month))
SELECT 'demo' AS project_id, 1700000000::BIGINT AS last_updated, metric, submetric,
       round(min(v::FLOAT::DOUBLE) FILTER (NOT is_reference), 4) AS low,
       round(max(v::FLOAT::DOUBLE) FILTER (NOT is_reference), 4) AS high,
       count(*) FILTER (is_reference) > 0 AS compared
FROM picked GROUP BY metric, submetric HAVING count(*) FILTER (NOT is_reference) > 0""",
        "assemble_overall": f"""WITH {HISTORY}, t AS (
  SELECT cycle, metric, submetric, sum(p) AS mass FROM hist WHERE cycle <> 0 GROUP BY ALL
)
SELECT 'demo' AS project_id, cycle AS last_updated, 0 AS part, count(*)::INT AS n_histograms,
       count(*)::INT AS n_distances, round(sum(mass), 8) AS mass,
       string_agg(metric || '/' || submetric, ',' ORDER BY metric, submetric) AS names
FROM t GROUP BY cycle""",
        "latest_reference_stats": f"""WITH {OBS}, yr AS (
  SELECT metric, submetric, v, year(ts) AS last_updated FROM obs WHERE is_reference
), {_hist("last_updated, metric, submetric", source="yr")}
SELECT 'demo' AS project_id, last_updated, metric, submetric, bin, round(x, 8) AS x, round(p, 8) AS p
FROM hist WHERE last_updated = (SELECT max(last_updated) FROM yr)""",
        "metric_stats": f"""WITH {HISTORY}
SELECT metric, submetric, bin, round(x, 8) AS x, round(p, 8) AS p FROM hist
WHERE cycle = (SELECT max(cycle) FROM yr) AND metric = 'extendedprice' AND submetric = 'N'""",
        "metric_stats_first": f"""WITH {HISTORY}
SELECT metric, submetric, bin, round(x, 8) AS x, round(p, 8) AS p FROM hist
WHERE cycle = (SELECT max(cycle) FROM yr) AND metric = 'quantity'
  AND submetric = (SELECT min(submetric) FROM hist
                   WHERE metric = 'quantity' AND cycle = (SELECT max(cycle) FROM yr))""",
        "metric_distances": f"""WITH {HISTORY_DIST}
SELECT 'demo' AS project_id, cycle::VARCHAR AS timestamp, metric, submetric,
       psi AS "PSI", pearson AS "Pearson", euclidean AS "Euclidean" FROM dist""",
        "project_data": _project(),
        "project_data_filtered": _project("timestamp = '20240105' AND metric = 'view'"),
        "nested_project_data": f"""WITH {SAMPLES}, first AS (
  SELECT status FROM smp WHERE project_name = 'demo' ORDER BY timestamp, sensor_id, status LIMIT 1
)
SELECT project_name AS "projectName", (SELECT status FROM first) AS status, sensor_id AS "sensorId",
       timestamp, count(DISTINCT (metric, submetric))::INT AS n_metrics,
       string_agg(url, ',' ORDER BY metric, submetric, url_timestamp, url) AS urls
FROM smp WHERE project_name = 'demo' GROUP BY project_name, sensor_id, timestamp""",
        "explode_samples": f"WITH {SAMPLES} SELECT * FROM smp",
        "url_times": f"""WITH {SAMPLES}
SELECT url, url_timestamp AS taken FROM smp
UNION ALL SELECT url, NULL FROM pages""",
        "list_metrics": "SELECT DISTINCT event_type AS metric FROM events",
        "list_submetrics": """SELECT DISTINCT json_extract_string(props, '$.k') AS submetric
FROM events WHERE event_type = 'click'""",
        "dist_psi": f"""WITH {OBS}, {SIDES}, {_pairs('metric, submetric')}
SELECT metric, submetric, round({PSI}, 8) AS value, false AS infinite FROM pq GROUP BY metric, submetric""",
    }
    for name, (extra, body) in DISTANCES.items():
        parts = [OBS, SIDES, _pairs("metric, submetric"), D_FROM_PQ, *([extra] if extra else [])]
        found[f"dist_{name}"] = (
            f"WITH {','.join(parts)}, v AS ({body}) SELECT metric, submetric, "
            "CASE WHEN isinf(value) THEN NULL ELSE round(value, 8) END AS value, "
            "isinf(value) AS infinite FROM v"
        )
    return found
