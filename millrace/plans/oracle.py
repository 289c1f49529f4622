"""The queries' results in DuckDB's SQL, written from the operators' definitions."""

from __future__ import annotations

SIGNALS = """signals AS (
  SELECT CAST(user_id AS VARCHAR) AS run_name, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
         (epoch_us(ts) - 1704067200000000) / 1000000.0::DOUBLE AS time_s, value - 100 AS x, (event_id % 17) * 0.5::DOUBLE AS speed,
         CAST(event_id % 23 AS DOUBLE) AS cut, value AS v, event_type <> 'error' AS on_, event_id, ((event_id * 7919) % 1000) / 1000.0::DOUBLE AS score
  FROM events)"""

EPISODES = """edges AS (
  SELECT run_name, pos, time_s, on_, lag(on_, 1, false) OVER r AS was, max(time_s) OVER (PARTITION BY run_name) AS last_t, first_value(on_) OVER r AS first_on
  FROM signals WINDOW r AS (PARTITION BY run_name ORDER BY pos)),
turns AS (SELECT *, lead(time_s) OVER (PARTITION BY run_name ORDER BY pos) AS nxt FROM edges WHERE on_ <> was),
spans AS (
  SELECT run_name, pos, CASE WHEN first_on THEN coalesce(lag(time_s) OVER p, time_s) ELSE time_s END AS start_time, time_s AS own_start, coalesce(nxt, last_t) AS end_time, last_t
  FROM turns WHERE on_ WINDOW p AS (PARTITION BY run_name ORDER BY pos)),
episodes AS (
  SELECT run_name, CAST(row_number() OVER (PARTITION BY run_name ORDER BY pos) - 1 AS INTEGER) AS episode_ix, start_time, end_time, least(end_time + 86400, last_t) AS extended_end_time
  FROM spans WHERE end_time - start_time >= 0.1)"""


def detected(spans: str, quantile: float, name: str = "raw") -> str:
    """Events of every span of a table (run_name, episode_ix, start_time, end_time, extended_end_time), before dedup."""
    return f"""inside AS (
  SELECT s.run_name, e.episode_ix, s.time_s, s.v, e.start_time AS es, e.end_time AS ee
  FROM signals s JOIN {spans} e ON s.run_name = e.run_name AND s.time_s BETWEEN e.start_time AND e.extended_end_time),
levels AS (SELECT run_name, episode_ix, quantile_cont(v, {quantile}) AS threshold FROM inside GROUP BY run_name, episode_ix),
above AS (SELECT i.*, l.threshold FROM inside i JOIN levels l ON i.run_name = l.run_name AND i.episode_ix = l.episode_ix WHERE i.v > l.threshold),
marked AS (SELECT *, CASE WHEN time_s - lag(time_s) OVER w > 43200 THEN 1 ELSE 0 END AS fresh FROM above WINDOW w AS (PARTITION BY run_name, episode_ix ORDER BY time_s)),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY run_name, episode_ix ORDER BY time_s) AS g FROM marked),
topped AS (SELECT *, max(v) OVER (PARTITION BY run_name, episode_ix, g) AS mx FROM grouped),
{name} AS (
  SELECT run_name, episode_ix, min(time_s) AS start_time, min(time_s) FILTER (WHERE v = mx) AS peak_time, max(time_s) AS end_time, max(v) AS peak_voltage,
         min(threshold) AS threshold, min(es) AS episode_start_time, min(ee) AS episode_end_time, max(time_s) - min(time_s) AS duration_s,
         CASE WHEN min(threshold) = 0 THEN 'inf'::DOUBLE ELSE max(v) / min(threshold) END AS ratio
  FROM topped GROUP BY run_name, episode_ix, g)"""


EVENTS = (
    detected("episodes", 0.9)
    + """,
found AS (
  SELECT * EXCLUDE (place) FROM (
    SELECT *, row_number() OVER (PARTITION BY run_name, round_even(peak_time / 0.001, 0) ORDER BY abs(peak_time - episode_end_time), ratio DESC, peak_voltage DESC, episode_ix, start_time) AS place FROM raw)
  WHERE place = 1)"""
)

RATES = """stepped AS (SELECT *, time_s - lag(time_s) OVER (PARTITION BY run_name ORDER BY pos) AS dt FROM signals),
rates AS (
  SELECT run_name, count(*) AS n_rows, coalesce(1.0::DOUBLE / quantile_cont(dt, 0.5) FILTER (WHERE dt > 0), 0.0::DOUBLE) AS sample_rate_hz FROM stepped GROUP BY run_name)"""

WINDOWS = (
    RATES
    + """,
anchors AS (
  SELECT s.run_name, e.episode_ix, s.pos, s.time_s, e.end_time, r.n_rows,
         greatest(1, CAST(round_even(r.sample_rate_hz * 345600, 0) AS BIGINT)) AS n, greatest(1, CAST(round_even(r.sample_rate_hz * 86400, 0) AS BIGINT)) AS h,
         min(s.pos) OVER (PARTITION BY s.run_name, e.episode_ix) AS p0
  FROM signals s JOIN episodes e ON s.run_name = e.run_name AND s.time_s >= e.start_time AND s.time_s <= e.end_time
  JOIN rates r ON r.run_name = s.run_name
  WHERE r.sample_rate_hz > 0 AND e.start_time + 345600 <= e.end_time),
cuts AS (
  SELECT run_name, episode_ix, CAST((pos - p0) // h AS INTEGER) AS window_ix, time_s AS window_start, time_s + 345600 AS window_end, time_s + 345600 AS detection_time,
         pos AS start_index, pos + n AS end_index
  FROM anchors WHERE (pos - p0) % h = 0 AND time_s + 345600 <= end_time + 1e-12 AND pos + n <= n_rows)"""
)

#: The same windows up to the end of each episode's grace period.
EXTENDED = WINDOWS.replace("s.time_s, e.end_time, r.n_rows", "s.time_s, e.extended_end_time AS end_time, r.n_rows").replace("<= e.end_time", "<= e.extended_end_time")

FEATURES = """signed AS (
  SELECT *, time_s - lag(time_s) OVER r AS step, CASE WHEN signbit(x) <> signbit(lag(x) OVER r) THEN 1 ELSE 0 END AS flip FROM signals WINDOW r AS (PARTITION BY run_name ORDER BY pos)),
sampled AS (
  SELECT c.*, s.pos, s.time_s, s.x, s.speed, s.cut, s.step, s.flip FROM cuts c JOIN signed s ON s.run_name = c.run_name AND s.pos >= c.start_index AND s.pos < c.end_index),
feats AS (
  SELECT run_name, episode_ix, window_ix, window_start, detection_time, start_index, end_index,
         coalesce(1.0::DOUBLE / quantile_cont(step, 0.5) FILTER (WHERE pos > start_index AND step > 0), 0.0::DOUBLE) AS sample_rate_hz,
         avg(x) AS audio_mean, stddev_pop(x) AS audio_std, sqrt(avg(x * x)) AS audio_rms, max(abs(x)) AS audio_peak_abs,
         CASE WHEN sqrt(avg(x * x)) > 0 THEN max(abs(x)) / sqrt(avg(x * x)) ELSE 0 END AS audio_crest_factor,
         CASE WHEN count(*) >= 2 AND max(time_s) > min(time_s) THEN coalesce(sum(flip) FILTER (WHERE pos > start_index), 0) / (max(time_s) - min(time_s)) ELSE 0 END AS audio_zero_crossing_rate,
         avg(speed) AS speed_mean, stddev_pop(speed) AS speed_std, avg(cut) AS cut_mean, stddev_pop(cut) AS cut_std
  FROM sampled GROUP BY ALL)"""

LABELS = """paired AS (
  SELECT c.run_name, c.episode_ix, c.window_ix, c.detection_time,
         min(f.peak_time) FILTER (WHERE c.detection_time - f.peak_time >= 0 AND c.detection_time - f.peak_time <= 86400) AS past,
         min(f.peak_time) FILTER (WHERE f.peak_time - c.detection_time > 0 AND f.peak_time - c.detection_time <= 172800) AS nxt
  FROM cuts c LEFT JOIN found f ON f.run_name = c.run_name GROUP BY c.run_name, c.episode_ix, c.window_ix, c.detection_time),
labeled AS (
  SELECT run_name, episode_ix, window_ix, detection_time, CASE WHEN past IS NOT NULL THEN -1 WHEN nxt IS NOT NULL THEN 1 ELSE 0 END AS label,
         coalesce(past, nxt) AS event_peak_time, CASE WHEN past IS NOT NULL THEN -(detection_time - past) ELSE nxt - detection_time END AS time_to_event_s
  FROM paired)"""


def kept(thresholds: tuple[float, ...]) -> str:
    """Alarms after 2-of-3 consensus (alarms0) and suppression (kept)."""
    values = ", ".join(f"({t}::DOUBLE)" for t in thresholds)
    return f"""thresholds(threshold) AS (VALUES {values}),
hits AS (
  SELECT t.threshold, s.run_name, s.time_s, s.score, sum(CASE WHEN s.score >= t.threshold THEN 1 ELSE 0 END) OVER (PARTITION BY t.threshold, s.run_name ORDER BY s.time_s ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n
  FROM signals s CROSS JOIN thresholds t),
alarms0 AS (SELECT threshold, run_name, time_s, score FROM hits WHERE n >= 2),
follow AS (
  SELECT a.threshold, a.run_name, a.time_s, a.score, min(b.time_s) AS nxt
  FROM alarms0 a LEFT JOIN alarms0 b ON a.threshold = b.threshold AND a.run_name = b.run_name AND b.time_s - a.time_s > 86400 GROUP BY ALL),
kept AS (
  SELECT threshold, run_name, time_s, score, nxt FROM (SELECT *, min(time_s) OVER (PARTITION BY threshold, run_name) AS t0 FROM follow) WHERE time_s = t0
  UNION ALL
  SELECT f.threshold, f.run_name, f.time_s, f.score, f.nxt FROM kept k JOIN follow f ON f.threshold = k.threshold AND f.run_name = k.run_name AND f.time_s = k.nxt)"""


MATCHES = """waiting AS (SELECT threshold, run_name, list(time_s ORDER BY time_s) AS times FROM kept GROUP BY threshold, run_name),
queue AS (
  SELECT t.threshold, f.run_name, f.peak_time, row_number() OVER (PARTITION BY t.threshold, f.run_name ORDER BY f.peak_time) AS n, coalesce(w.times, []) AS times
  FROM found f CROSS JOIN thresholds t LEFT JOIN waiting w ON w.threshold = t.threshold AND w.run_name = f.run_name),
steps AS (
  SELECT threshold, run_name, 0::BIGINT AS n, CAST(NULL AS DOUBLE) AS peak_time, CAST(NULL AS DOUBLE) AS hit, CAST([] AS DOUBLE[]) AS used FROM queue WHERE n = 1
  UNION ALL
  SELECT threshold, run_name, n, peak_time, hit, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit) END FROM (
    SELECT q.threshold, q.run_name, q.n, q.peak_time, s.used,
           list_max([d FOR d IN q.times IF d < q.peak_time AND d > q.peak_time - 172800 AND NOT list_contains(s.used, d)]) AS hit
    FROM steps s JOIN queue q ON q.threshold = s.threshold AND q.run_name = s.run_name AND q.n = s.n + 1)),
matches AS (SELECT threshold, run_name, peak_time, hit FROM steps WHERE n > 0),
falses AS (
  SELECT k.threshold, k.run_name, k.time_s FROM kept k
  WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.threshold = k.threshold AND m.run_name = k.run_name AND m.hit = k.time_s))"""

SUMMARY = """totals AS (SELECT sum(end_time - start_time) AS seconds FROM episodes),
per AS (
  SELECT t.threshold, (SELECT count(*) FROM matches m WHERE m.threshold = t.threshold) AS e, (SELECT count(hit) FROM matches m WHERE m.threshold = t.threshold) AS h,
         (SELECT count(*) FROM falses f WHERE f.threshold = t.threshold) AS n, (SELECT avg(peak_time - hit) FROM matches m WHERE m.threshold = t.threshold) AS adv
  FROM thresholds t)
SELECT threshold, e AS n_reference_events, h AS n_detected_events, n AS n_false_detections, round(CASE WHEN e > 0 THEN h / e ELSE 0 END, 6) AS true_positive_rate,
       round(n / (seconds / 3600), 6) AS false_detections_per_hour, round(CASE WHEN n > 0 THEN seconds / n END, 6) AS mean_seconds_between_false_detections, round(adv, 6) AS average_advance_time_s
FROM per, totals"""


def query(*parts: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)}\n{select}"


_EVENT = "round(start_time, 6) AS start_time, round(peak_time, 6) AS peak_time, round(end_time, 6) AS end_time, round(peak_voltage, 6) AS peak_voltage, round(threshold, 6) AS threshold, round(episode_start_time, 6) AS episode_start_time, round(episode_end_time, 6) AS episode_end_time, round(duration_s, 6) AS duration_s, round(ratio, 6) AS peak_to_threshold_ratio"
_AUDITED = "round(peak_time - episode_end_time, 6) AS time_from_episode_end_to_peak, peak_time <= episode_end_time AS inside_header_on_episode"
_WINDOW = "run_name, episode_ix, window_ix"

SPECTRUM = """samples AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS n, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
shaped AS (SELECT vec_id, n, (x - avg(x) OVER (PARTITION BY vec_id)) * (0.5 - 0.5 * cos(2 * pi() * n / 63)) AS w FROM samples),
bins AS (
  SELECT vec_id, k, pow(sum(w * cos(2 * pi() * k * n / 64)), 2) + pow(sum(w * sin(2 * pi() * k * n / 64)), 2) AS p, k * 256.0::DOUBLE AS hz
  FROM shaped, range(0, 33) t(k) GROUP BY vec_id, k),
sums AS (SELECT vec_id, sum(p) AS total, sum(p * hz) / sum(p) AS centre FROM bins GROUP BY vec_id)"""

FRAMES = """spread AS (
  SELECT vec_id, f, i, CAST(embedding[f * {hop} + i + 1] AS DOUBLE) AS x FROM embeddings, range(0, {frames}) a(f), range(0, 16) b(i))"""

#: The fixed forest of the score query, as nested CASE over 32-bit comparisons.
FOREST = """(CASE WHEN CAST(audio_mean AS FLOAT) <= CAST(0.5 AS FLOAT) THEN CASE WHEN CAST(audio_rms AS FLOAT) <= CAST(90 AS FLOAT) THEN 0.125::DOUBLE ELSE 0.5::DOUBLE END ELSE 0.75::DOUBLE END
  + CASE WHEN CAST(speed_mean AS FLOAT) <= CAST(4 AS FLOAT) THEN 0.25::DOUBLE ELSE 0.875::DOUBLE END) / 2"""

ORACLE_SQL = {
    "normalize_status": query(SIGNALS, select="SELECT run_name, count(*) FILTER (WHERE on_) AS n_on, count(*) AS n_rows FROM signals GROUP BY run_name"),
    "validate_runs": query(
        SIGNALS, "steps AS (SELECT run_name, time_s - lag(time_s) OVER (PARTITION BY run_name ORDER BY pos) AS d FROM signals)", select="SELECT run_name, count(*) AS n_rows, coalesce(min(d) >= 0, true) AS monotonic FROM steps GROUP BY run_name"
    ),
    "run_profile": query(
        SIGNALS,
        select="SELECT run_name, count(*) AS n_rows, round(min(time_s), 6) AS start_time, round(max(time_s), 6) AS end_time, count(*) FILTER (WHERE on_) AS n_on, round(max(v), 6) AS max_voltage, round(avg(x), 6) AS sensor_mean FROM signals GROUP BY run_name",
    ),
    "sample_rate": query(SIGNALS, RATES, select="SELECT run_name, n_rows, round(sample_rate_hz, 9) AS sample_rate_hz FROM rates"),
    "episodes": query(SIGNALS, EPISODES, select="SELECT run_name, episode_ix, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, round(extended_end_time, 6) AS extended_end_time FROM episodes"),
    "episodes_own_start": query(
        SIGNALS,
        EPISODES,
        select="SELECT run_name, CAST(row_number() OVER (PARTITION BY run_name ORDER BY pos) - 1 AS INTEGER) AS episode_ix, round(own_start, 6) AS start_time, round(end_time, 6) AS end_time, round(least(end_time + 86400, last_t), 6) AS extended_end_time FROM spans WHERE end_time - own_start >= 0.1",
    ),
    "evaluated_duration": query(SIGNALS, EPISODES, select="SELECT run_name, round(sum(end_time - start_time), 3) AS evaluated_duration_s FROM episodes GROUP BY run_name"),
    "candidate_groups": query(
        SIGNALS,
        "m AS (SELECT *, CASE WHEN time_s - lag(time_s) OVER w > 43200 THEN 1 ELSE 0 END AS fresh FROM signals WINDOW w AS (PARTITION BY run_name ORDER BY time_s))",
        "g AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY run_name ORDER BY time_s) AS BIGINT) AS group_ix FROM m)",
        select="SELECT run_name, group_ix, round(min(time_s), 6) AS start_time, round(max(time_s), 6) AS end_time, count(*) AS n_rows FROM g GROUP BY run_name, group_ix",
    ),
    "voltage_events": query(SIGNALS, EPISODES, EVENTS, select=f"SELECT run_name, episode_ix, {_EVENT}, 'VoltageSignal' AS source FROM raw"),
    "dedup_events": query(SIGNALS, EPISODES, EVENTS, select=f"SELECT run_name, episode_ix, {_EVENT} FROM found"),
    "ratio_filter": query(
        SIGNALS, EPISODES, EVENTS, select="SELECT run_name, round(peak_time, 6) AS peak_time, round(peak_voltage, 6) AS peak_voltage, round(threshold, 6) AS threshold, round(ratio, 6) AS peak_to_threshold_ratio FROM found WHERE ratio >= 1.05"
    ),
    "event_audit": query(
        SIGNALS, EPISODES, EVENTS, select=f"SELECT run_name, episode_ix, {_EVENT}, CAST(row_number() OVER (PARTITION BY run_name ORDER BY found.peak_time, found.start_time) AS INTEGER) AS event_index, {_AUDITED.replace('peak_time -', 'found.peak_time - found.').replace('found. ', 'found.')} FROM found"
    ),
    "audit_summary": query(
        SIGNALS,
        EPISODES,
        EVENTS,
        select="SELECT run_name, count(*) AS n_events, round(min(ratio), 6) AS min_ratio, round(median(ratio), 6) AS median_ratio, round(max(ratio), 6) AS max_ratio, count(*) FILTER (WHERE peak_time <= episode_end_time) AS n_inside, count(*) FILTER (WHERE ratio >= 1.05) AS n_strong FROM found GROUP BY ROLLUP (run_name)",
    ),
    "weakest_events_topk": query(
        SIGNALS,
        EPISODES,
        EVENTS,
        "weak AS (SELECT * FROM found ORDER BY ratio, run_name, peak_time LIMIT 10)",
        select="SELECT run_name, round(weak.peak_time, 6) AS peak_time, round(peak_voltage, 6) AS peak_voltage, round(threshold, 6) AS threshold, round(ratio, 6) AS peak_to_threshold_ratio, round(weak.peak_time - weak.episode_end_time, 6) AS time_from_episode_end_to_peak, weak.peak_time <= weak.episode_end_time AS inside_header_on_episode FROM weak",
    ),
    "inspect_run_quantile": query(
        SIGNALS,
        "whole AS (SELECT run_name, 0 AS episode_ix, min(time_s) AS start_time, max(time_s) AS end_time, max(time_s) AS extended_end_time FROM signals GROUP BY run_name)",
        detected("whole", 0.95),
        "seen AS (SELECT run_name, time_s, on_, max(CASE WHEN on_ THEN 1 ELSE 0 END) OVER (PARTITION BY run_name ORDER BY time_s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) = 1 AS recent FROM signals)",
        select="SELECT r.run_name, round(r.start_time, 6) AS start_time, round(r.peak_time, 6) AS peak_time, round(r.end_time, 6) AS end_time, round(r.peak_voltage, 6) AS peak_voltage, round(r.threshold, 6) AS threshold, s.on_ AS on_at_peak, s.recent AS recently_on FROM raw r JOIN seen s ON s.run_name = r.run_name AND s.time_s = r.peak_time",
    ),
    "recent_header_on": query(
        SIGNALS,
        "seen AS (SELECT run_name, on_, max(CASE WHEN on_ THEN 1 ELSE 0 END) OVER (PARTITION BY run_name ORDER BY time_s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) = 1 AS recent FROM signals)",
        select="SELECT run_name, count(*) FILTER (WHERE recent) AS n_recent, count(*) FILTER (WHERE recent AND NOT on_) AS n_only_recent FROM seen GROUP BY run_name",
    ),
    "sliding_windows": query(SIGNALS, EPISODES, WINDOWS, select=f"SELECT {_WINDOW}, round(window_start, 6) AS window_start, round(window_end, 6) AS window_end, round(detection_time, 6) AS detection_time, start_index, end_index FROM cuts"),
    "windows_extended": query(
        SIGNALS, EPISODES, EXTENDED, select=f"SELECT {_WINDOW}, round(window_start, 6) AS window_start, round(window_end, 6) AS window_end, round(detection_time, 6) AS detection_time, start_index, end_index FROM cuts"
    ),
    "timed_windows": query(
        SIGNALS,
        EPISODES,
        """starts AS (
  SELECT run_name, episode_ix, CAST(k AS INTEGER) AS window_ix, start_time + k * 86400.0::DOUBLE AS window_start, start_time + k * 86400.0::DOUBLE + 345600 AS window_end
  FROM (SELECT *, unnest(range(0, greatest(0, CAST(floor((end_time - start_time - 345600 + 1e-12) / 86400) AS BIGINT) + 1))) AS k FROM episodes)
  WHERE start_time + k * 86400.0::DOUBLE + 345600 <= end_time + 1e-12),
held AS (
  SELECT w.run_name, w.episode_ix, w.window_ix, w.window_start, w.window_end, min(s.pos) AS start_index, max(s.pos) + 1 AS end_index
  FROM starts w LEFT JOIN signals s ON s.run_name = w.run_name AND s.time_s >= w.window_start AND s.time_s < w.window_end GROUP BY ALL),
seen AS (SELECT *, max(CASE WHEN start_index IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY run_name, episode_ix ORDER BY window_ix) AS empty FROM held)""",
        select=f"SELECT {_WINDOW}, round(window_start, 6) AS window_start, round(window_end, 6) AS window_end, round(window_end, 6) AS detection_time, start_index, end_index FROM seen WHERE empty = 0",
    ),
    "resampled_runs": query(
        SIGNALS,
        "runs AS (SELECT run_name, min(time_s) AS a, max(time_s) AS b FROM signals GROUP BY run_name)",
        "grid AS (SELECT run_name, k, a + k * 21600.0::DOUBLE AS t FROM (SELECT *, unnest(range(0, CAST(floor((b - a) / 21600 + 1e-9) AS BIGINT) + 1)) AS k FROM runs))",
        "past AS (SELECT g.run_name, g.k, g.t, s.time_s, s.x, s.v, s.cut FROM grid g ASOF JOIN signals s ON g.run_name = s.run_name AND g.t >= s.time_s)",
        "both_ AS (SELECT p.*, n.time_s AS nt, n.x AS nx, n.v AS nv FROM past p ASOF LEFT JOIN signals n ON p.run_name = n.run_name AND p.t < n.time_s)",
        select="SELECT run_name, k AS pos, round(t, 6) AS time_s, round(x + CASE WHEN nt IS NULL THEN 0 ELSE (nx - x) * (t - time_s) / (nt - time_s) END, 6) AS Sensor1, round(v + CASE WHEN nt IS NULL THEN 0 ELSE (nv - v) * (t - time_s) / (nt - time_s) END, 6) AS VoltageSignal, cut AS CutLength FROM both_",
    ),
    "label_features": query(
        SIGNALS,
        EPISODES,
        EVENTS,
        WINDOWS,
        FEATURES,
        LABELS,
        select="SELECT run_name, episode_ix, window_ix, round(audio_rms, 6) AS audio_rms, label, round(event_peak_time, 6) AS event_peak_time, round(time_to_event_s, 6) AS time_to_event_s FROM labeled JOIN feats USING (run_name, episode_ix, window_ix)",
    ),
    "window_time_features": query(
        SIGNALS,
        EPISODES,
        WINDOWS,
        FEATURES,
        select=f"SELECT {_WINDOW}, round(window_start, 6) AS window_start, round(detection_time, 6) AS detection_time, start_index, end_index, round(sample_rate_hz, 6) AS sample_rate_hz, round(audio_mean, 6) AS audio_mean, round(audio_std, 6) AS audio_std, round(audio_rms, 6) AS audio_rms, round(audio_peak_abs, 6) AS audio_peak_abs, round(audio_crest_factor, 6) AS audio_crest_factor, round(audio_zero_crossing_rate, 6) AS audio_zero_crossing_rate FROM feats",
    ),
    "window_context_features": query(
        SIGNALS, EPISODES, WINDOWS, FEATURES, select=f"SELECT {_WINDOW}, round(speed_mean, 6) AS VehicleSpeed_mean, round(speed_std, 6) AS VehicleSpeed_std, round(cut_mean, 6) AS CutLength_mean, round(cut_std, 6) AS CutLength_std FROM feats"
    ),
    "temporal_delta": query(
        SIGNALS,
        EPISODES,
        WINDOWS,
        FEATURES,
        select=f"SELECT {_WINDOW}, round(detection_time, 6) AS detection_time, round(coalesce(audio_rms - lag(audio_rms) OVER p, 0), 6) AS audio_rms_delta_1, round(coalesce(speed_mean - lag(speed_mean) OVER p, 0), 6) AS VehicleSpeed_mean_delta_1 FROM feats WINDOW p AS (PARTITION BY run_name ORDER BY feats.detection_time, episode_ix, window_ix)",
    ),
    "label_windows": query(
        SIGNALS, EPISODES, EVENTS, WINDOWS, LABELS, select=f"SELECT {_WINDOW}, round(detection_time, 6) AS detection_time, label, round(event_peak_time, 6) AS event_peak_time, round(time_to_event_s, 6) AS time_to_event_s FROM labeled"
    ),
    "label_counts": query(
        SIGNALS, EPISODES, EVENTS, WINDOWS, LABELS, select="SELECT run_name, count(*) FILTER (WHERE label = 1) AS n_positive, count(*) FILTER (WHERE label = 0) AS n_negative, count(*) FILTER (WHERE label = -1) AS n_ignored FROM labeled GROUP BY run_name"
    ),
    "trainable_rows": query(SIGNALS, EPISODES, EVENTS, WINDOWS, LABELS, select="SELECT label, count(*) AS n_rows, count(DISTINCT run_name) AS n_runs FROM labeled WHERE label <> -1 GROUP BY label"),
    "balanced_weights": query(
        SIGNALS, EPISODES, EVENTS, WINDOWS, LABELS, "c AS (SELECT label, count(*) AS n FROM labeled WHERE label <> -1 GROUP BY label)", select="SELECT label, round(sum(n) OVER () / (2.0::DOUBLE * n), 6) AS weight FROM c"
    ),
    "consensus_alarms": query(SIGNALS, kept((0.5,)), select="SELECT run_name, round(time_s, 6) AS detection_time, round(score, 6) AS score FROM alarms0", recursive=True),
    "refractory": query(SIGNALS, kept((0.5,)), select="SELECT run_name, round(time_s, 6) AS detection_time, round(score, 6) AS score FROM kept", recursive=True),
    "match_events": query(
        SIGNALS, EPISODES, EVENTS, kept((0.5,)), MATCHES, select="SELECT run_name, round(peak_time, 6) AS event_peak_time, round(hit, 6) AS detection_time, round(peak_time - hit, 6) AS advance_time_s FROM matches", recursive=True
    ),
    "false_detections": query(SIGNALS, EPISODES, EVENTS, kept((0.5,)), MATCHES, select="SELECT run_name, round(time_s, 6) AS detection_time FROM falses", recursive=True),
    "evaluation_summary": query(SIGNALS, EPISODES, EVENTS, kept((0.5,)), MATCHES, SUMMARY.split("\nSELECT")[0], select="SELECT" + SUMMARY.split("\nSELECT")[1], recursive=True),
    "threshold_sweep": query(SIGNALS, EPISODES, EVENTS, kept((0.1, 0.3, 0.5, 0.9)), MATCHES, SUMMARY.split("\nSELECT")[0], select="SELECT" + SUMMARY.split("\nSELECT")[1], recursive=True),
    "min_spacing": query(
        SIGNALS,
        "follow AS (SELECT a.run_name, a.time_s, min(b.time_s) AS nxt FROM signals a LEFT JOIN signals b ON a.run_name = b.run_name AND b.time_s > a.time_s AND b.time_s - a.time_s >= 86400 GROUP BY a.run_name, a.time_s)",
        "taken AS (SELECT run_name, time_s, nxt FROM (SELECT *, min(time_s) OVER (PARTITION BY run_name) AS t0 FROM follow) WHERE time_s = t0 UNION ALL SELECT f.run_name, f.time_s, f.nxt FROM taken k JOIN follow f ON f.run_name = k.run_name AND f.time_s = k.nxt)",
        select="SELECT run_name, round(time_s, 6) AS time_s FROM taken",
        recursive=True,
    ),
    "group_folds": query(
        SIGNALS,
        "sizes AS (SELECT run_name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, run_name) AS k FROM signals GROUP BY run_name)",
        "dealt AS (SELECT 0::BIGINT AS k, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS loads, 0::BIGINT AS fold UNION ALL SELECT s.k, [d.loads[i] + CASE WHEN i = list_position(d.loads, list_min(d.loads)) THEN s.n ELSE 0 END FOR i IN range(1, 6)], CAST(list_position(d.loads, list_min(d.loads)) AS BIGINT) - 1 FROM dealt d JOIN sizes s ON s.k = d.k + 1)",
        select="SELECT s.run_name, s.n AS n_rows, CAST(d.fold AS INTEGER) AS fold FROM dealt d JOIN sizes s ON s.k = d.k",
        recursive=True,
    ),
    "forest_score_case": query(SIGNALS, EPISODES, WINDOWS, FEATURES, select=f"SELECT {_WINDOW}, {FOREST} AS score, CASE WHEN {FOREST} >= 0.5 THEN 1 ELSE 0 END AS predicted FROM feats"),
    "forest_size": "WITH nodes(tree_id, n) AS (VALUES (0, 5), (1, 3)) SELECT count(*) AS n_trees, CAST(sum(n) AS BIGINT) AS n_nodes, CAST(sum(n) * 14 AS BIGINT) AS model_bytes FROM nodes",
    "metadata_to_events": query(
        SIGNALS,
        select="SELECT run_name, round(time_s, 6) AS peak_time, round(v, 6) AS peak_voltage, 1.0::DOUBLE AS threshold, round(v, 6) AS peak_to_threshold_ratio, 0.0::DOUBLE AS duration_s, 'synthetic_metadata' AS source FROM signals",
    ),
    "spectrum_features": query(
        SPECTRUM,
        select="""SELECT b.vec_id, round(sum(p) FILTER (WHERE hz < 500) / total, 6) AS band_energy_0_500_hz, round(sum(p) FILTER (WHERE hz >= 500 AND hz < 2000) / total, 6) AS band_energy_500_2000_hz,
       round(sum(p) FILTER (WHERE hz >= 2000 AND hz < 8000) / total, 6) AS band_energy_2000_8000_hz, round(sum(p) FILTER (WHERE hz >= 8000 AND hz < 16000) / total, 6) AS band_energy_8000_16000_hz,
       round(centre, 3) AS spectral_centroid_hz, round(sqrt(sum(pow(hz - centre, 2) * p) / total), 3) AS spectral_bandwidth_hz, round(sum(p) FILTER (WHERE hz >= 2000 AND hz < 16000) / total, 6) AS high_frequency_energy_ratio
FROM bins b JOIN sums s ON s.vec_id = b.vec_id GROUP BY b.vec_id, total, centre""",
    ),
    "window_spectrum": query(
        SIGNALS,
        EPISODES,
        WINDOWS,
        "samples AS (SELECT c.run_name, c.episode_ix, c.window_ix, s.pos - c.start_index AS i, c.end_index - c.start_index AS n, s.x FROM cuts c JOIN signals s ON s.run_name = c.run_name AND s.pos >= c.start_index AND s.pos < c.end_index)",
        "shaped AS (SELECT *, (x - avg(x) OVER w) * CASE WHEN n > 1 THEN 0.5 - 0.5 * cos(2 * pi() * i / (n - 1)) ELSE 0 END AS v FROM samples WINDOW w AS (PARTITION BY run_name, episode_ix, window_ix))",
        "spread AS (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM shaped)",
        "bins AS (SELECT run_name, episode_ix, window_ix, k, k * 16384.0::DOUBLE / n AS hz, pow(sum(v * cos(2 * pi() * k * i / n)), 2) + pow(sum(v * sin(2 * pi() * k * i / n)), 2) AS p FROM spread GROUP BY run_name, episode_ix, window_ix, n, k)",
        "sums AS (SELECT run_name, episode_ix, window_ix, sum(p) AS total, sum(p * hz) / nullif(sum(p), 0) AS centre FROM bins GROUP BY run_name, episode_ix, window_ix)",
        select="""SELECT b.run_name, b.episode_ix, b.window_ix, round(coalesce(sum(p) FILTER (WHERE hz < 500) / nullif(total, 0), 0), 6) AS band_energy_0_500_hz,
       round(coalesce(sum(p) FILTER (WHERE hz >= 500 AND hz < 2000) / nullif(total, 0), 0), 6) AS band_energy_500_2000_hz, round(coalesce(sum(p) FILTER (WHERE hz >= 2000 AND hz < 8000) / nullif(total, 0), 0), 6) AS band_energy_2000_8000_hz,
       round(coalesce(sum(p) FILTER (WHERE hz >= 8000 AND hz < 16000) / nullif(total, 0), 0), 6) AS band_energy_8000_16000_hz, round(coalesce(centre, 0), 3) AS spectral_centroid_hz,
       round(coalesce(sqrt(sum(pow(hz - centre, 2) * p) / nullif(total, 0)), 0), 3) AS spectral_bandwidth_hz, round(coalesce(sum(p) FILTER (WHERE hz >= 2000 AND hz < 16000) / nullif(total, 0), 0), 6) AS high_frequency_energy_ratio
FROM bins b JOIN sums s USING (run_name, episode_ix, window_ix) GROUP BY b.run_name, b.episode_ix, b.window_ix, total, centre""",
    ),
    "frame_signal": query(
        FRAMES.format(hop=10, frames=5), select="SELECT vec_id, CAST(f AS INTEGER) AS frame_ix, CAST(count(x) AS INTEGER) AS n, round(sum(x), 6) AS total FROM spread GROUP BY vec_id, f HAVING count(x) = 16"
    ),
    "spectrogram_normalized": query(
        FRAMES.format(hop=8, frames=7),
        "shaped AS (SELECT vec_id, f, i, x * (0.5 - 0.5 * cos(2 * pi() * i / 15)) AS w FROM spread)",
        "bins AS (SELECT vec_id, f, k, ln(pow(sum(w * cos(2 * pi() * k * i / 16)), 2) + pow(sum(w * sin(2 * pi() * k * i / 16)), 2) + 1e-8) AS p FROM shaped, range(0, 9) t(k) GROUP BY vec_id, f, k)",
        "level AS (SELECT vec_id, avg(p) AS m, stddev_pop(p) AS d FROM bins GROUP BY vec_id)",
        select="SELECT b.vec_id, round(min((p - m) / d), 5) AS least, round(max((p - m) / d), 5) AS most, round(avg(pow((p - m) / d, 2)), 5) AS mean_square FROM bins b JOIN level l ON l.vec_id = b.vec_id GROUP BY b.vec_id",
    ),
    "log_spectrogram_stats": query(
        FRAMES.format(hop=8, frames=7),
        "shaped AS (SELECT vec_id, f, i, x * (0.5 - 0.5 * cos(2 * pi() * i / 15)) AS w FROM spread)",
        "bins AS (SELECT vec_id, f, k, ln(pow(sum(w * cos(2 * pi() * k * i / 16)), 2) + pow(sum(w * sin(2 * pi() * k * i / 16)), 2) + 1e-8) AS p FROM shaped, range(0, 9) t(k) GROUP BY vec_id, f, k)",
        select="SELECT vec_id, CAST(count(DISTINCT k) AS INTEGER) AS n_bins, CAST(count(DISTINCT f) AS INTEGER) AS n_frames, round(avg(p), 5) AS mean_power, round(max(p), 5) AS max_power FROM bins GROUP BY vec_id",
    ),
}
