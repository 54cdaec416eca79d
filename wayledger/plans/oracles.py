"""DuckDB SQL for the registered queries, over the driver's ``events`` table."""

from __future__ import annotations

EV = r"""
e0 AS (
  SELECT event_id AS n, user_id // 10 AS v, regexp_extract(props, '(\d+)', 1)::INT AS k, event_type AS et, value AS x,
         TIMESTAMP '2024-01-01' + to_microseconds((epoch_us(ts) - 1704067200000000) // 6) AS tm FROM events
), e1 AS (
  SELECT n, k, et, tm, et = 'error' AND k BETWEEN 55 AND 59 AS broken, n::VARCHAR AS event_id,
    CASE WHEN et = 'purchase' THEN 'trip_end' WHEN et = 'click' AND k % 2 = 0 THEN 'trip_start' WHEN et = 'error' AND k BETWEEN 50 AND 54 THEN 'bogus' ELSE 'ping' END AS event_type,
    CASE WHEN et NOT IN ('signup', 'error') THEN 'T' || n END AS trip_id,
    CASE WHEN NOT (et = 'error' AND k BETWEEN 40 AND 44) THEN 'D' || lpad((v + 1)::VARCHAR, 3, '0') END AS driver_id,
    'V' || lpad((v + 1)::VARCHAR, 3, '0') AS vehicle_id,
    CASE WHEN et = 'error' AND k BETWEEN 0 AND 9 THEN 99e0 ELSE 12.921e0 + (v % 4) * 0.04e0 + (k % 10 - 5) * 0.004e0 END AS lat,
    77.541e0 + (v // 4 % 4) * 0.04e0 + (n % 10 - 5) * 0.004e0 AS lon,
    CASE WHEN et = 'error' AND k BETWEEN 10 AND 19 THEN -5e0 WHEN et IN ('signup', 'error') THEN 0e0 ELSE (15 + k % 30)::DOUBLE END AS speed,
    CASE WHEN et = 'error' AND k BETWEEN 20 AND 29 THEN 'teleporting' WHEN et IN ('signup', 'error') THEN 'idle' WHEN et = 'view' THEN 'enroute' ELSE 'on_trip' END AS status,
    CASE WHEN et = 'error' AND k BETWEEN 30 AND 39 THEN -1e0 WHEN et = 'purchase' THEN x ELSE 0e0 END AS fare,
    CASE WHEN NOT (et = 'error' AND k BETWEEN 45 AND 49) THEN tm END AS event_time,
    CASE WHEN n % 50 = 3 THEN tm + to_minutes(n // 50 % 20 + 1) ELSE tm END AS arrival_time
  FROM e0
), e2 AS (
  SELECT n, arrival_time, broken,
    CASE WHEN NOT broken THEN event_id END AS event_id, CASE WHEN NOT broken THEN event_type END AS event_type, CASE WHEN NOT broken THEN trip_id END AS trip_id,
    CASE WHEN NOT broken THEN driver_id END AS driver_id, CASE WHEN NOT broken THEN vehicle_id END AS vehicle_id, CASE WHEN NOT broken THEN lat END AS lat,
    CASE WHEN NOT broken THEN lon END AS lon, CASE WHEN NOT broken THEN speed END AS speed, CASE WHEN NOT broken THEN status END AS status,
    CASE WHEN NOT broken THEN fare END AS fare, CASE WHEN NOT broken THEN event_time END AS event_time FROM e1
), raw AS (
  SELECT *, n AS kafka_offset FROM e2 UNION ALL SELECT *, n + 1000000000 FROM e2 WHERE n % 100 = 7
), j AS (
  SELECT *, CASE WHEN broken THEN 'unparseable_json' WHEN driver_id IS NULL THEN 'missing_field' WHEN event_type NOT IN ('ping', 'trip_start', 'trip_end') THEN 'bad_event_type'
    WHEN status NOT IN ('idle', 'enroute', 'on_trip') THEN 'bad_status' WHEN NOT (lat BETWEEN 12.90e0 AND 13.06e0 AND lon BETWEEN 77.52e0 AND 77.68e0) THEN 'coords_out_of_bounds'
    WHEN speed < 0 THEN 'negative_speed' WHEN fare < 0 THEN 'negative_fare' WHEN event_time IS NULL THEN 'bad_timestamp' END AS reason FROM raw
), ok AS (SELECT * FROM j WHERE reason IS NULL
), z AS (
  SELECT kafka_offset, lat BETWEEN 12.90e0 AND 13.06e0 AND lon BETWEEN 77.52e0 AND 77.68e0 AS in_city,
    CASE WHEN lat BETWEEN 12.90e0 AND 13.06e0 AND lon BETWEEN 77.52e0 AND 77.68e0 THEN 'Z' || lpad((
      least(greatest(floor((13.06e0 - lat) / ((13.06e0 - 12.90e0) / 4)), 0), 3) * 4 + least(greatest(floor((lon - 77.52e0) / ((77.68e0 - 77.52e0) / 4)), 0), 3) + 1)::INT::VARCHAR, 2, '0') END AS zone_id
  FROM raw WHERE lat IS NOT NULL
), cl AS (
  SELECT ok.*, strftime(event_time, '%Y-%m-%d') AS sim_date, z.zone_id FROM ok JOIN z USING (kafka_offset)
  QUALIFY row_number() OVER (PARTITION BY event_time::DATE, event_id ORDER BY event_time, kafka_offset) = 1
)"""

SEQ = r""", w AS (
  SELECT *, lag(lat) OVER o AS plat, lag(lon) OVER o AS plon, lag(event_time) OVER o AS ptime, lead(event_time) OVER o AS ntime
  FROM cl WINDOW o AS (PARTITION BY sim_date, vehicle_id ORDER BY event_time, event_id)
), s AS (
  SELECT *, CASE WHEN ptime IS NOT NULL THEN 2 * 6371.0088e0 * asin(least(1e0, sqrt(pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2)))) END AS hop_km,
    (epoch_us(event_time) - epoch_us(ptime)) / 3600e6 AS hop_h, (epoch_us(ntime) - epoch_us(event_time)) / 60e6 AS gap_min FROM w
), q AS (
  SELECT *, CASE WHEN ptime IS NOT NULL THEN CASE WHEN hop_h > 0 THEN hop_km / hop_h ELSE 0e0 END END AS hop_kmh FROM s
), vd AS (
  SELECT sim_date, vehicle_id, count_if(event_type = 'trip_end')::BIGINT AS trips, round(coalesce(sum(CASE WHEN event_type = 'trip_end' THEN fare END), 0e0), 2) AS revenue,
    min(event_time) AS first_seen, max(event_time) AS last_seen, count(*) AS events,
    round(coalesce(sum(CASE WHEN hop_kmh <= 150 THEN hop_km END), 0e0), 3) AS gps_km, count_if(hop_kmh <= 150)::BIGINT AS hops,
    round(coalesce(sum(CASE WHEN gap_min <= 20 THEN gap_min END), 0e0), 2) AS online_min, round(coalesce(sum(CASE WHEN gap_min <= 20 AND status = 'on_trip' THEN gap_min END), 0e0), 2) AS on_trip_min,
    round(coalesce(sum(CASE WHEN gap_min <= 20 AND status = 'idle' THEN gap_min END), 0e0), 2) AS idle_min,
    round(CASE WHEN coalesce(sum(CASE WHEN gap_min <= 20 THEN gap_min END), 0e0) > 0 THEN least(1e0, coalesce(sum(CASE WHEN gap_min <= 20 AND status = 'on_trip' THEN gap_min END), 0e0) / sum(CASE WHEN gap_min <= 20 THEN gap_min END)) ELSE 0e0 END, 4) AS utilization
  FROM q GROUP BY sim_date, vehicle_id
)"""

ZH = r""", zh AS (
  SELECT zone_id, date_trunc('hour', event_time)::TIMESTAMP AS window_start, date_trunc('hour', event_time)::TIMESTAMP + INTERVAL 1 HOUR AS window_end, date_trunc('hour', event_time)::DATE AS sim_day,
    hour(event_time)::INT AS sim_hour, count_if(event_type = 'trip_start')::BIGINT AS trips_started, count_if(event_type = 'trip_end')::BIGINT AS trips_completed,
    round(coalesce(sum(CASE WHEN event_type = 'trip_end' THEN fare END), 0e0), 2) AS earnings, count_if(status = 'idle')::BIGINT AS idle_pings, count_if(status = 'on_trip')::BIGINT AS on_trip_pings, count_if(status = 'enroute')::BIGINT AS enroute_pings, count(*) AS pings
  FROM cl GROUP BY ALL
), st AS (
  SELECT vehicle_id, driver_id, status, zone_id, trip_id, speed, event_time, lat, lon FROM cl QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY event_time DESC, event_id DESC) = 1
), nw AS (SELECT max(event_time) AS now FROM cl
), dr AS (
  SELECT vehicle_id, event_time::DATE AS sim_day, count_if(event_type = 'trip_end')::BIGINT AS trips, round(coalesce(sum(CASE WHEN event_type = 'trip_end' THEN fare END), 0e0), 2) AS revenue FROM cl GROUP BY ALL
), i0 AS (
  SELECT *, status = 'idle' AND coalesce(lag(status) OVER o <> 'idle', true) AS st0, lead(event_time) OVER o AS next_time FROM cl WINDOW o AS (PARTITION BY vehicle_id ORDER BY event_time, event_id)
), i1 AS (SELECT *, sum(st0::INT) OVER (PARTITION BY vehicle_id ORDER BY event_time, event_id ROWS UNBOUNDED PRECEDING) AS island FROM i0
), i2 AS (SELECT *, min(event_time) OVER (PARTITION BY vehicle_id, island) AS since FROM i1 WHERE status = 'idle'
), i3 AS (
  SELECT vehicle_id, min(event_time) AS idle_since, min(event_time) FILTER (epoch_us(event_time) - epoch_us(since) >= 2700000000) AS opened_at, max(event_time) AS last_idle_at,
    CASE WHEN count(next_time) = count(*) THEN max(next_time) END AS closed_at, count(*) AS events
  FROM i2 GROUP BY vehicle_id, island
), isl AS (
  SELECT vehicle_id, idle_since, opened_at, last_idle_at, closed_at, round((epoch_us(coalesce(closed_at, last_idle_at)) - epoch_us(idle_since)) / 60e6, 2) AS idle_min, events,
    opened_at IS NOT NULL AS alert, CASE WHEN closed_at IS NULL THEN 'open' ELSE 'closed' END AS status FROM i3
)"""


def _expenses(name: str, fault: str) -> str:
    return rf""", {name}g AS (
  SELECT v, d, {fault} AS f, (v + 2 * d) % 9 = 0 AS svc FROM (SELECT unnest(range(0, (SELECT max(user_id // 10) + 2 FROM events))) AS v), range(5) t(d)
), {name}0 AS (
  SELECT strftime(DATE '2024-01-01' + d::INT, '%Y-%m-%d') AS sim_date, v AS line_no, f, CASE WHEN f = 3 THEN 'V999' ELSE 'V' || lpad((v + 1)::VARCHAR, 3, '0') END AS vehicle_id,
    CASE WHEN f = 0 THEN '' ELSE (300 + (97 * v + 211 * d) % 600)::VARCHAR END AS fuel_cost,
    (CASE WHEN f = 1 THEN -1 ELSE 1 END * (90 + (53 * v + 71 * d) % 200 + CASE WHEN svc THEN 700 ELSE 0 END))::VARCHAR AS maintenance_cost,
    CASE WHEN f = 2 THEN 'abc' ELSE (200 + (37 * v + 53 * d) % 120)::VARCHAR END AS distance_covered, svc AS service_flag FROM {name}g WHERE f <> 11
), {name}1 AS (
  SELECT * FROM {name}0 UNION ALL SELECT * REPLACE (line_no + 1000000 AS line_no, (fuel_cost::BIGINT + 10)::VARCHAR AS fuel_cost) FROM {name}0 WHERE f = 4
), {name}j AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY sim_date, trim(vehicle_id) ORDER BY line_no) > 1 THEN 'duplicate'
    WHEN try_cast(fuel_cost AS DOUBLE) IS NULL OR try_cast(maintenance_cost AS DOUBLE) IS NULL OR try_cast(distance_covered AS DOUBLE) IS NULL THEN 'missing_value'
    WHEN try_cast(fuel_cost AS DOUBLE) < 0 OR try_cast(maintenance_cost AS DOUBLE) < 0 OR try_cast(distance_covered AS DOUBLE) < 0 THEN 'negative_value'
    WHEN vehicle_id = 'V999' AND (SELECT max(user_id // 10) + 2 FROM events) < 999 THEN 'unknown_vehicle' END AS reason FROM {name}1
), {name} AS (
  SELECT sim_date, vehicle_id, fuel_cost::DOUBLE AS fuel_cost, maintenance_cost::DOUBLE AS maintenance_cost, distance_covered::DOUBLE AS distance_covered, service_flag FROM {name}j WHERE reason IS NULL
)"""


def _rec(name: str, costs: str) -> str:
    return rf""", {name}0 AS (
  SELECT coalesce(vd.sim_date, c.sim_date) AS sim_date, coalesce(vd.vehicle_id, c.vehicle_id) AS vehicle_id, vd.sim_date IS NOT NULL AS ht, c.sim_date IS NOT NULL AS hc,
    coalesce(trips, 0) AS trips, coalesce(revenue, 0e0) AS revenue, coalesce(gps_km, 0e0) AS gps_km, coalesce(online_min, 0e0) AS online_min, coalesce(on_trip_min, 0e0) AS on_trip_min, coalesce(idle_min, 0e0) AS idle_min,
    coalesce(utilization, 0e0) AS utilization, coalesce(fuel_cost, 0e0) AS fuel_cost, coalesce(maintenance_cost, 0e0) AS maintenance_cost, coalesce(distance_covered, 0e0) AS distance_covered, coalesce(service_flag, false) AS in_service
  FROM vd FULL JOIN {costs} c ON vd.sim_date = c.sim_date AND vd.vehicle_id = c.vehicle_id
), {name}c AS (SELECT *, round(fuel_cost + maintenance_cost, 2) AS total_cost FROM {name}0
), {name}n AS (SELECT *, round(revenue - total_cost, 2) AS net_profit FROM {name}c
), {name}1 AS (
  SELECT *, round(CASE WHEN revenue <> 0 THEN net_profit / revenue ELSE 0e0 END, 4) AS margin,
    round(CASE WHEN gps_km <> 0 THEN revenue / gps_km ELSE 0e0 END, 4) AS revenue_per_km, round(CASE WHEN gps_km <> 0 THEN total_cost / gps_km ELSE 0e0 END, 4) AS cost_per_km,
    round(CASE WHEN distance_covered > 0 THEN abs(gps_km - distance_covered) / distance_covered ELSE 0e0 END, 4) AS mismatch_pct, ht AND NOT hc AS missing_costs, hc AND NOT ht AS missing_telemetry FROM {name}n
), {name} AS (
  SELECT *, net_profit < 0 AS unprofitable, revenue > 0 AND margin < 0.1e0 AS low_margin, mismatch_pct > 0.15e0 AS distance_mismatch,
    coalesce((lag(net_profit, 2) OVER o > lag(net_profit, 1) OVER o AND lag(net_profit, 1) OVER o > net_profit) OR (lag(net_profit, 2) OVER o < 0)::INT + (lag(net_profit, 1) OVER o < 0)::INT + (net_profit < 0)::INT >= 2, false) AS becoming_unprofitable
  FROM {name}1 WINDOW o AS (PARTITION BY vehicle_id ORDER BY sim_date)
)"""


LATE = r""", b0 AS (SELECT date_trunc('minute', arrival_time) AS batch, max(event_time) AS top FROM ok GROUP BY 1
), b1 AS (SELECT batch, max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS seen FROM b0
), late AS (SELECT ok.event_id, ok.kafka_offset FROM ok JOIN b1 ON date_trunc('minute', arrival_time) = batch WHERE event_time <= seen - INTERVAL 10 MINUTE)"""
BOUNDED = r""", lg AS (SELECT *, coalesce(vehicle_id[2:]::INT % 6, 0) AS log_partition, row_number() OVER (PARTITION BY coalesce(vehicle_id[2:]::INT % 6, 0) ORDER BY arrival_time, kafka_offset) - 1 AS log_offset FROM j
), lb AS (SELECT log_offset // 400 AS batch, max(event_time) FILTER (reason IS NULL) AS top FROM lg GROUP BY 1
), lm AS (SELECT batch, max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS seen FROM lb
), lt AS (SELECT event_id, kafka_offset, log_partition::INT AS log_partition, log_offset, coalesce(event_time <= seen - INTERVAL 10 MINUTE, false) AS late FROM lg JOIN lm ON log_offset // 400 = batch WHERE reason IS NULL)"""

LABEL = """CASE WHEN unprofitable THEN 'unprofitable' WHEN becoming_unprofitable THEN 'declining' WHEN low_margin THEN 'low margin' WHEN distance_mismatch THEN 'distance mismatch'
  WHEN in_service THEN 'in service' WHEN missing_costs THEN 'no costs' WHEN missing_telemetry THEN 'no telemetry' ELSE 'ok' END"""
FLAGS = ("unprofitable", "becoming_unprofitable", "low_margin", "distance_mismatch", "in_service", "missing_costs", "missing_telemetry")
# The texts that the report shows.
# Halves go away from zero, as in Spark's formats; a bare printf follows the binary digits.
PERCENT = "printf('%.1f%%', round({0} * 100 + sign({0}) * 1e-9, 1))"
REASONS = f"""concat_ws('; ', CASE WHEN unprofitable THEN 'net profit ' || printf('%.2f', net_profit) || ' CU is negative' END,
  CASE WHEN becoming_unprofitable THEN 'net profit trending down or loss-making on 2 of the last 3 days' END, CASE WHEN low_margin THEN 'margin ' || {PERCENT.format('margin')} || ' is below the 10% threshold' END,
  CASE WHEN distance_mismatch THEN 'GPS distance differs from reported distance by ' || {PERCENT.format('mismatch_pct')} END, CASE WHEN in_service THEN 'vehicle was serviced or in the garage' END,
  CASE WHEN missing_costs THEN 'telemetry present but no expense row' END, CASE WHEN missing_telemetry THEN 'expense row present but no telemetry' END)"""
ANY = " OR ".join(f for f in FLAGS if f != "in_service")
COST = _expenses("ex", "(5 * v + d) % 41")
COST2 = _expenses("ey", "-1")
REC = SEQ + COST + _rec("rec", "ex")
COLS = "sim_date, vehicle_id, trips, revenue, gps_km, total_cost, net_profit, margin, revenue_per_km, cost_per_km, mismatch_pct"
AVAILABLE = ", av AS (SELECT DISTINCT sim_date, CASE WHEN sim_date IN ('2024-01-01', '2024-01-03') THEN 2 ELSE 1 END AS version FROM exj WHERE sim_date <> '2024-01-04'), pr AS (SELECT sim_date, 1 AS processed_version FROM rn WHERE status = 'success')"

RAW = COST + COST2 + """, ln AS (SELECT sim_date, 1 AS version, line_no, vehicle_id, fuel_cost, maintenance_cost, distance_covered, service_flag FROM ex1
  UNION ALL SELECT sim_date, 2, line_no, vehicle_id, fuel_cost, maintenance_cost, distance_covered, service_flag FROM ey1
), landed AS (SELECT * FROM ln WHERE CASE WHEN version = 1 THEN sim_date <> '2024-01-04' ELSE sim_date IN ('2024-01-01', '2024-01-03') END
), arr AS (SELECT sim_date, version, sim_date::TIMESTAMP + to_minutes(1440 + sum(coalesce(try_cast(fuel_cost AS BIGINT), 0))::BIGINT % 240) AS arrived_at FROM ln GROUP BY 1, 2
)"""
RUNS = COST + """, rn0 AS (SELECT sim_date, count(*) AS n, count(reason) AS bad FROM exj GROUP BY 1
), rn AS (SELECT 'reconcile-' || sim_date AS run_id, sim_date, CASE WHEN sim_date = '2024-01-04' THEN 'failed' ELSE 'success' END AS status, sim_date = '2024-01-04' AS late, bad AS quarantined,
    sim_date::TIMESTAMP + INTERVAL 88200 SECOND AS started_at, sim_date::TIMESTAMP + INTERVAL 88200 SECOND + to_seconds(n) AS finished_at, n / 10e0 AS validate_s, bad::DOUBLE AS merge_s FROM rn0
)"""
DRIFT = LATE + """, dft AS (SELECT sim_date, round(b - s, 2) AS drift_abs, round(CASE WHEN b <> 0 THEN round(b - s, 2) / b ELSE 0e0 END, 6) AS drift_ratio FROM (
  SELECT sim_date, round(coalesce(sum(CASE WHEN event_type = 'trip_end' THEN fare END), 0e0), 2) AS b,
    round(coalesce(sum(CASE WHEN event_type = 'trip_end' AND kafka_offset NOT IN (SELECT kafka_offset FROM late) THEN fare END), 0e0), 2) AS s FROM cl GROUP BY 1)
)"""
NOTICE = """, nt AS (SELECT CASE WHEN idle_min < 120 THEN 'IdleVehicle' ELSE 'unknown' END AS alertname, 'warning' AS severity, CASE WHEN status = 'closed' THEN 'resolved' ELSE 'firing' END AS status,
    vehicle_id || ' idle since ' || strftime(opened_at, '%Y-%m-%dT%H:%M:%SZ') AS summary, date_trunc('second', opened_at)::TIMESTAMP AS starts_at,
    CASE WHEN status = 'closed' THEN date_trunc('second', closed_at)::TIMESTAMP END AS ends_at, vehicle_id FROM isl WHERE alert
)"""
STALLED = """, sp AS (SELECT min(arrival_time) AS started_at, max(arrival_time) AS now FROM raw
), zq AS (SELECT 'Z' || lpad((i + 1)::VARCHAR, 2, '0') AS query FROM range(16) t(i)
), zp AS (SELECT zone_id AS query, count(*) AS n, max(arrival_time) AS last_at FROM cl GROUP BY 1
), stl AS (SELECT query, last_at, CASE WHEN coalesce(n, 0) % 7 = 0 THEN 'inactive' WHEN date_diff('microsecond', started_at, now) >= 120e6 THEN
    CASE WHEN last_at IS NULL THEN 'no_progress' WHEN date_diff('microsecond', last_at, now) >= 121e6 THEN 'silent' END END AS reason FROM zq LEFT JOIN zp USING (query), sp
)"""
METRICS = """, bm AS (
  SELECT 'batch_last_success' AS metric, '' AS label, epoch(max(finished_at))::BIGINT::DOUBLE AS value FROM rn WHERE status = 'success'
  UNION ALL SELECT 'batch_quarantined_rows', '', max_by(quarantined, started_at)::DOUBLE FROM rn WHERE status = 'success'
  UNION ALL SELECT 'batch_task_duration', 'validate', max_by(validate_s, started_at) FROM rn WHERE status = 'success'
  UNION ALL SELECT 'batch_task_duration', 'merge', max_by(merge_s, started_at) FROM rn WHERE status = 'success'
  UNION ALL SELECT 'expense_file_late', '', max_by(late, started_at)::INT::DOUBLE FROM rn UNION ALL SELECT 'batch_run_failed', '', (max_by(status, started_at) = 'failed')::INT::DOUBLE FROM rn
  UNION ALL SELECT 'speed_batch_drift', '', max_by(drift_ratio, sim_date) FROM dft UNION ALL SELECT 'open_idle_alerts', '', count(*)::DOUBLE FROM isl WHERE alert AND status = 'open'
)"""
# A quarter of an hour is a step; a minute of a rule is an hour, so four steps.
GRID = """, gr AS (SELECT unnest(range(0, 529)) AS n), src AS (
  SELECT greatest(ceil(date_diff('microsecond', TIMESTAMP '2024-01-01', arrival_time) / 900e6), 0)::BIGINT AS n, 'p' || coalesce(vehicle_id[2:]::INT % 6, 0) AS label, reason FROM j
)"""
RULES = """, mk AS (SELECT n, coalesce(c, 0) AS made, coalesce(d, 0) AS bad FROM gr LEFT JOIN (SELECT n, count(*) AS c, count(reason) AS d FROM src GROUP BY 1) USING (n)
), mw AS (SELECT n, sum(made) OVER (ORDER BY n ROWS 3 PRECEDING) AS m1, sum(made) OVER (ORDER BY n ROWS 7 PRECEDING) AS m2, sum(made) OVER (ORDER BY n ROWS 19 PRECEDING) AS m5, sum(bad) OVER (ORDER BY n ROWS 19 PRECEDING) AS b5 FROM mk
), ga(kind, t, value) AS (SELECT 'late', started_at, late::INT::DOUBLE FROM rn UNION ALL SELECT 'failed', finished_at, (status = 'failed')::INT::DOUBLE FROM rn UNION ALL SELECT 'good', finished_at, 0e0 FROM rn WHERE status = 'success'
  UNION ALL SELECT 'drift', finished_at, drift_ratio FROM dft JOIN rn USING (sim_date)
), gn AS (SELECT kind, greatest(ceil(date_diff('microsecond', TIMESTAMP '2024-01-01', t) / 900e6), 0)::BIGINT AS k, t, value FROM ga
), gv AS (SELECT kind, gr.n, max_by(value, t) AS value, max_by(k, t) AS k FROM gr JOIN gn ON k <= gr.n GROUP BY ALL
), op AS (SELECT n, (SELECT count(*) FROM isl WHERE alert AND opened_at <= TIMESTAMP '2024-01-01' + to_minutes(15 * n)) - (SELECT count(*) FROM isl WHERE alert AND closed_at <= TIMESTAMP '2024-01-01' + to_minutes(15 * n)) AS value FROM gr
), pc AS (SELECT label, n, coalesce(c, 0) AS c FROM (SELECT DISTINCT label FROM src) CROSS JOIN gr LEFT JOIN (SELECT label, n, count(*) AS c FROM src GROUP BY ALL) USING (label, n)
), ps AS (SELECT label, n, c, n - coalesce(last_value(CASE WHEN c > 0 THEN n END IGNORE NULLS) OVER o, 0) AS gap, sum(c) OVER (PARTITION BY label ORDER BY n ROWS 7 PRECEDING) AS work FROM pc WINDOW o AS (PARTITION BY label ORDER BY n ROWS UNBOUNDED PRECEDING)
), co(rule, label, n, value, holds) AS (
  SELECT 'TelemetryNotProduced', '', n, m1::DOUBLE, m1 = 0 FROM mw UNION ALL SELECT 'DLQRateHigh', '', n, (b5 / 300) / greatest(m5 / 300, 0.001e0), (b5 / 300) / greatest(m5 / 300, 0.001e0) > 0.02e0 FROM mw
  UNION ALL SELECT 'StreamStalled', label, n, gap::DOUBLE, gap > 8 OR (work = 0 AND m2 > 0) FROM ps JOIN mw USING (n) UNION ALL SELECT 'StreamLagHigh', label, n, 0e0, false FROM ps
  UNION ALL SELECT 'ExpenseFileLate', '', gr.n, value, coalesce(value > 0, false) FROM gr LEFT JOIN gv ON gr.n = gv.n AND kind = 'late' UNION ALL SELECT 'BatchRunFailed', '', gr.n, value, coalesce(value > 0, false) FROM gr LEFT JOIN gv ON gr.n = gv.n AND kind = 'failed'
  UNION ALL SELECT 'BatchNotRunRecently', '', gr.n, (gr.n - k)::DOUBLE, coalesce(gr.n - k > 180, true) FROM gr LEFT JOIN gv ON gr.n = gv.n AND kind = 'good'
  UNION ALL SELECT 'SpeedBatchDriftHigh', '', gr.n, value, coalesce(abs(value) > 0.05e0, false) FROM gr LEFT JOIN gv ON gr.n = gv.n AND kind = 'drift' UNION ALL SELECT 'IdleVehiclesHigh', '', n, value::DOUBLE, value > 8 FROM op
), ru(rule, severity, hold) AS (VALUES ('TelemetryNotProduced', 'critical', 4), ('DLQRateHigh', 'warning', 8), ('StreamStalled', 'critical', 8), ('StreamLagHigh', 'warning', 8), ('ExpenseFileLate', 'warning', 4),
  ('BatchRunFailed', 'critical', 4), ('BatchNotRunRecently', 'warning', 8), ('SpeedBatchDriftHigh', 'warning', 8), ('IdleVehiclesHigh', 'warning', 8)
), s0 AS (SELECT *, n - row_number() OVER (PARTITION BY rule, label, holds ORDER BY n) AS run FROM co
), s1 AS (SELECT *, n - min(n) OVER (PARTITION BY rule, label, holds, run) AS age FROM s0
), sx AS (SELECT rule, severity, label, n, TIMESTAMP '2024-01-01' + to_minutes(15 * n) AS moment, value, CASE WHEN NOT holds THEN 'inactive' WHEN age >= hold THEN 'firing' ELSE 'pending' END AS state FROM s1 JOIN ru USING (rule)
), sy AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY rule, label ORDER BY n), 'inactive') AS before FROM sx
)"""
SOME = "('2024-01-01', '2024-01-02', '2024-01-03', '2024-01-05')"
MIXED = SEQ + COST + COST2 + ", mix AS (SELECT *, 1 AS version FROM ex WHERE sim_date IN ('2024-01-02', '2024-01-05') UNION ALL SELECT *, 2 FROM ey WHERE sim_date IN ('2024-01-01', '2024-01-03'))"
MIXED += _rec("rec", "mix").replace("FROM vd FULL JOIN", f"FROM (SELECT * FROM vd WHERE sim_date IN {SOME}) vd FULL JOIN")

# The daily job: first files of four dates, then corrected ones of two and a broken one of the last.
DAILY = SEQ + COST + COST2 + """, gt AS (SELECT sim_date, count(reason) / count(*)::DOUBLE <= 0.2e0 AS ok, count(reason) AS bad FROM exj WHERE sim_date <> '2024-01-04' GROUP BY 1
), d1 AS (SELECT sim_date, 1 AS version FROM gt WHERE ok
), d2 AS (SELECT * FROM d1 WHERE sim_date NOT IN ('2024-01-01', '2024-01-03') UNION ALL VALUES ('2024-01-01', 2), ('2024-01-03', 2)
), m1 AS (SELECT * FROM ex WHERE sim_date IN (SELECT sim_date FROM d1)
), m2 AS (SELECT * FROM ex WHERE sim_date IN (SELECT sim_date FROM d2 WHERE version = 1) UNION ALL SELECT * FROM ey WHERE sim_date IN (SELECT sim_date FROM d2 WHERE version = 2))"""
for _n in ("1", "2"):
    DAILY += _rec(f"r{_n}", f"m{_n}").replace("FROM vd FULL JOIN", f"FROM (SELECT * FROM vd WHERE sim_date IN (SELECT sim_date FROM d{_n})) vd FULL JOIN")

# A vehicle is offline when the watermark has passed its last event by the minutes of silence.
STATES = "SELECT vehicle_id, driver_id, CASE WHEN gone THEN 'offline' ELSE status END AS status, zone_id, CASE WHEN gone THEN 0e0 ELSE speed END AS speed, CASE WHEN NOT gone THEN trip_id END AS trip_id, event_time FROM (SELECT *, event_time + INTERVAL 20 MINUTE <= now - INTERVAL 10 MINUTE AS gone FROM st, nw)"

PARTS: dict[str, tuple[str, str]] = {
    "daily_table": (DAILY, f"SELECT {COLS}, online_min, on_trip_min, idle_min, utilization, fuel_cost, maintenance_cost, distance_covered, {', '.join(FLAGS)}, version AS expense_file_version, sim_date || '_v' || version AS run_id FROM r2 JOIN d2 USING (sim_date)"),
    "daily_runs": (DAILY, "SELECT sim_date || '_v' || version AS run_id, sim_date, version, CASE WHEN ok THEN 'success' ELSE 'failed' END AS status, bad::BIGINT AS quarantined, true AS timed FROM (SELECT sim_date, 1 AS version, ok, bad FROM gt UNION ALL SELECT sim_date, 2, true, 0 FROM d2 WHERE version = 2 UNION ALL SELECT '2024-01-05', 3, false, count_if(line_no % 2 = 1) FROM ey1 WHERE sim_date = '2024-01-05')"),
    "daily_quarantine": (DAILY, "SELECT sim_date || '_v1' AS run_id, sim_date, reason, count(*) AS rows FROM exj WHERE reason IS NOT NULL AND sim_date <> '2024-01-04' GROUP BY sim_date, reason UNION ALL SELECT '2024-01-05_v3', '2024-01-05', 'missing_value', count(*) FROM ey1 WHERE sim_date = '2024-01-05' AND line_no % 2 = 1"),
    "daily_summary": (DAILY, "SELECT vehicle_id, min(sim_date) AS first_date, max(sim_date) AS last_date, max_by(net_profit, sim_date) AS last_net, max_by(before_net, sim_date) AS before_net FROM (SELECT *, coalesce(lag(net_profit) OVER (PARTITION BY vehicle_id ORDER BY sim_date)) AS before_net FROM r2) GROUP BY 1"),
    "restated_versions": (DAILY, "SELECT coalesce(a.sim_date, b.sim_date) AS sim_date, coalesce(a.vehicle_id, b.vehicle_id) AS vehicle_id, a.net_profit AS old_net_profit, a.total_cost AS old_total_cost, b.net_profit AS new_net_profit, b.total_cost AS new_total_cost FROM r1 a FULL JOIN r2 b ON a.sim_date = b.sim_date AND a.vehicle_id = b.vehicle_id WHERE a.net_profit IS DISTINCT FROM b.net_profit OR a.total_cost IS DISTINCT FROM b.total_cost"),
    "expense_raw": (RAW, "SELECT sim_date, version, sim_date AS date, vehicle_id, fuel_cost, maintenance_cost, distance_covered, service_flag::VARCHAR AS service_flag FROM landed"),
    "landing_versions": (RAW, "SELECT sim_date, max(version) AS version FROM landed GROUP BY 1"),
    "late_deliveries": (RAW, "SELECT sim_date, version, arrived_at FROM arr WHERE version <= 1 AND arrived_at > sim_date::TIMESTAMP + INTERVAL 1560 MINUTE"),
    "report_csv": (REC, f"SELECT {COLS} FROM rec"),
    "recompute": (MIXED, f"SELECT sim_date, vehicle_id, trips, revenue, gps_km, total_cost, net_profit, margin, mismatch_pct, {', '.join(FLAGS)}, CASE WHEN sim_date IN ('2024-01-01', '2024-01-03') THEN 2 ELSE 1 END AS source_version FROM rec"),
    "run_log_latest": (RUNS, "SELECT * FROM rn"),
    "alert_rows": (ZH + NOTICE, "SELECT * FROM nt"),
    "recent_alerts": (ZH + NOTICE, "SELECT alertname, severity, status, summary, starts_at, ends_at FROM nt ORDER BY starts_at DESC, alertname, summary LIMIT 25"),
    "pipeline_status": (ZH + RUNS + DRIFT, "SELECT (SELECT now FROM nw) AS latest_event, round(date_diff('second', (SELECT date_trunc('second', now + INTERVAL 999999 MICROSECOND) FROM nw), TIMESTAMP '2024-01-06 12:00:00') / 60e0, 2) AS lag_min, (SELECT max_by(run_id, started_at) FROM rn) AS last_run, (SELECT max_by(status, started_at) FROM rn) AS last_status, (SELECT max(sim_date) FROM rn WHERE status = 'success') AS last_good_date, (SELECT max_by(drift_ratio, sim_date) FROM dft) AS drift_ratio, (SELECT count(*) FROM isl WHERE alert AND status = 'open') AS open_alerts, (SELECT count(reason) FROM exj) AS dq_issues"),
    "stalled_queries": (STALLED, "SELECT * FROM stl WHERE reason IS NOT NULL"),
    "batch_metrics": (ZH + RUNS + DRIFT + METRICS, "SELECT * FROM bm"),
    "health_rules": (ZH + RUNS + DRIFT + GRID + RULES, "SELECT rule, severity, max(state = 'firing') AS firing, round(max(value), 6) AS value FROM sx WHERE n = 528 GROUP BY 1, 2"),
    "stream_backlog": (GRID + """, pc AS (SELECT label, n, coalesce(c, 0) AS c FROM (SELECT DISTINCT label FROM src) CROSS JOIN gr LEFT JOIN (SELECT label, n, count(*) AS c FROM src GROUP BY ALL) USING (label, n)
), pa AS (SELECT *, sum(c) OVER o - (n + 1) AS over FROM pc WINDOW o AS (PARTITION BY label ORDER BY n ROWS UNBOUNDED PRECEDING)
), pb AS (SELECT *, over - least(min(over) OVER (PARTITION BY label ORDER BY n ROWS UNBOUNDED PRECEDING), 0) AS behind FROM pa)""", "SELECT label AS partition, TIMESTAMP '2024-01-01' + to_minutes(15 * n) AS at, c AS came, (c + lag(behind, 1, 0) OVER (PARTITION BY label ORDER BY n) - behind)::BIGINT AS read, behind::BIGINT AS behind FROM pb"),
    "source_coordinates": ("", "SELECT kafka_offset, coalesce(vehicle_id[2:]::INT % 6, 0) AS kafka_partition, vehicle_id AS kafka_key, arrival_time AS kafka_timestamp, true AS ingested FROM raw"),
    "rule_transitions": (ZH + RUNS + DRIFT + GRID + RULES, "SELECT rule, severity, label, moment AS at, CASE WHEN state <> 'inactive' THEN state WHEN before = 'firing' THEN 'resolved' ELSE 'dropped' END AS change, round(value, 6) AS value FROM sy WHERE state <> before"),
    "rule_values": (ZH + RUNS + DRIFT + GRID + RULES, "SELECT rule, count(*) AS evaluations, count_if(state <> 'inactive')::BIGINT AS holding, count_if(state = 'firing')::BIGINT AS firing, round(max(value), 6) AS largest FROM sx GROUP BY 1"),
    "stream_source": ("", "SELECT event_id, vehicle_id, status, kafka_offset FROM raw"),
    "stream_intake": ("", "SELECT 'archive' AS sink, coalesce(strftime(event_time, '%Y-%m-%d'), 'unknown') AS part, count(*) AS rows FROM raw GROUP BY 2 UNION ALL SELECT s.sink, reason, count(*) FROM j, (VALUES ('dlq'), ('dlq_reasons')) s(sink) WHERE reason IS NOT NULL GROUP BY 1, 2"),
    "stream_dedup": ("", "SELECT event_id, event_time FROM cl"),
    "stream_zone_hourly": (ZH, "SELECT * REPLACE (sim_day::VARCHAR AS sim_day) FROM zh"),
    "stream_vehicle_daily": (ZH, "SELECT * REPLACE (sim_day::VARCHAR AS sim_day) FROM dr"),
    "stream_dlq": ("", "SELECT vehicle_id AS key, reason, event_id FROM j WHERE reason IS NOT NULL"),
    "stream_vehicle_state": (ZH, STATES),
    "stream_typed_state": (ZH, STATES),
    "stream_restarted_state": (ZH, f"SELECT * FROM ({STATES}) WHERE event_time >= TIMESTAMP '2024-01-04'"),
    "stream_stored_state": (ZH, f"SELECT * FROM ({STATES}) WHERE status <> 'offline'"),
    "archive_partition_counts": ("", "SELECT coalesce(strftime(event_time, '%Y-%m-%d'), 'unknown') AS sim_date, count(*) AS rows FROM raw GROUP BY 1"),
    "archive_day": ("", "SELECT event_id, vehicle_id, kafka_offset, event_time FROM raw WHERE event_time::DATE = DATE '2024-01-02'"),
    "parse_events": ("", "SELECT event_id, event_type, trip_id, driver_id, vehicle_id, status, speed, fare, kafka_offset FROM raw"),
    "parse_event_time": ("", "SELECT kafka_offset, event_time FROM raw"),
    "closed_days": ("", "SELECT DISTINCT strftime(event_time, '%Y-%m-%d') AS sim_date FROM raw WHERE event_time IS NOT NULL AND event_time::DATE + INTERVAL 1470 MINUTE <= TIMESTAMP '2024-01-04 00:30:00'"),
    "validate_events": ("", "SELECT kafka_offset, reason FROM j"),
    "valid_events": ("", "SELECT event_id, event_type, trip_id, driver_id, vehicle_id, status, speed, fare, kafka_offset FROM ok"),
    "invalid_events": ("", "SELECT kafka_offset, vehicle_id, reason FROM j WHERE reason IS NOT NULL"),
    "dlq_by_reason": ("", "SELECT reason, count(*) AS rows FROM j WHERE reason IS NOT NULL GROUP BY 1"),
    "dlq_payload": ("", "SELECT vehicle_id AS key, reason, kafka_offset, reason AS payload_reason, event_id AS payload_event_id, '2024-01-06T12:00:00.000' AS rejected_at, vehicle_id AS original_vehicle FROM j WHERE reason IS NOT NULL"),
    "dlq_rate": ("", "SELECT date_trunc('hour', arrival_time)::TIMESTAMP AS window_start, count(*) AS events, count_if(reason IS NOT NULL)::BIGINT AS rejected, round(count_if(reason IS NOT NULL) / count(*)::DOUBLE, 6) AS rate FROM j GROUP BY 1"),
    "dedup_events": ("", "SELECT event_id, kafka_offset FROM cl"),
    "dedup_effect": ("", "SELECT (SELECT count(*) FROM ok) AS naive_rows, (SELECT round(sum(CASE WHEN event_type = 'trip_end' THEN fare END), 2) FROM ok) AS naive_revenue, (SELECT count(*) FROM cl) AS dedup_rows, (SELECT round(sum(CASE WHEN event_type = 'trip_end' THEN fare END), 2) FROM cl) AS dedup_revenue"),
    "zone_assign": ("", "SELECT kafka_offset, zone_id, in_city FROM z"),
    "zone_dim": ("", "SELECT zone_id, lat, lon, coalesce(events, 0) AS events FROM (SELECT 'Z' || lpad((i + 1)::VARCHAR, 2, '0') AS zone_id, round(13.06e0 - (i // 4 + 0.5e0) * 0.04e0, 4) AS lat, round(77.52e0 + (i % 4 + 0.5e0) * 0.04e0, 4) AS lon FROM range(16) t(i)) LEFT JOIN (SELECT zone_id, count(*) AS events FROM cl GROUP BY 1) USING (zone_id)"),
    "haversine_pairs": (SEQ, "SELECT event_id, round(hop_km, 6) AS km FROM q WHERE ptime IS NOT NULL"),
    "fare_quote": ("", "SELECT event_id, round(30e0 + 12e0 * greatest(speed / 4, 0e0) + 1.5e0 * greatest(speed - 20, 0e0), 2) AS quote FROM cl"),
    "gps_hops": (SEQ, "SELECT sim_date, vehicle_id, event_id, round(hop_km, 6) AS hop_km, round(hop_kmh, 3) AS hop_kmh, hop_kmh <= 150 AS kept FROM q WHERE ptime IS NOT NULL"),
    "status_durations": (SEQ, "SELECT sim_date, vehicle_id, event_id, status, round(gap_min, 4) AS minutes FROM q WHERE gap_min <= 20"),
    "vehicle_day": (SEQ, "SELECT * FROM vd"),
    "vehicle_day_totals": (SEQ, "SELECT sim_date, vehicle_id, trips, revenue, first_seen, last_seen, events FROM vd"),
    "vehicle_day_distance": (SEQ, "SELECT sim_date, vehicle_id, gps_km, hops FROM vd"),
    "vehicle_day_time": (SEQ, "SELECT sim_date, vehicle_id, online_min, on_trip_min, idle_min FROM vd"),
    "zone_hourly": (ZH, "SELECT * REPLACE (sim_day::VARCHAR AS sim_day) FROM zh"),
    "vehicle_daily_running": (ZH, "SELECT * REPLACE (sim_day::VARCHAR AS sim_day) FROM dr"),
    "vehicle_state_latest": (ZH, "SELECT vehicle_id, driver_id, status, zone_id, trip_id, speed, event_time FROM st"),
    "idle_islands": (ZH, "SELECT * FROM isl"),
    "idle_spells_by_day": (ZH, "SELECT * FROM isl"),
    "idle_alerts": (ZH, "SELECT vehicle_id, opened_at, closed_at, idle_min, status FROM isl WHERE alert ORDER BY opened_at DESC, vehicle_id LIMIT 200"),
    "open_idle_alerts": (ZH, "SELECT vehicle_id, opened_at, closed_at, idle_min, status FROM isl WHERE alert AND status = 'open' ORDER BY opened_at DESC, vehicle_id LIMIT 200"),
    "open_alert_count": (ZH, "SELECT count(*) AS open_alerts FROM isl WHERE alert AND status = 'open'"),
    "late_rows_bounded": (BOUNDED, "SELECT * EXCLUDE (late) FROM lt WHERE late"),
    "stream_bounded": (BOUNDED, "SELECT * EXCLUDE (late) FROM lt WHERE NOT late"),
    "stream_behind": (BOUNDED, """SELECT batch AS batch_id, log_partition::INT AS partition, least(rows, (batch + 1) * 400) AS reached, rows - least(rows, (batch + 1) * 400) AS behind
  FROM lb, (SELECT log_partition, count(*) AS rows FROM lg GROUP BY 1)"""),
    "late_rows": (LATE, "SELECT * FROM late"),
    "fleet_live": (ZH, "SELECT (SELECT now FROM nw) AS as_of, count(*) AS active, count_if(status = 'idle')::BIGINT AS idle, count_if(status = 'on_trip')::BIGINT AS on_trip, count_if(status = 'enroute')::BIGINT AS enroute, round(coalesce(count_if(status = 'idle') / nullif(count(*), 0)::DOUBLE, 0e0), 4) AS idle_ratio, count_if(vehicle_id IN (SELECT vehicle_id FROM isl WHERE alert AND status = 'open'))::BIGINT AS open_alerts FROM st, nw WHERE event_time >= now - INTERVAL 5 MINUTE"),
    "zone_live": (ZH, "SELECT zone_id, as_of, active, idle, on_trip, round(idle / active::DOUBLE, 4) AS idle_ratio, coalesce(trips_started, 0) AS trips_started, coalesce(trips_completed, 0) AS trips_completed, coalesce(earnings, 0e0) AS earnings FROM (SELECT zone_id, max(now) AS as_of, count(*) AS active, count_if(status = 'idle')::BIGINT AS idle, count_if(status = 'on_trip')::BIGINT AS on_trip FROM st, nw WHERE event_time >= now - INTERVAL 5 MINUTE GROUP BY 1) LEFT JOIN (SELECT zone_id, trips_started, trips_completed, earnings FROM zh, nw WHERE window_start = date_trunc('hour', now)) USING (zone_id)"),
    "vehicle_map": (ZH, "SELECT vehicle_id, status, round(lat, 6) AS lat, round(lon, 6) AS lon, zone_id FROM st, nw WHERE event_time >= now - INTERVAL 10 MINUTE"),
    "trips_in_hour": (ZH, "SELECT coalesce(sum(trips_completed), 0)::BIGINT AS trips, round(coalesce(sum(earnings), 0e0), 2) AS earnings FROM zh, nw WHERE window_start = date_trunc('hour', now) - INTERVAL 1 HOUR"),
    "earnings_this_hour": (ZH, "SELECT coalesce(sum(trips_completed), 0)::BIGINT AS trips, round(coalesce(sum(earnings), 0e0), 2) AS earnings FROM zh, nw WHERE window_start = date_trunc('hour', now)"),
    "zone_earnings_hour": (ZH, "SELECT zone_id, earnings, trips_completed AS trips FROM zh, nw WHERE window_start = date_trunc('hour', now) ORDER BY earnings DESC, zone_id"),
    "zone_profile": (ZH, "SELECT zone_id, sim_day::VARCHAR AS sim_day, sim_hour, trips_started, trips_completed, earnings, round(on_trip_pings / pings::DOUBLE, 4) AS on_trip_share FROM zh JOIN (SELECT zone_id, max(sim_day) AS sim_day FROM zh GROUP BY 1) USING (zone_id, sim_day)"),
    "zone_hour_matrix": (ZH, "SELECT zone_id, sim_hour, round(sum(earnings), 2) AS earnings FROM zh GROUP BY 1, 2"),
    "expense_verdict": (COST, "SELECT sim_date, line_no, vehicle_id, reason FROM exj"),
    "expense_duplicates": (COST, "SELECT sim_date, line_no, vehicle_id FROM exj WHERE reason = 'duplicate'"),
    "expense_unknown_vehicle": (COST, "SELECT sim_date, line_no, vehicle_id FROM exj WHERE reason = 'unknown_vehicle'"),
    "expense_clean": (COST, "SELECT *, 1 AS version FROM ex"),
    "expense_gate": (COST, "SELECT sim_date, 1 AS version, count(*) AS total, count(reason) AS invalid, round(count(reason) / count(*)::DOUBLE, 6) AS invalid_ratio, count(reason) / count(*)::DOUBLE <= 0.2e0 AS accepted FROM exj GROUP BY 1 UNION ALL SELECT '2024-01-09', 1, 0, 0, NULL, false"),
    "dq_issues": (COST, """SELECT 'reconcile-' || sim_date AS run_id, sim_date, 'expenses' AS source, vehicle_id, reason, '{"date":"' || sim_date || '","vehicle_id":"' || vehicle_id || '","fuel_cost":"' || fuel_cost || '","maintenance_cost":"' || maintenance_cost || '","distance_covered":"' || distance_covered || '","service_flag":"' || service_flag::VARCHAR || '"}' AS payload FROM exj WHERE reason IS NOT NULL"""),
    "upsert_latest": (ZH, "SELECT * REPLACE (sim_day::VARCHAR AS sim_day) FROM zh"),
    "replace_date": (SEQ, "SELECT sim_date, vehicle_id, trips, revenue, events FROM vd WHERE sim_date IN ('2024-01-01', '2024-01-04', '2024-01-05') OR (sim_date = '2024-01-02' AND trips > 2)"),
    "dq_by_reason": (COST, "SELECT sim_date, reason, count(*) AS rows FROM exj WHERE reason IS NOT NULL GROUP BY 1, 2"),
    "dq_run_totals": (COST, "SELECT sim_date, count_if(reason IS NULL)::BIGINT AS clean, count(reason) AS quarantined FROM exj GROUP BY 1"),
    "reconcile_join": (REC, "SELECT sim_date, vehicle_id, missing_costs, missing_telemetry FROM rec"),
    "vehicle_profit": (REC, f"SELECT {COLS} FROM rec"),
    "vehicle_flags": (REC, f"SELECT sim_date, vehicle_id, {', '.join(FLAGS)} FROM rec"),
    "batch_vehicle_daily": (REC + RUNS.removeprefix(COST), f"SELECT {COLS}, online_min, on_trip_min, idle_min, utilization, fuel_cost, maintenance_cost, distance_covered, {', '.join(FLAGS)}, CASE WHEN run_id IS NOT NULL THEN 1 END AS expense_file_version, run_id FROM rec LEFT JOIN (SELECT run_id, sim_date FROM rn) USING (sim_date)"),
    "profit_trend": (REC, "SELECT sim_date, vehicle_id, net_profit, becoming_unprofitable FROM rec"),
    "profit_table": (REC, f"SELECT sim_date, vehicle_id, net_profit, {LABEL} AS label FROM rec"),
    "vehicle_reasons": (REC, f"SELECT sim_date, vehicle_id, {REASONS} AS reasons FROM rec"),
    "fleet_summary": (REC, "SELECT sim_date, count(*) AS vehicles, sum(trips)::BIGINT AS trips, round(sum(revenue), 2) AS revenue, round(sum(total_cost), 2) AS total_cost, round(sum(revenue) - sum(total_cost), 2) AS net_profit, round(CASE WHEN sum(revenue) <> 0 THEN (sum(revenue) - sum(total_cost)) / sum(revenue) ELSE 0e0 END, 4) AS margin, round(sum(gps_km), 2) AS gps_km, round(CASE WHEN sum(online_min) > 0 THEN least(1e0, sum(on_trip_min) / sum(online_min)) ELSE 0e0 END, 4) AS utilization FROM rec GROUP BY 1"),
    "flag_counts": (REC, f"SELECT sim_date, {', '.join(f'count_if({f})::BIGINT AS {f}' for f in FLAGS)} FROM rec GROUP BY 1"),
    "best_worst": (REC, "SELECT sim_date, vehicle_id, net_profit, row_number() OVER (PARTITION BY sim_date ORDER BY net_profit DESC, vehicle_id)::INT AS best, row_number() OVER (PARTITION BY sim_date ORDER BY net_profit, vehicle_id)::INT AS worst FROM rec QUALIFY best <= 5 OR worst <= 5"),
    "needs_attention": (REC, f"SELECT sim_date, vehicle_id, net_profit, {LABEL} AS label, {REASONS} AS reasons FROM rec WHERE {ANY} ORDER BY sim_date, net_profit, vehicle_id"),
    "report_flagged": (REC + RUNS.removeprefix(COST), f"SELECT sim_date, vehicle_id, format('{{:,.2f}}', net_profit) AS net_text, {PERCENT.format('margin')} AS margin_text, CASE WHEN sim_date IN (SELECT sim_date FROM rn) THEN '1.00' ELSE '-' END AS version_text, {LABEL} AS label, {REASONS} AS reasons FROM rec WHERE {ANY}"),
    "distance_mismatches": (REC, "SELECT sim_date, vehicle_id, gps_km, distance_covered, mismatch_pct FROM rec WHERE distance_mismatch ORDER BY sim_date, mismatch_pct DESC, vehicle_id"),
    "vehicle_history": (REC, "SELECT vehicle_id, sim_date, revenue, net_profit, row_number() OVER (PARTITION BY vehicle_id ORDER BY sim_date DESC)::INT AS nth FROM rec QUALIFY nth <= 3"),
    "reconciled_dates": (REC, "SELECT DISTINCT sim_date FROM rec ORDER BY sim_date DESC LIMIT 30"),
    "latest_markers": (ZH + REC + RUNS.removeprefix(COST) + DRIFT, "SELECT max(sim_date) AS latest_date, (SELECT now FROM nw) AS now, (SELECT max(sim_date) FROM dft) AS drift_date, (SELECT max_by(drift_abs, sim_date) FROM dft) AS drift_abs, (SELECT max_by(drift_ratio, sim_date) FROM dft) AS drift_ratio, (SELECT max_by(run_id, started_at) FROM rn) AS last_run, (SELECT max_by(status, started_at) FROM rn) AS last_status, (SELECT max_by(run_id, finished_at) FROM rn WHERE status = 'success') AS last_success FROM rec"),
    "vehicle_merge": (ZH + REC, f"SELECT vehicle_id, live_source, live_as_of, live_status, live_zone, today_source, today_date, today_trips, today_revenue, history_as_of, history FROM (SELECT vehicle_id, 'speed' AS live_source, status AS live_status, event_time AS live_as_of, zone_id AS live_zone FROM st) FULL JOIN (SELECT vehicle_id, 'speed' AS today_source, strftime(sim_day, '%Y-%m-%d') AS today_date, trips AS today_trips, revenue AS today_revenue FROM dr, nw WHERE sim_day = now::DATE) USING (vehicle_id) FULL JOIN (SELECT vehicle_id, max(sim_date)::TIMESTAMP + INTERVAL 1 DAY AS history_as_of, string_agg(sim_date || '|batch|' || printf('%.2f', net_profit) || '|' || trips || '|' || ({' + '.join(f'{f}::INT' for f in FLAGS)}), ',' ORDER BY sim_date DESC) AS history FROM (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY sim_date DESC) <= 7) GROUP BY 1) USING (vehicle_id)"),
    "known_vehicles": (REC, "SELECT vehicle_id FROM cl UNION SELECT vehicle_id FROM rec"),
    "speed_batch_drift": (LATE, "SELECT sim_date, coalesce(speed_revenue, 0e0) AS speed_revenue, coalesce(speed_trips, 0) AS speed_trips, batch_revenue, batch_trips, round(batch_revenue - coalesce(speed_revenue, 0e0), 2) AS drift_abs, round(CASE WHEN batch_revenue <> 0 THEN round(batch_revenue - coalesce(speed_revenue, 0e0), 2) / batch_revenue ELSE 0e0 END, 6) AS drift_ratio FROM (SELECT sim_date, round(sum(CASE WHEN event_type = 'trip_end' THEN fare ELSE 0e0 END), 2) AS batch_revenue, count_if(event_type = 'trip_end')::BIGINT AS batch_trips FROM cl GROUP BY 1) LEFT JOIN (SELECT sim_date, round(sum(CASE WHEN event_type = 'trip_end' THEN fare ELSE 0e0 END), 2) AS speed_revenue, count_if(event_type = 'trip_end')::BIGINT AS speed_trips FROM cl WHERE kafka_offset NOT IN (SELECT kafka_offset FROM late) GROUP BY 1) USING (sim_date)"),
    "restatement_diff": (REC + COST2 + _rec("rez", "ey"), "SELECT coalesce(a.sim_date, b.sim_date) AS sim_date, coalesce(a.vehicle_id, b.vehicle_id) AS vehicle_id, a.net_profit AS old_net_profit, a.total_cost AS old_total_cost, b.net_profit AS new_net_profit, b.total_cost AS new_total_cost FROM rec a FULL JOIN rez b ON a.sim_date = b.sim_date AND a.vehicle_id = b.vehicle_id WHERE a.net_profit IS DISTINCT FROM b.net_profit OR a.total_cost IS DISTINCT FROM b.total_cost"),
    "processed_versions": (RUNS + AVAILABLE, "SELECT * FROM pr"),
    "pending_dates": (RUNS + AVAILABLE, "SELECT sim_date, version FROM av LEFT JOIN pr USING (sim_date) WHERE version > coalesce(processed_version, 0) AND sim_date::TIMESTAMP + INTERVAL 1470 MINUTE <= TIMESTAMP '2024-01-06 12:00:00'"),
    "overdue_dates": (RUNS + AVAILABLE, "SELECT strftime(d, '%Y-%m-%d') AS sim_date FROM (SELECT DATE '2024-01-01' + i::INT AS d FROM range(6) t(i)) WHERE d::TIMESTAMP + INTERVAL 1560 MINUTE <= TIMESTAMP '2024-01-06 12:00:00' AND strftime(d, '%Y-%m-%d') NOT IN (SELECT sim_date FROM av) AND strftime(d, '%Y-%m-%d') NOT IN (SELECT sim_date FROM pr)"),
}



def _shown(section: str, source: str, place: str, value: str, vehicle: str = "NULL", label: str = "NULL", note: str = "NULL") -> str:
    return f"SELECT sim_date, '{section}' AS section, ({place})::INT AS place, ({vehicle})::VARCHAR AS vehicle_id, ({label})::VARCHAR AS label, ({value})::DOUBLE AS value, ({note})::VARCHAR AS note FROM {source} WHERE sim_date IN (SELECT sim_date FROM rec)"


def _figures(section: str, source: str, names: list[str], note: str = "NULL") -> list[str]:
    return [_shown(section, source, str(i), c, label=f"'{c}'", note=note) for i, c in enumerate(names, 1)]


_WORST = "row_number() OVER (PARTITION BY sim_date ORDER BY net_profit, vehicle_id)"
_BUNDLE = [
    *_figures("summary", "fs", ["vehicles", "trips", "revenue", "total_cost", "net_profit", "margin", "gps_km", "utilization"]),
    *_figures("run", "(SELECT *, 1 AS version FROM rn)", ["version", "late::INT", "quarantined"], "run_id"), *_figures("drift", "sbd", ["speed_revenue", "batch_revenue", "drift_ratio"]),
    _shown("quarantine", "(SELECT sim_date, reason, count(*) AS c FROM exj WHERE reason IS NOT NULL GROUP BY 1, 2)", "row_number() OVER (PARTITION BY sim_date ORDER BY c DESC, reason)", "c", label="reason"),
    _shown("flagged", f"(SELECT *, {LABEL} AS said, {REASONS} AS why FROM rec WHERE {ANY})", _WORST, "net_profit", "vehicle_id", "said", "why"),
    _shown("best", "rec", "row_number() OVER (PARTITION BY sim_date ORDER BY net_profit DESC, vehicle_id)", "net_profit", "vehicle_id") + " QUALIFY place <= 5",
    _shown("worst", "rec", _WORST, "net_profit", "vehicle_id") + " QUALIFY place <= 5",
    _shown("mismatch", "(SELECT * FROM rec WHERE distance_mismatch)", "row_number() OVER (PARTITION BY sim_date ORDER BY mismatch_pct DESC, vehicle_id)", "mismatch_pct", "vehicle_id"),
]
PARTS["report_bundle"] = (
    f"{REC}{RUNS.removeprefix(COST)}{LATE}, fs AS ({PARTS['fleet_summary'][1]}), sbd AS ({PARTS['speed_batch_drift'][1]})",
    " UNION ALL ".join(_BUNDLE).replace("'late::INT'", "'late'"),
)

ORACLES: dict[str, str] = {name: f"WITH {EV}{more} {select}" for name, (more, select) in PARTS.items()}
