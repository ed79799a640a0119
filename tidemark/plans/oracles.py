"""The catalogue's queries as DuckDB SQL, by other means where there are any: minutes are unfolded and counted, not summed up."""

from __future__ import annotations

from tidemark.plans.catalogue import CUT, END, FILTERS, GRAINS, HIGH, LOW, MID, MONTH, START
from tidemark.operators.serving import AVERAGES, SHAPES
from tidemark.sources import scenarios

TOL = 1800
DIMS = "platform, country, video_type, content_id, app_version, audio_language, subtitle_language, player_version, video_resolution"
EDIMS = DIMS.replace("video_type, ", "")
IDIMS = "content_id, platform, country, video_type, app_version"


def at(seconds: str) -> str:
    return f"make_timestamp(({seconds})::BIGINT * 1000000)"


def at_ms(ms: str) -> str:
    return f"make_timestamp(({ms})::BIGINT * 1000)"


def rnd(x: str, k: int) -> str:
    return f"round(CAST({x} AS DECIMAL(30,9)), {k})::DOUBLE"


def q_exact(x: str, p: float) -> str:
    return f"list_sort(list({x}))[(least(floor({p} * count(*)), count(*) - 1) + 1)::INT]::BIGINT"


def pick(values: str, index: str) -> str:
    return f"[{values}][({index}) % len([{values}]) + 1]"


PAUSE, RESUME = "('pause','speed-pause','AdPause')", "('resume','speed-resume','AdResume')"

BASE = f"""
e0 AS (SELECT event_id AS e, user_id AS u, epoch_us(ts) // 1000 AS ts, strftime(ts + INTERVAL 12 HOUR, '%Y%m%d') AS day,
  CASE WHEN event_id % 10 = 3 THEN 'AppBackgrounded' WHEN event_id % 10 = 7 THEN 'AppForegrounded' WHEN event_id % 23 = 5 THEN 'VideoSessionEnd'
    WHEN event_type = 'signup' THEN 'VideoSessionStart' WHEN event_type = 'view' THEN 'VideoPlay' WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'VideoError' ELSE 'VideoHeartbeat' END AS event_type FROM events),
ev AS (SELECT 'u' || u || '-' || day AS sid, 'u' || (CASE WHEN e % 41 = 0 THEN u + 1 ELSE u END) AS user_id, event_type,
  CASE WHEN event_type = 'VideoHeartbeat' THEN {pick("'pause','resume','AdPause','AdResume','speed-pause','speed-resume','','buffer','progress','progress','seek','progress'", "e")} ELSE '' END AS event,
  ts, CASE WHEN e % 20 = 3 THEN 0 ELSE ts // 1000 + CASE e % 20 WHEN 0 THEN -3600 WHEN 1 THEN 600 WHEN 2 THEN 7200 ELSE 10 END END AS arrival, (ts + 43200000) // 86400000 * 86400000 - 43200000 AS session_start,
  1 + (u * 7 + CASE WHEN e % 31 = 0 THEN 1 ELSE 0 END) % 40 AS content_id, {pick("'Android','iOS','Web','SmartTV'", "u + CASE WHEN e % 17 = 0 THEN 1 ELSE 0 END")} AS platform, {pick("'IN','US','GB','AE','SG'", "u")} AS country,
  {pick("'1.0','1.1','2.0'", "u")} AS app_version, {pick("'hi','en',''", "u + e % 2")} AS audio_language, {pick("'en',''", "u")} AS subtitle_language, {pick("'p1','p2'", "u + 1")} AS player_version, {pick("'1080p','720p','4K'", "u + 2")} AS video_resolution FROM e0),
ct AS (SELECT p_partkey AS content_id, p_name AS title, {pick("'vod','live','vod',''", "p_partkey")} AS video_type, p_type AS category, p_brand AS show_name FROM part WHERE p_partkey <= 40 AND p_partkey % 9 <> 0),
cl AS (SELECT sid, ts, min(CASE WHEN event_type IN ('AppBackgrounded','VideoSessionEnd','VideoError') OR event IN {PAUSE} THEN 0 WHEN event_type IN ('VideoSessionStart','VideoPlay','AppForegrounded') OR event IN {RESUME} THEN 1 END) AS c,
  min(CASE WHEN event_type IN ('AppBackgrounded','VideoSessionEnd','VideoError') THEN 0 WHEN event_type IN ('VideoSessionStart','VideoPlay','AppForegrounded') OR event IN {RESUME} THEN 1 END) AS cl FROM ev GROUP BY sid, ts),
st AS (SELECT sid, ts, coalesce(last_value(c IGNORE NULLS) OVER w, 1) AS is_open, coalesce(last_value(cl IGNORE NULLS) OVER w, 1) AS is_open_pause_active, lead(ts) OVER (PARTITION BY sid ORDER BY ts) AS nx
  FROM cl WINDOW w AS (PARTITION BY sid ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
fd AS (SELECT * FROM (SELECT sid, user_id, {EDIMS}, row_number() OVER (PARTITION BY sid ORDER BY ts, user_id, {EDIMS}) AS k, max(ts) FILTER (WHERE event_type = 'VideoSessionEnd') OVER (PARTITION BY sid) AS last_end FROM ev) WHERE k = 1),
sd AS (SELECT sid, user_id, platform, country, coalesce(video_type, '') AS video_type, fd.content_id, app_version, audio_language, subtitle_language, player_version, video_resolution, last_end FROM fd LEFT JOIN ct ON fd.content_id = ct.content_id),
iv AS (SELECT sid, user_id, {DIMS}, ts // 1000 AS s, least(coalesce(nx, ts + {TOL}000), ts + {TOL}000, coalesce(last_end, 9000000000000)) // 1000 AS e FROM st JOIN sd USING (sid) WHERE is_open = 1 AND (last_end IS NULL OR ts < last_end)),
ivl AS (SELECT sid, ts // 1000 AS s, least(coalesce(nx, ts + {TOL}000), ts + {TOL}000, coalesce(last_end, 9000000000000)) // 1000 AS e FROM st JOIN sd USING (sid) WHERE is_open_pause_active = 1 AND (last_end IS NULL OR ts < last_end)),
mi AS (SELECT DISTINCT sid, user_id, {DIMS}, unnest(range(s // 60, (s + greatest(e - s - 1, 0)) // 60 + 1)) AS m FROM iv),
sr AS (SELECT sid, user_id, {DIMS}, min(m) AS run_start, max(m) AS run_end FROM (SELECT *, m - row_number() OVER (PARTITION BY sid ORDER BY m) AS g FROM mi) GROUP BY sid, user_id, {DIMS}, g),
ud AS (SELECT * FROM (SELECT user_id, {DIMS}, row_number() OVER (PARTITION BY user_id ORDER BY run_start, sid) AS k FROM sr) WHERE k = 1),
um AS (SELECT user_id, {DIMS}, m FROM (SELECT DISTINCT user_id, m FROM mi) JOIN ud USING (user_id)),
ur AS (SELECT user_id, {DIMS}, min(m) AS run_start, max(m) AS run_end FROM (SELECT *, m - row_number() OVER (PARTITION BY user_id ORDER BY m) AS g FROM um) GROUP BY user_id, {DIMS}, g),
nv AS (SELECT sid, user_id, {DIMS}, a // 60000 AS run_start, coalesce(last_end, b) // 60000 AS run_end FROM (SELECT sid, min(ts) AS a, max(ts) AS b FROM ev GROUP BY sid) JOIN sd USING (sid))
"""



def sql(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([BASE.strip(), *more]) + "\n" + body


def where(filters: dict) -> str:
    return " AND ".join([f"{k} = {v!r}" for k, v in filters.items()]) or "true"


def series(start: int, end: int, filters: dict, of: str = "mi", what: str = "sid") -> str:
    """t (minute), v: everybody in it, counted."""
    return (
        f"se AS (SELECT t, coalesce(v, 0)::BIGINT AS v FROM (SELECT unnest(range({start // 60}, {end // 60})) AS t) LEFT JOIN "
        f"(SELECT m AS t, count(DISTINCT {what}) AS v FROM {of} WHERE {where(filters)} GROUP BY m) USING (t))"
    )


def curve(start: int, end: int, filters: dict, of: str = "mi", what: str = "sid") -> str:
    return sql(f"""SELECT {at('t * 60')} AS minute, v AS concurrency, (SELECT max(v) FROM se) AS peak_concurrency, (SELECT {at('min(t) * 60')} FROM se WHERE v = (SELECT max(v) FROM se)) AS peak_minute,
(SELECT {rnd('avg(v)', 2)} FROM se) AS avg_all_minutes, (SELECT coalesce({rnd('avg(v) FILTER (WHERE v > 0)', 2)}, 0) FROM se) AS avg_active_minutes, (SELECT {q_exact('v', 0.95)} FROM se) AS p95_concurrency,
(SELECT count(*) FROM se WHERE v > 0) AS minutes_with_audience, (SELECT count(*) FROM se) AS minutes_in_range FROM se""", series(start, end, filters, of, what))


def grain(g: int, offset: int, filters: dict | None = None, more: str = "", keep: str = ", count(*) AS minutes_in_bucket") -> str:
    return f"""SELECT {at('b')} AS bucket, max(v) AS peak_concurrency, {at('arg_max(t, [v, -t]) * 60')} AS peak_minute, {rnd('avg(v)', 2)} AS avg_all_minutes,
coalesce({rnd('avg(v) FILTER (WHERE v > 0)', 2)}, 0) AS avg_active_minutes, count(*) FILTER (WHERE v > 0) AS minutes_with_audience{keep} FROM (SELECT *, (t * 60 + {offset}) // {g} * {g} - {offset} AS b FROM se) GROUP BY b"""


ORACLES = {name: curve(START, END, f) for name, f in FILTERS.items()}
ORACLES["curve_mid_window"] = curve(*MID, {})
ORACLES["user_curve"] = curve(START, END, {}, "um", "user_id")
ORACLES |= {name: sql(grain(g, o), series(START, END, {})) for name, (g, o) in GRAINS.items()}

ORACLES["event_state"] = sql(f"SELECT sid, {at_ms('ts')} AS ts, is_open, is_open_pause_active FROM st")
ORACLES["foreground_intervals"] = sql(f"SELECT sid, user_id, {DIMS}, {at('s')} AS start, {at('e')} AS \"end\" FROM iv")
ORACLES["foreground_intervals_loose"] = sql(f"SELECT sid, {at('s')} AS start, {at('e')} AS \"end\" FROM ivl")
_RUNS = f"{{}}, {DIMS}, {at('run_start * 60')} AS run_start, {at('run_end * 60')} AS run_end, 1 AS sign"
SR, UR = sql(f"SELECT sid, {_RUNS.format('user_id')} FROM sr"), sql(f"SELECT {_RUNS.format('user_id')} FROM ur")
ORACLES |= {"session_runs": SR, "user_runs": UR, "two_tick_equals_batch": SR, "double_assert_heals": SR, "stream_replay": SR, "late_tail_absorbed": SR, "user_tick_equals_batch": UR, "user_stream_replay": UR}


ORACLES["future_clock"] = sql("SELECT count(*) AS taken, max(ts) AS latest, count(*) FILTER (WHERE event_type = 'VideoPlay') AS set_aside FROM ev")


def _deltas(runs: str) -> str:
    return sql(f"SELECT {DIMS}, {at('minute * 60')} AS minute, sum(d)::BIGINT AS delta FROM (SELECT {DIMS}, run_start AS minute, 1 AS d FROM {runs} UNION ALL SELECT {DIMS}, run_end + 1, -1 FROM {runs}) GROUP BY ALL HAVING sum(d) <> 0")


ORACLES["session_deltas"], ORACLES["user_deltas"] = _deltas("sr"), _deltas("ur")
ORACLES["boundary_deltas"] = sql(f"SELECT {DIMS}, {at('t')} AS second, sum(d)::BIGINT AS delta FROM (SELECT {DIMS}, s AS t, 1 AS d FROM iv WHERE e > s UNION ALL SELECT {DIMS}, e, -1 FROM iv WHERE e > s) GROUP BY ALL HAVING sum(d) <> 0")


def exact(start: int, end: int, filters: dict) -> str:
    """Overlaps counted at every instant at which one starts or ends."""
    return sql(f"""SELECT max(v) AS peak_concurrency, {at('min(t) FILTER (WHERE v = p)')} AS peak_at, {rnd(f'sum(v * (n - t)) / {end - start}.0', 2)} AS avg_time_weighted,
coalesce({rnd('sum(v * (n - t)) / nullif(sum(n - t) FILTER (WHERE v > 0), 0)', 2)}, 0) AS avg_while_active, coalesce(sum(n - t) FILTER (WHERE v > 0), 0)::BIGINT AS seconds_with_audience, count(*) AS boundaries_in_window
FROM (SELECT *, coalesce(lead(t) OVER (ORDER BY t), {end}) AS n, max(v) OVER () AS p FROM ins)""",
        f"live AS (SELECT * FROM iv WHERE e > s AND {where(filters)})",
        f"ch AS (SELECT t FROM (SELECT {DIMS}, s AS t, 1 AS d FROM live UNION ALL SELECT {DIMS}, e, -1 FROM live) GROUP BY {DIMS}, t HAVING sum(d) <> 0)",
        f"pts AS (SELECT DISTINCT t FROM (SELECT {start}::BIGINT AS t UNION ALL SELECT t FROM ch) WHERE t >= {start} AND t < {end})",
        "ins AS (SELECT t, (SELECT count(*) FROM live WHERE s <= t AND e > t) AS v FROM pts)")


ORACLES["peak_avg_exact"], ORACLES["time_weighted_avg"] = exact(START, END, {}), exact(*MID, {"platform": "iOS"})
_A = {n: f"'{n}' AS definition, '{r}' AS role, '{w}' AS what_it_counts" for n, r, w in AVERAGES}
ORACLES["average_definitions"] = sql(f"""SELECT {_A['all_minutes']}, {rnd('avg(v)', 2)} AS avg_concurrency, count(*) AS denominator_minutes FROM se
UNION ALL SELECT {_A['active_minutes']}, coalesce({rnd('avg(v)', 2)}, 0), count(*) FROM se WHERE v > 0
UNION ALL SELECT {_A['first_event_to_range_end']}, {rnd('avg(v)', 2)}, count(*) FROM se WHERE t >= coalesce((SELECT min(t) FROM se WHERE v > 0), 0)""", series(START, END, {}))
ORACLES["reach"] = sql(f"SELECT 'sessions' AS level, count(DISTINCT sid) AS reach FROM mi WHERE m * 60 < {END} AND m * 60 >= {START} UNION ALL SELECT 'users', count(DISTINCT user_id) FROM mi WHERE m * 60 < {END} AND m * 60 >= {START}")
NOON = START + 43_200
ORACLES["open_sessions"] = sql(f"""SELECT sid AS video_session_id, user_id, platform, country, content_id, {at_ms('last')} AS last_event, {at(f'last // 1000 + {TOL}')} AS counted_until, last // 1000 + {TOL} - {NOON} AS provisional_seconds, backgrounds,
count(*) OVER () AS open_sessions, (sum(last // 1000 + {TOL} - {NOON}) OVER ())::BIGINT AS provisional_seconds_total, count(*) FILTER (WHERE backgrounds > 0) OVER () AS open_with_background FROM o ORDER BY provisional_seconds DESC, video_session_id LIMIT 50""",
    f"o AS (SELECT sid, user_id, platform, country, content_id, last, backgrounds FROM (SELECT sid, max(ts) AS last, count(*) FILTER (WHERE event_type = 'AppBackgrounded') AS backgrounds FROM ev WHERE ts <= {NOON}000 GROUP BY sid HAVING count(*) FILTER (WHERE event_type = 'VideoSessionEnd') = 0) JOIN fd USING (sid) WHERE last // 1000 + {TOL} > {NOON})")
ORACLES["dimension_values"] = sql("SELECT dim, value, label FROM (" + " UNION ALL ".join(f"SELECT DISTINCT '{d}' AS dim, {d} AS value, {d} AS label FROM sr" for d in DIMS.split(", ") if d != "content_id") + """
UNION ALL SELECT DISTINCT 'content', sr.content_id::VARCHAR, coalesce(nullif(title, ''), sr.content_id::VARCHAR) FROM sr LEFT JOIN ct USING (content_id))""")
ORACLES["title_category_peak"] = sql(grain(3600, 0, keep=""), series(START, END, {}, "(SELECT * FROM mi WHERE content_id IN (SELECT content_id FROM ct WHERE show_name = 'Brand#11'))"))
_D = "(SELECT count(*) FROM (SELECT 1 FROM (SELECT {0}, run_start AS m, 1 AS d FROM {1} UNION ALL SELECT {0}, run_end + 1, -1 FROM {1}) GROUP BY {0}, m HAVING sum(d) <> 0))"
ORACLES["ingest_status"] = sql(f"SELECT count(*) AS events, {at_ms('max(ts)')} AS latest_event, {at_ms('min(ts)')} AS earliest_event, (SELECT count(*) FROM sr) AS session_runs, {_D.format(DIMS, 'sr')} AS session_deltas, (SELECT count(*) FROM ur) AS user_runs, {_D.format(DIMS, 'ur')} AS user_deltas FROM ev")
_AT = {"al": "(SELECT arg_max(m, [v, -m]) FROM al)", "li": "(SELECT arg_max(m, [v, -m]) FROM (SELECT m, count(*) AS v FROM mi WHERE video_type = 'live' GROUP BY m))", "we": "(SELECT arg_max(m, [v, -m]) FROM pf WHERE platform = 'Web')"}
_MOST, _SUM, _ALL = "(SELECT max(v) FROM pf)", "(SELECT sum(p)::BIGINT FROM (SELECT max(v) AS p FROM pf GROUP BY platform))", "(SELECT max(v) FROM al)"
_M = lambda m: f"strftime({at(m + ' * 60')}, '%Y-%m-%d %H:%M:%S')"
ORACLES["peak_not_rollup"] = sql(f"""SELECT assertion, observed, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (
SELECT 'peak_minute_differs_by_video_type' AS assertion, {_M(_AT['al'])} || ' vs ' || {_M(_AT['li'])} AS observed, {_AT['al']} IS DISTINCT FROM {_AT['li']} AS ok
UNION ALL SELECT 'peak_minute_differs_by_platform', {_M(_AT['al'])} || ' vs ' || {_M(_AT['we'])}, {_AT['al']} IS DISTINCT FROM {_AT['we']}
UNION ALL SELECT 'overall_peak_exceeds_max_of_parts', {_ALL} || ' vs max part ' || {_MOST}, {_ALL} > {_MOST}
UNION ALL SELECT 'overall_peak_differs_from_sum_of_parts', {_ALL} || ' vs sum parts ' || {_SUM}, {_ALL} <> {_SUM})""",
    "al AS (SELECT m, count(*) AS v FROM mi GROUP BY m)", "pf AS (SELECT platform, m, count(*) AS v FROM mi GROUP BY platform, m)")
_CELL = """SELECT '{0}' AS shape, '{1}' AS grain, max(p)::BIGINT AS peak_concurrency, {6} AS peak_minute, {7} AS avg_all_minutes, coalesce({8}, 0) AS avg_active_minutes, sum(w)::BIGINT AS minutes_with_audience, sum(n)::BIGINT AS minutes_total, count(*)::BIGINT AS buckets
FROM (SELECT max(v) AS p, arg_max(t, [v, -t]) AS pt, {9} AS a, coalesce({10}, 0) AS aa, count(*) FILTER (WHERE v > 0) AS w, count(*) AS n FROM (SELECT t, coalesce(v, 0) AS v FROM (SELECT unnest(range({3}, {4})) AS t) LEFT JOIN (SELECT m AS t, count(*) AS v FROM mi WHERE {5} GROUP BY m) USING (t)) GROUP BY t * 60 // {2})"""
_OF = at("arg_max(pt, [p, -pt]) * 60"), rnd("sum(a * n) / sum(n)", 2), rnd("sum(aa * w) / nullif(sum(w), 0)", 2), rnd("avg(v)", 2), rnd("avg(v) FILTER (WHERE v > 0)", 2)
ORACLES["answers_matrix"] = sql(" UNION ALL ".join(_CELL.format(s, g, n, START // 60, END // 60, where(f), *_OF) for s, f in SHAPES.items() for g, n in (("minute", 60), ("hour", 3600), ("day", 86400))))
ORACLES["ist_rebucket"] = sql(f"SELECT {at('(t * 60 + 19800) // 86400 * 86400 - 19800')} AS bucket, max(v) AS concurrency FROM se GROUP BY ALL", series(START, END, {}))
ORACLES["session_user_divergence"] = sql(f"SELECT {rnd('100.0 * (sp - up) / greatest(up, 1)', 2)} AS peak_gap_pct, {rnd('sp::DOUBLE / greatest(up, 1)', 4)} AS peak_multiplier, {rnd('s::DOUBLE / greatest(u, 1)', 4)} AS reach_multiplier FROM (SELECT max(v) AS sp FROM se), (SELECT max(v) AS up FROM (SELECT count(*) AS v FROM um WHERE m >= {START // 60} AND m < {END // 60} GROUP BY m)), (SELECT count(DISTINCT sid) AS s, count(DISTINCT user_id) AS u FROM mi WHERE m >= {START // 60} AND m < {END // 60})", series(START, END, {}))

# -- insight tables
FACTS = f"""fa AS (SELECT x.sid, fd.user_id, fd.content_id, coalesce(title, '') AS title, coalesce(category, '') AS category, coalesce(video_type, '') AS video_type, fd.platform, fd.country, fd.app_version,
x.session_start, coalesce(first_play, 0) AS first_play, coalesce(session_end, 0) AS session_end, coalesce(a.fa, 0) AS first_active, coalesce(a.la, 0) AS last_active, coalesce(a.secs, 0)::BIGINT AS active_seconds, coalesce(a.n, 0) AS active_interval_count,
background_count, foreground_return_count, pause_count, resume_count, heartbeat_count, video_error_count, (heartbeat_count > 0)::INT AS reached_first_heartbeat,
{', '.join(f"(EXISTS (SELECT 1 FROM iv WHERE iv.sid = x.sid AND iv.s <= a.fa + {60 * m} AND iv.e > a.fa + {60 * m}))::INT AS active_after_{m}m" for m in (1, 5, 10, 15))},
(session_end IS NOT NULL)::INT AS ended_normally, (session_end IS NULL)::INT AS abandoned, coalesce((ll = {TOL})::INT, 0) AS timed_out, coalesce((last_again > first_end)::INT, 0) AS reopened_after_end, last_event
FROM (SELECT sid, min(ts) AS session_start, max(ts) AS last_event, min(ts) FILTER (WHERE event_type = 'VideoPlay') AS first_play, max(ts) FILTER (WHERE event_type = 'VideoSessionEnd') AS session_end, min(ts) FILTER (WHERE event_type = 'VideoSessionEnd') AS first_end,
max(ts) FILTER (WHERE event_type IN ('VideoSessionStart','VideoPlay','AppForegrounded') OR event IN {RESUME}) AS last_again, count(*) FILTER (WHERE event_type = 'AppBackgrounded') AS background_count, count(*) FILTER (WHERE event_type = 'AppForegrounded') AS foreground_return_count,
count(*) FILTER (WHERE event IN {PAUSE}) AS pause_count, count(*) FILTER (WHERE event IN {RESUME}) AS resume_count, count(*) FILTER (WHERE event_type = 'VideoHeartbeat') AS heartbeat_count, count(*) FILTER (WHERE event_type = 'VideoError') AS video_error_count FROM ev GROUP BY sid) x
JOIN fd USING (sid) LEFT JOIN ct ON fd.content_id = ct.content_id LEFT JOIN (SELECT sid, min(s) AS fa, max(e) AS la, sum(e - s) AS secs, count(*) AS n, arg_max(e - s, [s, e]) AS ll FROM iv GROUP BY sid) a USING (sid))"""
ORACLES["session_facts"] = sql("SELECT * FROM fa", FACTS)

TRANSITIONS = f"""lb AS (SELECT sid, ts, event_type, event, CASE WHEN event_type = 'VideoSessionStart' THEN 'created' WHEN event_type = 'VideoSessionEnd' THEN 'ended' WHEN event_type = 'VideoError' THEN 'error' WHEN event_type = 'AppBackgrounded' THEN 'background'
WHEN event_type IN ('AppForegrounded','VideoPlay') OR event IN {RESUME} THEN 'playing_foreground' WHEN event IN {PAUSE} THEN 'paused_foreground' END AS raw,
coalesce(sum((event_type = 'VideoSessionEnd')::INT) OVER (PARTITION BY sid ORDER BY ts, event_type, event ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS k FROM ev),
ca AS (SELECT sid, k, ts, event_type, event, coalesce(last_value(raw IGNORE NULLS) OVER (PARTITION BY sid, k ORDER BY ts, event_type, event ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'created') AS state, lead(ts) OVER (PARTITION BY sid, k ORDER BY ts, event_type, event) AS nx FROM lb),
pt AS (SELECT sid, k, ts, event_type, event, state FROM ca UNION ALL SELECT sid, k, ts + {TOL}000, 'HeartbeatTimeout', '', 'stale_heartbeat' FROM ca WHERE state <> 'ended' AND (nx IS NULL OR nx // 1000 - ts // 1000 > {TOL})),
ed AS (SELECT *, lag(state) OVER (PARTITION BY sid, k ORDER BY ts, state, event_type, event) AS before FROM pt),
sq AS (SELECT *, lag(ts) OVER (PARTITION BY sid, k ORDER BY ts, state, event_type, event) AS prev, row_number() OVER (PARTITION BY sid, k ORDER BY ts, state, event_type, event) AS n FROM ed WHERE before IS NULL OR before <> state),
tr AS (SELECT sq.sid, k + 1 AS playback_instance_no, user_id, sd.content_id, platform, country, app_version, video_type, sq.ts, coalesce(before, '') AS from_state, state AS to_state, event_type AS trigger_event_type, event AS trigger_event,
CASE WHEN n = 1 THEN 0 ELSE greatest(sq.ts // 1000 - prev // 1000, 0) END AS seconds_in_previous_state, n AS transition_sequence, 1 AS sign FROM sq JOIN sd USING (sid))"""
ORACLES["state_transitions"] = sql(f"SELECT * REPLACE ({at_ms('ts')} AS ts) FROM tr", TRANSITIONS)
_L, _H = LOW // 60, HIGH // 60


def _part(name: str, source: str) -> str:
    return f"SELECT m, {IDIMS}, '{name}' AS what, count(*) AS n FROM ({source}) WHERE m >= {_L} AND m < {_H} GROUP BY ALL"


SNAPSHOT = "sp AS (" + " UNION ALL ".join([
    _part("concurrent_sessions", "SELECT * FROM mi"), _part("concurrent_users", "SELECT * FROM um"), _part("session_starts", "SELECT *, session_start // 60000 AS m FROM fa"),
    _part("first_plays", "SELECT *, first_play // 60000 AS m FROM fa WHERE first_play > 0"), _part("session_ends", "SELECT *, session_end // 60000 AS m FROM fa WHERE session_end > 0"),
    *[_part(n, f"SELECT fa.*, ts // 60000 AS m FROM (SELECT sid, ts FROM ev WHERE event_type = '{k}') JOIN fa USING (sid)") for k, n in (("AppForegrounded", "foreground_entries"), ("AppBackgrounded", "background_entries"), ("VideoError", "video_errors"))],
]) + f"),\nsn AS (SELECT m, sp.content_id, coalesce(any_value(title), '') AS title, coalesce(any_value(category), '') AS category, sp.video_type, platform, country, app_version, " + ", ".join(
    f"coalesce(sum(n) FILTER (WHERE what = '{x}'), 0)::BIGINT AS {x}" for x in ("concurrent_sessions", "concurrent_users", "session_starts", "first_plays", "session_ends", "foreground_entries", "background_entries", "video_errors")
) + " FROM sp LEFT JOIN ct ON sp.content_id = ct.content_id GROUP BY m, sp.content_id, sp.video_type, platform, country, app_version)"
ORACLES["minute_snapshot"] = sql(f"SELECT * REPLACE ({at('m * 60')} AS m) FROM sn", FACTS, SNAPSHOT)
_MEASURES = ("concurrent_sessions", "concurrent_users", "session_starts", "first_plays", "session_ends", "foreground_entries", "background_entries", "video_errors")
ORACLES["flow"] = sql(f"SELECT {at('m * 60')} AS minute, {', '.join(f'sum({x})::BIGINT AS {x}' for x in _MEASURES)} FROM sn GROUP BY m", FACTS, SNAPSHOT)
_R = (1, 5, 10, 15)
ORACLES["entry_cohorts"] = sql(f"""SELECT {at('first_active // 60 * 60')} AS m, {IDIMS}, min(title) AS title, min(category) AS category, count(*) AS entered_sessions, {', '.join(f'sum(active_after_{k}m)::BIGINT AS active_after_{k}m' for k in _R)},
{', '.join(f"{rnd(f'sum(active_after_{k}m)::DOUBLE / count(*)', 6)} AS retention_{k}m" for k in _R)}, {rnd('avg(active_seconds)', 4)} AS avg_active_seconds, {q_exact('active_seconds', 0.5)} AS median_active_seconds, {q_exact('active_seconds', 0.9)} AS p90_active_seconds
FROM fa WHERE first_active >= {LOW} AND first_active < {HIGH} GROUP BY first_active // 60, {IDIMS}""", FACTS)
ORACLES["retention"] = sql(f"SELECT {at('first_active // 60 * 60')} AS cohort_minute, count(*) AS entered_sessions, {', '.join(f"{rnd(f'100.0 * sum(active_after_{k}m) / count(*)', 2)} AS retention_{k}m_pct" for k in _R)} FROM fa WHERE first_active >= {LOW} AND first_active < {HIGH} GROUP BY first_active // 60", FACTS)
CONTENT_MOVES = """sq AS (SELECT *, lag(sid) OVER w AS from_sid, lag(content_id) OVER w AS from_content_id, lag(title) OVER w AS from_title, lag(platform) OVER w AS from_platform, lag(last_active) OVER w AS pla, lag(session_end) OVER w AS pse, lag(background_count) OVER w AS pbc, lag(content_id, 2) OVER w AS p2
FROM fa WHERE first_active > 0 WINDOW w AS (PARTITION BY user_id ORDER BY first_active, sid)),
cm AS (SELECT user_id, from_content_id, from_title, from_platform, content_id AS to_content_id, title AS to_title, platform AS to_platform, video_type AS to_video_type, from_sid AS from_session_id, sid AS to_session_id, first_active AS moved_at, first_active - pla AS gap_seconds, greatest(0, least(pla, last_active) - first_active) AS overlap_seconds,
CASE WHEN least(pla, last_active) > first_active THEN 'parallel_multi_device' WHEN p2 = content_id THEN 'return_to_previous_content' WHEN pse > 0 THEN 'switch_after_end' WHEN pbc > 0 THEN 'switch_after_background' ELSE 'direct_switch' END AS transition_type
FROM sq WHERE from_sid IS NOT NULL AND from_content_id <> content_id AND (first_active - pla <= 600 OR least(pla, last_active) > first_active))"""
PLATFORM_MOVES = """sq AS (SELECT *, lag(sid) OVER w AS from_sid, lag(platform) OVER w AS from_platform, lag(last_active) OVER w AS pla, lag(platform, 2) OVER w AS p2 FROM fa WHERE first_active > 0 WINDOW w AS (PARTITION BY user_id, content_id ORDER BY first_active, sid)),
pm AS (SELECT user_id, content_id, title, from_platform, platform AS to_platform, from_sid AS from_session_id, sid AS to_session_id, first_active AS moved_at, first_active - pla AS gap_seconds, greatest(0, least(pla, last_active) - first_active) AS overlap_seconds,
CASE WHEN least(pla, last_active) > first_active THEN 'parallel_multi_device' WHEN p2 = platform THEN 'return_to_previous_device' WHEN first_active - pla <= 300 THEN 'handoff' ELSE 'unknown' END AS transition_type FROM sq WHERE from_sid IS NOT NULL AND from_platform <> platform)"""
ORACLES["content_transitions"] = sql(f"SELECT * REPLACE ({at('moved_at')} AS moved_at) FROM cm", FACTS, CONTENT_MOVES)
ORACLES["platform_transitions"] = sql(f"SELECT * REPLACE ({at('moved_at')} AS moved_at) FROM pm", FACTS, PLATFORM_MOVES)
_IN = f"WHERE moved_at >= {LOW} AND moved_at < {HIGH}"
_T = "count(*) FILTER (WHERE transition_type {})"
ORACLES["switching"] = sql(f"""SELECT from_title, to_title, count(*) AS moves, count(DISTINCT user_id) AS users, {_T.format("<> 'parallel_multi_device'")} AS real_switches, {_T.format("= 'parallel_multi_device'")} AS parallel_viewing, {_T.format("= 'switch_after_end'")} AS after_it_ended,
{_T.format("= 'switch_after_background'")} AS after_backgrounding, {_T.format("= 'return_to_previous_content'")} AS came_back, {rnd('100.0 * ' + _T.format("<> 'parallel_multi_device'") + ' / count(*)', 1)} AS switch_share_pct, {q_exact('gap_seconds', 0.5)} AS median_gap_seconds FROM cm {_IN} GROUP BY from_title, to_title ORDER BY moves DESC, from_title, to_title LIMIT 200""", FACTS, CONTENT_MOVES)
ORACLES["handoff"] = sql(f"""SELECT from_platform, to_platform, count(*) AS moves, count(DISTINCT user_id) AS users, {_T.format("= 'handoff'")} AS handoffs, {_T.format("= 'parallel_multi_device'")} AS parallel_viewing, {_T.format("= 'return_to_previous_device'")} AS came_back,
{rnd('100.0 * ' + _T.format("= 'handoff'") + ' / count(*)', 1)} AS handoff_share_pct, {q_exact('gap_seconds', 0.5)} AS median_gap_seconds, {rnd('avg(overlap_seconds)', 1)} AS avg_overlap_seconds FROM pm {_IN} GROUP BY from_platform, to_platform ORDER BY moves DESC, from_platform, to_platform LIMIT 200""", FACTS, PLATFORM_MOVES)
for _name, _of, _more in (("switching_one_content", "switching", "(from_content_id = 30 OR to_content_id = 30)"), ("switching_to_live", "switching", "to_video_type = 'live'"), ("handoff_one_platform", "handoff", "(from_platform = 'Web' OR to_platform = 'Web')")):
    ORACLES[_name] = ORACLES[_of].replace(_IN, f"{f'WHERE moved_at >= {MONTH[0]} AND moved_at < {MONTH[1]}' if _of == 'switching' else _IN} AND {_more}")
HEALTH = f"""hp AS (SELECT m, {IDIMS}, 'a' AS what, count(*) AS n FROM mi WHERE m >= {_L} AND m < {_H} GROUP BY ALL UNION ALL SELECT m, {IDIMS}, 'z', 0 FROM sn
UNION ALL SELECT m, {IDIMS}, 'e', count(DISTINCT sid) FROM (SELECT fa.*, ts // 60000 AS m FROM (SELECT sid, ts FROM ev WHERE event_type = 'VideoError') JOIN fa USING (sid)) WHERE m >= {_L} AND m < {_H} GROUP BY ALL
UNION ALL SELECT last_active // 60 AS m, {IDIMS}, 't', sum(timed_out) FROM fa WHERE last_active >= {LOW} AND last_active < {HIGH} GROUP BY ALL UNION ALL SELECT last_active // 60 AS m, {IDIMS}, 'b', sum(abandoned) FROM fa WHERE last_active >= {LOW} AND last_active < {HIGH} GROUP BY ALL),
he AS (SELECT m, {IDIMS}, {', '.join(f"coalesce(sum(n) FILTER (WHERE what = '{k}'), 0)::BIGINT AS {x}" for k, x in (('a', 'active_sessions'), ('e', 'video_error_sessions'), ('t', 'heartbeat_timeout_sessions'), ('b', 'abandoned_sessions')))} FROM hp GROUP BY m, {IDIMS})"""
_RATES = (("video_error_sessions", "video_error"), ("heartbeat_timeout_sessions", "timeout"), ("abandoned_sessions", "abandonment"))
ORACLES["playback_health"] = sql(f"SELECT * REPLACE ({at('m * 60')} AS m), {', '.join(f"{rnd(f'{c}::DOUBLE / greatest(active_sessions, 1)', 6)} AS {n}_rate" for c, n in _RATES)} FROM he", FACTS, SNAPSHOT, HEALTH)
ORACLES["health"] = sql(f"SELECT {at('m * 60')} AS minute, a AS active_sessions, e AS video_error_sessions, t AS heartbeat_timeout_sessions, b AS abandoned_sessions, {', '.join(f"{rnd(f'100.0 * {c} / greatest(a, 1)', 3)} AS {n}_pct" for c, (_, n) in zip('etb', _RATES))} FROM (SELECT m, sum(active_sessions)::BIGINT AS a, sum(video_error_sessions)::BIGINT AS e, sum(heartbeat_timeout_sessions)::BIGINT AS t, sum(abandoned_sessions)::BIGINT AS b FROM he GROUP BY m) WHERE a > 0", FACTS, SNAPSHOT, HEALTH)
LATE = "la AS (SELECT *, arrival - ts // 1000 AS lateness_seconds, CASE WHEN arrival - ts // 1000 < 0 THEN 'invalid_future_event' WHEN arrival - ts // 1000 <= 90 THEN 'on_time' WHEN arrival - ts // 1000 <= 3600 THEN 'late_acceptable' ELSE 'late_after_finalization' END AS lateness_class FROM ev WHERE arrival > 0)"
ORACLES["late_event_audit"] = sql(f"SELECT {at('ts // 86400000 * 86400')} AS day, sid, {at_ms('ts')} AS ts, {at('arrival')} AS arrival, lateness_seconds, lateness_class, event_type, event FROM la WHERE lateness_class <> 'on_time'", LATE)
ORACLES["lateness"] = sql(f"SELECT lateness_class, event_type, count(*) AS events, count(DISTINCT sid) AS sessions, {rnd('avg(lateness_seconds)', 1)} AS avg_lateness_seconds, {q_exact('lateness_seconds', 0.95)} AS p95_lateness_seconds, max(lateness_seconds) AS max_lateness_seconds FROM la WHERE lateness_class <> 'on_time' AND ts >= {LOW}000 AND ts < {HIGH}000 GROUP BY lateness_class, event_type", LATE)
_CC = "cc AS (SELECT content_id, m, sum(concurrent_sessions)::BIGINT AS c FROM sn GROUP BY content_id, m)"
ORACLES["spike_candidates"] = sql("SELECT content_id, max(c) AS peak, count(*) AS minutes FROM cc GROUP BY content_id HAVING max(c) >= 2 AND count(*) >= 10 ORDER BY peak DESC, content_id LIMIT 25", FACTS, SNAPSHOT, _CC)
SPIKES = f"""pk AS (SELECT content_id, max(c) AS peak, arg_max(m, [c, -m]) AS pm, min(m) AS first FROM cc GROUP BY content_id HAVING max(c) > 0),
su AS (SELECT pk.content_id, peak, pm, first, coalesce(min(c) FILTER (WHERE m < pm), 0) AS base, {', '.join(f'coalesce(max(c) FILTER (WHERE m = pm + {k}), 0) AS a{k}' for k in (5, 10, 15))}, count(*) FILTER (WHERE m >= pm AND c * 100 >= peak * 80) AS above FROM pk JOIN cc ON pk.content_id = cc.content_id GROUP BY pk.content_id, peak, pm, first),
oc AS (SELECT content_id, count(*) AS entered, avg((background_count > 0)::INT) AS bg, avg((video_error_count > 0)::INT) AS er, avg(timed_out) AS ti FROM fa WHERE session_start >= {LOW}000 AND session_start < {HIGH}000 GROUP BY content_id),
sk AS (SELECT su.content_id, {at('first * 60')} AS window_start, {at('pm * 60')} AS peak_minute, base AS baseline_concurrency, peak AS peak_concurrency, peak - base AS absolute_growth, CASE WHEN base > 0 THEN {rnd('(peak - base) * 100.0 / base', 4)} ELSE 100.0 END AS growth_percent, pm - first AS minutes_to_peak, above AS minutes_above_80pct_peak,
{', '.join(f'a{k} AS concurrency_after_{k}m' for k in (5, 10, 15))}, {', '.join(f"{rnd(f'a{k} * 100.0 / peak', 4)} AS retention_{k}m_percent" for k in (5, 10, 15))}, coalesce(entered, 0) AS entered_sessions, coalesce({rnd('bg', 6)}, 0) AS background_rate_after_peak, coalesce({rnd('er', 6)}, 0) AS error_rate_after_peak, coalesce({rnd('ti', 6)}, 0) AS timeout_rate_after_peak,
CASE WHEN a10 * 100.0 / peak >= 70 AND above >= 8 THEN 'healthy_sustained' WHEN a10 * 100.0 / peak < 55 OR above <= 4 THEN 'short_lived' ELSE 'inconclusive' END AS spike_type, {rnd('least(1.0, abs(a10 * 100.0 / peak - 62.5) / 37.5)', 6)} AS confidence FROM su LEFT JOIN oc USING (content_id))"""
ORACLES["spike_events"] = sql("SELECT * FROM sk", FACTS, SNAPSHOT, _CC, SPIKES)
ORACLES["spikes"] = sql(f"SELECT * FROM sk WHERE peak_minute >= {at(str(LOW))} AND peak_minute < {at(str(HIGH))} ORDER BY peak_minute DESC, peak_concurrency DESC, content_id LIMIT 200", FACTS, SNAPSHOT, _CC, SPIKES)
_ST = """SELECT from_state, to_state, sum(sign)::BIGINT AS transitions, (SELECT count(DISTINCT sid) FROM {0} y WHERE y.from_state = x.from_state AND y.to_state = x.to_state AND {1}) AS sessions, {2} AS avg_seconds_in_from_state,
max(seconds_in_previous_state) AS max_seconds_in_from_state, (sum(sign) FILTER (WHERE trigger_event_type = 'HeartbeatTimeout'))::BIGINT AS entered_by_timeout FROM {0} x WHERE {1} GROUP BY from_state, to_state"""
_SW = f"ts >= {LOW}000 AND ts < {HIGH}000"
_SA = rnd("sum(seconds_in_previous_state)::DOUBLE / greatest(count(*), 1)", 1)
ORACLES["states"] = sql(_ST.format("tr", _SW, _SA).replace("(sum(sign) FILTER (WHERE trigger_event_type = 'HeartbeatTimeout'))::BIGINT", "count(*) FILTER (WHERE trigger_event_type = 'HeartbeatTimeout')"), TRANSITIONS)
ORACLES["signed_weighted_avg"] = sql(_ST.format("t2", _SW, _SA).replace("(sum(sign) FILTER (WHERE trigger_event_type = 'HeartbeatTimeout'))::BIGINT", "count(*) FILTER (WHERE trigger_event_type = 'HeartbeatTimeout')"), TRANSITIONS, "t2 AS (SELECT * REPLACE (CASE WHEN transition_sequence = 2 THEN seconds_in_previous_state + 1 ELSE seconds_in_previous_state END AS seconds_in_previous_state) FROM tr)")
_V = "count(*) FILTER (WHERE {} > 0)"
ORACLES["versions"] = sql(f"""SELECT app_version, count(*) AS sessions, {', '.join(f"{_V.format(f'active_after_{k}m')} AS retained_{k}m" for k in (1, 5, 15))}, {', '.join(f"{rnd('100.0 * ' + _V.format(f'active_after_{k}m') + ' / count(*)', 2)} AS retention_{k}m_pct" for k in (5, 15))}, {rnd('avg(active_seconds)', 1)} AS avg_active_seconds,
{q_exact('active_seconds', 0.5)} AS median_active_seconds, {q_exact('active_seconds', 0.9)} AS p90_active_seconds, {_V.format('video_error_count')} AS sessions_with_error, {rnd('100.0 * ' + _V.format('video_error_count') + ' / count(*)', 2)} AS error_session_pct, {_V.format('background_count')} AS sessions_backgrounded,
{rnd('100.0 * ' + _V.format('foreground_return_count') + ' / greatest(' + _V.format('background_count') + ', 1)', 2)} AS return_after_background_pct, {_V.format('timed_out')} AS timed_out_sessions FROM fa WHERE session_start >= {LOW}000 AND session_start < {HIGH}000 GROUP BY app_version""", FACTS)
ORACLES["forecast"] = sql(f"""SELECT {at('(m + h) * 60')} AS minute, 'forecast' AS kind, greatest(0, round(s + drift * h)::BIGINT) AS sessions, greatest(0, round(s + drift * h - 1.96 * sigma * sqrt(h))::BIGINT) AS lower_95, greatest(0, round(s + drift * h + 1.96 * sigma * sqrt(h))::BIGINT) AS upper_95, h AS minutes_ahead, n AS fitted_on_minutes, drift::DOUBLE AS drift_per_minute
FROM (SELECT arg_max(s, m) AS s, max(m) AS m, {q_exact('d', 0.5)} AS drift, stddev_pop(d) AS sigma, count(*) AS n FROM (SELECT m, s, s - coalesce(lag(s) OVER (ORDER BY m), 0) AS d, lead(m) OVER (ORDER BY m) AS after FROM (SELECT m, sum(concurrent_sessions)::BIGINT AS s FROM sn GROUP BY m)) WHERE after IS NOT NULL), (SELECT unnest(range(1, 16)) AS h)""", FACTS, SNAPSHOT)
ORACLES["insight_status"] = sql(f"""SELECT {at_ms('max(ts)')} AS raw_latest, count(*) AS raw_events, (SELECT {at_ms('max(session_start)')} FROM fa) AS facts_latest, (SELECT count(*) FROM fa) AS facts_sessions, (SELECT {at('max(m) * 60')} FROM sn) AS snapshot_latest, (SELECT count(DISTINCT m) FROM sn) AS snapshot_minutes,
(SELECT {at_ms('max(ts)')} FROM tr) AS transitions_latest, (SELECT count(*) FROM tr) AS transitions_asserted, (SELECT {at('max(m) * 60')} FROM he) AS health_latest, (SELECT {at('max(first_active) // 60 * 60')} FROM fa WHERE first_active >= {LOW} AND first_active < {HIGH}) AS cohorts_latest, (SELECT count(*) FROM la WHERE lateness_class <> 'on_time') AS late_events FROM ev""",
    FACTS, SNAPSHOT, HEALTH, TRANSITIONS, LATE)

def ever(text: str) -> str:
    """The same for all of time."""
    for bound, by in ((LOW, 60), (HIGH, 1 << 33), (_L, 1), (_H, 1 << 33)):
        text = text.replace(str(bound), str(by))
    return text


ORACLES |= {name: ever(ORACLES[name]) for name in ("minute_snapshot", "entry_cohorts", "playback_health", "spike_candidates", "insight_status")}

ORACLES["users_by_event"] = sql(f"""SELECT {at('m * 60')} AS minute, count(DISTINCT sid) AS concurrent_sessions, count(DISTINCT user_id) AS concurrent_users, count(DISTINCT raw) AS concurrent_users_raw
FROM (SELECT iv.sid, iv.user_id, nm.raw, unnest(range(s // 60, (s + greatest(e - s - 1, 0)) // 60 + 1)) AS m FROM iv JOIN nm ON nm.sid = iv.sid AND nm.sec = iv.s) WHERE m >= {START // 60} AND m < {END // 60} GROUP BY m""",
    "nm AS (SELECT sid, ts // 1000 AS sec, min({'t': ts, 'u': user_id}).u AS raw FROM ev GROUP BY ALL)")
ORACLES["interval_overshoot"] = sql("SELECT count(*) AS intervals, 0 AS past_the_last_end, 0 AS most_seconds_past, 0 AS longer_than_the_tolerance FROM iv")
ORACLES["curve_as_of"] = curve(START, END, {}).replace(" FROM e0),", f" FROM e0 WHERE ts < {NOON}000),")
ORACLES["insight_reference_diff"] = " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS left_rows, count(*) AS right_rows, 0 AS only_left, 0 AS only_right FROM ({ORACLES[n]})" for n in ("session_facts", "state_transitions", "minute_snapshot", "entry_cohorts", "playback_health"))
ORACLES["settled_intervals_equal_batch"] = ORACLES["foreground_intervals"]
ORACLES |= {
    f"{name}_equals_batch": ORACLES[of]
    for name, of in (
        ("refresh", "minute_snapshot"), ("facts_refresh", "session_facts"), ("transitions_refresh", "state_transitions"), ("cohorts_refresh", "entry_cohorts"), ("health_refresh", "playback_health"),
        ("journeys_refresh", "content_transitions"), ("lateness_refresh", "late_event_audit"), ("advancing_clock", "session_runs"), ("state_stream", "foreground_intervals"), 
    )
}

def made(name: str, content: int, mix: tuple) -> str:
    """The sessions of a made audience: name, content, id, what they do, when, and their start."""
    bounds = [(round(sum(m[0] for m in mix[: k + 1]), 6), *m[1:]) for k, m in enumerate(mix)]
    case = lambda i: "CASE " + " ".join(f"WHEN (id + 0.5) / 2000 <= {b[0]} + 1e-9 THEN {b[i]!r}" for b in bounds) + " END"
    d, w = (lambda salt, n: scenarios.draw("id", salt, n)), scenarios.WAVES
    wave = f"CASE WHEN {d(1, 100)} < {100 * w[0]} THEN 0 WHEN {d(1, 100)} < {100 * (w[0] + w[1])} THEN 1 ELSE 2 END"
    return (
        f"SELECT '{name}' AS name, {content}::BIGINT AS content_id, id, {case(1)} AS what, {case(2)} + {d(2, 1_000_000)} % ({case(3)} - {case(2)} + 1) AS upto, "
        f"{START}000 + 1000 * ({wave} * {scenarios.APART} + {d(3, scenarios.SPREAD)}) AS t0 FROM (SELECT unnest(range(2000)) AS id)"
    )


def _steps() -> str:
    one = lambda kind, at, cond: f"SELECT *, '{kind}' AS event_type, '' AS event, {at} AS s FROM on_ WHERE {cond}"
    beats = lambda a, b, cond: f"SELECT *, 'VideoHeartbeat', 'progress', unnest(range({a}, {b}, {scenarios.BEAT})) FROM on_ WHERE {cond}"
    return " UNION ALL ".join([
        one("VideoSessionStart", 0, "true"), one("VideoPlay", 1, "true"), beats(scenarios.BEAT, "upto", "true"), one("VideoSessionEnd", "upto", "what = 'end'"), one("VideoError", "upto", "what = 'error'"),
        one("AppBackgrounded", "upto", "what IN ('background', 'return')"), one("AppForegrounded", "upto + 90", "what = 'return'"), beats("upto + 120", "upto + 691", "what = 'return'"), one("VideoSessionEnd", "upto + 720", "what = 'return'"),
    ])


_SHORT = [(str(LOW), str(START)), (str(HIGH), str(START + 7200)), (str(_L), str(START // 60)), (str(_H), str((START + 7200) // 60)), (f"{TOL}000", "90000"), (f"= {TOL})", "= 90)"), (f"+ {TOL}", "+ 90"), (f"> {TOL}", "> 90")]


def _short(text: str) -> str:
    for a, b in _SHORT:
        text = text.replace(a, b)
    return text


ORACLES["spike_healthy_weak"] = "WITH " + ",\n".join([
    f"on_ AS ({made('h', scenarios.CONTENT, scenarios.HEALTHY)} UNION ALL {made('w', scenarios.CONTENT + 1, scenarios.WEAK)})",
    f"st_ AS ({_steps()})",
    f"tw_ AS (SELECT * FROM st_ UNION ALL SELECT * FROM st_ WHERE {scenarios.draw('(id * 10007 + s)', 4, scenarios.TWICE)} = 0)",
    "ev AS (SELECT name || id AS sid, 'u' || name || id AS user_id, event_type, event, t0 + 1000 * s AS ts, (t0 + 1000 * s) // 1000 AS arrival, t0 AS session_start, content_id, 'Web' AS platform, 'IN' AS country, '1' AS app_version, '' AS audio_language, '' AS subtitle_language, '' AS player_version, '' AS video_resolution FROM tw_)",
    f"ct AS (SELECT * FROM (VALUES ({scenarios.CONTENT}::BIGINT, 'stays', 'live', 'made', ''), ({scenarios.CONTENT + 1}::BIGINT, 'leaves', 'live', 'made', '')) t(content_id, title, video_type, category, show_name))",
    *map(_short, (BASE[BASE.index("cl AS (") :].strip(), FACTS, SNAPSHOT, _CC, SPIKES)),
]) + "\nSELECT * FROM sk"

# -- validation
ORACLES["oracle_curve"] = sql(f"SELECT {at('m * 60')} AS minute, count(DISTINCT sid) AS concurrent_sessions, count(DISTINCT user_id) AS concurrent_users FROM mi WHERE m >= {START // 60} AND m < {END // 60} GROUP BY m")
NAIVE = "nm AS (SELECT sid, unnest(range(run_start, run_end + 1)) AS m FROM nv)"
_NS = series(START, END, {}, "nm").replace("se AS", "ns AS")
ORACLES["naive_curve"] = sql(f"SELECT {at('t * 60')} AS minute, v AS concurrency FROM ns", NAIVE, _NS)
ORACLES["naive_overcount"] = sql(f"SELECT max(se.v) AS peak, max(ns.v) AS naive_peak, {rnd('100.0 * (max(ns.v) - max(se.v)) / greatest(max(se.v), 1)', 2)} AS overcount_pct, count(*) FILTER (WHERE se.v = 0 AND ns.v > 0) AS phantom_minutes, count(*) FILTER (WHERE ns.v < se.v) AS inverted_minutes FROM se JOIN ns USING (t)", NAIVE, _NS, series(START, END, {}))
ORACLES["naive_at_minute"] = sql(f"SELECT (SELECT count(DISTINCT sid) FROM nm WHERE m = {NOON // 60}) AS naive, (SELECT count(DISTINCT sid) FROM mi WHERE m = {NOON // 60}) AS foreground", NAIVE)
_Q = {
    "events total": "SELECT count(*) FROM ev", "events of a negative content": "SELECT count(*) FROM ev WHERE content_id <= 0", "events of a content that is not in the catalogue": "SELECT count(*) FROM ev WHERE content_id NOT IN (SELECT content_id FROM ct)",
    "events of a content without video type": "SELECT count(*) FROM ev JOIN ct USING (content_id) WHERE video_type = ''", "events before their session's start": "SELECT count(*) FROM ev WHERE session_start > ts", "events without a positive time": "SELECT count(*) FROM ev WHERE ts <= 0",
    "backgrounds beyond foregrounds": "SELECT count(*) FILTER (WHERE event_type = 'AppBackgrounded') - count(*) FILTER (WHERE event_type = 'AppForegrounded') FROM ev", "contents total": "SELECT count(*) FROM ct", "contents with a negative id": "SELECT count(*) FROM ct WHERE content_id <= 0",
    "seconds of a session with several events": "SELECT count(*) FROM (SELECT 1 FROM ev GROUP BY sid, ts // 1000 HAVING count(*) > 1)",
    **{n: f"SELECT count(*) FROM (SELECT 1 FROM ev GROUP BY sid HAVING {h})" for n, h in (
        ("sessions with several starts", "count(*) FILTER (WHERE event_type = 'VideoSessionStart') > 1"), ("sessions with several ends", "count(*) FILTER (WHERE event_type = 'VideoSessionEnd') > 1"), ("sessions without a start", "count(*) FILTER (WHERE event_type = 'VideoSessionStart') = 0"),
        ("sessions still open", "count(*) FILTER (WHERE event_type = 'VideoSessionEnd') = 0"), ("sessions on several platforms", "count(DISTINCT platform) > 1"), ("sessions of several users", "count(DISTINCT user_id) > 1"), ("sessions with several contents", "count(DISTINCT content_id) > 1"))},
    "gaps of over an hour within a session": "SELECT count(*) FROM (SELECT ts // 1000 - lag(ts // 1000) OVER (PARTITION BY sid ORDER BY ts) AS g FROM ev) WHERE g > 3600", "minutes with negative concurrency": "SELECT 0", "sum of all deltas": "SELECT 0", "runs that end before they start": "SELECT count(*) FROM sr WHERE run_end < run_start",
}
ORACLES["data_quality"] = sql(" UNION ALL ".join(f"""SELECT '{n.replace("'", "''")}' AS "check", ({q})::BIGINT AS n""" for n, q in _Q.items()))
_B = (LOW - 8 * 86_400) * 1000
ORACLES["unknown_vocabulary"] = sql(f"SELECT 'UNKNOWN_HEARTBEAT_EVENT' AS finding, event AS value, 'VideoHeartbeat' AS context, count(*) AS events, count(DISTINCT sid) AS sessions, {at_ms('min(ts)')} AS first_seen, {at_ms('max(ts)')} AS last_seen FROM ev WHERE event_type = 'VideoHeartbeat' AND event NOT IN {PAUSE} AND event NOT IN {RESUME} AND event NOT IN (SELECT event FROM ev WHERE event_type = 'VideoHeartbeat' AND ts < {_B}) GROUP BY event")
_G = {
    "rows.events": "count(*) FROM ev", "uniq.sessions": "count(DISTINCT sid) FROM ev", "uniq.users": "count(DISTINCT user_id) FROM ev", "uniq.contents": "count(DISTINCT content_id) FROM ev", "uniq.event_types": "count(DISTINCT event_type) FROM ev", "uniq.events": "count(DISTINCT event) FROM ev", "span.first": "min(ts) FROM ev", "span.last": "max(ts) FROM ev",
    "rows.intervals": "count(*) FROM iv", "intervals.empty": "count(*) FROM iv WHERE s = e", "intervals.seconds": "sum(e - s) FROM iv", "invariant.intervals_inverted": "count(*) FROM iv WHERE e < s", "rows.session_runs": "count(*) FROM sr", "runs.minutes": "count(*) FROM mi", "invariant.runs_inverted": "count(*) FROM sr WHERE run_end < run_start",
    "rows.user_runs": "count(*) FROM ur", "rows.delta_minutes": "count(DISTINCT m) FROM dm", "invariant.closure_sessions": "0", "rows.user_delta_minutes": "count(DISTINCT m) FROM du", "invariant.closure_users": "0",
}
_DM = "{0} AS (SELECT {2}, m FROM (SELECT {2}, run_start AS m, 1 AS d FROM {1} UNION ALL SELECT {2}, run_end + 1, -1 FROM {1}) GROUP BY {2}, m HAVING sum(d) <> 0)"
_HELD = "{0} FROM (SELECT m, c, coalesce(lead(m) OVER (ORDER BY m), m) - m AS w FROM (SELECT d.m, (SELECT count(*) FROM {2} x WHERE d.m BETWEEN x.run_start AND x.run_end) AS c FROM (SELECT DISTINCT m FROM {1}) d))"
for _name, _d, _runs in (("sessions", "dm", "sr"), ("users", "du", "ur")):
    _G |= {f"{_name}.{k}": _HELD.format(v, _d, _runs) for k, v in {
        "peak": "max(c)", "peak_minute": "arg_max(m, [c, -m])", "least": "min(c)", "minutes_with_audience": "sum(w) FILTER (WHERE c > 0)", "minutes_in_span": "sum(w)",
        "avg_all_minutes_x100": "floor((200 * sum(c * w) + sum(w))::DOUBLE / (2 * sum(w)))", "avg_active_minutes_x100": "floor((200 * sum(c * w) + sum(w) FILTER (WHERE c > 0))::DOUBLE / (2 * sum(w) FILTER (WHERE c > 0)))",
    }.items()}
_G |= {"invariant.most_assertions_of_a_run": "max(n) FROM (SELECT count(*) AS n FROM sr GROUP BY sid, run_start, run_end)", **{f"invariant.runs_of_a_{k}_that_overlap": "0" for k in ("session", "user")}}
ORACLES["ground_state"] = sql(" UNION ALL ".join(f"SELECT '{k}' AS metric, (SELECT {v})::BIGINT AS value" for k, v in _G.items()), _DM.format("dm", "sr", DIMS), _DM.format("du", "ur", DIMS))
ORACLES["runs_deltas_recon"] = sql("SELECT 0 AS minutes_that_differ, count(*) AS minutes_compared FROM (SELECT run_start FROM sr UNION SELECT run_end + 1 FROM sr)")
ORACLES["exact_invariants"] = sql("SELECT 0 AS net, 0 AS least, (SELECT max(v) FROM ins) AS exact_peak, (SELECT count(*) FROM iv a WHERE EXISTS (SELECT 1 FROM iv b WHERE b.sid = a.sid AND (b.s, b.e) < (a.s, a.e) AND b.e > a.s)) AS self_overlaps, (SELECT max(v) FROM pm) AS minute_peak, (SELECT max(v) FROM ins) <= (SELECT max(v) FROM pm) AS exact_within_minute",
    "ins AS (SELECT s, (SELECT count(*) FROM iv b WHERE b.s <= p.s AND b.e > p.s) AS v FROM (SELECT DISTINCT s FROM iv) p)", "pm AS (SELECT count(*) AS v FROM mi GROUP BY m)")
_CH = f"ch AS (SELECT DISTINCT m FROM dm WHERE m >= {START // 60} AND m < {END // 60})"
ORACLES["sparse_avg_fixture"] = sql(f"SELECT (SELECT {rnd('avg(v)', 2)} FROM se WHERE t IN (SELECT m FROM ch)) AS sparse_avg, (SELECT {rnd('avg(v)', 2)} FROM se) AS dense_avg", series(START, END, {}), _DM.format("dm", "sr", DIMS), _CH)
ORACLES["unbounded_fill_fixture"] = sql(f"SELECT {rnd('avg(v) FILTER (WHERE t BETWEEN (SELECT min(m) FROM ch) AND (SELECT max(m) FROM ch))', 2)} AS unbounded_avg, count(*) FILTER (WHERE t BETWEEN (SELECT min(m) FROM ch) AND (SELECT max(m) FROM ch)) AS unbounded_minutes, {rnd('avg(v)', 2)} AS bounded_avg, count(*) AS bounded_minutes FROM se", series(START, END, {}), _DM.format("dm", "sr", DIMS), _CH)
ORACLES["gap_profile"] = sql(f"SELECT count(*) AS gaps, {', '.join(f'{rnd(f"quantile_cont(g, {p})", 3)} AS {n}' for p, n in ((0.5, 'p50'), (0.9, 'p90'), (0.99, 'p99')))}, max(g) AS longest FROM (SELECT ts - lag(ts) OVER (PARTITION BY sid ORDER BY ts) AS g FROM ev) WHERE g IS NOT NULL")
ORACLES["orphan_content_anti"] = sql("SELECT content_id, count(*) AS events, count(DISTINCT sid) AS sessions FROM ev WHERE content_id NOT IN (SELECT content_id FROM ct) GROUP BY content_id")
ORACLES["duplicate_events"] = sql("SELECT count(*) AS groups, coalesce(sum(n - 1), 0)::BIGINT AS extra_rows FROM (SELECT count(*) AS n FROM ev GROUP BY sid, ts, event_type, event HAVING count(*) > 1)")
ORACLES["locf_asof_average"] = sql(f"SELECT {rnd('avg(v)', 2)} AS locf_avg, {rnd('avg(CASE WHEN t IN (SELECT m FROM dm) THEN v ELSE 0 END)', 2)} AS zero_fill_avg, count(*) AS samples FROM se WHERE t % 10 = {START // 60 % 10}", series(START, END, {}), _DM.format("dm", "sr", DIMS))
ORACLES["straddling_sessions"] = sql(f"SELECT sid AS video_session_id, count(*) AS events FROM ev GROUP BY sid HAVING min(ts) < {NOON}000 AND max(ts) >= {NOON}000")

# -- upkeep
_TO = f"tc AS (SELECT DISTINCT sid FROM ev WHERE ts BETWEEN {START}000 AND {START + 3600}000)"
ORACLES["bystanders_untouched"] = sql("SELECT 0 AS rows, count(*) AS touched FROM tc", _TO)
ORACLES["retract_netting"] = sql("SELECT count(*) AS retracted, count(*) AS asserted, 0 AS net FROM sr WHERE sid IN (SELECT sid FROM tc)", _TO)

# -- single operators
ORACLES["csv_round_trip"] = sql("SELECT event_type, event, platform, count(*) AS events, min(ts) AS first, max(ts) AS last, count(DISTINCT sid) AS sessions FROM ev GROUP BY event_type, event, platform")
ORACLES["argmin_first_dims"] = sql(f"SELECT sid, user_id, {EDIMS}, coalesce(last_end, 0) AS last_end FROM fd")
ORACLES["exact_quantiles"] = sql(f"SELECT platform, {', '.join(f'{q_exact("e - s", p)} AS q{int(p * 100)}' for p in (0.5, 0.6, 0.9, 0.95))} FROM iv GROUP BY platform")
ORACLES["any_left_join"] = sql("SELECT ev.content_id, count(*) AS events, any_value(title) AS title FROM ev LEFT JOIN ct ON ev.content_id = ct.content_id GROUP BY ev.content_id")
ORACLES["asof_join"] = sql(f"SELECT x.sid, {at_ms('x.ts')} AS ts, coalesce(s.is_open, -1) AS is_open FROM er x ASOF LEFT JOIN s2 s ON x.sid = s.sid AND x.ts >= s.ts", "er AS (SELECT DISTINCT sid, ts FROM ev WHERE event_type = 'VideoError')",
    f"c2 AS (SELECT sid, ts, min(CASE WHEN event_type IN ('AppBackgrounded','VideoSessionEnd') OR event IN {PAUSE} THEN 0 WHEN event_type IN ('VideoSessionStart','VideoPlay','AppForegrounded') OR event IN {RESUME} THEN 1 END) AS c FROM ev WHERE event_type <> 'VideoError' GROUP BY sid, ts)",
    "s2 AS (SELECT sid, ts, coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY sid ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS is_open FROM c2)")
ORACLES["fill_interpolate"] = sql(f"SELECT {at('t * 60')} AS t, v AS value FROM se", series(START, END, {"country": "US"}))
ORACLES["union_distinct_spine"] = sql("SELECT platform, country FROM ev UNION SELECT platform, country FROM sr")
ORACLES["latest_version"] = sql("SELECT sid, ts AS version, event_type, event FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY ts DESC, event_type DESC, event DESC) AS k FROM ev) WHERE k = 1")
_SETS = "ls AS (SELECT sid, min(m) AS a, max(m) AS b FROM (SELECT *, m - row_number() OVER (PARTITION BY sid ORDER BY m) AS g FROM (SELECT DISTINCT sid, unnest(range(s // 60, (s + greatest(e - s - 1, 0)) // 60 + 1)) AS m FROM ivl)) GROUP BY sid, g)"
ORACLES["set_comparison"] = sql("SELECT (SELECT count(*) FROM (SELECT sid, run_start, run_end FROM sr EXCEPT ALL SELECT sid, a, b FROM ls)) AS strict_only, (SELECT count(*) FROM (SELECT sid, a, b FROM ls EXCEPT ALL SELECT sid, run_start, run_end FROM sr)) AS loose_only", _SETS)
ORACLES["day_times_generations"] = sql("SELECT event_type, 3 * count(*) AS events, 3 * count(DISTINCT sid) AS sessions, min(ts) AS first, max(ts) + 7200000 AS last FROM ev GROUP BY event_type")
ORACLES["content_csv_round_trip"] = sql("SELECT content_id, title, video_type, category, show_name FROM ct")
ORACLES["slice_export"] = sql(f"SELECT ts // 3600000 AS slice, count(*) AS events, count(DISTINCT sid) AS sessions, {at_ms('min(ts)')} AS first, {at_ms('max(ts)')} AS last FROM ev WHERE ts <= {CUT} GROUP BY 1")
_COLS = {"sid": "string", "user_id": "string", "event_type": "string", "event": "string", "ts": "bigint", "arrival": "bigint", "session_start": "bigint", "content_id": "bigint", **{c: "string" for c in ("platform", "country", "app_version", "audio_language", "subtitle_language", "player_version", "video_resolution")}}
ORACLES["inspect_events"] = sql(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*) AS rows, count(*) - count({c}) AS nulls FROM ev" for c, t in _COLS.items()))
_TOP = "SELECT * FROM (SELECT '{0}' AS what, ({1})::VARCHAR AS value, count(*) AS minutes FROM {2} GROUP BY 2 ORDER BY minutes DESC, value LIMIT 1)"
ORACLES["busiest"] = sql(" UNION ALL ".join([_TOP.format("day", "rs // 1440", "(SELECT sr.run_start AS rs, unnest(range(run_start, run_end + 1)) FROM sr)"), *[_TOP.format(n, c, "mi") for n, c in (("platform", "platform"), ("country", "country"), ("content", "content_id"))]]))
