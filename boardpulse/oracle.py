"""The registered queries once more, as SQL over the same test tables.

Written from the meaning of each result, statement by statement, without the shared
reductions the Spark plans use.
"""

from __future__ import annotations

DOMAIN = """
sessions AS (
  SELECT min(event_id) AS id, user_id,
         CASE WHEN event_type = 'signup' THEN 'LOGIN_PORTAL'
              ELSE 'https://bi.example/r/' || event_type END AS dashboard_url,
         CAST(ts - INTERVAL 3 HOUR AS DATE) AS session_date,
         min(ts) AS start_time, max(ts) AS last_ping,
         CASE WHEN event_type = 'signup' THEN 1 ELSE count(*) END AS duration_minutes
  FROM events
  GROUP BY user_id, event_type, CAST(ts - INTERVAL 3 HOUR AS DATE)),
users AS (
  SELECT c_custkey AS id, lower(c_name) AS username, c_name AS name,
         CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE lower(c_name) || '@example.com' END AS email,
         CASE WHEN c_custkey % 20 = 0 THEN 'admin' ELSE 'user' END AS role
  FROM customer),
positions AS (
  SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, n_regionkey = 0 AS can_view_metrics
  FROM nation),
user_positions AS (
  SELECT c_custkey AS user_id, CAST(c_nationkey AS BIGINT) AS position_id
  FROM customer WHERE c_custkey % 10 <> 9
  UNION
  SELECT c_custkey, CAST((c_nationkey + 7) % 25 AS BIGINT) FROM customer WHERE c_custkey % 3 = 0),
dashboard_types AS (
  SELECT CAST(r_regionkey + 1 AS BIGINT) AS id,
         CASE r_regionkey WHEN 0 THEN 'Ventas' WHEN 1 THEN 'Stock' WHEN 2 THEN 'Finanzas' WHEN 3 THEN 'Admin'
              ELSE r_name END AS name,
         CASE WHEN r_regionkey > 3 THEN lower(r_name) END AS description
  FROM region),
page_types AS (
  SELECT * FROM (VALUES ('click', 1), ('view', 1), ('view', 2), ('purchase', 3), ('error', 4)) v(page, type_id)),
dashboard_links AS (
  SELECT row_number() OVER (ORDER BY n_nationkey, type_id, page) AS id,
         CAST(n_nationkey AS BIGINT) AS position_id, CAST(type_id AS BIGINT) AS dashboard_type_id,
         'https://bi.example/r/' || page AS url
  FROM nation, page_types WHERE (n_nationkey + type_id) % 3 <> 0),
page_weight AS (SELECT url AS page, count(DISTINCT dashboard_type_id) AS weight FROM dashboard_links GROUP BY url),
sales_pages AS (
  SELECT url AS page, count(DISTINCT dashboard_type_id) AS weight FROM dashboard_links
  WHERE dashboard_type_id IN (SELECT id FROM dashboard_types WHERE name = 'Ventas') GROUP BY url),
page_names AS (
  SELECT DISTINCT links.url AS page, kinds.id AS kind, kinds.name
  FROM dashboard_links links, dashboard_types kinds
  WHERE kinds.id = links.dashboard_type_id AND kinds.name NOT IN ('Admin', 'Portal/login')),
holders AS (SELECT DISTINCT user_id AS holder FROM user_positions WHERE position_id = 7),
admins AS (SELECT id FROM users WHERE role = 'admin'),
period AS (SELECT * FROM sessions WHERE session_date BETWEEN DATE '2024-01-27' AND DATE '2024-01-29'),
before AS (SELECT * FROM sessions WHERE session_date BETWEEN DATE '2024-01-24' AND DATE '2024-01-26')
"""


def over(body: str, extra: str = "") -> str:
    return f"WITH {DOMAIN}{', ' + extra if extra else ''} {body}"


def totals(source: str, where: str = "TRUE", pages: str = "page_weight", unlisted: int = 1) -> str:
    """Every session counts as often as ``pages`` says, or ``unlisted`` times."""
    return f"""
      SELECT CAST(coalesce(sum(duration_minutes * times), 0) AS BIGINT) AS total_minutes,
             CAST(coalesce(sum(times), 0) AS BIGINT) AS total_sessions,
             count(DISTINCT user_id) FILTER (times > 0) AS unique_users
      FROM (SELECT user_id, duration_minutes,
                   coalesce((SELECT weight FROM {pages} WHERE page = dashboard_url), {unlisted}) AS times
            FROM {source} WHERE {where})"""


def tenth(top: str, bottom: str, factor: int = 1) -> str:
    """A non-negative ratio rounded half up to one place, in whole numbers."""
    return (
        f"CASE WHEN {bottom} = 0 THEN NULL ELSE "
        f"CAST(({top} * {20 * factor} + {bottom}) // (2 * {bottom}) AS DOUBLE) / 10.0 END"
    )


def change(now: str, then: str) -> str:
    """Change in percent rounded half away from zero, in whole numbers."""
    return (
        f"CASE WHEN {then} > 0 THEN CAST(sign({now} - {then}) * "
        f"((abs({now} - {then}) * 200 + {then}) // (2 * {then})) AS BIGINT) ELSE 0 END"
    )


NO_ADMINS = "user_id NOT IN (SELECT id FROM admins)"
HOLDS = "user_id IN (SELECT holder FROM holders)"


def adoption(where: str = "TRUE") -> str:
    return over(
        f"""
      SELECT total_users, active_users_30d, {tenth('active_users_30d', 'total_users', 100)} AS adoption_rate,
             total_users - active_users_30d AS inactive_users_count
      FROM (SELECT (SELECT count(*) FROM users) AS total_users,
                   (SELECT count(DISTINCT user_id) FROM sessions s
                    WHERE session_date >= DATE '2023-12-31' AND {where}) AS active_users_30d)"""
    )


def by_dashboard(where: str = "TRUE") -> str:
    return f"""
      SELECT name, CAST(sum(visits) AS BIGINT) AS count
      FROM page_names NATURAL JOIN (
        SELECT dashboard_url AS page, count(*) AS visits FROM period WHERE {where} GROUP BY dashboard_url)
      GROUP BY name"""


OVER_TIME = """
  SELECT d.date AS date, coalesce(c.n, 0) AS count
  FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-27', DATE '2024-01-29', INTERVAL 1 DAY)) AS DATE) AS date) d
  LEFT JOIN (SELECT session_date, count(id) AS n FROM period GROUP BY 1) c ON c.session_date = d.date"""

PER_USER = "SELECT user_id, count(*) AS n, sum(duration_minutes) AS spent FROM period GROUP BY user_id"

BY_POSITION = f"""
  SELECT name, CAST(sum(n) AS BIGINT) AS count
  FROM (SELECT id AS position_id, name FROM positions) NATURAL JOIN user_positions NATURAL JOIN ({PER_USER})
  GROUP BY name"""

ENGAGEMENT = f"""
  SELECT segment, count(*) AS user_count, min(n) AS least
  FROM ({PER_USER}), (VALUES ('1 Sesión', 1, 1), ('2-5 Sesiones', 2, 5), ('6-10 Sesiones', 6, 10),
                             ('+10 Sesiones', 11, 1000000000)) bounds(segment, low, high)
  WHERE n BETWEEN low AND high
  GROUP BY segment"""

TOP_USERS = f"""
  SELECT name, CAST(sum(n) AS BIGINT) AS sessions, CAST(sum(spent) AS BIGINT) AS minutes
  FROM (SELECT id AS user_id, name FROM users) NATURAL JOIN ({PER_USER})
  GROUP BY name ORDER BY 2 DESC, 1 LIMIT 10"""


def kpis(where: str = "TRUE", everywhere: str = "TRUE") -> str:
    """CTE list: cur, prev and one row ``k`` of all KPIs."""
    return f"""
      cur AS ({totals('period', f'{where} AND {everywhere}')}),
      prev AS ({totals('before', f'{where} AND {everywhere}')}),
      tops AS ({by_dashboard(everywhere)}),
      top AS (SELECT name, count FROM tops ORDER BY count DESC, name LIMIT 1),
      raw AS (
        SELECT cur.total_minutes AS cm, cur.total_sessions AS cs, cur.unique_users AS cu,
               prev.total_minutes AS pm, prev.total_sessions AS ps, prev.unique_users AS pu,
               (SELECT count(*) FROM users) AS people,
               (SELECT count(DISTINCT user_id) FROM sessions s
                WHERE session_date >= DATE '2023-12-31' AND {everywhere}) AS active
        FROM cur, prev),
      k AS (
        SELECT active AS active_users_30d, {tenth('active', 'people', 100)} AS adoption_rate,
               cs AS total_sessions, {tenth('cs', 'cu')} AS avg_sessions_user,
               {tenth('cm', 'cs')} AS avg_time_session,
               coalesce((SELECT name FROM top), 'N/A') AS top_name,
               coalesce((SELECT count FROM top), 0) AS top_count,
               people - active AS inactive_users_count,
               {change('cu', 'pu')} AS var_active_30d, {change('cs', 'ps')} AS var_sessions,
               {change('cm', 'pm')} AS var_time
        FROM raw)"""


def log(chosen: str, kept: str = "TRUE") -> str:
    """CTE list ending in ``trail``, the audit log."""
    return f"""
      newest AS (SELECT * FROM sessions s WHERE {chosen}
                 ORDER BY last_ping DESC NULLS FIRST, id DESC LIMIT 500),
      shown AS (SELECT url, coalesce(nullif(name, ''), 'Desconocido') AS shown_name
                FROM (SELECT l.url, t.name, row_number() OVER (PARTITION BY l.url ORDER BY l.id DESC) AS rn
                      FROM dashboard_links l LEFT JOIN dashboard_types t ON l.dashboard_type_id = t.id)
                WHERE rn = 1),
      trail AS (
        SELECT s.id, coalesce(nullif(u.name, ''), 'Usuario Desconocido') AS name, s.start_time, s.last_ping,
               coalesce(s.duration_minutes, 0) AS duration_minutes, s.dashboard_url,
               coalesce(shown_name, 'General') AS dashboard_name,
               coalesce((SELECT string_agg(p.name, ', ' ORDER BY p.id)
                         FROM user_positions up JOIN positions p ON up.position_id = p.id
                         WHERE up.user_id = s.user_id AND p.name <> ''), '') AS position_name
        FROM newest s JOIN users u ON s.user_id = u.id LEFT JOIN shown ON s.dashboard_url = shown.url
        WHERE s.dashboard_url <> 'LOGIN_PORTAL' AND u.role <> 'admin' AND {kept})"""


HELD = """
  held AS (
    SELECT up.user_id, string_agg(p.name, ', ' ORDER BY p.id) AS names,
           string_agg(CAST(p.id AS VARCHAR), ',' ORDER BY p.id) AS ids,
           bool_or(p.can_view_metrics) AS viewer,
           '[' || string_agg('{"id":' || p.id || ',"name":"' || p.name || '"}', ',' ORDER BY p.id) || ']' AS slim,
           '[' || string_agg('{"id":' || p.id || ',"name":"' || p.name || '","can_view_metrics":'
                             || CAST(p.can_view_metrics AS VARCHAR) || '}', ',' ORDER BY p.id) || ']' AS full_list
    FROM user_positions up JOIN positions p ON up.position_id = p.id GROUP BY 1)"""

# Raw events in time order per user, with the page they happened on (none on the login page).
ACTIVITY = """
  acts AS (
    SELECT user_id, ts, CASE WHEN event_type = 'signup' THEN NULL
                             ELSE 'https://bi.example/r/' || event_type END AS url
    FROM events),
  steps AS (
    SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, url NULLS FIRST) AS following FROM acts),
  ticks AS (
    SELECT user_id, url AS dashboard_url, make_timestamp(g * 30000000) AS ts
    FROM (SELECT user_id, url, unnest(range(
            epoch_us(ts) // 30000000 + 1,
            epoch_us(least(coalesce(following, ts + INTERVAL 300 SECOND), ts + INTERVAL 300 SECOND)) // 30000000 + 1
          )) AS g
          FROM steps WHERE url IS NOT NULL))"""


def islands(gap: str) -> str:
    return f"""
      marked AS (
        SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL {gap} THEN 0 ELSE 1 END AS opens
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      numbered AS (
        SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts
                                             ROWS UNBOUNDED PRECEDING) AS session FROM marked),
      stays AS (
        SELECT user_id, min(ts) AS session_start, max(ts) AS last_activity, count(*) AS activities
        FROM numbered GROUP BY user_id, session)"""


BREACHES = """
  breaches AS (
    SELECT user_id AS key, date_trunc('day', ts) AS window_start,
           date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
           count(*) AS requests, count(*) - 4 AS excess
    FROM events GROUP BY 1, 2, 3 HAVING count(*) > 4)"""

ROLLED = """
  SELECT user_id, 'https://bi.example/r/' || event_type AS dashboard_url,
         CAST(ts - INTERVAL 3 HOUR AS DATE) AS session_date,
         min(event_id) AS id, min(ts) AS start_time, max(ts) AS last_ping, count(*) AS duration_minutes
  FROM events WHERE event_type <> 'signup' GROUP BY ALL"""

TICKS_BY_DAY = """
  SELECT user_id, dashboard_url, CAST(ts - INTERVAL 3 HOUR AS DATE) AS session_date,
         min(ts) AS start_time, max(ts) AS last_ping, count(*) AS duration_minutes
  FROM ticks GROUP BY ALL"""

POSITION_CHANGES = """
  wanted AS (
    SELECT n_name AS name, c_acctbal > 0 AS flag, c_custkey AS seq
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL
    SELECT c_mktsegment, c_acctbal > 0, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
  latest AS (
    SELECT name, flag FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq DESC) AS rn FROM wanted)
    WHERE rn = 1),
  upserted AS (
    SELECT p.id, p.name, CASE WHEN l.name IS NULL THEN p.can_view_metrics ELSE l.flag END AS can_view_metrics
    FROM positions p LEFT JOIN latest l ON p.name = l.name
    UNION ALL
    SELECT (SELECT max(id) FROM positions) + row_number() OVER (ORDER BY name), name, flag
    FROM latest WHERE name NOT IN (SELECT name FROM positions))"""

GUARD = """
  guard AS (
    SELECT u.id AS position_id, count(up.user_id) AS assigned_users,
           CASE WHEN count(up.user_id) > 0 THEN 'blocked' ELSE 'deleted' END AS status
    FROM upserted u LEFT JOIN user_positions up ON up.position_id = u.id GROUP BY 1)"""

REQUESTS = """
  asked AS (
    SELECT lower(c_name) AS username,
           CASE WHEN c_acctbal < 0 THEN c_mktsegment WHEN c_mktsegment <> 'BUILDING' THEN n_name END AS position_name
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL
    SELECT lower(s_name), 'NATION_' || s_nationkey FROM supplier),
  resolved AS (
    SELECT a.username, a.position_name, u.id AS user_id, p.id AS position_id
    FROM asked a LEFT JOIN users u ON a.username = u.username LEFT JOIN positions p ON a.position_name = p.name
    WHERE a.position_name IS NOT NULL)"""

IN_DEBT = "(SELECT c_custkey FROM customer WHERE c_acctbal < 0)"

TOP_TYPE = f"""
  tops AS ({by_dashboard()}),
  doomed AS (SELECT id FROM dashboard_types
             WHERE name = (SELECT name FROM tops ORDER BY count DESC, name LIMIT 1))"""


TEXT_FIELDS = ("date", "name", "segment")


def json_rows(source: str, fields: str, order: str) -> str:
    """All rows of a query as one JSON array of objects with the named fields."""
    parts = []
    for field in fields.split():
        quote = '"' if field in TEXT_FIELDS else ""
        parts.append(f"'\"{field}\":{quote}' || {field} || '{quote}'")
    row = "'{' || " + " || ',' || ".join(parts) + " || '}'"
    return f"(SELECT '[' || coalesce(string_agg({row}, ',' ORDER BY {order}), '') || ']' FROM ({source}))"


DOCUMENT = f"""
  SELECT '{{"kpis":{{"active_users_30d":' || active_users_30d || ',"adoption_rate":' || adoption_rate
    || ',"total_sessions":' || total_sessions || ',"avg_sessions_user":' || avg_sessions_user
    || ',"avg_time_session":' || avg_time_session
    || ',"top_dashboard":{{"name":"' || top_name || '","count":' || top_count || '}}'
    || ',"inactive_users_count":' || inactive_users_count || ',"var_active_30d":' || var_active_30d
    || ',"var_sessions":' || var_sessions || ',"var_time":' || var_time || '}}'
    || ',"over_time":' || {json_rows(OVER_TIME, "date count", "date")}
    || ',"by_dashboard":' || {json_rows(by_dashboard(), "name count", "count DESC, name")}
    || ',"by_position":' || {json_rows(BY_POSITION, "name count", "count DESC, name")}
    || ',"engagement":' || {json_rows(ENGAGEMENT, "segment user_count", "least")}
    || ',"top_users":' || {json_rows(TOP_USERS, "name sessions minutes", "sessions DESC, name")}
    || '}}' AS document
  FROM k"""

SIGNED = "CASE WHEN {0} >= 0 THEN 'up' ELSE 'down' END"


def _card(place: int, label: str, value: str, change_column: str | None = None, note: str = "'---'") -> str:
    if change_column is None:
        moved, trend = "CAST(NULL AS BIGINT)", "CAST(NULL AS VARCHAR)"
    else:
        moved, trend, note = f"abs({change_column})", SIGNED.format(change_column), "CAST(NULL AS VARCHAR)"
    return (
        f"SELECT {place} AS position, '{label}' AS label, {value} AS value, "
        f"{moved} AS change_percent, {trend} AS trend, {note} AS note FROM k"
    )


def _shown(column: str) -> str:
    return f"regexp_replace(CAST(coalesce({column}, 0) AS VARCHAR), '\\.0$', '')"


CARDS = " UNION ALL ".join(
    [
        _card(1, "Activos (30d)", "CAST(active_users_30d AS VARCHAR)", "var_active_30d"),
        _card(2, "% Adopción", _shown("adoption_rate") + " || '%'"),
        _card(3, "Total Sesiones", "CAST(total_sessions AS VARCHAR)", "var_sessions"),
        _card(4, "Avg Sesiones", _shown("avg_sessions_user")),
        _card(5, "Avg Tiempo", _shown("avg_time_session") + " || 'm'", "var_time"),
        _card(6, "Top Tablero", "top_name", note="top_count || ' accesos'"),
        _card(7, "Inactivos", "CAST(inactive_users_count AS VARCHAR)"),
    ]
)


def _period_row(name: str, start: str, end: str, before_start: str, before_end: str, days: int) -> str:
    count = "(SELECT count(*) FROM sessions WHERE session_date BETWEEN DATE '{0}' AND DATE '{1}')"
    return (
        f"SELECT '{name}' AS period, DATE '{start}' AS curr_start, DATE '{end}' AS curr_end, "
        f"DATE '{before_start}' AS prev_start, DATE '{before_end}' AS prev_end, CAST({days} AS BIGINT) AS days, "
        f"{count.format(start, end)} AS sessions, {count.format(before_start, before_end)} AS sessions_before"
    )


PERIODS = " UNION ALL ".join(
    [
        _period_row("reset", "2024-01-23", "2024-01-30", "2024-01-15", "2024-01-22", 8),
        _period_row("this_month", "2024-01-01", "2024-01-31", "2023-12-01", "2023-12-31", 31),
        _period_row("30d", "2023-12-31", "2024-01-30", "2023-11-30", "2023-12-30", 31),
        _period_row("custom", "2024-01-27", "2024-01-29", "2024-01-24", "2024-01-26", 3),
    ]
)

def _doubled(check: str, key: str, source: str) -> str:
    return f"SELECT '{check}' AS check, {key} AS key, count(*) AS rows FROM {source} GROUP BY 2 HAVING count(*) > 1"


def _dangling(column: str, child: str, source: str, parent: str) -> str:
    return (
        f"SELECT '{child}.{column}', CAST({column} AS VARCHAR), count(*) FROM {source} "
        f"WHERE {column} NOT IN (SELECT id FROM {parent}) GROUP BY 2"
    )


FINDINGS = f"""
  left_users AS (SELECT * FROM users WHERE id NOT IN {IN_DEBT}
                 UNION ALL SELECT id + 1000000, username, name, email, role FROM users WHERE id % 50 = 1),
  all_positions AS (SELECT id, name FROM positions UNION ALL SELECT seq, name FROM wanted),
  all_pairs AS (SELECT * FROM user_positions UNION ALL SELECT * FROM user_positions WHERE user_id % 7 = 0
                UNION ALL SELECT user_id, 999 FROM user_positions WHERE user_id % 13 = 0),
  all_links AS (SELECT position_id, dashboard_type_id FROM dashboard_links
                UNION ALL SELECT 999, 99 FROM dashboard_links WHERE id % 5 = 0),
  all_sessions AS (SELECT * FROM sessions UNION ALL SELECT * FROM sessions WHERE user_id % 11 = 0),
  found AS (
    {_doubled('users.username', 'username', 'left_users')}
    UNION ALL {_doubled('positions.name', 'name', 'all_positions')}
    UNION ALL {_doubled('user_positions.pair', "user_id || '|' || position_id", 'all_pairs')}
    UNION ALL {_doubled('sessions.key', "user_id || '|' || dashboard_url || '|' || session_date", 'all_sessions')}
    UNION ALL {_dangling('user_id', 'user_positions', 'all_pairs', 'left_users')}
    UNION ALL {_dangling('position_id', 'user_positions', 'all_pairs', 'all_positions')}
    UNION ALL {_dangling('position_id', 'dashboard_links', 'all_links', 'all_positions')}
    UNION ALL {_dangling('dashboard_type_id', 'dashboard_links', 'all_links', 'dashboard_types')}
    UNION ALL {_dangling('user_id', 'sessions', 'all_sessions', 'left_users')})"""

DAY_FINDINGS = f"""
  left_users AS (SELECT * FROM users WHERE id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)),
  all_sessions AS (
    SELECT * FROM sessions UNION ALL
    SELECT * FROM sessions WHERE session_date = DATE '2024-01-27' AND user_id % 11 = 0),
  found AS (
    {_doubled('sessions.key', "user_id || '|' || dashboard_url || '|' || session_date", 'all_sessions')}
    UNION ALL {_dangling('user_id', 'sessions', 'all_sessions', 'left_users')})"""

LOADED = """
  all_positions AS (
    SELECT id, name FROM positions
    UNION ALL
    SELECT (SELECT max(id) FROM positions) + row_number() OVER (ORDER BY name), name
    FROM (SELECT DISTINCT c_mktsegment AS name FROM customer)),
  all_users AS (
    SELECT id, username FROM users
    UNION ALL
    SELECT (SELECT max(id) FROM users) + row_number() OVER (ORDER BY lower(s_name)), lower(s_name) FROM supplier),
  all_pairs AS (
    SELECT user_id, position_id FROM user_positions
    UNION
    SELECT u.id, p.id FROM supplier JOIN all_users u ON u.username = lower(s_name)
    JOIN all_positions p ON p.name = 'NATION_' || s_nationkey WHERE s_acctbal > 0),
  held AS (
    SELECT user_id, string_agg(p.name, ', ' ORDER BY p.id) AS names
    FROM all_pairs JOIN all_positions p ON position_id = p.id GROUP BY 1)"""

ENROLLED = """
  strangers AS (
    SELECT (SELECT max(id) FROM users) + row_number() OVER (ORDER BY lower(s_name)) AS id,
           lower(s_name) AS username, s_name AS name, s_nationkey FROM supplier WHERE s_acctbal > 0)"""

USER_FILTERS = {
    "none": ("TRUE", "page_weight", 1),
    "position": (HOLDS, "page_weight", 1),
    "dashboard": ("TRUE", "sales_pages", 0),
    "user": ("user_id = 7", "page_weight", 1),
    "no_admins": (NO_ADMINS, "page_weight", 1),
    "all": (f"{HOLDS} AND {NO_ADMINS}", "sales_pages", 0),
}
USERS_OF_PERIODS = " UNION ALL ".join(
    f"SELECT '{name}' AS filter, '{period}' AS period, unique_users FROM ({totals(source, where, pages, unlisted)})"
    for name, (where, pages, unlisted) in USER_FILTERS.items()
    for period, source in (("now", "period"), ("before", "before"))
)

ACTIVE_BY_DAY = f"""
  SELECT day, count(DISTINCT user_id) AS active_users
  FROM (SELECT DISTINCT session_date AS day FROM sessions) days
  LEFT JOIN sessions ON session_date BETWEEN day - 30 AND day AND {NO_ADMINS}
  GROUP BY day"""

ACTIVE_ESTIMATED = f"""
  SELECT TRUE AS with_admins, count(DISTINCT user_id) AS active_users, TRUE AS near
  FROM sessions WHERE session_date >= DATE '2023-12-31'
  UNION ALL
  SELECT FALSE, count(DISTINCT user_id), TRUE FROM sessions WHERE session_date >= DATE '2023-12-31' AND {NO_ADMINS}"""

REQUESTED = f"""
  asked AS (
    SELECT CAST(c_custkey AS BIGINT) AS request_id,
           CASE WHEN c_custkey % 10 <> 0 THEN DATE '2024-01-01' + CAST(c_custkey % 29 AS INTEGER) END AS low,
           CASE WHEN c_custkey % 8 <> 0 THEN DATE '2024-01-01' + CAST(c_custkey % 29 + c_custkey % 9 AS INTEGER) END AS high,
           CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS place,
           CASE c_custkey % 5 WHEN 0 THEN 'Ventas' WHEN 1 THEN 'Stock' WHEN 2 THEN 'Nada' END AS board,
           CASE WHEN c_custkey % 7 = 0 THEN c_custkey // 7 END AS person, c_custkey % 2 = 0 AS plain
    FROM customer),
  dated AS (
    SELECT * REPLACE (coalesce(low, coalesce(high, DATE '2024-01-30') - 7) AS low, coalesce(high, DATE '2024-01-30') AS high) FROM asked),
  both_periods AS (
    SELECT *, low AS a, high AS b, 'cur' AS period FROM dated UNION ALL
    SELECT *, low - CAST(high - low + 1 AS INTEGER), low - 1, 'prev' FROM dated),
  named_weight AS (
    SELECT name, url, count(DISTINCT dashboard_type_id) AS weight
    FROM dashboard_links JOIN dashboard_types t ON t.id = dashboard_type_id GROUP BY ALL),
  hits AS (
    SELECT request_id, period, s.user_id, s.duration_minutes,
           CASE WHEN board IS NULL THEN coalesce(p.weight, 1) ELSE coalesce(w.weight, 0) END AS times
    FROM both_periods r JOIN sessions s ON s.session_date BETWEEN a AND b
    LEFT JOIN page_weight p ON p.page = s.dashboard_url
    LEFT JOIN named_weight w ON w.name = r.board AND w.url = s.dashboard_url
    WHERE (person IS NULL OR s.user_id = person)
      AND (place IS NULL OR (s.user_id, place) IN (SELECT (user_id, position_id) FROM user_positions))
      AND (NOT plain OR {NO_ADMINS.replace("user_id", "s.user_id")})),
  summed AS (
    SELECT request_id,
           {", ".join(
               f"CAST(coalesce(sum(duration_minutes * times) FILTER (period = '{p}'), 0) AS BIGINT) AS {p}_total_minutes, "
               f"CAST(coalesce(sum(times) FILTER (period = '{p}'), 0) AS BIGINT) AS {p}_total_sessions, "
               f"count(DISTINCT user_id) FILTER (period = '{p}' AND times > 0) AS {p}_unique_users"
               for p in ("cur", "prev"))}
    FROM dated LEFT JOIN hits USING (request_id) GROUP BY request_id)"""

PER_REQUEST = f"""
  SELECT *, {tenth("cur_total_sessions", "cur_unique_users")} AS avg_sessions_user,
         {tenth("cur_total_minutes", "cur_total_sessions")} AS avg_time_session,
         {change("cur_unique_users", "prev_unique_users")} AS var_users,
         {change("cur_total_sessions", "prev_total_sessions")} AS var_sessions,
         {change("cur_total_minutes", "prev_total_minutes")} AS var_time
  FROM summed"""

PING_LINES = """
  lines AS (
    SELECT CASE WHEN event_id % 19 = 0 THEN 'malformed' WHEN event_id % 17 = 0 OR user_id IS NULL THEN 'no user'
                WHEN event_id % 13 = 0 THEN 'no page' ELSE 'accepted' END AS outcome,
           user_id, event_type, ts
    FROM events)"""

REPLAYED = """
  SELECT user_id, page AS dashboard_url, CAST(ts - INTERVAL 3 HOUR AS DATE) AS session_date,
         min(ts) AS start_time, max(ts) AS last_ping,
         CASE WHEN page = 'LOGIN_PORTAL' THEN 1 ELSE count(*) END AS duration_minutes, count(*) AS pings
  FROM (SELECT user_id, ts, CASE WHEN outcome = 'no page' THEN 'https://bi.example/r/lost'
                                 WHEN event_type = 'signup' THEN 'LOGIN_PORTAL'
                                 ELSE 'https://bi.example/r/' || event_type END AS page
        FROM lines WHERE outcome IN ('accepted', 'no page'))
  GROUP BY user_id, page, CAST(ts - INTERVAL 3 HOUR AS DATE)"""

ORACLE: dict[str, str] = {
    "period_bounds": over(PERIODS),
    "base_kpis": over(totals("period")),
    "base_kpis_by_position": over(totals("period", HOLDS)),
    "base_kpis_by_dashboard": over(totals("period", "TRUE", "sales_pages", 0)),
    "base_kpis_by_user": over(totals("period", "user_id = 7")),
    "base_kpis_no_admins": over(totals("period", NO_ADMINS)),
    "base_kpis_previous": over(totals("before")),
    "adoption": adoption(),
    "adoption_no_admins": adoption(NO_ADMINS),
    "usage_averages": over("SELECT avg_sessions_user, avg_time_session FROM k", kpis()),
    "usage_variation": over("SELECT var_active_30d, var_sessions, var_time FROM k", kpis()),
    "top_dashboard": over("SELECT top_name AS name, top_count AS count FROM k", kpis()),
    "sessions_over_time": over(OVER_TIME),
    "sessions_by_dashboard": over(by_dashboard()),
    "sessions_by_dashboard_no_admins": over(by_dashboard(NO_ADMINS)),
    "sessions_by_position": over(BY_POSITION),
    "engagement_histogram": over(
        f"""SELECT segment, user_count, CAST(user_count AS DOUBLE) / CAST(active AS DOUBLE) * 100.0 AS share
            FROM ({ENGAGEMENT}), (SELECT count(DISTINCT user_id) AS active FROM sessions
                                  WHERE session_date >= DATE '2023-12-31')"""
    ),
    "top_users": over(TOP_USERS),
    "report_kpis": over("SELECT * FROM k", kpis(HOLDS, NO_ADMINS)),
    "report_kpis_from_text": over("SELECT * FROM k", kpis(HOLDS, NO_ADMINS)),
    "position_rows_written": over(BY_POSITION),
    "report_document": over(DOCUMENT, kpis()),
    "kpi_cards": over(CARDS, kpis()),
    "unique_users_of_periods": over(USERS_OF_PERIODS),
    "active_users_by_day": over(ACTIVE_BY_DAY),
    "adoption_from_bitmaps": adoption(),
    "adoption_from_bitmaps_no_admins": adoption(NO_ADMINS),
    "active_users_estimated": over(ACTIVE_ESTIMATED),
    "audit_log": over("SELECT * FROM trail", log("TRUE")),
    "base_kpis_of_requests": over(PER_REQUEST, REQUESTED),
    "ping_line_outcomes_stream": over("SELECT outcome, count(*) AS lines FROM lines GROUP BY outcome", PING_LINES),
    "replayed_pings_stream": over(REPLAYED, PING_LINES),
    "audit_log_newest_days": over("SELECT * FROM trail", log("TRUE")),
    "audit_log_of_user_newest_days": over(
        "SELECT * FROM trail", log("session_date >= DATE '2024-01-27' AND user_id = 7")
    ),
    "audit_log_filtered": over(
        "SELECT * FROM trail",
        log(
            "session_date BETWEEN DATE '2024-01-27' AND DATE '2024-01-29'",
            f"coalesce(shown_name, 'General') = 'Ventas' AND {HOLDS}",
        ),
    ),
    "audit_log_of_user": over(
        "SELECT * FROM trail", log("session_date >= DATE '2024-01-27' AND user_id = 7")
    ),
    "recent_activity": over(
        """SELECT id, name, position_name, dashboard_name,
                  CASE WHEN duration_minutes = 0 THEN 1 ELSE duration_minutes END AS minutes,
                  strftime(start_time - INTERVAL 3 HOUR, '%H:%M | %d/%m') AS time_label
           FROM (SELECT * FROM trail ORDER BY last_ping DESC NULLS FIRST, id DESC LIMIT 15)""",
        log("session_date BETWEEN DATE '2024-01-27' AND DATE '2024-01-29'"),
    ),
    "user_profiles": over(
        """SELECT id, username, name, role, coalesce(full_list, '[]') AS positions,
                  coalesce(viewer, FALSE) AS can_view_metrics, names AS position_name
           FROM users LEFT JOIN held ON id = user_id""",
        HELD,
    ),
    "metrics_viewers": over(
        """SELECT id, username, name, role FROM users LEFT JOIN held ON id = user_id
           WHERE role = 'admin' OR coalesce(viewer, FALSE)""",
        HELD,
    ),
    "user_dashboards": over(
        """SELECT up.user_id, l.url AS dashboard_url,
                  CASE WHEN t.id IS NULL THEN 'Sin Nombre' ELSE t.name END AS dashboard_name
           FROM user_positions up JOIN dashboard_links l ON up.position_id = l.position_id
           LEFT JOIN dashboard_types t ON l.dashboard_type_id = t.id"""
    ),
    "user_directory": over(
        """SELECT id, username, name, email, role, coalesce(slim, '[]') AS positions,
                  coalesce(ids, '') AS position_ids, coalesce(names, '') AS position_name
           FROM users LEFT JOIN held ON id = user_id""",
        HELD,
    ),
    "link_matrix": over(
        """SELECT l.id, l.position_id, l.dashboard_type_id, l.url, p.name AS position_name, t.name AS type_name,
                  substring(l.url, 1, 100) || '...' AS url_preview
           FROM dashboard_links l LEFT JOIN positions p ON l.position_id = p.id
           LEFT JOIN dashboard_types t ON l.dashboard_type_id = t.id"""
    ),
    "position_catalog": over("SELECT * FROM positions"),
    "type_catalog": over("SELECT id, name, description FROM dashboard_types"),
    "links_of_types": over(
        """SELECT id, name, (SELECT count(*) FROM dashboard_links WHERE dashboard_type_id = kinds.id) AS links
           FROM dashboard_types kinds"""
    ),
    "users_of_position": over(
        "SELECT * FROM users WHERE id IN (SELECT user_id FROM user_positions WHERE position_id = 7)"
    ),
    "types_of_position": over(
        "SELECT * FROM dashboard_types WHERE id IN (SELECT dashboard_type_id FROM dashboard_links WHERE position_id = 7)"
    ),
    "session_rollup": ROLLED,
    "login_rollup": over(
        """SELECT user_id, dashboard_url, session_date, id, start_time, last_ping, duration_minutes
           FROM sessions WHERE dashboard_url = 'LOGIN_PORTAL'"""
    ),
    "engaged_ticks": f"WITH {ACTIVITY} SELECT * FROM ticks",
    "engaged_sessions": f"WITH {ACTIVITY} {TICKS_BY_DAY}",
    "idle_sessions": f"WITH {islands('6 HOUR')} SELECT * FROM stays",
    "idle_sessions_five_minutes": f"WITH {islands('5 MINUTE')} SELECT * FROM stays",
    "rate_breaches": f"WITH {BREACHES} SELECT * FROM breaches",
    "login_breaches": """
      SELECT user_id, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
             count(*) AS requests, count(*) - 1 AS excess
      FROM events WHERE event_type = 'signup' GROUP BY 1, 2, 3 HAVING count(*) > 1""",
    "session_rollup_stream": over("SELECT * FROM sessions"),
    "closed_day_sessions_stream": over(
        """SELECT user_id, dashboard_url, session_date, start_time, last_ping, duration_minutes
           FROM sessions WHERE session_date <= DATE '2024-01-30'"""
    ),
    "engaged_ticks_stream": f"WITH {ACTIVITY} SELECT * FROM ticks",
    "idle_sessions_stream": f"WITH {islands('6 HOUR')} SELECT * FROM stays",
    "rate_breaches_stream": f"WITH {BREACHES} SELECT * FROM breaches",
    "blank_pings_refused": over("SELECT * FROM sessions WHERE dashboard_url NOT IN ('LOGIN_PORTAL', 'https://bi.example/r/error')"),
    "blank_pings_refused_stream": over("SELECT * FROM sessions WHERE dashboard_url <> 'https://bi.example/r/error'"),
    "stored_sessions_report": over(
        """SELECT session_date, count(*) AS sessions, CAST(sum(duration_minutes) AS BIGINT) AS minutes FROM period
           WHERE session_date > DATE '2024-01-27' OR user_id % 2 = 0 GROUP BY session_date"""
    ),
    "audit_log_complete": over("SELECT * FROM trail", log("TRUE", HOLDS).replace("LIMIT 500", "")),
    "upsert_positions": over("SELECT * FROM upserted", POSITION_CHANGES),
    "upsert_users": over(
        f"""SELECT id, username, name, email, CASE WHEN id IN {IN_DEBT} THEN 'admin' ELSE role END AS role FROM users
            UNION ALL
            SELECT (SELECT max(id) FROM users) + row_number() OVER (ORDER BY lower(s_name)), lower(s_name), s_name,
                   NULL, 'user' FROM supplier"""
    ),
    "update_users": over(
        f"""SELECT id, username, name,
                   CASE WHEN id IN {IN_DEBT} THEN username || '@new.example' ELSE email END AS email, role
            FROM users"""
    ),
    "assign_positions": over(
        """SELECT user_id, position_id FROM user_positions
           UNION
           SELECT user_id, position_id FROM resolved WHERE user_id IS NOT NULL AND position_id IS NOT NULL""",
        REQUESTS,
    ),
    "assign_positions_unresolved": over(
        "SELECT * FROM resolved WHERE user_id IS NULL OR position_id IS NULL", REQUESTS
    ),
    "replace_assignments": over(
        """SELECT user_id, position_id FROM user_positions
           WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING')
           UNION ALL
           SELECT c_custkey, CAST(c_nationkey AS BIGINT) FROM customer WHERE c_acctbal < 0
           UNION ALL
           SELECT c_custkey, CAST((c_nationkey + 1) % 25 AS BIGINT) FROM customer WHERE c_acctbal < 0"""
    ),
    "load_directory": over(
        "SELECT id, username, names AS position_name FROM all_users LEFT JOIN held ON id = user_id", LOADED
    ),
    "load_directory_unresolved": """
      SELECT lower(s_name) AS username, 'NOWHERE' AS position_name FROM supplier WHERE NOT s_acctbal > 0""",
    "enroll_users": over(
        """SELECT id, username, name, email, role FROM users
           UNION ALL SELECT id, username, name, NULL, 'user' FROM strangers""",
        ENROLLED,
    ),
    "enroll_users_positions": over(
        """SELECT user_id, position_id FROM user_positions
           UNION ALL SELECT id, CAST(s_nationkey AS BIGINT) FROM strangers
           UNION ALL SELECT id, CAST((s_nationkey + 1) % 25 AS BIGINT) FROM strangers""",
        ENROLLED,
    ),
    "enroll_users_rejected": over(
        """SELECT lower(s_name) AS username, 'Missing required fields: name' AS reason
           FROM supplier WHERE NOT s_acctbal > 0
           UNION ALL SELECT username, 'Username already exists' FROM users"""
    ),
    "revise_users": over(
        f"""SELECT id, username, CASE WHEN id IN {IN_DEBT} THEN upper(name) ELSE name END AS name,
                   CASE WHEN id IN {IN_DEBT} THEN NULL ELSE email END AS email,
                   CASE WHEN id IN {IN_DEBT} THEN 'user' ELSE role END AS role
            FROM users"""
    ),
    "revise_users_positions": over(
        f"""SELECT user_id, position_id FROM user_positions WHERE user_id NOT IN {IN_DEBT}
            UNION ALL
            SELECT c_custkey, CAST((c_nationkey + 1) % 25 AS BIGINT) FROM customer
            WHERE c_acctbal < 0 AND c_mktsegment <> 'BUILDING'"""
    ),
    "revise_users_unknown": """
      SELECT -1 - c_custkey AS id, lower(c_name) AS username, upper(c_name) AS name,
             CAST(NULL AS VARCHAR) AS email, 'user' AS role
      FROM customer WHERE c_acctbal < 0""",
    "purge_users": over(f"SELECT * FROM users WHERE id NOT IN {IN_DEBT}"),
    "purge_users_positions": over(f"SELECT * FROM user_positions WHERE user_id NOT IN {IN_DEBT}"),
    "purge_users_sessions": over(f"SELECT * FROM sessions WHERE user_id NOT IN {IN_DEBT}"),
    "purge_users_stored_sessions": over(f"SELECT * FROM sessions WHERE user_id NOT IN {IN_DEBT}"),
    "purge_types": over("SELECT * FROM dashboard_types WHERE id NOT IN (SELECT id FROM doomed)", TOP_TYPE),
    "purge_types_links": over(
        "SELECT * FROM dashboard_links WHERE dashboard_type_id NOT IN (SELECT id FROM doomed)", TOP_TYPE
    ),
    "delete_guard": over("SELECT * FROM guard", f"{POSITION_CHANGES}, {GUARD}"),
    "delete_positions": over(
        "SELECT * FROM upserted WHERE id IN (SELECT position_id FROM guard WHERE status = 'blocked')",
        f"{POSITION_CHANGES}, {GUARD}",
    ),
    "integrity_of_changed_days": over("SELECT * FROM found", f"{DAY_FINDINGS}"),
    "integrity_audit": over("SELECT * FROM found", f"{POSITION_CHANGES}, {FINDINGS}"),
    "drop_legacy": over("SELECT * FROM users"),
    "credentials_ready": over("SELECT * FROM users WHERE email IS NOT NULL"),
    "credentials_rejected": over("SELECT *, 'email' AS missing_fields FROM users WHERE email IS NULL"),
    "update_links": over(
        """SELECT id, position_id, dashboard_type_id,
                  CASE WHEN id % 3 = 0 THEN 'https://moved.example/' || id ELSE url END AS url FROM dashboard_links"""
    ),
    "delete_links": over("SELECT * FROM dashboard_links WHERE id % 3 <> 0"),
    "update_types": over(
        """SELECT id, coalesce((SELECT n_name FROM nation WHERE n_nationkey = id), name) AS name, description
           FROM dashboard_types"""
    ),
    "update_positions": over("SELECT id, name, can_view_metrics OR id % 3 = 0 AS can_view_metrics FROM positions"),
    "upsert_without_order": over(
        """SELECT id, username, name, CASE WHEN id % 4 IN (1, 2) THEN 'a@x.example' ELSE email END AS email, role
           FROM users"""
    ),
    "upsert_conflicts": "SELECT lower(c_name) AS username, CAST(2 AS BIGINT) AS changes FROM customer WHERE c_custkey % 4 = 0",
    "revise_users_rejected": """
      SELECT c_custkey AS id, 'Username already exists' AS reason FROM customer WHERE c_custkey % 5 < 2
      UNION ALL SELECT c_custkey, 'Unknown position: 99' FROM customer WHERE c_custkey % 5 = 2""",
}
