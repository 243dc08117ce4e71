"""The same queries as SQL over the view ``events``.

The texts follow the definitions, not the plans: plain windows, range joins and epochs.
"""

from __future__ import annotations

_EV = "ev AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, event_type AS topic FROM events)"

_LOG = """routed AS (SELECT * FROM ev WHERE topic IN ('click', 'purchase', 'view')),
log AS (SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY ts, event_id) - 1 AS BIGINT) AS "offset"
        FROM routed)"""

_FLIGHTS = """flights AS (
  SELECT topic, CAST("offset" // 5 AS BIGINT) AS flight, CAST(count(*) AS BIGINT) AS n,
         arg_min(event_id, "offset") AS first_event, arg_max(event_id, "offset") AS last_event, max(ts) AS fts
  FROM log GROUP BY 1, 2)"""

# Each of four equal time spans is one micro-batch, which is cut into flights of its own.
_BATCHES = """bounds AS (SELECT min(epoch_us(ts)) AS lo, (max(epoch_us(ts)) - min(epoch_us(ts))) // 4 + 1 AS width FROM ev),
arrived AS (SELECT log.*, (epoch_us(ts) - lo) // width AS batch FROM log, bounds),
drained AS (SELECT *, (row_number() OVER (PARTITION BY topic, batch ORDER BY ts, event_id) - 1) // 5 AS chunk FROM arrived),
flights AS (
  SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY batch, chunk) - 1 AS BIGINT) AS flight, n, fts, ids
  FROM (SELECT topic, batch, chunk, CAST(count(*) AS BIGINT) AS n, max(ts) AS fts,
          string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS ids
        FROM drained GROUP BY 1, 2, 3))"""

_CTL = """ctl AS (
  SELECT event_id AS seq, ts,
         CASE WHEN event_type = 'signup' THEN 'subscribe' WHEN event_type = 'error' THEN 'unsubscribe'
              WHEN k = 0 THEN 'add_topic' ELSE 'remove_topic' END AS action,
         CASE WHEN event_type = 'view' THEN ['click', 'purchase', 'view'][CAST(user_id % 3 AS INTEGER) + 1]
              ELSE ['click', 'purchase', 'view', 'bogus'][k % 4 + 1] END AS topic,
         CASE WHEN event_type <> 'view'
              THEN 'grpc://u' || CAST(user_id % 10 AS VARCHAR) || ':' || CAST(user_id % 10 * 8000 AS VARCHAR)
         END AS address
  FROM ev WHERE event_type IN ('signup', 'error') OR (event_type = 'view' AND k IN (0, 1))),
judged AS (
  SELECT *,
    action IN ('add_topic', 'remove_topic') AS is_topic,
    coalesce(try_cast(regexp_extract(address,
      '^(grpcs?://)?([a-zA-Z0-9.-]+|\\[[0-9a-fA-F:]+\\]):([0-9]{1,5})$', 3) AS INTEGER) BETWEEN 1 AND 65535,
      false) AS valid,
    coalesce(last_value(CASE WHEN action IN ('add_topic', 'remove_topic') THEN action END IGNORE NULLS)
      OVER (PARTITION BY topic ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
      CASE WHEN topic IN ('click', 'purchase', 'view') THEN 'add_topic' ELSE 'none' END) = 'add_topic' AS registered
  FROM ctl)"""


def _intervals(resets: str) -> str:
    return f"""epochs AS (
  SELECT *, count(*) FILTER ({resets}) OVER (PARTITION BY topic ORDER BY ts, seq) AS epoch,
         min(ts) FILTER ({resets})
           OVER (PARTITION BY topic ORDER BY ts, seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS reset_ts
  FROM judged),
accepted AS (
  SELECT *, lead(ts) OVER (PARTITION BY topic, epoch, address ORDER BY ts, seq) AS next_ts
  FROM epochs WHERE NOT is_topic AND valid AND registered),
intervals AS (
  SELECT topic, address, ts AS valid_from,
         least(coalesce(next_ts, TIMESTAMP '9999-01-01'), coalesce(reset_ts, TIMESTAMP '9999-01-01')) AS valid_to
  FROM accepted WHERE action = 'subscribe')"""


_INTERVALS = _intervals("is_topic")

_SESSIONS = """sess AS (
  SELECT event_id AS seq, ts, event_type = 'signup' AS connects, CAST(user_id AS VARCHAR) AS address,
         ['click', 'purchase', 'view'][k % 3 + 1] AS topic
  FROM ev WHERE event_type IN ('signup', 'error'))"""

_DELIVERIES = """deliveries AS (
  SELECT f.topic, f.flight, i.address, f.n FROM flights f JOIN intervals i
  ON f.topic = i.topic AND f.fts >= i.valid_from AND f.fts < i.valid_to)"""

_SLOTS = """span AS (SELECT date_trunc('hour', min(ts)) AS lo, date_diff('hour', min(ts), max(ts)) + 1 AS n FROM events),
hours AS (SELECT lo, unnest(range(n)) AS i FROM span),
grid AS (
  SELECT CAST(i AS BIGINT) AS slot, lo + to_hours(CAST(i AS INTEGER)) AS t,
         ['click', 'purchase', 'view'][CAST(i % 3 AS INTEGER) + 1] AS topic FROM hours),
placed AS (
  SELECT g.slot, g.t, g.topic, e.event_id, e.ts, e.value, e.props
  FROM grid g LEFT JOIN events e ON e.event_type = g.topic AND date_trunc('hour', e.ts) = g.t)"""

_OPS = """ops AS (
  SELECT event_id AS seq, ts, event_type = 'click' AS is_write, length(props) AS size
  FROM events WHERE event_type IN ('click', 'view')),
sums AS (SELECT *, sum(CASE WHEN is_write THEN 1 ELSE -1 END) OVER (ORDER BY ts, seq) AS s FROM ops),
depths AS (SELECT *, CAST(s - least(0, min(s) OVER (ORDER BY ts, seq)) AS BIGINT) AS depth FROM sums)"""

_REQUESTS = """committed AS (SELECT topic, CAST(max("offset") + 1 AS BIGINT) AS c FROM log GROUP BY 1),
asked AS (SELECT a.place, a.topic, c.c FROM (VALUES (0, 'click'), (1, 'purchase'), (2, 'view'), (3, 'bogus'))
          a(place, topic) LEFT JOIN committed c ON a.topic = c.topic),
requests AS (
  SELECT CAST(place * 8 + i - 1 AS BIGINT) AS request_id, topic, c,
         CAST([0, 4, coalesce(c, 0) - 101, coalesce(c, 0) - 100, coalesce(c, 0) - 1, coalesce(c, 0),
               coalesce(c, 0) + 5, -1][i] AS BIGINT) AS requested
  FROM asked, range(1, 9) r(i)),
plan AS (SELECT *, CASE WHEN c - requested > 100 THEN c - 100 WHEN c IS NOT NULL THEN requested END AS start
         FROM requests)"""

_MONEY = "DECIMAL(10,2)"
_TICKS = f"""ticks AS (
  SELECT event_id, ts AS "timestamp", event_type AS stock_symbol, CAST(value AS {_MONEY}) AS price, k AS volume,
         CAST(value AS {_MONEY}) AS bid_price, CAST(CAST(value AS {_MONEY}) + k / 100 AS {_MONEY}) AS ask_price,
         CAST(k / 100 AS {_MONEY}) AS spread, k FROM ev)"""


def _with(*parts: str, then: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + then


_EVENT = "event_id, ts, topic"
_READ_CSV = _with(
    _EV, _TICKS, then='SELECT "timestamp", stock_symbol, price, volume, bid_price, ask_price, spread FROM ticks'
)
_ROUTED = _with(_EV, then=f"SELECT {_EVENT} FROM ev WHERE topic IN ('click', 'purchase', 'view')")
_DEAD = _with(_EV, then=f"SELECT {_EVENT} FROM ev WHERE topic NOT IN ('click', 'purchase', 'view')")
_TAP = _with(_EV, then=f"SELECT {_EVENT} FROM ev WHERE topic = 'view'")
_OFFSETS = _with(_EV, _LOG, then=f'SELECT {_EVENT}, "offset" FROM log')
_READ = _with(
    _EV,
    _LOG,
    then=f"""SELECT {_EVENT}, "offset" FROM log
WHERE topic = 'view' AND "offset" >= greatest(4, (SELECT max("offset") + 1 FROM log WHERE topic = 'view') - 100)""",
)
_MEMBERS = _with(
    _EV,
    _CTL,
    _INTERVALS,
    then="SELECT topic, address FROM intervals WHERE valid_to = TIMESTAMP '9999-01-01'",
)
_FAN_OUT = _with(_EV, _LOG, _FLIGHTS, _CTL, _INTERVALS, _DELIVERIES, then="SELECT * FROM deliveries")
_CURRENT = """last_topic AS (SELECT topic, arg_max(action, (ts, seq)) AS action FROM ctl
  WHERE action IN ('add_topic', 'remove_topic') GROUP BY 1),
current AS (SELECT t.topic FROM (SELECT unnest(['click', 'purchase', 'view']) AS topic UNION SELECT topic FROM last_topic) t
  LEFT JOIN last_topic l ON t.topic = l.topic WHERE coalesce(l.action, 'add_topic') = 'add_topic')"""
_LATE_FILES = """files AS (SELECT event_id, strftime(ts, '%Y-%m-%d-%H') AS file, event_id % 1000 = 507 AS bad FROM events)"""
_FILES = """files AS (SELECT event_id, strftime(ts, '%Y-%m-%d-%H') AS file, event_id % 1000 = 7 AS bad FROM events)"""

ORACLE: dict[str, str] = {
    "read_ticks_csv": _READ_CSV,
    "stream_ticks_csv": _READ_CSV,
    "split_valid_ticks": _with(
        _EV,
        _TICKS,
        then='SELECT event_id, "timestamp", stock_symbol, price, volume, bid_price, ask_price, spread '
        "FROM ticks WHERE k > 3",
    ),
    "split_valid_ticks_rejected": _with(
        _EV,
        then="""SELECT event_id, ['stock_symbol_too_long', 'price_missing', 'volume_invalid', 'price_overflow'][k + 1]
  AS reason FROM ev WHERE k <= 3""",
    ),
    "file_atomic_accept": _with(
        _FILES, then="SELECT event_id, file FROM files WHERE file NOT IN (SELECT file FROM files WHERE bad)"
    ),
    "file_atomic_accept_strict": _with(
        _LATE_FILES, then="SELECT event_id, file FROM files WHERE file < (SELECT min(file) FROM files WHERE bad)"
    ),
    "with_surrogate_id": """SELECT CAST(row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS id, event_id, ts
FROM events""",
    "append_ticks": _with(
        _EV,
        _TICKS,
        then="""SELECT "timestamp", stock_symbol, price, volume, bid_price, ask_price, spread
  FROM ticks, range(2)""",
    ),
    "scan_count": "SELECT CAST(count(*) AS BIGINT) AS n_rows FROM events",
    "point_lookup": """SELECT event_id, ts, user_id, event_type, value, props FROM events
WHERE event_type = 'click' AND ts = (SELECT min(ts) FROM events WHERE event_type = 'click')""",
    "quote_spread": _with(
        _EV,
        _TICKS,
        then=f"""SELECT "timestamp", stock_symbol, bid_price, ask_price,
  CAST(round(ask_price - bid_price, 2) AS {_MONEY}) AS spread FROM ticks""",
    ),
    "tag_topic": _with(_EV, then=f"SELECT {_EVENT} FROM ev"),
    "drop_untagged": _with(_EV, then=f"SELECT {_EVENT} FROM ev WHERE k % 10 <> 0"),
    "route_registered": _ROUTED,
    "dead_letter": _DEAD,
    "topic_tap": _TAP,
    "partition_by_topic": _ROUTED,
    "skip_undecodable": _with(_EV, then="SELECT event_id, props AS body FROM ev WHERE k % 10 <> 9"),
    "skip_undecodable_skipped": _with(_EV, then="SELECT event_id, 'not json' AS body FROM ev WHERE k % 10 = 9"),
    "replay_slots": _with(
        _SLOTS, then="SELECT slot, t, topic, CAST(count(event_id) AS BIGINT) AS n_rows FROM placed GROUP BY ALL"
    ),
    "replay_rows": _with(_SLOTS, then=f"SELECT slot, {_EVENT} FROM placed WHERE event_id IS NOT NULL"),
    "replay_events": _with(
        _SLOTS,
        then="""SELECT slot, topic, CAST(0 AS BIGINT) AS part, CAST(1 AS BIGINT) AS n_parts,
  CAST(count(event_id) AS BIGINT) AS n_rows,
  arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event
  FROM placed GROUP BY 1, 2""",
    ),
    "parse_control": _with(
        _EV, _CTL, then="SELECT seq, address, topic, 'ok' AS parse_status FROM ctl WHERE address IS NOT NULL"
    ),
    "valid_endpoint": _with(
        _EV, _CTL, then="SELECT seq, address, valid FROM judged WHERE address IS NOT NULL"
    ),
    "control_responses": _with(
        _EV,
        _CTL,
        then="""SELECT seq, action, CASE WHEN valid AND registered THEN 'Success' ELSE 'error' END AS response
  FROM judged WHERE NOT is_topic""",
    ),
    "topics_current": _with(_EV, _CTL, _CURRENT, then="SELECT topic FROM current"),
    "topic_count": _with(_EV, _CTL, _CURRENT, then="SELECT CAST(count(*) AS BIGINT) AS n_topics FROM current"),
    "has_topic": _with(
        _EV,
        _CTL,
        _CURRENT,
        then="SELECT event_id, topic, topic IN (SELECT topic FROM current) AS registered FROM ev",
    ),
    "subscription_intervals": _with(_EV, _CTL, _INTERVALS, then="SELECT * FROM intervals"),
    "subscription_intervals_additive": _with(
        _EV, _CTL, _intervals("action = 'remove_topic'"), then="SELECT * FROM intervals"
    ),
    "subscribers_current": _MEMBERS,
    "stream_subscribers": _MEMBERS,
    "subscriber_lists": _with(
        _EV,
        _CTL,
        _INTERVALS,
        _CURRENT,
        """members AS (SELECT topic, address,
    row_number() OVER (PARTITION BY topic ORDER BY address) - 1 AS place, count(*) OVER (PARTITION BY topic) AS total
  FROM intervals WHERE valid_to = TIMESTAMP '9999-01-01')""",
        then="""SELECT t.topic, CAST(coalesce(place // 3, 0) AS BIGINT) AS page, CAST(count(address) AS BIGINT) AS n,
  coalesce(string_agg(address, ',' ORDER BY address), '') AS addresses,
  CAST(coalesce(any_value(total), 0) AS BIGINT) AS n_total,
  CAST(coalesce((any_value(total) + 2) // 3, 1) AS BIGINT) AS n_pages
  FROM (SELECT topic FROM current UNION SELECT topic FROM ctl) t LEFT JOIN members m ON t.topic = m.topic
  GROUP BY 1, 2""",
    ),
    "connect_sessions": _with(
        _EV,
        _SESSIONS,
        then="""SELECT topic, address, valid_from, least(coalesce(own, TIMESTAMP '9999-01-01'),
    coalesce(reset_ts, TIMESTAMP '9999-01-01')) AS valid_to
  FROM (SELECT topic, address, ts AS valid_from, connects,
          lead(ts) OVER (PARTITION BY topic, address ORDER BY ts, seq) AS own,
          min(ts) FILTER (connects) OVER (PARTITION BY topic ORDER BY ts, seq
            ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS reset_ts FROM sess)
  WHERE connects""",
    ),
    "connect_sessions_additive": _with(
        _EV,
        _SESSIONS,
        then="""SELECT topic, address, valid_from, coalesce(own, TIMESTAMP '9999-01-01') AS valid_to
  FROM (SELECT topic, address, ts AS valid_from, connects,
          lead(ts) OVER (PARTITION BY topic, address ORDER BY ts, seq) AS own FROM sess)
  WHERE connects""",
    ),
    "flight_batches": _with(_EV, _LOG, _FLIGHTS, then="SELECT * FROM flights"),
    "flight_rows": _with(
        _SLOTS,
        then="""SELECT topic, CAST(slot // 3 // 5 AS BIGINT) AS flight, CAST(slot // 3 AS BIGINT) AS number, event_id
  FROM placed WHERE event_id IS NOT NULL""",
    ),
    "fan_out": _FAN_OUT,
    "stream_fan_out": _with(_EV, _LOG, _BATCHES, _CTL, _INTERVALS, _DELIVERIES, then="SELECT * FROM deliveries"),
    "undelivered_flights": _with(
        _EV,
        _LOG,
        _FLIGHTS,
        _CTL,
        _INTERVALS,
        then="""SELECT topic, flight, n FROM flights f WHERE NOT EXISTS (SELECT 1 FROM intervals i
  WHERE i.topic = f.topic AND f.fts >= i.valid_from AND f.fts < i.valid_to)""",
    ),
    "delivery_outcomes": _with(
        _EV,
        _LOG,
        _FLIGHTS,
        _CTL,
        _INTERVALS,
        _DELIVERIES,
        then="""SELECT *, CASE WHEN flight % 40 = 39 THEN 'failed' ELSE 'delivered' END AS status FROM deliveries""",
    ),
    "prune_failed": _with(
        _EV,
        _LOG,
        _FLIGHTS,
        _CTL,
        _INTERVALS,
        _DELIVERIES,
        then="""SELECT topic, flight, address, n FROM (SELECT *, coalesce(sum(CASE WHEN flight % 40 = 39 THEN 1 ELSE 0 END)
    OVER (PARTITION BY topic, address ORDER BY flight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS failures
  FROM deliveries) WHERE failures = 0""",
    ),
    "columnar_json": _with(
        _SLOTS,
        then="""SELECT slot, topic, CAST(0 AS BIGINT) AS part, CAST(1 AS BIGINT) AS n_parts,
  coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id), '') AS event_ids,
  coalesce(string_agg(CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
    ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END, ',' ORDER BY ts, event_id), '') AS times,
  coalesce(string_agg(CASE WHEN CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 10 = 0 THEN 'null'
    ELSE CAST(CAST(value AS DECIMAL(18,6)) AS VARCHAR) END, ',' ORDER BY ts, event_id), '') AS vals
  FROM placed GROUP BY 1, 2""",
    ),
    "delivery_stats": _with(
        _EV,
        _LOG,
        _FLIGHTS,
        _CTL,
        _INTERVALS,
        _DELIVERIES,
        then="""SELECT topic, address, CAST(count(*) AS BIGINT) AS n_flights, CAST(sum(n) AS BIGINT) AS n_rows
  FROM deliveries GROUP BY 1, 2""",
    ),
    "assign_offsets": _OFFSETS,
    "committed_offsets": _with(
        _EV, _LOG, then='SELECT topic, CAST(max("offset") + 1 AS BIGINT) AS committed FROM log GROUP BY 1'
    ),
    "read_from_offset": _READ,
    "read_requests": _with(
        _EV,
        _LOG,
        _REQUESTS,
        then="""SELECT request_id, l.topic, l."offset", l.event_id FROM plan p
  JOIN log l ON p.topic = l.topic AND l."offset" >= p.start WHERE p.start >= 0""",
    ),
    "resume_plan": _with(
        _EV,
        _LOG,
        _REQUESTS,
        then="""SELECT request_id, topic, requested, start, c - requested AS lag, start - requested AS skipped,
  CASE WHEN c IS NULL THEN 'unknown_topic' WHEN start < 0 THEN 'error' WHEN start >= c THEN 'no_data'
       WHEN c - requested > 100 THEN 'clamped' ELSE 'ok' END AS status FROM plan""",
    ),
    "topic_volume": _with(
        _EV,
        _LOG,
        then="""SELECT topic, "offset", CAST(length(props) AS BIGINT) AS size,
  CAST(coalesce(sum(4 + length(props)) OVER (PARTITION BY topic ORDER BY "offset"
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte FROM log""",
    ),
    "queue_depth": _with(_OPS, then="SELECT seq, depth, depth >= 999 AS at_capacity FROM depths"),
    "byte_backlog": _with(
        _OPS,
        """marked AS (SELECT *, NOT is_write AND coalesce(lag(depth) OVER (ORDER BY ts, seq), 0) > 0 AS frees FROM depths),
numbered AS (SELECT *, sum(CASE WHEN is_write THEN 1 ELSE 0 END) OVER (ORDER BY ts, seq) AS w,
  sum(CASE WHEN frees THEN 1 ELSE 0 END) OVER (ORDER BY ts, seq) AS r FROM marked),
writes AS (SELECT w AS no, size FROM numbered WHERE is_write),
changes AS (SELECT n.seq, n.ts, CASE WHEN n.is_write THEN n.size WHEN n.frees THEN -w.size ELSE 0 END AS change
  FROM numbered n LEFT JOIN writes w ON n.frees AND n.r = w.no),
used AS (SELECT seq, CAST(sum(change) OVER (ORDER BY ts, seq) AS BIGINT) AS bytes_used FROM changes)""",
        then="SELECT seq, bytes_used, bytes_used * CAST(100.0 AS DOUBLE) / 104857600 AS pct FROM used",
    ),
    "stream_route": _ROUTED,
    "stream_dead_letter": _DEAD,
    "stream_assign_offsets": _OFFSETS,
    "stream_read_from_offset": _READ,
    "stream_topic_tap": _TAP,
    "stream_payloads": _with(
        _EV,
        _LOG,
        _BATCHES,
        then="SELECT topic, flight, ids AS event_ids, n AS n_ts FROM flights WHERE topic = 'view'",
    ),
}

ORACLE["stream_prune_failed"] = ORACLE["prune_failed"]
ORACLE["stream_control_responses"] = ORACLE["control_responses"]
ORACLE["stream_accept_files"] = _with(
    _FILES, then="SELECT event_id FROM files WHERE file NOT IN (SELECT file FROM files WHERE bad)"
)
ORACLE["stream_payloads_all"] = _with(_EV, _LOG, _BATCHES, then="SELECT topic, flight, ids AS event_ids, n AS n_ts FROM flights")
