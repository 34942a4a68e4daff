"""Statements for the event, conversation and text jobs."""

from __future__ import annotations


def admission(
    keys: str, limit: int, window: str, strict: bool, flag: str, source: str = "events"
) -> str:
    """Event by event per key: the recursion carries the accepted times that may still count."""
    live = f"x > n.ts - INTERVAL {window}" if strict else f"x >= n.ts - INTERVAL {window}"
    same = " AND ".join(f"n.{key} = f.{key}" for key in keys.split(", "))
    return f"""
WITH RECURSIVE numbered AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts, event_id) AS n FROM {source}),
fold AS (
  SELECT {keys}, event_id AS id, n, true AS accepted, [ts] AS alive FROM numbered WHERE n = 1
  UNION ALL
  SELECT {', '.join('n.' + key for key in keys.split(', '))}, n.event_id, n.n,
         len(list_filter(f.alive, lambda x: {live})) < {limit},
         CASE WHEN len(list_filter(f.alive, lambda x: {live})) < {limit}
              THEN list_append(list_filter(f.alive, lambda x: {live}), n.ts)
              ELSE list_filter(f.alive, lambda x: {live}) END
  FROM fold f JOIN numbered n ON {same} AND n.n = f.n + 1)
SELECT id AS event_id, NOT accepted AS {flag} FROM fold"""


def sessions(keys: str, idle: str) -> str:
    return f"""
SELECT {keys}, min(ts) AS session_start, max(ts) AS last_event, count(*) AS event_count
FROM (SELECT *, sum(starts) OVER (PARTITION BY {keys} ORDER BY ts, event_id) AS session
      FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY {keys} ORDER BY ts, event_id)
                           <= INTERVAL {idle} THEN 0 ELSE 1 END AS starts FROM events))
GROUP BY {keys}, session"""


_TWICE = "(SELECT * FROM events UNION ALL SELECT * FROM events)"


def redelivered_duplicates() -> str:
    marked = admission("event_id", 1, "5 MINUTE", False, "is_duplicate", _TWICE)
    return f"""
SELECT event_id, count(*) AS deliveries, CAST(count(*) FILTER (is_duplicate) AS BIGINT) AS duplicates
FROM ({marked}) GROUP BY event_id"""


def redelivered_limits(limit: int, window: str) -> str:
    marked = admission("user_id", limit, window, True, "is_limited", _TWICE)
    return f"""
SELECT event_id, count(*) AS requests, CAST(count(*) FILTER (is_limited) AS BIGINT) AS limited
FROM ({marked}) GROUP BY event_id"""


def bound_sql() -> str:
    return """
SELECT c_mktsegment AS membership_type, count(*) AS customers
FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY ALL"""


def truncated_history(limit: int) -> str:
    return f"""
WITH placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place,
         count(*) OVER (PARTITION BY conv_id) AS total FROM conversations),
cuts AS (
  SELECT conv_id, min(place) AS cut FROM placed
  WHERE total > {limit} AND place >= total - {limit} AND role = 'user' GROUP BY conv_id)
SELECT conv_id, turn, role, text FROM placed LEFT JOIN cuts USING (conv_id)
WHERE place >= coalesce(cut, 0)"""


MESSAGES = """
  SELECT 'E' || conv_id || '-' || turn AS event_id, 'C' || conv_id AS channel,
         CASE WHEN role = 'system' THEN 'channel' ELSE 'im' END AS channel_type,
         CASE WHEN role = 'assistant' THEN 'bot_message' END AS subtype,
         CAST(turn AS VARCHAR) AS ts, CASE WHEN turn <> 0 THEN '0' END AS thread_ts,
         CASE WHEN turn = 0 THEN ' <@U0> ' || text || ' ' ELSE text END AS text
  FROM conversations"""


def intake(limit: int) -> str:
    """Every delivery comes twice at the same second, so each question is new once."""
    return rf"""
WITH RECURSIVE asked AS (
  SELECT event_id, CAST(ts AS BIGINT) AS sent, channel || ':' || coalesce(thread_ts, ts) AS thread_key,
         CASE WHEN channel_type <> 'im' THEN NULL ELSE 'U' || substr(channel, 2) END AS sender,
         CASE WHEN channel_type = 'im' THEN text
              ELSE trim(regexp_replace(text, '^\s*<@[^>]+>\s*', ''), ' ' || chr(9) || chr(10) || chr(13)) END AS question
  FROM ({MESSAGES}) WHERE subtype IS NULL AND text <> '' AND (channel_type = 'im' OR text LIKE '%<@_%>%')),
placed AS (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY sent, event_id) AS n FROM asked WHERE sender IS NOT NULL),
fold AS (
  SELECT sender, event_id, n, false AS is_limited, [sent] AS alive FROM placed WHERE n = 1
  UNION ALL
  SELECT p.sender, p.event_id, p.n, len(list_filter(f.alive, lambda x: x > p.sent - 60)) >= {limit},
         CASE WHEN len(list_filter(f.alive, lambda x: x > p.sent - 60)) < {limit} THEN list_append(f.alive, p.sent) ELSE f.alive END
  FROM fold f JOIN placed p ON p.sender = f.sender AND p.n = f.n + 1)
SELECT event_id, thread_key, question, coalesce(is_limited, false) AS is_limited
FROM asked LEFT JOIN (SELECT event_id, is_limited FROM fold) USING (event_id)"""


def remembered(limit: int, messages: int) -> str:
    return f"""
SELECT event_id, thread_key, question FROM ({intake(limit)}) WHERE NOT is_limited
QUALIFY row_number() OVER (
  PARTITION BY thread_key ORDER BY CAST(split_part(event_id, '-', 2) AS BIGINT) DESC) <= {messages}"""


def intake_remembered(limit: int, messages: int) -> str:
    """Questions come at most a minute apart in their thread, so none is idle."""
    return f"""
SELECT event_id, thread_key, question, is_limited,
       CASE WHEN NOT is_limited THEN least({messages}, count(*) FILTER (NOT is_limited) OVER (
         PARTITION BY thread_key ORDER BY CAST(split_part(event_id, '-', 2) AS BIGINT))) END AS history_length
FROM ({intake(limit)})"""


def remembered_turns(limit: int) -> str:
    """Turn by turn: the kept ones as a list, cut at the first user turn among the newest ones."""
    return f"""
WITH RECURSIVE placed AS (
  SELECT conv_id, turn, role = 'user' AS clean, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n
  FROM conversations),
fold AS (
  SELECT conv_id, turn, n, [{{'turn': turn, 'clean': clean}}] AS kept FROM placed WHERE n = 1
  UNION ALL
  SELECT conv_id, turn, n, CASE WHEN len(k) > {limit} AND cut IS NOT NULL THEN k[cut:] ELSE k END
  FROM (SELECT *, list_min(list_filter(range(len(k) - {limit} + 1, len(k) + 1), lambda i: i > 0 AND k[i].clean)) AS cut
        FROM (SELECT p.conv_id, p.turn, p.n, list_append(f.kept, {{'turn': p.turn, 'clean': p.clean}}) AS k
              FROM fold f JOIN placed p ON p.conv_id = f.conv_id AND p.n = f.n + 1)))
SELECT conv_id, turn, kept[1].turn AS history_start, CAST(len(kept) AS BIGINT) AS history_length FROM fold"""


def direct_questions() -> str:
    return f"""
SELECT event_id, 'U' || substr(channel, 2) AS "user", ts, channel || ':' || coalesce(thread_ts, ts) AS thread_key, text AS question
FROM ({MESSAGES}) WHERE subtype IS NULL AND channel_type = 'im' AND text <> ''"""


def mentions() -> str:
    return rf"""
SELECT event_id, CAST(NULL AS VARCHAR) AS "user", ts, channel || ':' || coalesce(thread_ts, ts) AS thread_key,
       trim(regexp_replace(text, '^\s*<@[^>]+>\s*', ''), ' ' || chr(9) || chr(10) || chr(13)) AS question
FROM ({MESSAGES}) WHERE subtype IS NULL AND channel_type <> 'im' AND text LIKE '%<@_%>%'"""


def live_threads(idle: str) -> str:
    return f"""
SELECT user_id, max(ts) AS last_event FROM events GROUP BY user_id
HAVING (SELECT max(ts) FROM events) - max(ts) <= INTERVAL {idle}"""


def json_rows() -> str:
    return """
SELECT CAST(json_object('c_custkey', c_custkey, 'c_name', c_name, 'c_mktsegment', nullif(c_mktsegment, 'BUILDING'))
       AS VARCHAR) AS json
FROM customer"""


def thread_keys() -> str:
    return f"""
SELECT event_id, channel || ':' || coalesce(thread_ts, ts) AS thread_key FROM ({MESSAGES})"""


def direct_messages() -> str:
    return f"""
SELECT event_id, channel, ts, text FROM ({MESSAGES})
WHERE subtype IS NULL AND channel_type = 'im' AND text <> ''"""


def message_text() -> str:
    return rf"""
SELECT event_id,
       regexp_replace(regexp_replace(text, '^\s*<@[^>]+>\s*', ''), '^\s+|\s+$', '', 'g') AS question
FROM ({MESSAGES})"""


def answers() -> str:
    """Summaries are documents with a list mark put before each line."""
    return r"""
WITH answer AS (
  SELECT doc_id, '- ' || replace(text, chr(10), chr(10) || '* ') || '\nend' AS summary,
         CASE WHEN lang = 'en' THEN ['Check ' || source || '\nthen ' || lang, 'Keep ' || lang] END
           AS actions
  FROM documents),
plain AS (
  SELECT doc_id, replace(summary, '\n', chr(10)) AS summary,
         list_transform(actions, lambda a: replace(a, '\n', chr(10))) AS actions FROM answer),
marked AS (
  SELECT *, regexp_replace(summary, '(?m)^(\s*)[-*]\s+', '\1• ', 'g') AS section FROM plain)
SELECT doc_id,
       CASE WHEN length(section) > 2900 THEN left(section, 2899) || '…' ELSE section END
         AS summary_section,
       '*Recommended Next Actions*' || chr(10)
         || array_to_string(list_transform(actions, lambda a: '• ' || a), chr(10))
         AS actions_section,
       CASE WHEN actions IS NULL THEN summary ELSE summary || chr(10) || chr(10)
         || 'Recommended Next Actions' || chr(10)
         || array_to_string(list_transform(actions, lambda a: '- ' || a), chr(10)) END
         AS fallback_text
FROM marked"""


def replies() -> str:
    return """
WITH reply AS (
  SELECT conv_id, turn, role, text FROM conversations)
SELECT conv_id, turn, CASE WHEN role = 'system' THEN '' ELSE text END AS interpretation,
       CASE WHEN role = 'user' THEN NULL ELSE 'SELECT ' || turn END AS generated_sql
FROM reply"""


def readonly_sql() -> str:
    return """
SELECT m.event_type, c.membership_type, count(*) AS events
FROM (SELECT user_id, CASE event_type WHEN 'signup' THEN 'Signup' WHEN 'purchase' THEN 'Upgrade'
             WHEN 'error' THEN 'Downgrade' WHEN 'click' THEN 'Renewal' WHEN 'view'
             THEN 'Cancellation' END AS event_type FROM events) m
JOIN (SELECT c_custkey, c_mktsegment AS membership_type FROM customer) c ON c_custkey = user_id
GROUP BY ALL"""
