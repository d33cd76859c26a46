"""Chat export to documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from memograph import adapters as A
from memograph.catalog.base import CHAT, query, us, with_ctes
from memograph.sources import chat

RESOLVED = """
resolved AS (
  SELECT m.*, coalesce(u.shown, m.user, 'System') AS user_name,
    replace(replace(m.text, '<@U' || m1 || '>', '@' || coalesce(a.shown, 'U' || m1)),
      '<@U' || m2 || '>', '@' || coalesce(b.shown, 'U' || m2)) AS clean
  FROM messages m LEFT JOIN users u ON u.user_id = m.user LEFT JOIN users a ON a.user_id = 'U' || m1
    LEFT JOIN users b ON b.user_id = 'U' || m2),
written AS (SELECT *, user_name || ' [' || strftime(make_timestamp(sec * 1000000), '%H:%M:%S') || ']: ' || clean AS line
  FROM resolved)
"""


@query("thread_documents", with_ctes(CHAT, RESOLVED, body="""
SELECT 'slack_thread_' || channel_id || '_' || thread_ts AS id, '/Slack/' || channel_name || '/Thread_' || thread_ts AS path,
  'Slack Thread: ' || CASE WHEN arg_min(coalesce(user, ''), sec) = '' THEN 'System' ELSE arg_min(user_name, sec) END
    || ' in #' || channel_name AS title,
  md5(string_agg(line, chr(10) ORDER BY sec)) AS content_md5, min(sec) * 1000000 + 100 AS created_us,
  max(sec) * 1000000 + 100 AS edited_us, count(*) - 1 AS reply_count,
  string_agg(DISTINCT user_name, ',' ORDER BY user_name) AS participants
FROM written WHERE thread_ts IS NOT NULL GROUP BY channel_id, channel_name, thread_ts"""))
def thread_documents(spark, sf_dir):
    threads, _ = chat.route(chat.resolve(A.chat_messages(spark, sf_dir), A.chat_users(spark, sf_dir)))
    return chat.thread_documents(threads).select(
        "id", "path", "title", F.md5("content").alias("content_md5"), us("created_time", "created_us"),
        us("last_edited_time", "edited_us"), "reply_count", F.array_join("participants", ",").alias("participants"))


@query("day_documents", with_ctes(CHAT, RESOLVED, """
dated AS (SELECT *, strftime(make_timestamp(sec * 1000000), '%Y-%m-%d') AS day FROM written WHERE thread_ts IS NULL)
""", body="""
SELECT 'slack_chat_' || channel_id || '_' || day AS id, 'Slack Chat: #' || channel_name || ' (' || day || ')' AS title,
  md5('Slack messages in #' || channel_name || ' on ' || day || ':' || chr(10) || chr(10)
    || string_agg(line, chr(10) ORDER BY sec)) AS content_md5, count(*) AS message_count,
  string_agg(DISTINCT user_name, ',' ORDER BY user_name) AS participants
FROM dated GROUP BY channel_id, channel_name, day"""))
def day_documents(spark, sf_dir):
    _, loose = chat.route(chat.resolve(A.chat_messages(spark, sf_dir), A.chat_users(spark, sf_dir)))
    return chat.day_documents(loose).select(
        "id", "title", F.md5("content").alias("content_md5"), "message_count",
        F.array_join("participants", ",").alias("participants"))


@query("day_sections", with_ctes(CHAT, RESOLVED, """
dated AS (SELECT *, strftime(make_timestamp(sec * 1000000), '%Y-%m-%d') AS day FROM written WHERE thread_ts IS NULL),
placed AS (SELECT *, coalesce(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY channel_id, day ORDER BY sec
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 2000 AS cut FROM dated),
parts AS (SELECT channel_id, channel_name, day, cut, string_agg(line, chr(10) ORDER BY sec) AS body, min(sec) AS first FROM placed GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY channel_id, day ORDER BY cut) AS section FROM parts)
""", body="""
SELECT 'slack_chat_' || channel_id || '_' || day || CASE WHEN section > 1 THEN '#' || section ELSE '' END AS id,
  md5('Slack messages in #' || channel_name || ' on ' || day || ':' || chr(10) || chr(10) || body) AS content_md5, first * 1000000 + 100 AS created_us,
  (SELECT count(*) FROM dated d WHERE d.channel_id = n.channel_id AND d.day = n.day) AS message_count
FROM numbered n"""))
def day_sections(spark, sf_dir):
    """Day documents in sections of 2,000 bytes: busy days far above the bound come in many."""
    _, loose = chat.route(chat.resolve(A.chat_messages(spark, sf_dir), A.chat_users(spark, sf_dir)))
    return chat.day_documents(loose, section_bytes=2000).select(
        "id", F.md5("content").alias("content_md5"), us("created_time", "created_us"), "message_count")


@query("channel_scope", with_ctes(CHAT, body="""
SELECT channel_id, ts FROM messages WHERE (channel_id IN ('C1', 'C3') OR channel_name = 'chan_5')
  AND make_timestamp(sec * 1000000 + 100) >= TIMESTAMP '2024-01-01 00:00:00'"""))
def channel_scope(spark, sf_dir):
    scoped = chat.in_scope(A.chat_messages(spark, sf_dir), A.as_of(), ["C1", "C3", "chan_5"], 30)
    return scoped.select("channel_id", "ts")


@query("user_names", """
SELECT 'U' || n_nationkey AS user_id, CASE WHEN n_nationkey % 3 <> 0 THEN upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2))
  WHEN n_nationkey % 2 = 0 THEN 'Real ' || n_nationkey ELSE 'login' || n_nationkey END AS shown FROM nation""")
def user_names(spark, sf_dir):
    return chat.user_names(A.chat_users(spark, sf_dir))
