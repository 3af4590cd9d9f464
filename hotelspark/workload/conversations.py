"""Conversation logs, digests and similarity search."""

from __future__ import annotations

from pyspark.sql import functions as F

from hotelspark.operators import sessions
from hotelspark.workload.registry import query

M = ("fx_messages",)


def _message_json(load):
    """Messages as the JSON their log holds: user texts as strings, assistant texts as parts, tool calls and broken text."""
    k = F.col("id") % 10
    part = F.array(F.struct(F.lit("output_text").alias("type"), F.col("text")), F.struct(F.lit("text").alias("type"), F.lit("end").alias("text")))
    as_json = (
        F.when(k == 7, F.lit("{broken"))
        .when(k == 8, F.to_json(F.struct(F.lit("function_call").alias("type"), F.lit("sql").alias("name"), F.col("text").alias("arguments"))))
        .when(k == 9, F.to_json(F.struct(F.lit("function_call_output").alias("type"), F.col("text").alias("output"))))
        .when(F.col("role") == "assistant", F.to_json(F.struct(F.lit("message").alias("type"), "role", part.alias("content"))))
        .otherwise(F.to_json(F.struct("role", F.col("text").alias("content"))))
    )
    return load("fx_messages").select("id", "session_id", "run_id", as_json.alias("message_data"))


_ROLE = """CASE WHEN id % 10 = 7 THEN NULL WHEN id % 10 = 8 THEN 'tool_call' WHEN id % 10 = 9 THEN 'tool_output' ELSE role END"""
_CONTENT = """CASE WHEN id % 10 = 7 THEN '{broken' WHEN id % 10 = 8 THEN 'sql(' || text || ')' WHEN id % 10 = 9 THEN text WHEN role = 'assistant' THEN text || chr(10) || 'end' ELSE text END"""


@query("transcripts_parsed", f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id) AS rn FROM fx_messages)
SELECT id, session_id, run_id, {_ROLE} AS role, {_CONTENT} AS content FROM r""", M)
def _(load):
    return sessions.parse_transcripts(_message_json(load), order=("id",))


@query("transcript_of_one_long_session", f"""
SELECT id, 'all' AS session_id, run_id, {_ROLE} AS role, {_CONTENT} AS content FROM fx_messages""", M)
def _(load):
    return sessions.parse_transcripts(_message_json(load).withColumn("session_id", F.lit("all")), order=("id",))


@query("transcript_of_latest_session", f"""
SELECT id, session_id, run_id, {_ROLE} AS role, {_CONTENT} AS content FROM fx_messages WHERE session_id = (SELECT session_id FROM fx_messages ORDER BY id DESC LIMIT 1)""", M)
def _(load):
    return sessions.parse_transcripts(sessions.latest_transcript(_message_json(load), order=("id",)), order=("id",))


@query("runs_compacted", """
, p AS (SELECT id, session_id, run_id, CASE WHEN id % 10 < 7 AND role = 'user' AND trim(text) <> '' AND NOT (length(trim(text)) <= 80 AND ends_with(trim(text), '...')) THEN text END AS prompt,
  CASE WHEN id % 10 < 7 AND role = 'assistant' AND trim(text) <> '' THEN text END AS output FROM fx_messages),
g AS (SELECT session_id, run_id, min(id) AS run_order FROM p GROUP BY session_id, run_id),
a AS (SELECT session_id, run_id, min(id) AS id FROM p WHERE prompt IS NOT NULL GROUP BY session_id, run_id),
b AS (SELECT session_id, run_id, max(id) AS id FROM p WHERE output IS NOT NULL GROUP BY session_id, run_id),
k AS (SELECT *, 'user_prompt' AS kind FROM a UNION ALL SELECT *, 'assistant_output' FROM b)
SELECT k.session_id, k.run_id, g.run_order, k.kind, k.id, CASE k.kind WHEN 'user_prompt' THEN p.prompt ELSE p.output END AS content
FROM k JOIN p ON p.id = k.id JOIN g ON g.session_id = k.session_id AND g.run_id IS NOT DISTINCT FROM k.run_id""", M)
def _(load):
    return sessions.compact_runs(_message_json(load))


@query("insights_flattened", """
SELECT conv_id, t AS insight_type, unnest(string_split(text, '.')) AS insight_content FROM conversations, (VALUES ('insight'), ('preference')) v(t)
UNION ALL SELECT conv_id, 'pattern', text FROM conversations WHERE turn % 2 = 0""")
def _(load):
    parts = F.split("text", r"\.")
    digests = load("conversations").select(
        "conv_id", parts.alias("insights"), F.when(F.col("turn") % 2 == 0, F.array("text")).alias("patterns"), parts.alias("preferences")
    )
    return sessions.flatten_insights(digests, "conv_id")


@query("messages_tagged", """
, marks AS (SELECT session_id, quantile_disc(id, 0.5) AS after_id FROM fx_messages GROUP BY session_id)
SELECT m.id, m.session_id, CASE WHEN (m.run_id IS NULL OR m.run_id = '') AND m.id > k.after_id THEN 'run_' || m.session_id ELSE m.run_id END AS run_id
FROM fx_messages m LEFT JOIN marks k ON k.session_id = m.session_id""", M)
def _(load):
    messages = load("fx_messages")
    marks = messages.groupBy("session_id").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY id)").cast("bigint").alias("after_id"))
    marks = marks.withColumn("run_id", F.concat(F.lit("run_"), "session_id"))
    return sessions.tag_runs(messages, marks).select("id", "session_id", "run_id")


_SESSIONS = """
, s AS (SELECT session_id, max(id) AS updated_at FROM fx_messages GROUP BY session_id),
i AS (SELECT session_id, id - 2 * (id % 5) AS created_at FROM fx_messages WHERE role = 'assistant'),
l AS (SELECT session_id, max(created_at) AS last_insight_at FROM i GROUP BY session_id)
SELECT s.session_id, s.updated_at, l.last_insight_at FROM s LEFT JOIN l ON l.session_id = s.session_id
WHERE s.session_id <> (SELECT session_id FROM s ORDER BY updated_at DESC, session_id DESC LIMIT 1) AND (last_insight_at IS NULL OR last_insight_at < updated_at)"""


def _sessions(load, n):
    messages = load("fx_messages")
    table = messages.groupBy("session_id").agg(F.max("id").alias("updated_at"))
    insights = messages.filter("role = 'assistant'").select("session_id", (F.col("id") - 2 * (F.col("id") % 5)).alias("created_at"))
    return sessions.sessions_needing_digest(table, insights, n)


@query("sessions_due", _SESSIONS, M)
def _(load):
    return _sessions(load, None)


@query("session_due_first", _SESSIONS + " ORDER BY s.updated_at, s.session_id LIMIT 1", M)
def _(load):
    return _sessions(load, 1)


@query("vectors_most_similar", """
SELECT e.vec_id, e.label::BIGINT AS label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 3) AS similarity_score
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.embedding IS NOT NULL
  AND list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) >= 0.2
ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id LIMIT 5""")
def _(load):
    vectors = load("embeddings")
    # One row by its id: the question that is asked.
    question = list(vectors.filter("vec_id = 0").first()["embedding"])
    return sessions.similar_top_k(vectors, question, k=5, threshold=0.2, id="vec_id")
