"""Conversation logs, their digests and similarity search over stored insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Phrases that mark a seed prompt, compared in lower case.
SEED_PHRASES = (
    "anda akan membaca keseluruhan", "baca keseluruhan percakapan", "you will read the entire",
    "read the conversation", "experience agent",
)
# List name in a digest -> stored insight type.
INSIGHT_TYPES = {"insights": "insight", "patterns": "pattern", "preferences": "preference"}

_PARTS = "array<struct<type:string,text:string>>"
_MESSAGE = "type string, role string, content string, name string, arguments string, output string, _bad string"


def _parsed(json: Column) -> Column:
    return F.from_json(json, _MESSAGE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})


def _content_list(json: Column) -> Column:
    """The content as a list of parts; null when it is a plain string, even one that looks like a list."""
    return F.from_json(json, f"content {_PARTS}")["content"]


def _text_parts(parts: Column, kinds: tuple[str, ...]) -> Column:
    return F.transform(F.filter(parts, lambda p: p["type"].isin(*kinds)), lambda p: F.coalesce(p["text"], F.lit("")))


def parse_transcripts(messages: DataFrame, data: str = "message_data", session: str = "session_id",
                      order: tuple[str, ...] = ("created_at", "id"), per_session: int | None = None) -> DataFrame:
    """JSON messages -> role and content: all of them, or the first ``per_session`` of each session by time.

    Text parts are joined by newlines, tool calls and outputs become text, unreadable JSON is kept as it is.
    Without a number there is no shuffle. With one, Spark's window group limit works below the shuffle, so each task
    forwards at most that many rows of a session.
    """
    m = F.col("_m")
    is_message = m["type"] == "message"
    texts = F.coalesce(_text_parts(F.col("_parts"), ("output_text", "input_text", "text")), F.array().cast("array<string>"))
    role = (
        F.when(m["_bad"].isNotNull() | m.isNull(), F.lit(None).cast("string"))
        .when(is_message, F.coalesce(F.nullif(m["role"], F.lit("")), F.lit("assistant")))
        .when(m["type"] == "function_call", F.lit("tool_call"))
        .when(m["type"] == "function_call_output", F.lit("tool_output"))
        .otherwise(m["role"])
    )
    call = F.concat(F.coalesce(m["name"], F.lit("tool")), F.lit("("), F.coalesce(m["arguments"], F.lit("")), F.lit(")"))
    content = (
        F.when(m["_bad"].isNotNull() | m.isNull(), F.col(data))
        .when(is_message, F.array_join(texts, "\n"))
        .when(m["type"] == "function_call", call)
        .when(m["type"] == "function_call_output", F.coalesce(m["output"], F.lit("")))
        .otherwise(m["content"])
    )
    if per_session:
        rank = F.row_number().over(Window.partitionBy(session).orderBy(*order))
        messages = messages.withColumn("_rn", rank).filter(F.col("_rn") <= per_session).drop("_rn")
    parsed = messages.withColumns({"_m": _parsed(F.col(data)), "_parts": _content_list(F.col(data))})
    return parsed.withColumns({"role": role, "content": content}).drop("_m", "_parts", data)


def latest_transcript(messages: DataFrame, order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """All messages of the session that owns the newest message."""
    newest = messages.agg(F.max_by("session_id", F.struct(*order))).scalar()
    return messages.filter(F.col("session_id") == newest)


def is_seed_prompt(c: Column) -> Column:
    """Seed phrases anywhere, or at most 80 characters ending in three dots."""
    t = F.trim(c)
    phrase = F.lit(False)
    for p in SEED_PHRASES:
        phrase = phrase | F.contains(F.lower(t), F.lit(p))
    return phrase | ((F.length(t) <= 80) & t.endswith("..."))


def is_insight_payload(c: Column) -> Column:
    """A digest: it names preferences, or both other lists, or one of them in a JSON object."""
    t = F.lower(F.trim(c))
    insights, patterns, preferences = (F.contains(t, F.lit(f'"{name}"')) for name in ("insights", "patterns", "preferences"))
    enough = F.when(t.startswith("{"), F.lit(1)).otherwise(F.lit(2))
    return preferences | (insights.cast("int") + patterns.cast("int") >= enough)


def compact_runs(messages: DataFrame, data: str = "message_data") -> DataFrame:
    """Per session and run: the first genuine user prompt and the last assistant text that is not a digest.

    One row per kept message (kind 'user_prompt' or 'assistant_output') with ``run_order``, the run's first
    message id. Messages without a run form one group per session.
    """
    m = F.col("_m")
    prompt = F.when((m["role"] == "user") & (F.trim(m["content"]) != "") & F.col("_parts").isNull()
                    & ~is_seed_prompt(m["content"]), m["content"])
    outputs = F.filter(_text_parts(F.col("_parts"), ("output_text",)),
                       lambda t: (F.trim(t) != "") & ~is_insight_payload(t))
    output = F.try_element_at(outputs, F.lit(-1))
    parsed = messages.withColumns({"_m": _parsed(F.col(data)), "_parts": _content_list(F.col(data))}).select(
        "id", "session_id", F.nullif("run_id", F.lit("")).alias("run_id"), prompt.alias("p"), output.alias("o")
    )
    runs = parsed.groupBy("session_id", "run_id").agg(
        F.min("id").alias("run_order"),
        F.min_by(F.struct("id", F.col("p").alias("content")), F.when(F.col("p").isNotNull(), F.col("id"))).alias("first"),
        F.max_by(F.struct("id", F.col("o").alias("content")), F.when(F.col("o").isNotNull(), F.col("id"))).alias("last"),
    )
    kept = runs.select("session_id", "run_id", "run_order", F.explode(F.array(
        F.struct(F.lit("user_prompt").alias("kind"), F.col("first").alias("m")),
        F.struct(F.lit("assistant_output").alias("kind"), F.col("last").alias("m")),
    )).alias("x"))
    return kept.select(
        "session_id", "run_id", "run_order", F.col("x.kind").alias("kind"), F.col("x.m.id").alias("id"),
        F.col("x.m.content").alias("content"),
    ).filter(F.col("id").isNotNull())


def flatten_insights(digests: DataFrame, *carry: str) -> DataFrame:
    """Digest lists -> one typed row per entry; null lists are empty."""
    def typed(column: str, kind: str) -> Column:
        entries = F.coalesce(F.col(column), F.array().cast("array<string>"))
        return F.transform(entries, lambda x: F.struct(F.lit(kind).alias("insight_type"), x.alias("insight_content")))

    lists = [typed(c, t) for c, t in INSIGHT_TYPES.items() if c in digests.columns]
    return digests.select(*carry, F.explode(F.flatten(F.array(*lists))).alias("x")).select(*carry, "x.*")


def tag_runs(messages: DataFrame, marks: DataFrame) -> DataFrame:
    """Give untagged messages above a session's mark (session_id, after_id, run_id) that run id.

    ``marks`` has one row per session.
    """
    m = marks.select("session_id", F.col("after_id").alias("_after"), F.col("run_id").alias("_run"))
    open_row = F.col("run_id").isNull() | (F.col("run_id") == "")
    tagged = F.when(open_row & (F.col("id") > F.col("_after")), F.col("_run")).otherwise(F.col("run_id"))
    return messages.join(m, "session_id", "left").withColumn("run_id", tagged).select(*messages.columns)


def sessions_needing_digest(sessions: DataFrame, insights: DataFrame, n: int | None = None) -> DataFrame:
    """Sessions other than the latest that changed after their last insight, or have none; oldest first, all or ``n``."""
    latest = sessions.agg(F.max_by("session_id", F.struct("updated_at", "session_id"))).scalar()
    last = insights.groupBy("session_id").agg(F.max("created_at").alias("last_insight_at"))
    due = sessions.filter(F.col("session_id") != latest).join(last, "session_id", "left").filter(
        F.col("last_insight_at").isNull() | (F.col("last_insight_at") < F.col("updated_at"))
    ).select("session_id", "updated_at", "last_insight_at")
    return due.orderBy("updated_at", "session_id").limit(n) if n else due


def cosine_similarity(vector: Column, query: list[float]) -> Column:
    """Cosine of an array column and a fixed vector, in double precision; null on a length mismatch or zero norm."""
    q = F.array(*[F.lit(float(x)) for x in query])
    add = lambda acc, x: acc + x
    v = F.transform(vector, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), add)
    norm = F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), add))
    q_norm = sum(x * x for x in map(float, query)) ** 0.5
    return F.when(F.size(vector) == len(query), dot / F.nullif(norm * F.lit(q_norm), F.lit(0.0)))


def similar_top_k(df: DataFrame, query: list[float], k: int, threshold: float, user: str | None = None,
                  vector: str = "embedding", id: str = "id") -> DataFrame:
    """The k most similar rows at or above the threshold, best first, score rounded to three decimals.

    Rows without a vector are skipped. The top-k is kept per task and merged, so nothing is sorted as a whole.
    """
    rows = df.filter(F.col(vector).isNotNull())
    if user is not None:
        rows = rows.filter(F.col("user_id") == user)
    scored = rows.withColumn("_score", cosine_similarity(F.col(vector), query)).filter(F.col("_score") >= threshold)
    top = scored.drop(vector).orderBy(F.col("_score").desc(), id).limit(k)
    return top.withColumn("similarity_score", F.round("_score", 3)).drop("_score")
