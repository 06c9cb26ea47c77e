"""Conversations rebuilt from their event logs and rendered for training, with DataFrame functions only.

A log has a row for each event: conv_id, message (orders the messages of a conversation), seq (orders the events), kind, role, text.
``delta`` adds its text to the message, ``edit`` puts its text in place of the message, ``regenerate`` empties the message. A
message's final text is that of its last edit or regeneration and all its deltas after that. The events of one message
are folded on their own, before a conversation's messages come together, so a hot conversation is gathered once, as final messages.

A turn is rendered as ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed. Inside texts ``<|`` becomes
``<\\|``, and each ``<`` before n > 0 backslashes and ``|`` gets one more, so a text never holds ``<|`` and is got
back by taking one away. Roles are escaped likewise, without line feeds. ``loss`` has a span (begin, length, in code points of the
rendered conversation) for each turn, of length 0 but for turns of the trained role, where it covers the escaped text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billcycle.llm.common import table

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("<"), F.lit("\\l"))


def _unescape_role(role: Column) -> Column:
    parts = F.transform(
        F.split(role, r"\\\\"), lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\l"), F.lit("<"))
    )
    return F.array_join(parts, "\\")


def fold(log: DataFrame) -> DataFrame:
    """conv_id, message, role, text: the final messages of a log.

    Null texts are empty; unknown kinds and null kinds are ignored, but open the message; the role is that of the first event that has
    one. Events of equal seq go by kind, then text. Null conv_ids and messages are values like any other.
    """
    event = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role")
    events = F.sort_array(F.collect_list(event))
    gathered = log.groupBy("conv_id", "message").agg(events.alias("events"))
    places = F.transform("events", lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i))
    since = F.coalesce(F.array_max(places), F.lit(-1))
    last = F.expr("slice(events, greatest(since, 0) + 1, size(events))")
    text = F.array_join(
        F.transform(F.filter(last, lambda e: e["kind"].isin("delta", "edit")), lambda e: e["text"]), ""
    )
    roles = F.filter(F.transform("events", lambda e: e["role"]), lambda r: r.isNotNull())
    return gathered.withColumn("since", since).select(
        "conv_id", "message", F.coalesce(F.get(roles, F.lit(0)), F.lit("")).alias("role"), text.alias("text")
    )


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss of each conversation of messages (conv_id, message, role, text)."""
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    role = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    turns = (
        messages.withColumn("opening", role)
        .withColumn("escaped", escape(F.col("text")))
        .withColumn("turn", F.concat("opening", "escaped", F.lit(END + "\n")))
        .withColumn("begin", F.coalesce(F.sum(F.char_length("turn").cast("long")).over(before), F.lit(0).cast("long")))
        .withColumn(
            "loss",
            F.struct(
                (F.col("begin") + F.char_length("opening")).alias("begin"),
                F.when(F.col("role") == trained_role, F.char_length("escaped")).otherwise(0).cast("long").alias("length"),
            ),
        )
    )
    gathered = F.sort_array(F.collect_list(F.struct("begin", "turn", "loss")))
    return turns.groupBy("conv_id").agg(gathered.alias("turns")).select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        F.transform("turns", lambda t: t["loss"]).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, place, role, text, learned (the text under the loss mask, null where there is none) of each turn."""
    turns = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, F.size("loss"))
    rows = formatted.select("conv_id", F.posexplode(F.arrays_zip(turns.alias("turn"), F.col("loss").alias("loss"))).alias("place", "x"))
    rows = rows.select("conv_id", "place", "x.turn", F.col("x.loss.begin").alias("begin"), F.col("x.loss.length").alias("length"))
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length("turn").cast("long") + len(START)
    role = F.substring_index("turn", "\n", 1)
    text = F.expr(f"substring(turn, char_length(substring_index(turn, '\\n', 1)) + 2, char_length(turn) - char_length(substring_index(turn, '\\n', 1)) - {len(END) + 2})")
    masked = F.expr(f"substring(turn, int(begin - at - {len(START)}) + 1, int(length))")
    return rows.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0).cast("long"))).select(
        "conv_id",
        "place",
        _unescape_role(role).alias("role"),
        unescape(text).alias("text"),
        F.when(F.col("length") > 0, unescape(masked)).alias("learned"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars as read back from the rendered text."""
    turns = read_back(formatted)
    sizes = formatted.select(F.col("conv_id").alias("of"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    gathered = turns.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("place", "role", "text", "learned"))).alias("turns"),
    )
    whole = F.array_join(F.flatten(F.transform("turns", lambda t: F.array(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), "")
    learned = F.array_join(F.transform("turns", lambda t: t["learned"]), "")
    return (
        gathered.select("conv_id", "n_turns", F.sha2(whole, 256).alias("turns_sha256"), learned.alias("learned"))
        .join(sizes, F.col("conv_id").eqNullSafe(F.col("of")))
        .select(
            "conv_id",
            "n_turns",
            "turns_sha256",
            F.char_length("learned").cast("long").alias("loss_chars"),
            F.sha2("learned", 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )


def log_of_turns(turns: DataFrame) -> DataFrame:
    """An event log that ends in the given turns (conv_id, turn, role, text), with every kind of event.

    A user's message is typed in part and then edited, any other is streamed in part, regenerated, and streamed again in two deltas.
    Rows of equal conv_id and turn are turns of their own, by role, then text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.char_length(text) / 2).cast("int")
    first, rest = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.char_length(text))
    event = lambda seq, kind, part: F.struct(F.lit(seq).alias("step"), F.lit(kind).alias("kind"), part.alias("text"))
    none = F.lit(None).cast("string")
    edited = F.array(event(0, "delta", first), event(1, "edit", text))
    streamed = F.array(
        event(0, "delta", first), event(1, "regenerate", none), event(2, "delta", first), event(3, "delta", rest)
    )
    return (
        turns.withColumn("message", F.row_number().over(order).cast("long"))
        .select("conv_id", "message", "role", F.explode(F.when(F.col("role") == "user", edited).otherwise(streamed)).alias("e"))
        .select("conv_id", "message", (F.col("message") * 4 + F.col("e.step")).alias("seq"), "e.kind", "role", "e.text")
    )


def op7_chat(spark, folder) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.sql(
        f"SELECT * FROM VALUES (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)"
    )
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return digests(render(fold(log_of_turns(given.unionByName(extra)))))


def chat_sql() -> str:
    esc = r"regexp_replace({0}, '<(\\*)\|', '<\\\1|', 'g')"
    role = r"replace(replace(replace(coalesce(role, ''), '\', '\\'), chr(10), '\n'), '<', '\l')"
    return rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
           UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({len(START) + len(END) + 2} + length({role}) + length({esc.format("text")}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""
