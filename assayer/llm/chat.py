"""Chat formatting by event-sourced reconstruction. DataFrame functions only.

A log row is an event: kind 'message' starts a message, 'delta' appends to its target, 'edit' replaces the target's
text, 'regenerate' empties the target and drops the messages after it that were there by then. Rows are partitioned by
conversation, sorted by sequence, folded into final messages and rendered. Turns are marked by ``<|im_start|>role`` and
``<|im_end|>``; control strings inside roles and texts get a backslash after their first character (and those that
have backslashes there one more), so that nothing in a text can end a turn and every text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import read

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
#: What follows the first character of a control string: those of this template and of two other common ones.
_REST = r"(\||/?s>|/?INST\])"
_EVENT = "struct<seq:bigint,kind:string,target:bigint,role:string,text:string>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, r"$1$2$3")


def _fold(events: Column) -> Column:
    """Final (role, text) of sorted events; ``target`` is the seq of the message meant."""
    blank = F.lit("")
    messages = F.filter(events, lambda e: e.kind == "message")

    def final(m: Column) -> Column:
        own = F.filter(events, lambda e: (e.kind != "message") & (e.target == m.seq))
        text = F.aggregate(own, m.text, lambda acc, e: F.when(e.kind == "delta", F.concat(acc, e.text)).when(e.kind == "edit", e.text).when(e.kind == "regenerate", blank).otherwise(acc))
        gone = F.exists(events, lambda e: (e.kind == "regenerate") & (e.target < m.seq) & (e.seq > m.seq))
        return F.struct(m.role.alias("role"), text.alias("text"), gone.alias("gone"))

    logged = F.filter(F.transform(messages, final), lambda m: ~m.gone)
    plain = F.transform(messages, lambda m: F.struct(m.role.alias("role"), m.text.alias("text"), F.lit(False).alias("gone")))
    return F.when(F.exists(events, lambda e: e.kind != "message"), logged).otherwise(plain)


def format_chats(log: DataFrame, conv: str = "conv_id", seq: str = "turn", role: str = "role", text: str = "text", kind: str | None = None, target: str | None = None, trained: str = "assistant") -> DataFrame:
    """conv_id, formatted and loss_spans (start and length in code points of each trained text) per conversation.

    Null texts, roles and kinds count as empty, empty and 'message'. Events with equal sequence are sorted by kind, target, role and
    text, so repeats and ties have one order; null sequences come first. Null ids are one conversation. A conversation is
    one row of the result and so one task's; its bytes are gathered once. Empty tables give an empty result.
    """
    event = F.struct(
        F.col(seq).cast("bigint").alias("seq"), F.coalesce(F.col(kind) if kind else F.lit("message"), F.lit("message")).alias("kind"), (F.col(target) if target else F.lit(None)).cast("bigint").alias("target"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    logs = log.select(F.col(conv).alias("conv_id"), event.alias("e")).groupBy("conv_id").agg(F.array_sort(F.collect_list("e")).alias("events"))
    turns = logs.select("conv_id", F.transform(_fold(F.col("events")), lambda m: F.struct((m.role == trained).alias("learn"), F.concat(F.lit(START), F.replace(escape(m.role), F.lit("\n"), F.lit(BREAK)), F.lit("\n")).alias("head"), escape(m.text).alias("body"))).alias("turns"))
    rendered = turns.withColumn("formatted", F.array_join(F.transform("turns", lambda t: F.concat(t.head, t.body, F.lit(END + "\n"))), ""))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    tail = len(END) + 1
    # offsets come from a running sum over lengths; spans are gathered once per trained turn
    sized = F.transform("turns", lambda t: F.struct(t.learn.alias("learn"), F.length(t.head).cast("long").alias("h"), F.length(t.body).cast("long").alias("b")))
    spans = F.aggregate(sized, zero, lambda acc, t: F.struct((acc.at + t.h + t.b + tail).alias("at"), F.when(t.learn, F.concat(acc.spans, F.array(F.struct((acc.at + t.h).alias("start"), t.b.alias("length"))))).otherwise(acc.spans).alias("spans")), lambda acc: acc.spans)
    return rendered.select("conv_id", "formatted", spans.alias("loss_spans"))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss (trained text) recovered from the rendered string and its spans alone."""
    parts = F.transform(F.slice(F.split("formatted", r"<\|im_end\|>\n"), 1, F.greatest(F.size(F.split("formatted", r"<\|im_end\|>\n")) - 1, F.lit(0))), lambda p: F.substring(p, len(START) + 1, 1 << 30))
    turns = F.transform(parts, lambda p: F.struct(unescape(F.replace(F.substring_index(p, "\n", 1), F.lit(BREAK), F.lit("\n"))).alias("role"), unescape(p.substr(F.length(F.substring_index(p, "\n", 1)) + 2, F.lit(1 << 30))).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr((s.start + 1).cast("int"), s.length.cast("int")))), "")
    return chats.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))


_PROBE = "</s>[INST] ok [/INST]"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"SELECT cast(-7 as bigint) conv_id, cast(t as bigint) turn, r role, '{_PROBE}' text FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, r)")
    back = read_back(format_chats(logs.unionByName(probe)))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(listed).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP8_SQL = rf"""
WITH l AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '{_PROBE}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(START) + len(END) + 2} + length(regexp_replace(role, '([<\[])(\\*){_REST}', '\1\\\2\3', 'g')) + length(regexp_replace(text, '([<\[])(\\*){_REST}', '\1\\\2\3', 'g'))) AS BIGINT) AS formatted_chars
FROM l GROUP BY conv_id"""
