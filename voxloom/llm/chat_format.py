"""Chat formatting with Spark expressions only.

A message is ``<|turn|>role``, a line feed, the text and ``<|end|>``; adjacent turns of one role share a message and
are set apart by ``<|next|>``. Inside roles and texts a backslash goes after the first character of every control
string of this template and of other common ones (``<s>``, ``</s>``, ``[INST]``, ``[/INST]``), and one more after each
such escape that the text already has, so that removing one brings back the text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TURN, NEXT, END = "<|turn|>", "<|next|>", "<|end|>"
_CONTROL = r"(\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, "$1$2$3")


def escape_role(role: Column) -> Column:
    """A role on one line: % and line feeds as %25 and %0A, then as a text."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted and segments, one row for each conversation: each conv_id, and each row without one.

    segments is an array of (text, loss) whose texts, joined, are ``formatted``; loss marks the texts of assistants.
    The turns of a conversation are ordered by (turn, role, text), so equal turn numbers have a defined order; a null
    turn comes first and stays a turn, a null role or text is empty, and repeated rows are turns of their own. A row
    with a null conv_id belongs to no other and is a conversation of its own. An empty table gives an empty result; further columns are ignored.
    All rows of a conversation meet in one row, since its formatted text is one value; each step over them is linear.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = conversations.withColumn("_alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    chats = alone.groupBy("conv_id", "_alone").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    at = F.sequence(F.lit(0), F.size("turns") - 1)
    starts = F.filter(at, lambda i: (i == 0) | (F.element_at("turns", i + 1)["role"] != F.element_at("turns", F.greatest(i, F.lit(1)))["role"]))
    chats = chats.withColumn("starts", starts)
    last = F.size("turns")
    runs = F.transform(
        "starts",
        lambda s, k: F.slice("turns", s + 1, F.coalesce(F.get("starts", k + 1), last) - s),
    )
    chats = chats.select("conv_id", runs.alias("runs"))

    def message(run: Column) -> Column:
        role = run[0]["role"]
        head = F.struct(F.concat(F.lit(TURN), escape_role(role), F.lit("\n")).alias("text"), F.lit(False).alias("loss"))
        between = F.struct(F.lit(NEXT).alias("text"), F.lit(False).alias("loss"))
        tail = F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss"))
        bodies = F.flatten(F.transform(run, lambda t, i: F.array(F.when(i == 0, head).otherwise(between), F.struct(escape(t["text"]).alias("text"), (role == "assistant").alias("loss")))))
        return F.concat(bodies, F.array(tail))

    chats = chats.select("conv_id", F.flatten(F.transform("runs", message)).alias("segments"))
    return chats.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def parse_chats(formatted: Column) -> Column:
    """The turns, an array of (role, text), of a formatted conversation."""
    messages = F.filter(F.split(formatted, r"<\|end\|>"), lambda m: m != "")
    return F.flatten(
        F.transform(
            messages,
            lambda m: F.transform(
                F.split(F.substring(m, F.instr(m, "\n") + 1, F.length(m)), r"<\|next\|>"),
                lambda t: F.struct(unescape_role(F.regexp_extract(m, r"^<\|turn\|>([^\n]*)", 1)).alias("role"), unescape(t).alias("text")),
            ),
        )
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long"), "role", "text")
    both = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(both).alias("text"))
    formatted = format_chats(chats.unionByName(extra)).withColumn("turns", parse_chats(F.col("formatted")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    digests = formatted.select("conv_id", F.size("turns").cast("long").alias("n_turns"), told.alias("told"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return digests.select("conv_id", "n_turns", F.sha2("told", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS DISTINCT FROM role AS starts,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         length(text) + length(regexp_extract_all(text, '[<\[]\\*(?:\||/?s>|/?INST\])')) AS written FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(written + CASE WHEN starts THEN 16 + length(role) ELSE 8 END)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""
