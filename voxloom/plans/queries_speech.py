"""Queries of text functions over sentences that are made from the tables' keys, with SQL by rules of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from .registry import query

TOKENS = ("PRO_HIMHER", "PRO_RACE", "LEVEL", "CHARNAME", "NOSUCH", "MONTHNAME", "PRO_MANWOMAN")
# what a hero is called, and what the others become
SAID = {"neutral": ("them", "traveler", "experienced", "Hero", "friend", "Mirtul", "person"), "male": ("him", "human", "experienced", "Hero", "friend", "Mirtul", "man")}


def _spoken_sql(profile: str) -> str:
    word = f"['{"', '".join(SAID[profile])}'][o_orderkey % 7 + 1]"
    return (
        f"SELECT o_orderkey AS k, '{profile}' AS profile, CASE WHEN o_orderkey % 10 = 0 THEN 'Bring  a <lower> ,now' ELSE 'Bring ' || CASE WHEN {word} IN ('experienced', 'Ogre') THEN 'an ' ELSE 'a ' END || {word} || ', now' "
        "|| CASE WHEN o_orderkey % 3 = 0 THEN ', friend' ELSE '' END || '!' END AS spoken FROM orders"
    )


def sentences(t):
    """A token after an article, with spaces in wrong places, and the hero's name at the end of some; some have none."""
    k = F.col("o_orderkey")
    token = F.get(F.array(*map(F.lit, TOKENS)), (k % 7).cast("int"))
    line = F.concat(F.lit("Bring  an <"), token, F.lit(">  , now"), F.when(k % 3 == 0, ", <CHARNAME>").otherwise(""), F.lit(" !"))
    return t.orders.select(k.alias("k"), "o_custkey", F.when(k % 10 == 0, "Bring  a <lower> ,now").otherwise(line).alias("line"))


@query(" UNION ALL ".join(map(_spoken_sql, SAID)))
def resolved_tokens(t):
    """Tokens as words of two profiles, articles that agree, tidy spaces; texts without a token stay."""
    s = sentences(t)
    told = [s.select("k", F.lit(p).alias("profile"), text.effective_spoken_text(F.col("line"), F.col("line"), profile=p).alias("spoken")) for p in SAID]
    return told[0].unionByName(told[1])


@query("SELECT p_partkey, s > 0 AND NOT (w >= 8 AND w / s > 5) AND NOT (5 * w >= 40 AND 5 * w / s > 30) AS plausible FROM (SELECT p_partkey, (p_size % 20)::DOUBLE AS w, (p_size % 6)::DOUBLE AS s FROM part)")
def plausible_clips(t):
    """So many words of five letters in so many seconds."""
    words = F.array_join(F.array_repeat(F.lit("speak"), (F.col("p_size") % 20).cast("int")), " ")
    return t.part.select("p_partkey", text.plausible_duration(words, (F.col("p_size") % 6).cast("double")).alias("plausible"))


@query("SELECT p_partkey, string_split(lower(p_name), ' ') AS words, p_partkey % 4 <> 1 AS same, CASE p_partkey % 5 WHEN 1 THEN 'command fragment' WHEN 2 THEN 'escape sequence' WHEN 3 THEN 'file path' END AS reason FROM part")
def spoken_words(t):
    """A part's name with punctuation, cues and tags around its words, against the name with one word more or not."""
    k, name = F.col("p_partkey"), F.col("p_name")
    loud = F.concat(F.lit("("), F.upper(F.replace(name, F.lit(" "), F.lit(",  \""))), F.lit("!)"))
    other = F.concat(F.lit("*sighs* "), name, F.when(k % 4 == 1, " again").otherwise("."), F.lit(" [sigh]"))
    tail = F.when(k % 5 == 1, " --LINE 4").when(k % 5 == 2, ' \\"').when(k % 5 == 3, F.lit(" C:\\x")).otherwise("")
    tail = F.when(k % 5 == 3, " AppData/Roaming/x").otherwise(tail)
    return t.part.select("p_partkey", text.spoken_words(loud).alias("words"), text.same_words(F.concat(name, F.lit("!")), other).alias("same"), text.artifact_reason(F.concat(name, tail)).alias("reason"))


@query("SELECT s_suppkey, lower(s_name) AS name, 'a' || chr(9) || '%TILDE%' || s_name || chr(10) || '%TILDE%%TILDE%' AS quoted FROM supplier")
def clean_names(t):
    """Names padded with NULs; tildes and control characters in quoted text."""
    padded = F.concat(F.lit(" "), "s_name", F.lit(" \0\0JUNK"))
    quoted = F.concat(F.lit("a\t~\x07"), "s_name", F.lit("\r\n~\x1b~"))
    return t.supplier.select("s_suppkey", text.clean_name(padded).alias("name"), text.escape_quoted(quoted).alias("quoted"))
