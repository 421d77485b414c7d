"""Pronunciation rules as a table, at any number.

A rule (id, find, speak_as) rewrites whole words in any case; rules act the longest first, each on what the one before
made. Applied as so many expressions, thousands of rules would make a plan of thousands of nodes and test each rule on
each text. Here a rule is found by the first word of its find: a match of a rule holds that word as a whole word, so the
words of the texts are joined with the rules, and only rules that share a word with a text are folded over it, in order.
Words that a rule puts in can call further rules; these are followed within the table of rules first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cuts import durable

#: Rules, or texts with rules, that are looked up by broadcast; a rule takes some 100 bytes.
BROADCAST_RULES, BROADCAST_TEXTS = 100_000, 20_000
#: Parts in which a text's words that rules change are kept by hash, as Spark looks a key up by trying all keys of a map.
MAPS = 32
WORD = r"[\p{IsAlphabetic}\p{N}']+"


def _folded(word: Column) -> Column:
    """One form for all that a pattern that ignores case takes as equal."""
    return F.lower(F.upper(F.replace(word, F.lit("İ"), F.lit("i"))))


def _pieces(text: Column) -> Column:
    """The distinct words of a text, and its other characters but spaces."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(WORD + r"|[^\p{IsAlphabetic}\p{N}'\s]"), F.lit(0)))


def _keys(text: Column) -> Column:
    """What a text can be found by: its pieces, folded."""
    return F.array_distinct(F.transform(_pieces(text), _folded))


def _held(column: Column) -> Column:
    """A generator hands its result on as it is; a projection would be merged into all expressions that use it."""
    return F.explode(F.array(column))


def _key(find: Column) -> Column:
    """What a rule is found by: its first word, or its first character if it has none."""
    word = F.regexp_extract(find, WORD, 0)
    return _folded(F.when(word != "", word).otherwise(F.substring(find, 1, 1)))


def whole_words(find: Column) -> Column:
    """A pattern that matches what functions.text.whole_word does for a constant. The word itself comes first, so that
    what is before and after is only looked at where it stands."""
    quoted = F.concat(F.lit("\\Q"), F.replace(find, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    letter = r"[\p{IsAlphabetic}\p{N}']"
    return F.concat(F.lit("(?iu)"), quoted, F.lit(f"(?!{letter})(?<!{letter}"), quoted, F.lit(")"))


def _few(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def _index(rules: DataFrame) -> DataFrame:
    """Rules with key, pattern, a replacement without special signs and their rank; rules without a find are left out."""
    found = F.trim("find")
    literal = F.replace(F.replace("speak_as", F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    rank = F.struct((-F.length(found)).alias("length"), "id")
    return durable(rules.where(found != "").select("id", found.alias("find"), "speak_as", _key(found).alias("key"), whole_words(found).alias("pattern"), literal.alias("put"), rank.alias("rank"), found.rlike(f"^{WORD}$").alias("alone"), found.rlike("^[A-Za-z0-9']+$").alias("plain")))


def _reached(index: DataFrame) -> DataFrame:
    """(key, rule): the rules that a key calls, itself or through words that an earlier rule of these puts in."""
    words = _few(durable(index.select(F.col("rank").alias("from"), F.explode(_keys(F.col("speak_as"))).alias("key"))), BROADCAST_RULES)
    rule = F.struct("rank", "id", "pattern", "put", "alone")
    steps = durable(words.join(index.select("key", rule.alias("rule")), "key").where(F.col("from") < F.col("rule.rank")).select("from", "rule").distinct())
    reached = fresh = durable(index.select("key", rule.alias("rule")))
    while not steps.isEmpty():
        more = fresh.select("key", F.col("rule.rank").alias("from")).join(steps, "from").select("key", "rule").distinct()
        fresh = durable(more.join(reached, ["key", "rule"], "left_anti"))
        if fresh.isEmpty():
            break
        reached = durable(reached.unionByName(fresh))
    return reached


def _fold(rules: Column, text: Column, kind: str) -> Column:
    """A struct of ``text`` after ``rules``, in order, and of ``applied``: rank and id of those that matched."""
    start = F.struct(text.alias("text"), F.array().cast(f"array<{kind}>").alias("applied"))

    def step(now: Column, r: Column) -> Column:
        """The text after a rule, which has matched if it changed the text, or else if it is found there."""
        told = F.transform(F.array(F.regexp_replace(now["text"], r["pattern"], r["put"])), lambda after: F.struct(
            after.alias("text"),
            F.when(F.coalesce((after != now["text"]) | F.regexp_like(now["text"], r["pattern"]), F.lit(False)), F.array_append(now["applied"], r["rank"])).otherwise(now["applied"]).alias("applied"),
        ))
        return F.get(told, 0)

    return F.aggregate(rules, start, step)


def apply_rule_table(rows: DataFrame, ident: str, column: str, rules: DataFrame) -> DataFrame:
    """``rows`` with ``spoken``, the text of ``column`` after all ``rules`` (id, find, speak_as), and ``applied``,
    the ids of those that matched, in order.

    Longest find first, then least id. ``ident`` names the rows; rows that share an id, or have none, get right results
    all the same, as only a text's own words count. A null text stays null. The plan does not grow with the rules. Texts
    are only shuffled if more of them have candidates than can be looked up by broadcast.

    Rules whose finds are one word each act on every word of a text by itself: what such a rule puts in stands between the
    same characters, which are no letters, so it never makes a word with them. So these rules are folded once over each
    distinct word of all texts, and texts are put together from what became of their words. A text that calls a rule of
    several words, or of other characters, has all its rules folded over it as a whole.
    """
    reached = durable(_reached(_index(rules)))
    kind = reached.schema["rule"].dataType["rank"].dataType.simpleString()
    called = durable(reached.groupBy("key").agg(F.sort_array(F.collect_set("rule")).alias("_all"), F.bool_and("rule.alone").alias("alone")))
    asked = rows.select(F.col(ident).alias("_id"), F.explode(_pieces(F.col(column))).alias("word")).withColumn("key", _folded(F.col("word")))
    known = _few(called.select("key", "alone"), BROADCAST_RULES)
    words = durable(asked.select("key", "word").join(known, "key").distinct())  # as many as rules, in the cases they come in
    folded = words.join(called.select("key", "_all"), "key").select("word", "key", "alone", F.when(F.col("alone"), _fold(F.col("_all"), F.col("word"), kind)).alias("told"))
    hits = asked.select("_id", "word").join(_few(durable(folded), BROADCAST_RULES), "word")
    became = F.when(F.col("alone"), F.struct("word", "told"))
    of_rows = durable(hits.groupBy("_id").agg(F.collect_set(became).alias("_words"), F.bool_and("alone").alias("_alone"), F.collect_set("key").alias("_keys")))
    mixed = of_rows.where("NOT _alone").select("_id", F.explode("_keys").alias("key")).join(called.select("key", "_all"), "key")
    whole = mixed.select("_id", F.explode("_all").alias("rule")).groupBy("_id").agg(F.sort_array(F.collect_set("rule")).alias("_rules"))
    part = lambda word: F.pmod(F.hash(word), F.lit(MAPS))
    in_part = lambda k: F.filter("_words", lambda x: part(x["word"]) == k)
    by_part = F.transform(F.sequence(F.lit(0), F.lit(MAPS - 1)), lambda k: F.map_from_entries(in_part(k)))
    simple = of_rows.where("_alone").select(F.col("_id"), by_part.alias("_map"), F.lit(None).cast(whole.schema["_rules"].dataType).alias("_rules"))
    some = simple.unionByName(whole.select("_id", F.lit(None).cast(simple.schema["_map"].dataType).alias("_map"), "_rules"))
    found = rows.join(_few(durable(some), BROADCAST_TEXTS), F.col(ident).eqNullSafe(F.col("_id")), "left").drop("_id")
    # words and what stands before each; after the last there is no word
    parts = F.arrays_zip(F.split(F.col(column), WORD, -1).alias("before"), F.regexp_extract_all(column, F.lit(WORD), F.lit(0)).alias("word"))
    looked = F.transform(parts, lambda x: F.struct(x["before"].alias("before"), x["word"].alias("word"), F.when(x["word"].isNotNull(), F.element_at(F.get("_map", part(x["word"])), x["word"])).alias("told")))
    seen = found.withColumn("_seen", _held(F.when(F.col("_map").isNotNull(), looked)))
    text = F.array_join(F.transform("_seen", lambda x: F.concat(x["before"], F.coalesce(x["told"]["text"], x["word"], F.lit("")))), "")
    ranks = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter("_seen", lambda x: x["told"].isNotNull()), lambda x: x["told"]["applied"]))))
    plain = F.struct(F.col(column).alias("text"), F.array().cast(f"array<{kind}>").alias("applied"))
    done = F.when(F.col("_rules").isNotNull(), _fold(F.col("_rules"), F.col(column), kind)).when(F.col("_map").isNotNull() & F.col(column).isNotNull(), F.struct(text.alias("text"), ranks.alias("applied"))).otherwise(plain)
    return seen.withColumn("_done", _held(done)).select(*rows.columns, F.col("_done.text").alias("spoken"), F.transform("_done.applied", lambda x: x["id"]).alias("applied"))


def rule_counts(rows: DataFrame, column: str, rules: DataFrame) -> DataFrame:
    """For each rule (id, find) how many rows' texts it matches, 0 included; one scan whatever the number of rules.

    A rule that is one word of ASCII letters matches a text that holds the word, in any case, in ASCII: that is known by the
    word alone. Only other rules and words are tried as patterns on the text.
    """
    index = _index(rules.select("id", "find", F.lit("").alias("speak_as")))
    cut = rows.select(F.col(column).alias("_text"), _held(_pieces(F.col(column))).alias("_pieces"))
    ascii_ = F.filter("_pieces", lambda x: F.octet_length(x) == F.length(x))
    sure = cut.select("_text", "_pieces", _held(F.array_distinct(F.transform(ascii_, _folded))).alias("_sure"))
    others = F.array_except(F.array_distinct(F.transform("_pieces", _folded)), F.col("_sure"))
    told = lambda keys, known: F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(known).alias("sure")))
    exploded = sure.select("_text", F.explode(F.concat(told(F.col("_sure"), True), told(others, False))).alias("_k")).select("_text", "_k.key", "_k.sure")
    asked = exploded.join(_few(index.select("key", "id", "pattern", "plain"), BROADCAST_RULES), "key")
    counted = asked.where(F.when(F.col("sure") & F.col("plain"), True).otherwise(F.regexp_like("_text", "pattern"))).groupBy("id").agg(F.count("*").alias("texts"))
    return rules.select("id", "find").join(counted.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").select("id", "find", F.coalesce("texts", F.lit(0)).alias("texts"))
