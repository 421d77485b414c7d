"""Queries over documents, pages and conversations: text functions, audit, hashes and unique texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import aggregates, ordering, predicates, rules, state
from . import pipelines
from .registry import query


@query(r"""
WITH u AS (SELECT trim(text) AS text, min(doc_id) AS first_id, min(n_chars) AS first_key, count(*) AS shared_count FROM documents WHERE trim(text) <> '' GROUP BY trim(text)),
m AS (SELECT *, trim(regexp_replace(regexp_replace(text, '\*[^*]*\*|\[[^\]]*\]', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM u)
SELECT sha256(trim(text, E' \n\t\r')) AS text_hash, first_id, first_key, shared_count, length(text) - length(replace(text, '*', '')) AS asterisks, regexp_matches(plain, '[\pL\pN]') AS speakable FROM m
""")
def corpus_audit(t):
    """Flagship: unique texts with hash, counts and what the audit's base tests say."""
    unique = aggregates.unique_texts(t.documents, "doc_id", "n_chars")
    return unique.select(
        hashing.text_hash(F.col("text")).alias("text_hash"), "first_id", "first_key", "shared_count",
        F.regexp_count("text", F.lit(r"\*")).cast("bigint").alias("asterisks"), text.speakable_dialogue(F.col("text")).alias("speakable"),
    )


@query()
def corpus_audit_flags(t):
    """Documents by audit flag; the whole classifier, checked against a plain version in the tests."""
    return aggregates.bit_counts(pipelines.corpus_audit(t.documents, "doc_id", "n_chars"), "mask", text.AUDIT_BITS)


@query("SELECT min(doc_id) AS first_id, count(*) AS shared_count FROM documents WHERE trim(text) <> '' GROUP BY trim(text) HAVING min(doc_id) > 50 ORDER BY 1 LIMIT 100")
def unique_texts_page(t):
    """A page of unique texts after a cursor."""
    return aggregates.page_after(aggregates.unique_texts(t.documents, "doc_id", "n_chars"), 50, 100).select("first_id", "shared_count")


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS collapsed, sha256(trim(text, E' \n\t\r')) AS text_hash FROM documents")
def normalized_lines(t):
    """T40, H01."""
    return t.documents.select("doc_id", text.collapse(F.col("text")).alias("collapsed"), hashing.text_hash(F.col("text")).alias("text_hash"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\*[^*]*\*|\[[^\]]*\]', ' ', 'g'), '\s+', ' ', 'g')) AS spoken, (length(text) - length(replace(text, '*', ''))) % 2 = 1 AS open_star FROM (SELECT doc_id, CASE WHEN regexp_full_match(trim(text), '(?s)<.*>') AND NOT regexp_full_match(trim(text), '<[A-Z0-9_]*[A-Z][A-Z0-9_]*>') THEN '' ELSE text END AS text FROM documents)")
def stripped_cues(t):
    """T10, T25."""
    return t.documents.select("doc_id", text.strip_cues(F.col("text")).alias("spoken"), text.unterminated_asterisk(F.col("text")).alias("open_star"))


@query(r"SELECT page_id, array_to_string(list_filter(regexp_extract_all(upper(html), '<([^>]*)>', 1), lambda x, i: regexp_full_match(x, '[A-Z0-9_]*[A-Z][A-Z0-9_]*') AND list_position(regexp_extract_all(upper(html), '<([^>]*)>', 1), x) = i), ' ') AS tokens, len(list_filter(regexp_extract_all(html, '\[([^\]]*)\]', 1), lambda x: NOT regexp_matches(x, '\s'))) AS unknown, len(list_filter(regexp_extract_all(html, '<([^>]*)>', 1), lambda x: x = 'p')) AS paragraphs FROM pages")
def page_spans(t):
    """Tokens and unknown tags of html, in upper case, since tokens are."""
    spans = F.regexp_extract_all("html", F.lit(r"<([^>]*)>"), F.lit(1))
    return t.pages.select("page_id", F.array_join(text.tokens(F.upper("html")), " ").alias("tokens"), F.size(text.unknown_tags(F.col("html"))).cast("bigint").alias("unknown"), F.size(F.filter(spans, lambda x: x == "p")).cast("bigint").alias("paragraphs"))


@query(r"SELECT doc_id, len(string_split_regex(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) AS words, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters, len(list_filter(string_split(lower(text), ' '), lambda w: w = 'the')) AS the FROM documents")
def word_counts(t):
    """Words and letters."""
    return t.documents.select("doc_id", F.size(text.words_of(F.col("text"))).cast("bigint").alias("words"), F.length(F.regexp_replace("text", "[^A-Za-z]", "")).cast("bigint").alias("letters"), F.size(F.filter(F.split(F.lower("text"), " "), lambda w: w == "the")).cast("bigint").alias("the"))


@query(r"SELECT c.conv_id, c.turn, CASE WHEN length(c.text) > 40 THEN left(c.text, 40) || '…' ELSE c.text END AS excerpt, left(lower(trim(c.text, E' \n\t')), 200) AS search_form FROM conversations c")
def excerpts(t):
    """T45, T48."""
    return t.conversations.select("conv_id", "turn", text.excerpt(F.col("text"), 40).alias("excerpt"), text.search_form(F.col("text")).alias("search_form"))


@query(r"SELECT s_suppkey, lower(regexp_replace(s_name, '[0-9]+$', '')) AS stem, CASE WHEN s_nationkey = 0 THEN 'ungrouped:' || s_suppkey ELSE s_nationkey || ':' || (s_suppkey % 3) END AS identity, array_to_string(list_transform([1679616, 46656, 1296, 36, 1], lambda p: substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', (greatest(s_suppkey, 0) // p % 36)::INT + 1, 1)), '') AS name FROM supplier")
def names_and_keys(t):
    """T42, T46, H06."""
    return t.supplier.select("s_suppkey", text.stem(F.col("s_name")).alias("stem"), text.identity_key(F.when(F.col("s_nationkey") != 0, F.col("s_nationkey")), F.col("s_suppkey") % 3, F.col("s_suppkey")).alias("identity"), hashing.base36(F.col("s_suppkey"), 5).alias("name"))


@query(r"SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, coalesce(json_extract_string(props, '$.eligibility'), 'automatic') = 'automatic' AS automatic, sha256(coalesce(user_id::VARCHAR, '') || '|' || event_type) AS state FROM events")
def event_fields(t):
    """H03, H09, H10, F18."""
    return t.events.select("event_id", hashing.json_field(F.col("props"), "$.k").cast("int").alias("k"), hashing.is_automatic(F.col("props")).alias("automatic"), hashing.state_hash(F.col("user_id"), F.col("event_type")).alias("state"))


@query("SELECT l_orderkey, l_linenumber, (l_partkey >> 20)::INT AS archive, ((l_partkey >> 14) & 63)::INT AS tileset, (l_partkey & 16383)::INT AS member, (CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) | (CASE WHEN l_linestatus = 'F' THEN 2 ELSE 0 END) AS mask FROM lineitem")
def bit_fields(t):
    """H12, H13."""
    at = hashing.locator(F.col("l_partkey"))
    labels = F.array_compact(F.array(F.when(F.col("l_returnflag") == "R", "returned"), F.when(F.col("l_linestatus") == "F", "final")))
    return t.lineitem.select("l_orderkey", "l_linenumber", at["archive"].alias("archive"), at["tileset"].alias("tileset"), at["member"].alias("member"), text.labels_mask(labels, {"returned": 1, "final": 2}).alias("mask"))


@query("SELECT doc_id, octet_length(encode(text)) AS bytes FROM documents WHERE octet_length(encode(text)) BETWEEN 500 AND 2000 AND lang IN ('en', 'de') AND lower(text) LIKE '%the%'")
def faceted_search(t):
    """Facets, search and byte bounds."""
    text_column = F.col("text")
    keep = predicates.facets({"lang": ["en", "de"], "source": []}) & predicates.search(" THE ", text_column) & predicates.byte_length(text_column, "500", " 2000 ")
    return t.documents.where(keep).select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def language_options(t):
    """O15."""
    return ordering.options(t.documents, "lang")


@query("SELECT doc_id, octet_length(encode(text)) AS bytes FROM documents ORDER BY bytes DESC, lang, source, doc_id LIMIT 200 OFFSET 20")
def longest_texts_page(t):
    """O01, O03."""
    rows = t.documents.withColumn("bytes", F.octet_length("text").cast("bigint"))
    return ordering.page(rows, [F.col("bytes").desc(), F.col("lang"), F.col("source"), F.col("doc_id")], 20, 1000).select("doc_id", "bytes")


@query(r"SELECT source, count(DISTINCT trim(regexp_replace(text, '\s+', ' ', 'g'))) AS texts FROM documents GROUP BY source HAVING count(DISTINCT trim(regexp_replace(text, '\\s+', ' ', 'g'))) > 1")
def conflicting_sources(t):
    """A11."""
    return aggregates.conflicting(t.documents, "source", "text")


@query("SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, lang, min(doc_id) AS leader, count(*) AS jobs FROM documents GROUP BY 1, 2")
def deduplicated_jobs(t):
    """A24."""
    return aggregates.dedup_jobs(t.documents, "doc_id", "text", "lang")


@query(r"SELECT * FROM (SELECT 'the' AS rule, count(*) FILTER (regexp_matches(text, '(?i)(^|[^\pL\pN''])the($|[^\pL\pN''])')) AS texts FROM documents UNION ALL SELECT 'und', count(*) FILTER (regexp_matches(text, '(?i)(^|[^\pL\pN''])und($|[^\pL\pN''])')) FROM documents)")
def rule_hits(t):
    """A26, T17."""
    return aggregates.rule_hits(t.documents, {w: F.col("text").rlike(text.whole_word(w)) for w in ("the", "und")})


@query(r"WITH once AS (SELECT doc_id, text, regexp_replace(text, '(?i)(^|[^\pL\pM\pN''])the($|[^\pL\pM\pN''])', '\1thee\2', 'g') AS a FROM documents), twice AS (SELECT doc_id, text, regexp_replace(a, '(?i)(^|[^\pL\pM\pN''])the($|[^\pL\pM\pN''])', '\1thee\2', 'g') AS a FROM once) SELECT doc_id, sha256(coalesce(a, '')) AS spoken, coalesce(length(a) - length(text), 0) AS longer FROM twice")
def spoken_rules(t):
    """A whole-word rule, in any case, over all documents. The SQL has no look-around, so it matches what is beside a
    word too, and runs twice, as neighbours share that."""
    spoken = text.apply_rules(F.col("text"), [("The", "thee")])
    return t.documents.select("doc_id", F.sha2(F.coalesce(spoken, F.lit("")), 256).alias("spoken"), F.coalesce((F.length(spoken) - F.length("text")).cast("bigint"), F.lit(0)).alias("longer"))


DICTIONARY = r"""rules AS (SELECT DISTINCT w AS find, 'q' || reverse(w) || 'qx' AS speak FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM benchmark) WHERE w NOT LIKE 'q%'),
tokens AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\pL\pM\pN'']+|[^\pL\pM\pN'']+')) AS tok, generate_subscripts(regexp_extract_all(text, '[\pL\pM\pN'']+|[^\pL\pM\pN'']+'), 1) AS i FROM documents)"""


def dictionary(t):
    """A rule for each word of four letters or more of the benchmark."""
    words = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("find")).where("find NOT LIKE 'q%'").distinct()
    return words.select(F.xxhash64("find").alias("id"), "find", F.concat(F.lit("q"), F.reverse("find"), F.lit("qx")).alias("speak_as"))


@query(f"WITH {DICTIONARY} SELECT d.doc_id, coalesce(sha256(string_agg(coalesce(speak, tok), '' ORDER BY i)), sha256('')) AS spoken, count(DISTINCT find) AS n_rules FROM documents d LEFT JOIN tokens USING (doc_id) LEFT JOIN rules ON lower(tok) = find GROUP BY d.doc_id")
def dictionary_spoken(t):
    """A dictionary of many rules, as a table, over all documents."""
    found = rules.apply_rule_table(t.documents.select("doc_id", "text"), "doc_id", "text", dictionary(t))
    return found.select("doc_id", F.sha2(F.coalesce("spoken", F.lit("")), 256).alias("spoken"), F.size("applied").cast("bigint").alias("n_rules"))


@query(f"WITH {DICTIONARY}, hits AS (SELECT lower(tok) AS find, count(DISTINCT doc_id) AS texts FROM tokens GROUP BY 1) SELECT find, coalesce(texts, 0) AS texts FROM rules LEFT JOIN hits USING (find)")
def dictionary_hits(t):
    """How many documents each rule of a dictionary matches."""
    return rules.rule_counts(t.documents, "text", dictionary(t)).select("find", "texts")


@query("SELECT b.doc_id FROM documents b JOIN labels l ON b.doc_id = l.doc_id WHERE l.quality = 0 AND b.doc_id > 20 ORDER BY b.doc_id LIMIT 50")
def review_page(t):
    """Keyset page of marked rows; filtered before the limit."""
    marked = t.documents.join(t.labels.where("quality = 0").select("doc_id"), "doc_id", "left_semi")
    return ordering.key_page(marked, "doc_id", 20, 50).select("doc_id")


@query("SELECT count(*) FILTER (l.doc_id IS NULL) AS unmarked, count(*) FILTER (quality = 1) AS reviewed, count(*) FILTER (quality = 0 AND toxic = 1) AS suspicious FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def tagging_summary(t):
    """A16."""
    joined = t.documents.join(t.labels.withColumn("there", F.lit(1)), "doc_id", "left")
    return aggregates.counts(joined, {"unmarked": F.col("there").isNull(), "reviewed": F.col("quality") == 1, "suspicious": (F.col("quality") == 0) & (F.col("toxic") == 1)})


@query("SELECT doc_id, CASE WHEN l.quality IS NULL THEN d.lang ELSE 'marked' END AS lang, d.source FROM documents d LEFT JOIN labels l USING (doc_id)")
def marked_documents(t):
    """A column set on the rows with given keys."""
    return state.mark(t.documents.select("doc_id", "lang", "source"), t.labels.where("quality IS NOT NULL"), ["doc_id"], "lang", "marked")


@query("SELECT conv_id, string_agg(CASE WHEN regexp_matches(trim(text, E' \\n\\t'), '[.!?…;:]$') THEN trim(text, E' \\n\\t') ELSE trim(text, E' \\n\\t') || '.' END, ' ' ORDER BY turn) AS transcript FROM conversations WHERE trim(text, E' \\n\\t') <> '' GROUP BY conv_id")
def transcripts(t):
    """T41."""
    grouped = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("turns")).where(F.exists("turns", lambda x: text.trim(x["text"]) != ""))
    return grouped.select("conv_id", text.join_transcripts(F.transform("turns", lambda x: x["text"])).alias("transcript"))
