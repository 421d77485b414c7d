"""Dialogue text as Column expressions: tokens, stage directions, spelling, rules and reference-text gates.

A *cue* is ``*stage direction*``; a *token* is ``<UPPER_ID>``, replaced when a game runs. White space is Unicode white
space, alphabetic ranges are Unicode unless a docstring says ASCII. Each function takes and returns Columns and maps
null to null unless it says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cues that are mapped to inline tags.
CUE_TAGS = {
    "sigh": "[sigh]", "sighs": "[sigh]", "sighing": "[sigh]",
    "laugh": "[laughter]", "laughs": "[laughter]", "laughing": "[laughter]", "laughter": "[laughter]",
    "chuckle": "[laughter]", "chuckles": "[laughter]", "chuckling": "[laughter]",
    "giggle": "[laughter]", "giggles": "[laughter]", "giggling": "[laughter]",
    "cackle": "[laughter]", "cackles": "[laughter]", "cackling": "[laughter]",
    "grin": "[laughter]", "grins": "[laughter]", "grinning": "[laughter]",
    "gasp": "[surprise-ah]", "gasps": "[surprise-ah]", "gasping": "[surprise-ah]",
    "surprised": "[surprise-oh]", "surprise": "[surprise-oh]",
    "hmm": "[dissatisfaction-hnn]", "hmph": "[dissatisfaction-hnn]", "hnn": "[dissatisfaction-hnn]",
    "grumble": "[dissatisfaction-hnn]", "grumbles": "[dissatisfaction-hnn]",
}
SPOKEN_WORD_TAGS = {"Bah": "[dissatisfaction-hnn]"}

# Inline tags that a text may hold.
INLINE_TAGS = (
    "[laughter]", "[sigh]", "[confirmation-en]", "[question-en]", "[question-ah]", "[question-oh]", "[question-ei]", "[question-yi]",
    "[surprise-ah]", "[surprise-oh]", "[surprise-wa]", "[surprise-yo]", "[dissatisfaction-hnn]",
)

# Cues that are removed and not spoken.
REMOVED_CUES = ("sniff", "sniffs", "sniffing", "breath", "breathes", "breathing")
UNSPOKEN_CUES = (
    "achoo", "ahem", "belch", "belches", "clap", "claps", "crunch", "crunches", "erp", "erf", "glug", "glugs", "grrr", "growl", "growls",
    "hack", "hacks", "hic", "hiss", "hisses", "hisss", "hissss", "hisssss", "moan", "moans", "mumble", "mumbles", "mutter", "mutters",
    "pant", "pants", "panting", "shiver", "shivers", "shudder", "shudders", "sniffle", "sniffling", "snap", "snaps", "yawn", "yawns",
    "cough", "coughs", "sneeze", "sneezes", "snore", "snores", "burp", "burps", "gulp", "gulps", "gag", "gags", "spit", "spits",
    "vomit", "vomits", "sob", "sobs", "cry", "cries", "groan", "groans", "grunt", "grunts", "snort", "snorts", "snicker", "snickers",
)

# Words that asterisks merely emphasise.
EMPHASIS_WORDS = (
    "a", "actual", "again", "against", "all", "alone", "also", "always", "am", "an", "and", "any", "anything", "are", "as", "assist", "at",
    "aware", "become", "before", "beneath", "believe", "better", "but", "by", "can", "close", "continue", "could", "course", "curse",
    "dare", "dead", "did", "died", "do", "does", "don't", "docks", "dozens", "earn", "entire", "entrepreneurs", "even", "exist",
    "extended", "feel", "few", "fine.", "first", "got", "good", "has", "have", "he", "headed", "her", "here", "him", "i", "in", "is", "it",
    "just", "knew", "know", "last", "like", "live", "love", "loves", "may", "me", "might", "more", "most", "must", "my", "natural", "nice",
    "no", "no one", "not", "nothing", "now", "only", "or", "our", "place", "please", "plenty", "power", "real", "really", "removed",
    "right", "right here", "safe", "seething", "serious", "shall", "she", "should", "so", "some", "someone", "something", "such", "sure",
    "still", "stands", "stench", "terrible", "that's", "the", "their", "them", "then", "there's", "these", "they", "think", "this",
    "thing", "those", "thought", "took", "too", "very", "was", "we", "well", "were", "what", "when", "who", "why", "will", "wish", "with",
    "won't", "would", "want", "yet", "you", "your", "elf",
)

# Cues that rule a line out as reference text.
HARD_VOCALIZATIONS = (
    "hic", "hiccup", "hiccups", "burp", "burps", "belch", "belches", "giggle", "giggles", "laugh", "laughs", "laughter", "chuckle", "chuckles",
    "snort", "snorts", "grunt", "grunts", "growl", "growls", "howl", "howls", "slurp", "slurps", "gurgle", "gurgles", "sob", "sobs",
    "whimper", "whimpers", "snarl", "snarls", "roar", "roars", "cackle", "cackles", "hoot", "hoots", "yawn", "yawns", "pant", "pants", "wheeze", "wheezes",
)
LAUGHTER = ("ha", "hah", "haa", "haha", "hahaha", "heh", "hehe", "ho", "hoo", "hoho")
INTERJECTIONS = ("ha", "hah", "haha", "heh", "ho", "hoho", "yo", "oy")

# Bits of token families, in the order of their labels.
TOKEN_BITS = {
    "charname": 1, "gabber": 2, "pro_hisher": 4, "pro_himher": 8, "pro_heshe": 16, "pro_ladylord": 32, "pro_sirmaam": 64, "pro_brothersister": 128,
    "pro_sondaughter": 256, "pro_girlboy": 512, "pro_manwoman": 1024, "pro_malefemale": 2048, "pro_race": 4096, "speaker_pronoun": 8192, "time": 16384, "global": 32768,
}
TIME_TOKENS = ("DAYTIME", "DAYNIGHT", "DAY", "MONTH", "MONTHNAME", "YEAR", "GAMEDAY", "GAMEDAYS")
SPEAKER_TOKENS = ("HISHER", "HIMHER", "HESHE", "LADYLORD", "SIRMAAM", "BROTHERSISTER", "SONDAUGHTER", "GIRLBOY", "MANWOMAN", "MALEFEMALE", "RACE", "LEVEL", "GENDER")

# Bits of the corpus audit, in the order of their labels.
AUDIT_BITS = {
    "plain_ok": 1, "mapped_ok": 2, "stripped_unknown_cue": 4, "spoken_stage_direction": 8, "unterminated_asterisk": 16,
    "placement_candidate": 32, "interpretive_candidate": 64, "tts_unfriendly_spelling": 128, "non_speakable": 256,
}
#: Audit results that need nobody's judgement.
BENIGN = AUDIT_BITS["plain_ok"] | AUDIT_BITS["mapped_ok"] | AUDIT_BITS["interpretive_candidate"] | AUDIT_BITS["non_speakable"]

TOKEN = r"[A-Z0-9_]*[A-Z][A-Z0-9_]*"
#: An article at the end of a text.
ARTICLE = r"(?<![\p{L}\p{N}'])([Aa])n? $"
MARKS = r"\*[^*]*\*|\[[^\]]*\]"


def _bool(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row, however often body uses it; a null value is passed on."""
    return F.get(F.transform(F.array(value), body), 0)


def ascii_lower(c: Column) -> Column:
    """Lower case of A to Z alone, as in tables whose collation is ASCII."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def trim(c: Column) -> Column:
    """Without Unicode white space at the ends (Spark's own trim removes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def in_list(c: Column, values: Sequence[str]) -> Column:
    return _bool(c.isin(list(values)))


# ---- tokens


def tokens(c: Column) -> Column:
    """Distinct tokens without brackets, in the order in which they appear. ``<`` reaches to the next ``>``."""
    spans = F.regexp_extract_all(c, F.lit(r"<([^>]*)>"), F.lit(1))
    return F.array_distinct(F.filter(spans, lambda x: x.rlike(f"^{TOKEN}$")))


def has_token(c: Column) -> Column:
    return F.size(tokens(c)) > 0


def is_token_name(c: Column) -> Column:
    """T02."""
    return c.rlike(f"^{TOKEN}$")


def token_mask(c: Column) -> Column:
    """The bits of all token families in a text."""

    def bit(t: Column) -> Column:
        own = F.coalesce(*(F.when(t == name.upper(), b) for name, b in TOKEN_BITS.items() if name not in ("speaker_pronoun", "time", "global")), F.lit(None))
        time, speaker = F.when(t.isin(*TIME_TOKENS), TOKEN_BITS["time"]), F.when(t.isin(*SPEAKER_TOKENS), TOKEN_BITS["speaker_pronoun"])
        return F.coalesce(own, time, speaker, F.lit(TOKEN_BITS["global"]))

    return F.aggregate(F.transform(tokens(c), bit), F.lit(0), lambda a, b: a.bitwiseOR(b))


def mask_labels(mask: Column, bits: Mapping[str, int]) -> Column:
    """The labels of the bits that are set."""
    return F.array_compact(F.array(*(F.when(mask.bitwiseAND(F.lit(b)) != 0, F.lit(name)) for name, b in bits.items())))


def labels_mask(labels: Column, bits: Mapping[str, int]) -> Column:
    """The inverse of mask_labels."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.array_contains(labels, name), F.lit(b)).otherwise(F.lit(0)) for name, b in bits.items()])


PROFILES = {
    # Words for tokens by profile.
    "male": {"PRO_HISHER": "his", "PRO_HIMHER": "him", "PRO_HESHE": "he", "PRO_LADYLORD": "Lord", "PRO_SIRMAAM": "sir", "PRO_BROTHERSISTER": "brother", "PRO_SONDAUGHTER": "son", "PRO_GIRLBOY": "boy", "PRO_MANWOMAN": "man", "PRO_MALEFEMALE": "male", "PRO_RACE": "human"},
    "female": {"PRO_HISHER": "her", "PRO_HIMHER": "her", "PRO_HESHE": "she", "PRO_LADYLORD": "Lady", "PRO_SIRMAAM": "ma'am", "PRO_BROTHERSISTER": "sister", "PRO_SONDAUGHTER": "daughter", "PRO_GIRLBOY": "girl", "PRO_MANWOMAN": "woman", "PRO_MALEFEMALE": "female", "PRO_RACE": "human"},
    "neutral": {"PRO_HISHER": "their", "PRO_HIMHER": "them", "PRO_HESHE": "they", "PRO_LADYLORD": "friend", "PRO_SIRMAAM": "friend", "PRO_BROTHERSISTER": "sibling", "PRO_SONDAUGHTER": "child", "PRO_GIRLBOY": "child", "PRO_MANWOMAN": "person", "PRO_MALEFEMALE": "person", "PRO_RACE": "traveler"},
}
COMMON_TOKENS = {
    "GABBER": "friend", "DAYTIME": "morning", "DAYNIGHT": "day", "DAY": "today", "MONTH": "this month", "MONTHNAME": "Mirtul", "YEAR": "1369", "GAMEDAY": "today", "GAMEDAYS": "today",
    "HISHER": "their", "HIMHER": "them", "HESHE": "they", "LADYLORD": "friend", "SIRMAAM": "friend", "BROTHERSISTER": "sibling", "SONDAUGHTER": "child", "GIRLBOY": "child", "MANWOMAN": "person", "MALEFEMALE": "person", "RACE": "traveler", "LEVEL": "experienced", "GENDER": "person",
}


def tidy_spaces(c: Column) -> Column:
    """Single spaces, none before ``.,!?;:`` and none at the ends."""
    return F.trim(F.regexp_replace(collapse(c), r" ([.,!?;:])", "$1"))


def resolve_tokens(c: Column, profile: str = "neutral", name: str = "Hero", vocative: str = "friend", other: str = "friend") -> Column:
    """Tokens as words that can be spoken; texts without a token stay as they are.

    The hero's name is a vocative after ``, `` or before ``,``; an empty vocative takes the comma before it along.
    Tokens of no known family become ``other``. An article before a token agrees with the word that takes its place.
    """
    hero = "<CHARNAME>"
    text = F.regexp_replace(F.regexp_replace(c, f", {hero}", f", {vocative}" if vocative else ""), f"{hero}(?=,)", vocative)
    words = COMMON_TOKENS | PROFILES[profile] | {"CHARNAME": name}
    known = F.create_map(*(F.lit(x) for pair in words.items() for x in pair))
    between, found = F.split(text, f"<{TOKEN}>"), F.regexp_extract_all(text, F.lit(f"<({TOKEN})>"), F.lit(1))

    def joined(part: Column, token: Column) -> Column:
        word = F.coalesce(F.try_element_at(known, token), F.lit(other))
        article = F.when(word.rlike("^[AEIOUaeiou]"), F.regexp_replace(part, ARTICLE, "$1n ")).otherwise(F.regexp_replace(part, ARTICLE, "$1 "))
        return F.when(token.isNull(), part).when(word == "", part).otherwise(F.concat(article, word))

    return F.when(has_token(c), tidy_spaces(F.array_join(F.zip_with(between, found, joined), ""))).otherwise(c)


def effective_spoken_text(original: Column, stored: Column, **words) -> Column:
    """The original resolved anew if it has tokens, else what is stored."""
    raw = F.when(F.coalesce(original, F.lit("")) != "", original).otherwise(stored)
    return F.when(_bool(has_token(raw)), resolve_tokens(raw, **words)).otherwise(stored)


# ---- cues


def normalize_cue(c: Column) -> Column:
    """Without white space around and ``!?`` at the end, ASCII lower case."""
    return ascii_lower(F.regexp_replace(trim(c), r"[!?]+$", ""))


def cue_variants(c: Column) -> Column:
    """The forms to look a cue up by: itself, and its word if it repeats one word only."""
    norm = normalize_cue(c)
    words = F.split(collapse(norm), " ")
    repeated = (F.size(words) >= 2) & (F.size(F.array_distinct(words)) == 1)
    return F.when(repeated, F.array(norm, words[0])).otherwise(F.array(norm))


def _tag_map(tags: Mapping[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in tags.items() for x in pair))


def cue_tag(c: Column, tags: Mapping[str, str] = CUE_TAGS) -> Column:
    """The inline tag of a cue, else null."""
    found = _tag_map(tags)
    return F.get(F.filter(F.transform(cue_variants(c), lambda v: F.try_element_at(found, v)), lambda t: t.isNotNull()), 0)


def cue_removed(c: Column) -> Column:
    """True for cues that are neither spoken nor tagged."""
    unspoken = F.array(*(F.lit(x) for x in (*REMOVED_CUES, *UNSPOKEN_CUES)))
    return F.arrays_overlap(cue_variants(c), unspoken)


def cues(c: Column) -> Column:
    """The trimmed insides of cues, without those that differ from an earlier one only in ASCII case."""
    found = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"\*([^*]*)\*"), F.lit(1)), trim), lambda x: x != "")
    # equal forms side by side, the earliest first, in time that does not grow with the square of the cues
    folded = let(found, lambda f: F.sort_array(F.transform(f, lambda x, i: F.struct(ascii_lower(x).alias("form"), i.alias("i"), x.alias("cue")))))
    first = let(folded, lambda f: F.filter(f, lambda x, k: (k == 0) | (F.get(f, k - 1)["form"] != x["form"])))
    return F.transform(F.sort_array(F.transform(first, lambda x: F.struct(x["i"].alias("i"), x["cue"].alias("cue")))), lambda x: x["cue"])


def annotation_only(c: Column) -> Column:
    """True for a text that is one ``<...>`` from end to end, with something other than a token inside."""
    return let(trim(c), _annotation)


def _annotation(t: Column) -> Column:
    return t.startswith("<") & t.endswith(">") & (F.length(t) >= 2) & ~t.rlike(f"^<{TOKEN}>$")


def map_cues(c: Column, tags: Mapping[str, str] = CUE_TAGS) -> Column:
    """Cues become tags set against what comes before, are removed, or are spoken as emphasis; ``[...]`` goes."""
    return let(trim(c), lambda t: _map_cues(t, tags))


def _map_cues(t: Column, tags: Mapping[str, str]) -> Column:
    pieces = F.regexp_extract_all(t, F.lit(MARKS + r"|[^*\[]+|[*\[]"), F.lit(0))

    def spoken(p: Column) -> Column:
        inner = F.substring(p, F.lit(2), F.length(p) - 2)
        tag = cue_tag(inner, tags)
        cue = F.when(tag.isNotNull(), F.concat(F.lit("\u0001"), tag, F.lit(" "))).when(cue_removed(inner) | (trim(inner) == ""), F.lit(" ")).otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))
        return F.when(p.rlike(r"^\*[^*]*\*$"), cue).when(p.rlike(r"^\[[^\]]*\]$"), F.lit(" ")).otherwise(p)

    joined = F.array_join(F.transform(pieces, spoken), "")
    mapped = collapse(F.regexp_replace(joined, "(?U)\\s*\u0001", ""))
    return F.when(_annotation(t), F.lit("")).when(~t.rlike("[*\\[\u0001]"), collapse(t)).otherwise(mapped)


def strip_cues(c: Column) -> Column:
    """The text without cues and ``[...]``."""
    return let(trim(c), lambda t: F.when(_annotation(t), F.lit("")).otherwise(collapse(F.regexp_replace(t, MARKS, " "))))


def speakable(c: Column) -> Column:
    """Has a letter or number; null counts as empty."""
    return _bool(c.rlike(r"[\p{IsAlphabetic}\p{N}]"))


def speakable_dialogue(c: Column) -> Column:
    """Something is left to speak when cues are stripped."""
    return _bool(let(trim(c), _speakable_dialogue))


def _speakable_dialogue(t: Column) -> Column:
    # spaces do not count, so they need not be collapsed
    return ~_annotation(t) & speakable(F.when(t.rlike(r"[*\[]"), F.regexp_replace(t, MARKS, " ")).otherwise(t))


def elongated(c: Column) -> Column:
    """Three equal characters in a row, ASCII case aside."""
    return c.rlike(r"(?is)(.)\1\1")


def cue_risk(c: Column, tags: Mapping[str, str] = CUE_TAGS) -> Column:
    """A cue that would be spoken although it looks like a stage direction."""
    norm = normalize_cue(c)
    growl = norm.startswith("g") & (F.regexp_count(norm, F.lit("r")) >= 2)
    odd = norm.rlike(r"(?U)\s") | norm.startswith("(") | elongated(norm) | growl | ~in_list(norm, EMPHASIS_WORDS)
    return (trim(c) != "") & cue_tag(c, tags).isNull() & ~cue_removed(c) & (norm != "") & odd


def unknown_tags(c: Column) -> Column:
    """``[...]`` insides that are no inline tag; those with white space are spellings of sounds and fine."""
    inner = F.regexp_extract_all(c, F.lit(r"\[([^\]]*)\]"), F.lit(1))
    known = F.array(*(F.lit(t[1:-1]) for t in INLINE_TAGS))
    return F.filter(inner, lambda x: ~x.rlike(r"(?U)\s") & ~F.array_contains(known, x))


def unterminated_asterisk(c: Column) -> Column:
    """T25."""
    return F.regexp_count(c, F.lit(r"\*")) % 2 == 1


def tag_misplaced(c: Column) -> Column:
    """White space between the end of a sentence and a tag."""
    return c.rlike(r"(?U)[.?!…]\s+\[")


def interpretive(c: Column) -> Column:
    """Starts with hmm, hmph or ``hm ``."""
    return _interpretive(trim(c))


def _interpretive(t: Column) -> Column:
    return ascii_lower(F.substring(t, 1, 4)).rlike(r"^(hmm|hmph|hm )")


# ---- spelling


def _trim_token(t: Column) -> Column:
    return F.regexp_replace(t, r"^[^\p{IsAlphabetic}\p{N}'\-]+|[^\p{IsAlphabetic}\p{N}'\-]+$", "")


def unfriendly_token(t: Column) -> Column:
    """A spelling that speech models handle badly; Roman numerals are exempt."""
    w = _trim_token(t)
    low = ascii_lower(w)
    letters = F.length(F.regexp_replace(w, "[^A-Za-z]", ""))
    roman = w.rlike("[A-Za-z]") & ~low.rlike("[a-z&&[^ivxlcdm]]")
    parts = F.filter(F.split(low, "-"), lambda p: p != "")
    first = F.substring(F.get(parts, 0), 1, 1)
    stutter = (F.size(parts) >= 3) & F.forall(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p == first) & F.coalesce(F.substring(F.get(parts, F.size(parts) - 1), 1, 1) == first, F.lit(False))
    vocal = low.rlike("^[a-z]{6,}$") & low.rlike("^((ha)+|(he)+|(ho)+|(ah)+|(wa)+)$")
    run = (letters >= 6) & low.rlike("[a-z&&[^aeiouy]]{6}")
    return (w != "") & ~roman & (stutter | low.rlike(r"([a-z])\1\1") | vocal | low.contains("ssz") | low.contains("zzz") | run)


def words_of(c: Column) -> Column:
    """White-space separated parts."""
    return F.filter(F.split(collapse(c), " "), lambda w: w != "")


#: What a spelling that unfriendly_token finds holds in any case: three of one letter, ``ssz``, a syllable three times, six
#: consonants, or two hyphens.
_SUSPECT = r"([a-z])\1\1|ssz|(ha|he|ho|ah|wa)\2\2|[bcdfghjklmnpqrstvwxz]{6}|-[^ ]*?-"


def unfriendly_spelling(c: Column) -> Column:
    """T29. One pass over the text finds the words that hold a suspect run; only these are judged."""
    return _unfriendly_spelling(collapse(c))


def _unfriendly_spelling(c: Column) -> Column:
    words = F.regexp_extract_all(ascii_lower(c), F.lit(rf"(?<![^ ])(?=[^ ]*?(?:{_SUSPECT}))[^ ]+"), F.lit(0))
    return F.exists(words, unfriendly_token)


def spoken_words(c: Column) -> Column:
    """Lower-case words without punctuation around them."""
    return F.filter(F.transform(words_of(c), lambda w: F.lower(_trim_token(w))), lambda w: w != "")


def same_words(source: Column, other: Column) -> Column:
    """Both texts, stripped of cues, have the same words in order; a word that is hard to speak may become one that isn't."""
    word = lambda w: ascii_lower(F.regexp_replace(w, r"^[^\p{IsAlphabetic}\p{N}']+|[^\p{IsAlphabetic}\p{N}']+$", ""))
    found = lambda c: F.filter(F.transform(words_of(strip_cues(F.regexp_replace(c, r"\[[^\]]*\]", ""))), word), lambda w: w != "")
    x, y = found(source), found(other)
    return (F.size(x) == F.size(y)) & F.forall(F.zip_with(x, y, lambda p, q: (p == q) | (unfriendly_token(p) & ~unfriendly_token(q))), lambda ok: ok)


# Options of command lines that don't belong in dialogue.
COMMAND_MARKERS = ("--db", "--line", "--text", "--project", "--batch", "--limit", "--after")


def artifact_reason(c: Column, markers: Sequence[str] = COMMAND_MARKERS) -> Column:
    """Why a text looks like a tool's output and not dialogue; null if it doesn't."""
    low = ascii_lower(c)
    return (
        F.when(reduce(lambda a, b: a | b, [low.contains(m) for m in markers], F.lit(False)), "command fragment")
        .when(c.contains('\\"') | c.contains("\\\\"), "escape sequence")
        .when(c.rlike(r"[A-Za-z]:\\") | c.rlike(r"AppData[\\/]Roaming"), "file path")
    )


# ---- corpus audit


def audit_mask(source: Column, mapped: Column, tags: Mapping[str, str] = CUE_TAGS) -> Column:
    """The audit bits of a text and what the cue mapper makes of it, white space collapsed as map_cues does."""
    found = F.when(source.contains("*"), cues(source)).otherwise(F.array().cast("array<string>"))
    return let(F.struct(trim(source).alias("t"), found.alias("found")), lambda x: _audit_mask(x["t"], x["found"], mapped, tags))


def _audit_mask(t: Column, found: Column, mapped: Column, tags: Mapping[str, str]) -> Column:
    bit = lambda on, name: F.when(_bool(on), F.lit(AUDIT_BITS[name])).otherwise(F.lit(0))
    open_star = unterminated_asterisk(t)
    risky = F.exists(found, lambda x: cue_risk(x, tags))
    flags = [
        bit(open_star, "unterminated_asterisk"), bit(risky, "spoken_stage_direction"), bit(mapped.contains("[") & tag_misplaced(mapped), "placement_candidate"),
        bit((F.size(found) == 0) & ~open_star & _interpretive(t), "interpretive_candidate"), bit(_unfriendly_spelling(mapped), "tts_unfriendly_spelling"),
    ]
    clean = F.when(F.size(found) == 0, AUDIT_BITS["plain_ok"]).otherwise(AUDIT_BITS["mapped_ok"])
    mask = let(reduce(lambda a, b: a.bitwiseOR(b), flags), lambda m: F.when(m == 0, clean).otherwise(m))
    return F.when(~_bool(_speakable_dialogue(t)), AUDIT_BITS["non_speakable"]).otherwise(mask)


def needs_attention(mask: Column) -> Column:
    """a bit outside the benign set."""
    return mask.bitwiseAND(F.lit(~BENIGN & sum(AUDIT_BITS.values()))) != 0


# ---- pronunciation rules


def whole_word(find: str) -> str:
    """A pattern for a whole word, any case, with apostrophes as letters."""
    quoted = "\\Q" + find.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return rf"(?iu)(?<![\p{{IsAlphabetic}}\p{{N}}']){quoted}(?![\p{{IsAlphabetic}}\p{{N}}'])"


def apply_rules(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(find, speak as) rules of whole words, the longest first, each on what the one before made."""
    for find, speak in sorted(rules, key=lambda r: -len(r[0])):
        c = F.regexp_replace(c, whole_word(find), speak.replace("\\", "\\\\").replace("$", "\\$"))
    return c


def applied_rules(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The finds of the rules that match the source text."""
    return F.array_compact(F.array(*(F.when(c.rlike(whole_word(f)), F.lit(f)) for f, _ in sorted(rules, key=lambda r: -len(r[0])))))


def apply_tags(c: Column, cue_tags: Mapping[str, str] = CUE_TAGS, word_tags: Mapping[str, str] = SPOKEN_WORD_TAGS) -> Column:
    """Cues first, then words that are tags when spoken."""
    return apply_rules(map_cues(c, cue_tags), list(word_tags.items()))


# ---- reference text


def reference_form(c: Column) -> Column:
    """ASCII lower case without tokens, ``[...]`` and cues."""
    return ascii_lower(F.regexp_replace(trim(c), rf"<{TOKEN}>|{MARKS}", " "))


def word_count(c: Column) -> Column:
    """Words with two letters or more of the reference form."""
    return F.size(F.filter(words_of(reference_form(c)), lambda w: F.length(F.regexp_replace(w, "[^a-z]", "")) >= 2))


def letter_count(c: Column) -> Column:
    """ASCII letters of the reference form."""
    return F.length(F.regexp_replace(reference_form(c), "[^a-z]", ""))


def spoken_letters(c: Column) -> Column:
    """Letters of any script outside ``<...>``, ``[...]`` and cues; an open mark reaches to the end."""
    outside = F.regexp_replace(c, r"<[^>]*(>|$)|\[[^\]]*(\]|$)|\*[^*]*(\*|$)", "")
    return F.length(F.regexp_replace(outside, r"[^\p{IsAlphabetic}]", ""))


def ramp(x: Column, low: float, high: float) -> Column:
    """0 up to low, 1 from high, straight between."""
    return F.least(F.greatest((x - F.lit(float(low))) / (high - low), F.lit(0.0)), F.lit(1.0))


def text_richness(c: Column) -> Column:
    """T34."""
    return F.lit(0.6) * ramp(word_count(c), 1, 8) + F.lit(0.4) * ramp(letter_count(c), 10, 60)


def ordinary_word(w: Column) -> Column:
    """Looks like ordinary spelling."""
    vowels, n = F.regexp_count(w, F.lit("[aeiouy]")), F.length(w)
    slurred = w.contains("ssz") | w.contains("zzz") | (w.endswith("sz") & (n <= 8)) | ((n <= 10) & (F.regexp_count(w, F.lit("z")) >= 2))
    clusters = F.regexp_replace(w, "[^a-z]", "").rlike("[a-z&&[^aeiouy]]{5}")
    return (w != "") & ~in_list(w, INTERJECTIONS) & (vowels > 0) & ~unfriendly_token(w) & ~slurred & ~clusters & ~((n >= 5) & (vowels / n < 0.15))


def elongation(c: Column) -> Column:
    """Share of ASCII letters in runs of three or more equal ones, of a lower-case text."""
    letters = F.regexp_replace(c, "[^a-z]", "")
    runs = F.array_join(F.regexp_extract_all(letters, F.lit(r"((.)\2{2,})"), F.lit(1)), "")
    return F.when(letters == "", F.lit(0.0)).otherwise(F.length(runs) / F.length(letters))


def ordinary_speech(c: Column) -> Column:
    """0 to 1, how much a line reads like calm dialogue."""
    ascii_letters = lambda x: F.length(F.regexp_replace(x, "[^A-Za-z]", ""))
    inner = F.regexp_extract_all(c, F.lit(r"\*([^*]*)\*"), F.lit(1))
    hard = F.array(*(F.lit(x) for x in HARD_VOCALIZATIONS))
    vocal = F.exists(inner, lambda x: F.exists(hard, lambda h: ascii_lower(x).contains(h)))
    share = F.when(ascii_letters(c) == 0, F.lit(0.0)).otherwise(ascii_letters(F.array_join(inner, "")) / ascii_letters(c))
    norm = reference_form(c)
    found = F.filter(F.transform(words_of(norm), lambda w: F.regexp_replace(w, "^[^a-z]+|[^a-z]+$", "")), lambda w: w != "")
    laughs = F.size(F.filter(found, lambda w: in_list(w, LAUGHTER)))
    score = F.size(F.filter(found, ordinary_word)) / F.size(found) * (F.lit(1.0) - elongation(norm) * 0.7) - F.least(share * 2.0, F.lit(0.35))
    zero = (trim(c) == "") | vocal | (share > 0.25) | (F.size(found) == 0) | ((laughs >= 3) & (laughs * 2 >= F.size(found)))
    return F.when(zero, F.lit(0.0)).otherwise(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def usable_reference(c: Column) -> Column:
    """Enough ordinary words for a reference clip."""
    return ((word_count(c) >= 2) | (spoken_letters(c) >= 12)) & (ordinary_speech(c) >= 0.35)


def plausible_duration(c: Column, seconds: Column) -> Column:
    """The text can be spoken in that time."""
    words, letters = word_count(c), spoken_letters(c)
    return (seconds > 0) & ~((words >= 8) & (words / seconds > 5)) & ~((letters >= 40) & (letters / seconds > 30))


# ---- names and short forms


def join_transcripts(parts: Column) -> Column:
    """Trimmed parts that aren't blank, each with a final stop, joined by spaces."""
    kept = F.filter(F.transform(parts, trim), lambda x: x != "")
    return F.array_join(F.transform(kept, lambda x: F.when(x.rlike("[.!?…;:]$"), x).otherwise(F.concat(x, F.lit(".")))), " ")


def stem(c: Column) -> Column:
    """Lower case without digits at the end."""
    return ascii_lower(F.regexp_replace(c, "[0-9]+$", ""))


def clean_name(c: Column) -> Column:
    """Up to the first NUL, trimmed, lower case."""
    return ascii_lower(trim(F.regexp_replace(c, r"(?s)\x00.*$", "")))


def escape_quoted(c: Column) -> Column:
    """For a ``~``-quoted string table: no control characters but line feed and tab, ``~`` as %TILDE%."""
    return F.regexp_replace(F.regexp_replace(c, r"[\p{Cntrl}&&[^\n\t]]", ""), "~", "%TILDE%")


def excerpt(c: Column, most: int = 120) -> Column:
    """At most so many characters, with an ellipsis if cut."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def identity_key(name_id: Column, sex: Column, speaker: Column) -> Column:
    """``name_id:sex``, or ``ungrouped:speaker`` where there is no name id."""
    return F.when(name_id.isNotNull(), F.concat_ws(":", name_id, sex)).otherwise(F.concat_ws(":", F.lit("ungrouped"), speaker))


def parse_identity_key(key: Column) -> Column:
    """(name_id, sex, speaker) of a key in any of its forms: ``id:sex``, ``id`` and ``ungrouped:speaker``."""
    return F.struct(
        F.regexp_extract(key, r"^(-?\d+)(?::-?\d+)?$", 1).try_cast("bigint").alias("name_id"),
        F.regexp_extract(key, r"^-?\d+:(-?\d+)$", 1).try_cast("int").alias("sex"),
        F.regexp_extract(key, r"^ungrouped:(-?\d+)$", 1).try_cast("bigint").alias("speaker"),
    )


def shares_prefix(c: Column, stems: Column) -> Column:
    """The text starts with one of the stems, or one of them with it."""
    return F.exists(stems, lambda s: c.startswith(s) | s.startswith(c))


def search_form(c: Column, most: int = 200) -> Column:
    """Trimmed, capped and in lower case."""
    return F.lower(F.substring(trim(c), 1, most))


def option_label(label: Column, n: Column) -> Column:
    """A label with its count."""
    return F.concat(label, F.lit(" ("), n.cast("string"), F.lit(")"))
