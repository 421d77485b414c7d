import pytest
from pyspark.sql import functions as F

from voxloom.functions import hashing, text


@pytest.fixture(scope="module")
def check(spark):
    def run(f, cases):
        """cases: {input: expected}; all in one job."""
        rows = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, t string")
        got = [r.v for r in rows.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]
        assert dict(zip(cases, got, strict=True)) == cases

    return run


def test_tokens(check):
    check(text.tokens, {"<CHARNAME>, tell <PRO_HIMHER> that <CHARNAME> agrees.": ["CHARNAME", "PRO_HIMHER"], "a < b <CHARNAME>": [], "<123> <__> <PRO2>": ["PRO2"], "An unclosed <PRO_HISHER": [], "": []})
    check(text.token_mask, {"<CHARNAME> <DAY> <FOO>": 1 | 16384 | 32768, "<HESHE> <GABBER>": 8192 | 2, "none": 0})
    check(lambda c: text.mask_labels(text.token_mask(c), text.TOKEN_BITS), {"<CHARNAME> <DAY>": ["charname", "time"], "x": []})


def test_resolve_tokens(check):
    check(text.resolve_tokens, {
        "Well met, <CHARNAME>.": "Well met, friend.", "<CHARNAME>, come here.": "friend, come here.", "I am <CHARNAME>.": "I am Hero.",
        "Take <PRO_HISHER> hand": "Take their hand", "a <PRO_MANWOMAN> of honor": "a person of honor", "no tokens ,  here": "no tokens ,  here", "by <UNKNOWN_THING> !": "by friend!",
    })
    check(lambda c: text.resolve_tokens(c, "female", vocative=""), {"Well met, <CHARNAME>.": "Well met.", "<PRO_HESHE> is a <PRO_LADYLORD>": "she is a Lady"})
    check(lambda c: text.resolve_tokens(c, other="elf"), {"a <SOMETHING> here": "an elf here", "An <SOMETHING>": "An elf"})


def test_cues(check):
    check(text.map_cues, {
        "Please leave me alone *sigh*": "Please leave me alone[sigh]", "*sigh*Well": "[sigh] Well", "I *really* mean it": "I really mean it", "*hic* you [grunt] there": "you there",
        "*grumble grumble* no": "[dissatisfaction-hnn] no", "*sigh* *laughs* ok": "[sigh][laughter] ok", "<losing battle>": "", "<CHARNAME>": "<CHARNAME>", "": "", " a  b\n": "a b", "one * star": "one * star",
    })
    check(text.strip_cues, {"Please *sigh* go": "Please go", "a*x*b": "a b", "[grunt]": "", "<prose>": "", "open *star": "open *star"})
    check(text.cues, {"*Sigh* and *sigh* and * ok * **": ["Sigh", "ok"], "none": []})
    check(text.speakable_dialogue, {"*sigh*": False, "hm": True, "...": False, "9": True, "é": True})
    check(lambda c: F.transform(text.cues(c), lambda x: text.cue_risk(x)), {"*waves hands* *really* *grrowl* *sigh* *aaaah*": [True, False, True, False, True]})
    check(text.unknown_tags, {"[sigh] [angry] [B EY1 S] []": ["angry", ""]})


def test_audit(check):
    mask = lambda c: text.audit_mask(c, text.map_cues(c))
    bits = text.AUDIT_BITS
    check(mask, {
        "A fine day for murder.": bits["plain_ok"], "Please leave me alone *sigh*": bits["mapped_ok"], "*sigh*": bits["non_speakable"], "": bits["non_speakable"], "open * star": bits["unterminated_asterisk"],
        "Hmm, perhaps.": bits["interpretive_candidate"], "Nooooo!": bits["tts_unfriendly_spelling"], "*waves hands* hello": bits["spoken_stage_direction"], "Stop. *sigh* Go.": bits["mapped_ok"],
    })
    check(lambda c: text.needs_attention(mask(c)), {"A fine day.": False, "Nooooo!": True, "*sigh*": False, "Hmm, yes": False})


def test_spelling(check):
    check(text.unfriendly_token, {t: True for t in ("B-b-b-but", "wwaaAAAAHHHH", "Nooooo", "hahaha", "Gllgghh", "tthhrgunts")} | {t: False for t in ("But", "Waterdeep", "No", "bookkeeper", "III", "XVII", "1,000", "", "hmm-hmm")})
    check(text.spoken_words, {"Hello, (World)! it's  B-b": ["hello", "world", "it's", "b-b"]})
    check(text.elongated, {"Noo": False, "NOoo": True, "": False})


def test_rules(check):
    check(lambda c: text.apply_rules(c, [("Noooo", "No")]), {"NOOOO! But not Nooooise.": "No! But not Nooooise."})
    check(lambda c: text.apply_rules(c, [("B-b-b", "B"), ("B-b-b-but", "But")]), {"B-b-b-but...": "But..."})
    check(lambda c: text.apply_rules(c, [("a.b", "$1\\")]), {"x a.b axb": "x $1\\ axb"})
    check(lambda c: text.applied_rules(c, [("the", "x"), ("fox", "y")]), {"The Fox's fox": ["the", "fox"], "fox's": []})


def test_reference_text(check):
    check(text.usable_reference, {"Well met, traveler of the road.": True, "[grunt]": False, "Hah!": False, "*laughs* what a fine day it is": False, "Ha ha ha ha": False})
    check(lambda c: F.round(text.text_richness(c), 4), {"One two three four five six seven eight nine ten eleven twelve thirteen fourteen": 1.0, "Hm": 0.0})
    check(lambda c: text.plausible_duration(c, F.lit(1.0)), {"one two three four five six seven eight": False, "one two": True})
    check(lambda c: F.round(text.elongation(c), 4), {"sooo": 0.75, "so": 0.0, "": 0.0})


def test_names(check):
    check(text.stem, {"ABELA01": "abela", "x": "x", "12": ""})
    check(text.clean_name, {" Foo\0bar": "foo", "A ": "a"})
    check(lambda c: text.parse_identity_key(c)["name_id"], {"12:1": 12, "12": 12, "ungrouped:7": None, "x": None})
    check(lambda c: text.parse_identity_key(c)["speaker"], {"12:1": None, "ungrouped:7": 7})
    check(text.escape_quoted, {"a~b\x01\n": "a%TILDE%b\n"})
    check(lambda c: hashing.base36(F.length(c), 2), {"": "00", "x" * 35: "0Z", "x" * 36: "10"})
    check(hashing.is_generated_name, {"ZABCDE00": True, "zabcde00": True, "ABCDEFGH": False, "Z": False})
    check(lambda c: text.excerpt(c, 3), {"abcd": "abc…", "abc": "abc"})
    check(text.artifact_reason, {"ok then": None, "tag --batch x": "command fragment", 'a\\"b': "escape sequence", "see C:\\x": "file path", "at 5:00": None})
    assert "é" not in "É"


def test_ascii_folding_is_not_unicode_folding(check):
    check(text.ascii_lower, {"ÉA": "Éa"})
    check(hashing.text_hash, {"a\n": "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"})
