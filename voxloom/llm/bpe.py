"""BPE encoding and decoding with forced boundaries.

Merges never cross a pair of bytes that no token of the vocabulary holds, so such a pair marks a certain cut: the
fragments between cuts are encoded independently and their tokens concatenated. White space, and changes between
letters, digits and other characters, are cuts that the tokenizer's own splitting makes. Each distinct fragment and
word is merged once a worker and then looked up.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer, models

from .common import kind, map_batches, only_model, table, texts

#: Words that a worker remembers, and characters of the longest of them; beyond that number it forgets all and goes on.
REMEMBERED, LONGEST = 120_000, 64


#: How a file may normalise and split texts; another way would need another splitter here, so other files are refused.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
PLAIN = {"post_processor": None, "decoder": None, "truncation": None, "padding": None, "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}


class ForcedBoundaryBPE:
    """A tokenizer file of the library's BPE kind with byte-level letters, NORMALIZER and SPLITTER, and no decoder.

    A file that normalises, splits or decodes in another way raises ValueError.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        told = {"normalizer": spec["normalizer"], "pre_tokenizer": spec["pre_tokenizer"], **{k: (spec | model).get(k) or False for k in PLAIN}}
        want = {"normalizer": NORMALIZER, "pre_tokenizer": SPLITTER, **{k: v or False for k, v in PLAIN.items()}}
        if told != want or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} differs in {sorted(k for k in want if told[k] != want[k]) or 'its added tokens'}")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) for m in model["merges"]]
        self.library = Tokenizer.from_file(path)
        self.final = models.BPE(vocab=self.vocab, merges=merges, end_of_word_suffix=self.suffix) if self.suffix else models.BPE(vocab=self.vocab, merges=merges)
        self.inner = models.BPE(vocab=self.vocab, merges=merges)
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {t: i.to_bytes(4, "little") for t, i in specials.items()}
        names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in specials.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.special_at = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.pairs = {t[i : i + 2] for word in self.vocab for t in (word.removesuffix(self.suffix) if self.suffix else word,) for i in range(len(t) - 1)}
        # the byte-level alphabet: printable characters stand for themselves, the others for code points from 256 on
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.letter = {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}
        # texts of these characters only are split here; any other text is normalised and split by the library
        letters = "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == "L")
        numbers = "".join(chr(c) for c in range(0x180) if unicodedata.category(chr(c))[0] == "N")
        spaces = "\t-\r \x85\xa0"
        self.plain = re.compile("[\0-įı-ž]*").fullmatch  # no combining marks, no letter with odd lower case
        self.split = re.compile(f"[{letters}]+|[{numbers}]|'(?:s|t|re|ve|m|ll|d)|[^{spaces}{letters}{numbers}]+").findall
        self.known: dict[str, bytes] = {}

    def fragments(self, word: str) -> list[str]:
        """A word in the byte-level alphabet, cut where no token reaches across."""
        cuts = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.pairs), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def word(self, text: str) -> bytes:
        """Ids of one pre-token: its fragments, the last of which ends the word."""
        found = self.known.get(text)
        if found is None:
            parts = self.fragments("".join(self.letter[b] for b in text.encode()))
            tokens = [t for p in parts[:-1] for t in self.inner.tokenize(p)] + list(self.final.tokenize(parts[-1]))
            found = b"".join(t.id.to_bytes(4, "little") for t in tokens)
            if len(text) <= LONGEST:
                self.known[text] = found
        return found

    def pretokens(self, text: str) -> list[str]:
        if self.plain(text):
            return self.split(text.lower())
        steps = self.library
        whole = steps.normalizer.normalize_str(text) if steps.normalizer else text
        back = {c: b for b, c in self.letter.items()}
        return [bytes(back[c] for c in piece).decode() for piece, _ in steps.pre_tokenizer.pre_tokenize_str(whole)] if whole else []

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out: list[bytes] = []
        for k, part in enumerate(self.special_at.split(text) if self.special_at else [text]):
            if k % 2:
                out.append(self.special[part])
            elif part:
                known = self.known
                out += [known.get(w) or self.word(w) for w in self.pretokens(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The library's decoding: without a decoder, the tokens set apart by spaces."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def tokenizer(path: str) -> ForcedBoundaryBPE:
    return only_model(f"tokenizer {path}", lambda: ForcedBoundaryBPE(path))


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where this machine, driver or executor, has a file of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row, and with ``ids`` the token ids, an array of ints.

    ``vocabulary`` names a file of the public tokenizers, or is a path that every executor has. Texts are encoded as
    the tokenizers library does with add_special_tokens=False: strings of special tokens in a text become these tokens.
    The digest of the decoded text is that of these ids, decoded. A file that the splitter here does not fit is refused.
    Null and empty texts have no tokens. Repeated rows are encoded alike, an empty table gives an empty result, and
    columns other than doc_id and text are ignored.
    """

    def work(batch: pa.RecordBatch):
        bpe = tokenizer(vocabulary if "/" in vocabulary else vocabulary_path(vocabulary))
        n, id_digests, text_digests, raw = [], [], [], []
        for text in texts(batch):
            encoded = bpe.encode(text)
            n.append(len(encoded) // 4)
            id_digests.append(hashlib.sha256(encoded).hexdigest())
            text_digests.append(hashlib.sha256(bpe.decode(encoded).encode()).hexdigest())
            raw.append(encoded if ids else b"")
        out = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
        if ids:
            ends = pa.array([0, *accumulate(n)], pa.int32())
            out.append(pa.ListArray.from_arrays(ends, pa.Array.from_buffers(pa.int32(), sum(n), [None, pa.py_buffer(b"".join(raw))])))
        yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(out)])

    schema = f"doc_id {kind(docs, 'doc_id')}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return map_batches(docs.select("doc_id", "text"), work, schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
