"""BPE encoding and decoding by forced boundaries.

Two bytes that stand side by side in no token of the vocabulary can never be merged, so between them a
cut is certain. A word is cut at every such place, the fragments are encoded independently, and the
results are concatenated; fragments recur far more often than words and are remembered, up to a bound.

The normalisation and word pattern are those that the tokenizer file states: NFC, white space, lower
case, then letters, single digits and other runs. Defined results: null and empty texts give no ids and
an empty decoded text; the file's special tokens in a text are found as such; repeated rows give repeated
results; an empty table gives none. Texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import models

from . import common

#: White space as the tokenizer's pattern engine has it.
SPACE = "\t-\r \x85\xa0  -     　"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
SPACES = regex.compile(rf"[{SPACE}]+")
#: Python's split() cuts at these too, the tokenizer doesn't.
ODD = regex.compile("[\x1c-\x1f]")
#: Entries kept in each memo of a worker before it starts afresh.
MEMO = 600_000

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [rest.get(b, chr(b)) for b in range(256)]


class ForcedBoundaryCodec:
    """encode(text) and decode(ids) for a byte-level BPE vocabulary with an end-of-word mark."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.letters = byte_letters()
        merges = [tuple(m) for m in model["merges"]]
        # the same merges for fragments that end a word and for those that don't
        self.last = models.BPE(vocab=self.vocab, merges=merges, end_of_word_suffix=self.end, cache_capacity=0)
        self.inner = models.BPE(vocab=self.vocab, merges=merges, cache_capacity=0)
        self.seen = self.pairs_within_tokens()
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.fragments: dict[tuple[str, bool], tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[bytes, str]] = {}

    def pairs_within_tokens(self) -> set[str]:
        """Pairs of letters side by side in some token; every other pair is a forced boundary."""
        bare = (t.removesuffix(self.end) for t in self.vocab)
        return {t[k : k + 2] for t in bare for k in range(len(t) - 1)}

    def split_word(self, word: str) -> list[str]:
        """Fragments of a word that no merge crosses."""
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.seen]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def encode_fragment(self, fragment: str, last: bool) -> tuple[int, ...]:
        key = (fragment, last)
        got = self.fragments.get(key)
        if got is None:
            if len(self.fragments) >= MEMO:
                self.fragments.clear()
            got = self.fragments[key] = tuple(t.id for t in (self.last if last else self.inner).tokenize(fragment))
        return got

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Fragments encoded independently, then concatenated."""
        got = self.words.get(word)
        if got is None:
            parts = self.split_word("".join([self.letters[b] for b in word.encode()]))
            got = self.encode_fragment(parts[-1], True)
            if len(parts) > 1:
                got = (*(i for part in parts[:-1] for i in self.encode_fragment(part, False)), *got)
            if len(self.words) >= MEMO:
                self.words.clear()
            self.words[word] = got
        return got

    def encode_chunk(self, chunk: str) -> tuple[bytes, str]:
        """(packed ids, decoded) of a stretch without white space or special tokens."""
        if chunk.isascii():
            text = chunk.lower()
            words = [text] if text.isalpha() else WORDS.findall(text)
        else:
            words = WORDS.findall(unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower())
        known = self.words
        ids = [i for word in words for i in (known.get(word) or self.encode_word(word))]
        got = pack(ids), self.decode(ids)
        if len(self.chunks) >= MEMO:
            self.chunks.clear()
        self.chunks[chunk] = got
        return got

    def pieces(self, text: str) -> list[tuple[bytes, str]]:
        """(packed ids, decoded) of each stretch, in order; a stretch has at least one id."""
        memo, encode, out = self.chunks.get, self.encode_chunk, []
        parts = self.cut_special.split(text) if self.cut_special and "<|" in text else [text]
        for part in parts:
            if part in self.special:
                out.append((pack([self.special[part]]), part))
            else:
                out += [memo(c) or encode(c) for c in (filter(None, SPACES.split(part)) if ODD.search(part) else part.split())]
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(p[0] for p in self.pieces(text)), "<u4").tolist()

    def decode(self, ids) -> str:
        """The file states no decoder, so tokens are joined by blanks."""
        return " ".join([self.tokens[i] for i in ids])

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids and of the decoded text."""
        ids, tokens = zip(*got, strict=True) if (got := self.pieces(text)) else ((), ())
        packed, decoded = b"".join(ids), " ".join(tokens)
        return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def pack(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=4)
def codec(name: str) -> ForcedBoundaryCodec:
    """One for each worker process."""
    return ForcedBoundaryCodec(public_tokenizers.path(name))


def encode_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, ids array<int>, decoded string."""

    def run(batches):
        use = codec(vocabulary)
        for batch in batches:
            ids = [use.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([use.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"]
            )

    common.small_batches(docs.sparkSession)
    return common.texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """The digests of encode_documents' ids and decoded texts, without building either as columns."""

    def run(batches):
        use = codec(vocabulary)
        for batch in batches:
            got = [use.digest(t) for t in batch.column("text").to_pylist()]
            cols = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *cols], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    common.small_batches(docs.sparkSession)
    return common.texts(docs).mapInArrow(run, SCHEMA)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(common.table(spark, sf_dir, "documents"))
