"""Token counts of whole texts with a whole-token shortcut.

A tokenizer cuts a text into pre-tokens and merges each of them on its own. Before any text is read, every string of the vocabulary is
put to the model alone: it is proved if the pre-tokenizer leaves it in one piece and the merges end in one token. A pre-token that is a
proved string therefore counts one wherever it stands, and is only looked up; the rest are merged, and short ones remembered. The proof
is bounded by the vocabulary, not by the data, and is sent to the executors once. Texts are counted map-only, without a shuffle.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwise.llm.common import slices

LIMIT = 512
REMEMBERED, REMEMBERED_CHARS = 400_000, 48
# fixed values: the split pattern of byte-level vocabularies
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_READY: dict[str, "Counter"] = {}


@dataclass(frozen=True)
class Proof:
    """What holds of one vocabulary file: the strings that encode alone as one token."""

    path: str
    whole: frozenset[str]


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones as themselves, the others, in order, from 256 on."""
    # fixed values: the ranges of bytes that are written as themselves
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Rules:
    """Pre-tokens, merges and added tokens of a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        file = json.loads(self.tokenizer.to_str())
        before, added = file.get("pre_tokenizer") or {}, file.get("added_tokens") or []
        self.model = self.tokenizer.model
        self.byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not file.get("normalizer")
        # a shortcut needs pre-tokens that are merged alone and always alike, and added tokens that are plain strings
        self.plain = self.byte_level and file["model"].get("type") == "BPE" and not file["model"].get("dropout") and not any(
            a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added
        )
        names = sorted((a["content"] for a in added if a["content"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.cut = regex.compile(BYTE_LEVEL).findall
        self.letters = {b: letter for b, letter in enumerate(byte_letters())}

    def merged(self, part: str) -> int:
        """Tokens of one pre-token by the merges."""
        return len(self.model.tokenize(part.encode("utf-8").decode("latin-1").translate(self.letters)))

    def strings(self) -> Iterator[str]:
        """The vocabulary's strings as they stand in a text; those that end inside a character cannot be a pre-token."""
        back = {letter: b for b, letter in self.letters.items()}
        for written in self.tokenizer.get_vocab(with_added_tokens=False):
            try:
                yield bytes(back[c] for c in written).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue


def prove(path: str) -> Proof:
    """The strings of a vocabulary file that are one token wherever they are a pre-token; none for files the shortcut does not fit."""
    if not path.endswith(".json"):
        return Proof(path, frozenset())
    rules = Rules(path)
    if not rules.plain:
        return Proof(path, frozenset())
    return Proof(path, frozenset(s for s in rules.strings() if rules.cut(s) == [s] and rules.merged(s) == 1))


class _Merges(dict):
    """Tokens of a pre-token that is not proved, merged once per distinct short one."""

    def __init__(self, merged):
        super().__init__()
        self.merged = merged

    def __missing__(self, part: str) -> int:
        n = self.merged(part)
        if len(part) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[part] = n
        return n


class Counter:
    """text -> (tokens, pre-tokens counted directly)."""

    def __init__(self, proof: Proof):
        self.whole = proof.whole
        if not proof.path.endswith(".json"):
            from sentencepiece import SentencePieceProcessor

            processor = SentencePieceProcessor(model_file=proof.path)
            self.library = lambda text: len(processor.encode(text))
            return
        rules = Rules(proof.path)
        rules.tokenizer.no_truncation()
        rules.tokenizer.no_padding()
        self.library = lambda text: len(rules.tokenizer.encode(text, add_special_tokens=False).ids)
        self.added, self.cut, self.merges = rules.added, rules.cut, _Merges(rules.merged)
        self.settled: set[str] = set()

    @classmethod
    def of(cls, proof: Proof) -> "Counter":
        if proof.path not in _READY:
            _READY[proof.path] = cls(proof)
        return _READY[proof.path]

    def doubt(self, text: str) -> bool:
        """Whether a text holds a code point that Python's own Unicode table leaves unassigned: tables of other versions may call it a
        letter, so such a text is cut by the library."""
        if self.settled.issuperset(text):
            return False
        fresh = set(text) - self.settled
        self.settled.update(c for c in fresh if unicodedata.category(c) != "Cn")
        return not self.settled.issuperset(fresh)

    def __call__(self, text: str) -> tuple[int, int]:
        if not text:
            return 0, 0
        if not self.whole or (not text.isascii() and self.doubt(text)):
            return self.library(text), 0
        parts = self.cut(text) if self.added is None or not self.added.search(text) else None
        special = 0
        if parts is None:  # an added token is one token, and nothing is merged across it
            special = len(self.added.findall(text))
            parts = [part for between in self.added.split(text) for part in self.cut(between)]
        rest = [part for part in parts if part not in self.whole]
        direct = len(parts) - len(rest)
        return special + direct + sum(map(self.merges.__getitem__, rest)), direct


def counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, n_whole) of every row of ``docs`` (doc_id, text).

    ``path`` names a file of the tokenizers library (.json) or of sentencepiece (.model); the counts are that library's, without begin,
    end or added special tokens, truncation or padding. Special strings inside a text count as the library's default has it. ``n_whole``
    says how many pre-tokens were counted without merging; it is 0 for files and texts that only the library can cut. NULL and empty
    texts have 0 tokens; NULL ids and repeated rows are kept one by one; other columns are ignored. Very long texts are counted whole.
    """
    spark = docs.sparkSession
    proof = spark.sparkContext.broadcast(prove(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter.of(proof.value)
        for batch in slices(batches):
            found = [count(text.as_py() or "") for text in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["n_bytes"], pa.array([n for n, _ in found], pa.int64()), pa.array([n > limit for n, _ in found], pa.bool_()),
                 pa.array([w for _, w in found], pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_whole"],
            )

    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return told.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_whole long")
