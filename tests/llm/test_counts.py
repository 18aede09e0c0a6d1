"""Token counts against the library itself, and the proofs of the shortcut."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pickwise.llm import queries, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, n_tokens string, over_limit int"
ODD = [
    None, "", " ", "\n\n \t", "a", "Hello, world's   end", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|", "héllo   wörld ½ ٣٤", "日本語 の 文章", "🙂👍🏽 ‍",
    "՘x1՘ ౜", "x" * 100_000, " " * 5_000, "ab" * 30_000, "word " * 200_000, "don't I'LL we've", "\x00\x01 \x7f", " a\u0085b",
]


LIBRARY = Tokenizer.from_file(PATH)


def plain(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids) if text else 0


def test_counts_are_the_librarys(spark):
    rows = [(i, t, "clash", 7) for i, t in enumerate(ODD)] + [(None, "a b", "x", 1), (3, "again", "x", 1), (3, "again", "x", 1)]
    got = token_counts.counts(spark.createDataFrame(rows, DOCS), PATH, limit=20).collect()
    want = sorted((repr(i), len((t or "").encode()), plain(t), plain(t) > 20) for i, t, *_ in rows)
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op12_token_counts"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((docs[r.doc_id] or "").encode()), plain(docs[r.doc_id]), plain(docs[r.doc_id]) > 512)
    assert sum(r.n_whole for r in rows) > 0


def test_empty_table(spark):
    assert token_counts.counts(spark.createDataFrame([], DOCS), PATH).collect() == []


def test_proved_strings_are_one_token_between_others():
    proof = token_counts.prove(PATH)
    library = Tokenizer.from_file(PATH)
    assert len(proof.whole) > 49_000
    for s in sorted(proof.whole)[::50]:
        assert len(library.encode(s, add_special_tokens=False).ids) == 1
        # beside pre-tokens of other kinds it stays one token
        count = token_counts.Counter.of(proof)
        for text in (f"1{s}", f"{s} 1", f"!{s}"):
            assert count(text)[0] == len(library.encode(text, add_special_tokens=False).ids)


def test_settled_characters_are_cut_alike():
    """Every seventh code point that Python knows, beside a letter, a digit, a sign and a space."""
    import unicodedata

    rules = token_counts.Rules(PATH)
    known = [chr(c) for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    text = "".join(f"a{c}1{c}!{c} {c}" for c in known)
    spans = [b for _, b in rules.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
    pieces = rules.cut(text)
    assert [b - a for a, b in spans] == [len(p) for p in pieces] and "".join(pieces) == text


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_files_the_shortcut_does_not_fit(spark, name):
    path = public_tokenizers.path(name)
    assert not token_counts.prove(path).whole
    texts = ["Hello world", "a <|endoftext|> b", "", None]
    got = {r.doc_id: r.n_tokens for r in token_counts.counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    if name.endswith(".json"):
        library = Tokenizer.from_file(path)
        want = [len(library.encode(t, add_special_tokens=False).ids) if t else 0 for t in texts]
    else:
        from sentencepiece import SentencePieceProcessor

        processor = SentencePieceProcessor(model_file=path)
        want = [len(processor.encode(t)) if t else 0 for t in texts]
    assert got == dict(enumerate(want))
