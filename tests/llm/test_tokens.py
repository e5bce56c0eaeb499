from __future__ import annotations

import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers as P
import pytest
import regex
import sentencepiece
import tiktoken

from helpers import awkward, by_id, documents, prose
from ledgerloom.llm import bpe, token_counts

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
LIBRARY = tiktoken.Encoding("library", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PIECES = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def odd_texts():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(alphabet) for _ in range(2500)) for alphabet in (" \n\ta1é!日  ", "ab ", "   \n", "a", "'s't ' re", "▁ a▁", "<s></s> <unk>|", "\x00\x7f é")]
    return [*texts, prose("en", 700, 1), "x" * 3000 + " " * 3000 + "y", " lead", "trail ", ""]


@pytest.mark.parametrize("text", odd_texts())
def test_chunks_give_the_ids_of_the_whole(text):
    at = bpe.cut_points(text, P.PATTERN, 100, 4)
    assert at[0] == 0
    assert at[-1] == len(text)
    ids = [x for a, b in zip(at, at[1:], strict=False) for x in bpe.encode(text[a:b], P.path(bpe.RANKS), P.PATTERN)]
    assert ids == LIBRARY.encode_ordinary(text)
    assert bpe.decode(ids, P.path(bpe.RANKS), P.PATTERN) == text.encode()


@pytest.mark.parametrize("text", odd_texts())
def test_spliced_counts_are_those_of_the_whole(text):
    path = P.path(token_counts.MODEL)
    assert token_counts.model(path)[1]
    assert token_counts.count(text, path, 100, 4) == len(PIECES.encode(text))


def test_a_place_that_is_not_stable_is_an_error():
    with pytest.raises(ValueError, match="stable"):
        token_counts.count_chunk("hello world", 3, 11, P.path(token_counts.MODEL))


def test_text_is_really_cut():
    text = prose("de", 2000, 5)
    assert len(bpe.cut_points(text, P.PATTERN, 1000, 50)) > 5
    assert len(token_counts.chunks(text, 1000, 50)) > 5


def long_texts():
    rnd = random.Random(5)
    mixed = "".join(rnd.choice("日本語漢字。，！中文字符") for _ in range(2_000_000))
    return {"spaces": " " * 2_000_000, "lines": "\n" * 2_000_000 + "x", "letters": "a" * 2_000_000, "inside": "b" + " " * 1_000_000 + "c" + "\n" * 1_000_000, "mixed": mixed}


@pytest.mark.parametrize("name", ["spaces", "lines", "letters", "inside", "mixed"])
def test_long_texts_take_seconds(name):
    text, path = long_texts()[name], P.path(bpe.RANKS)
    began = time.process_time()
    at = bpe.cut_points(text, P.PATTERN)
    ids = [x for a, b in zip(at, at[1:], strict=False) for x in bpe.encode(text[a:b], path, P.PATTERN)]
    assert bpe.decode(ids, path, P.PATTERN) == text.encode()
    assert time.process_time() - began < 30
    if name in ("letters", "mixed"):
        assert ids == LIBRARY.encode_ordinary(text)
    else:  # the library's expressions overflow; each match of the pattern by itself
        assert ids == [x for m in regex.finditer(P.PATTERN, text) for x in LIBRARY._encode_single_piece(m[0])]
    assert (len(at) > 50) == (name == "mixed")
    assert token_counts.count(text, P.path(token_counts.MODEL)) == len(PIECES.encode(text))


@pytest.mark.parametrize("char", ["\x1c", "\x1f", "\x85", "\xa0", "\u180e", "\u200b", "\u2028", "\u3000", "\ufeff", "'", "é", "٣", "²", "_"])
def test_odd_characters_beside_places(char):
    text = "".join(random.Random(char).choice([char, "'s", "'ll", "'", " ", "a", "1", "!", "\n", "l"]) for _ in range(3000))
    at = bpe.cut_points(text, P.PATTERN, 20, 4)
    assert [x for a, b in zip(at, at[1:], strict=False) for x in bpe.encode(text[a:b], P.path(bpe.RANKS), P.PATTERN)] == LIBRARY.encode_ordinary(text)
    assert token_counts.count(text, P.path(token_counts.MODEL), 30, 4) == len(PIECES.encode(text))


def test_runs_of_white_space_are_split_as_the_pattern_does(monkeypatch):
    monkeypatch.setattr(bpe, "RUN", 3)
    monkeypatch.setattr(bpe, "SPACES", regex.compile(r"\s{3,}"))
    rnd = random.Random(2)
    for _ in range(200):
        text = "".join(rnd.choice(["   ", " ", "\n\n\n", "\u3000" * 4, "ab", "1", "!", "'s"]) for _ in range(12))
        assert bpe.encode(text, P.path(bpe.RANKS), P.PATTERN) == LIBRARY.encode_ordinary(text)


def test_places_widen_until_both_sides_agree(monkeypatch):
    real, refused = token_counts.aligned, []

    def aligned(text, at, overlap, loaded):
        refused.append(at)
        return len(refused) % 3 == 0 and real(text, at, overlap, loaded)

    monkeypatch.setattr(token_counts, "aligned", aligned)
    text = prose("en", 900, 4)
    assert token_counts.count(text, P.path(token_counts.MODEL), 500, 20) == len(PIECES.encode(text))
    assert len(refused) > 10


def packed(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


@pytest.mark.parametrize("chunk", [bpe.CHUNK, 50])
def test_bpe_rows(spark, chunk):
    df, rows = awkward(spark)
    want = sorted(((d, len(i := LIBRARY.encode_ordinary(t or "")), packed(i), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, _, _ in rows), key=repr)
    found = bpe.encoded(df, chunk=chunk, overlap=8, keep_ids=True).collect()
    assert by_id(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert sorted(map(list, (r["ids"] for r in found))) == sorted(LIBRARY.encode_ordinary(t or "") for _, t, _, _ in rows)
    assert bpe.encoded(df.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [token_counts.CHUNK, 50])
def test_count_rows(spark, chunk):
    df, rows = awkward(spark)
    want = sorted(((d, len((t or "").encode()), n := len(PIECES.encode(t or "")), n > 100) for d, t, _, _ in rows), key=repr)
    found = token_counts.counted(df, limit=100, chunk=chunk, overlap=8).collect()
    assert by_id(found, "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.counted(df.limit(0)).count() == 0


def test_other_vocabulary(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    row = bpe.encoded(documents(spark, [(1, "größer été", None, None)]), path=path).first()
    assert row["decoded_sha256"] == hashlib.sha256("größer été".encode()).hexdigest()
