"""The encoder of single texts against the tiktoken library, with small memories."""

import random

import public_tokenizers
import pytest
import tiktoken

from bitloom.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {token: rank for rank, token in enumerate(byte_bpe.read_ranks(PATH))}
    return tiktoken.Encoding("reference", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def made(rng):
    bits = ["the", "The", "über", "ß", "naïve", "x", "42", "it's", "don't", "漢字", "é́", "a.", "b,", "!?", "...", "-", "Ω", " ", "_", "zqxjk" * 9]
    gaps = [" "] * 12 + ["\n"] * 4 + ["", "", "\n\n", " \n", "\n ", "\t", "  ", "\r\n", " "]
    words = [rng.choice(bits) + rng.choice(["", "", "ing", ".", "able,"]) for _ in range(rng.randrange(0, 30))]
    return rng.choice(["", "", " ", "\n"]) + "".join(w + rng.choice(gaps if rng.random() < 0.4 else [" ", " ", "\n"]) for w in words)


@pytest.mark.parametrize("held,pairs", [(200_000, 400_000), (5, 7)])
def test_texts_equal_the_library(library, monkeypatch, held, pairs):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", held)
    monkeypatch.setattr(byte_bpe, "PAIRS", pairs)
    encoder = byte_bpe.Encoder(*byte_bpe.merge_table(PATH), public_tokenizers.PATTERN)
    rng = random.Random(held)
    texts = [made(rng) for _ in range(1500)] + ["", "\n", "a\nb\n", "a\n\nb", "a.\nB c.\n\nD e\n", "the.\nthe.\nthe.\nthe", "word\n"] * 3
    for text in texts:
        assert list(memoryview(encoder.encode(text)).cast("i")) == library.encode_ordinary(text), text


def test_random_bytes_equal_the_library(library):
    """Pieces without any sense make the search step back."""
    encoder = byte_bpe.Encoder(*byte_bpe.merge_table(PATH), public_tokenizers.PATTERN)
    rng = random.Random(5)
    tokens = [t for t in byte_bpe.read_ranks(PATH) if t.isalpha()]
    for _ in range(3000):
        piece = "".join(rng.choice(tokens).decode() for _ in range(rng.randrange(1, 7)))
        assert encoder.encode_piece(piece) == library.encode_ordinary(piece), piece
