import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from rangeloom.llm import packing, registry

PATH = registry.tokenizer_path("word_bpe_49k.json")


class Counting:
    """A tokenizer that counts the words it is handed."""

    def __init__(self, tokenizer):
        self.tokenizer, self.words = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.words += sum(w != packing.SEPARATOR for t in texts for w in t.split())
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_variants_of_a_word_are_tokenised_once_and_letters_without_the_rules():
    rng = random.Random(9)
    stems = sorted({"".join(rng.choice("abdeéñöœ") for _ in range(rng.randrange(6, 12))) for _ in range(400)})
    texts = [" ".join(v for s in stems[i::8] for v in (s, s.title() + ".", s + ",%%%", s.upper() + "!!", s + "###", s.title())) for i in range(8)]
    encoder, library = packing.WordEncoder(PATH), Tokenizer.from_file(PATH)
    encoder.tokenizer, encoder.bare = whole, bare = Counting(encoder.tokenizer), Counting(getattr(encoder, "bare", None))
    got = list(encoder.encode(texts))
    assert [np.frombuffer(c, "<u4").tolist() for c in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert whole.words == 4 and bare.words == len(stems)


@pytest.mark.parametrize("limit", [0, 50, packing.CACHE_WORDS])
def test_ids_equal_the_librarys_with_any_bound_of_the_caches(limit):
    rng = random.Random(limit)
    parts = ["a", "S", "ing", "É", "ß", "ẞ", "İ", "ı", "ŉ", "ǅ", "Ⱥ", "\u212a", "\u212b", "ª", "µ", "σ", "Σ", "ж", "語", "e\u0301", "\u0338", "\u0301", "'", "'s", "'LL", "~", ".", "%%%", "<|", "|>", "<|endoftext|>", "=", "_", "1", "²",
             "\u00a0", "\u0085", "\x1c", "\x0b", "\u2028", "\u200b", "🙂", "\x00", " ", " ", " ", "\n", "\t", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(3_000)]
    encoder, library = packing.WordEncoder(PATH, limit), Tokenizer.from_file(PATH)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        got = [np.frombuffer(c, "<u4").tolist() for c in encoder.encode(texts)]
        assert [(t, g) for t, g in zip(texts, got, strict=True)] == [(t, w) for t, w in zip(texts, want, strict=True)]


def test_every_letter_that_is_folded_here_has_the_librarys_ids():
    words = [f"{a}{chr(c)}{b}" for c in range(0x21, 0x250) if not chr(c).isspace() for a, b in (("", ""), ("a", ""), ("", "z!"), ("q", "e"))]
    encoder, library = packing.WordEncoder(PATH), Tokenizer.from_file(PATH)
    assert [np.frombuffer(c, "<u4").tolist() for c in encoder.encode(words)] == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]


def plainly(lengths, k):
    """Differencing with the members of every window at hand."""
    partial = [([n] + [0] * (k - 1), i, [[i]] + [[]] * (k - 1)) for i, n in enumerate(lengths)]
    while len(partial) > 1:
        (a, i, of_a), (b, _, of_b), *partial = sorted(partial, key=lambda p: (-p[0][0], p[1]))
        merged = sorted(((x + y, u + v) for x, y, u, v in zip(a, b[::-1], of_a, of_b[::-1])), key=lambda p: -p[0])
        partial.append(([x - merged[-1][0] for x, _ in merged], i, [u for _, u in merged]))
    return [sorted(w) for w in partial[0][2]] if partial else []


def test_differencing_equals_its_plain_form():
    rng = random.Random(2)
    for n, k in ((0, 1), (1, 1), (1, 3), (2, 3), (7, 1), (7, 3), (60, 8)):
        for most in (3, 4095):
            lengths = [rng.randrange(1, most + 1) for _ in range(n)]
            assert packing.differencing(lengths, k) == plainly(lengths, k)
