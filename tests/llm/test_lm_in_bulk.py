"""The language model's steps in bulk: shared strides, words tokenized together, words split and counted by Arrow."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from logweave.llm import attention_lm
from logweave.llm.simhash import words_of
from logweave.llm.subwords import WordsEncoder

BPE = public_tokenizers.path("word_bpe_49k.json")


def test_strides_in_a_row_have_the_gradients_of_their_windows():
    rng = np.random.default_rng(5)
    symbols = attention_lm.Symbols(rng.integers(0, 50, 301).astype(float))
    model = attention_lm.Model(symbols, attention_lm.Pairs(symbols, rng.integers(0, 3, (attention_lm.SYMBOLS, attention_lm.GROUPS)).astype(float)))
    sizes = [0, 5, 16, 3000, 700]
    x, first, y, _ = model.windows(rng.integers(0, 300, sum(sizes)).astype(np.uint16), np.cumsum([0, *sizes]))
    goal = np.where(y >= 0, model.klass[np.maximum(y, 0)], -1).reshape(-1, attention_lm.STRIDE)
    assert len(first) > attention_lm.TILE
    p = {k: v.astype(np.float64) for k, v in attention_lm.initial().items()}
    loss, g = attention_lm.gradients(p, model.prior, x, first, goal)
    want_loss, want = attention_lm.gradients(p, model.prior, attention_lm.doubled(x), first, goal)
    assert abs(loss - want_loss) < 1e-9
    assert all(np.abs(g[k] - want[k]).max() < 1e-9 for k in attention_lm.NAMES)


def test_words_together_have_the_tokenizers_ids():
    plain, rng = Tokenizer.from_file(BPE), random.Random(2)
    letters = "aZ.é%ÀÿŸ0́\x00\x1c　中😀<|>ſ"
    words = ["", "the", "The,", "<|endoftext|>", "a<|endoftext|>b", "don't", "é", "é", "a" * 9000, "." * 5000]
    words += ["".join(rng.choice(letters) for _ in range(rng.randrange(9))) for _ in range(3000)]
    encoder = WordsEncoder(BPE)
    for part in (words, words[:7], [], ["new"], words[::-1]):
        ids, size = encoder.words(part)
        want = [plain.encode(w, add_special_tokens=False).ids for w in part]
        assert ids.tolist() == [k for w in want for k in w] and size.tolist() == [len(w) for w in want]


def test_words_split_by_arrow_are_those_of_the_bytes():
    rng = random.Random(1)
    letters = [*map(chr, range(0x41)), *"AZaz[\x7f\x80\x85\xa0 　É😀"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(3000)]
    words, at = attention_lm.words_in(pa.array(texts)[9:])
    words = words.cast(pa.binary()).to_pylist()
    assert [[w for w in words[a:b] if w] for a, b in zip(at, at[1:], strict=False)] == [words_of(t) for t in texts[9:]]
