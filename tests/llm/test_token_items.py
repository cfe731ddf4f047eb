"""The item encoder: work for each new word, fields with runs of marks, and its bounded memory."""

import cProfile
import pstats

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from meshfold.llm import tokens


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def new_words(n, seed):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdefghinorstäé"), rng.integers(6, 14))) for _ in range(n)]


def split(encoder, texts):
    ids, at = encoder.ids(pa.array(texts, pa.string()))
    return [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])]


def test_new_words_are_no_python_calls(tokenizer):
    words = new_words(5000, 3)
    texts = [" ".join(w + m for w in words[at : at + 500]) for at in range(0, 5000, 500) for m in ("", "%%%", ".")]
    encoder, profile = tokens.ItemEncoder(), cProfile.Profile()
    got = profile.runcall(split, encoder, texts)
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert pstats.Stats(profile).total_calls < 5000


def test_runs_of_marks(tokenizer):
    heads = ["word", "Straße", "ÀÉ", "don't", "it's", "a1", "µ", "ª", "x_y", "'", "", "終わり", "word<|endoftext|>", "<"]
    tails = ["", "!", "!!", "%%%", "&&&,", "$$$", "'", "''", "'s", "!'s", "'s!!", "***'ll", "__", "_", "<|", "|>", "<|endoftext|>", "!<", "~`^", '"', ")}]", "\\/", "-", "--x", "#1", "²", "…", "«"]
    fields = [h + t for h in heads for t in tails]
    texts = [*fields, " ".join(fields), " " + "  ".join(reversed(fields)) + "\n", "", None]
    assert split(tokens.ItemEncoder(), texts) == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    items, at, starts = tokens.distinct_items(pa.array(["Word%%% word word!! don't%%%"]))
    assert [items[i] for i in at] == ["word", "%%%", "word", "", "word", "!!", "don't%%%", ""]
    assert starts.tolist() == [0, 8]


def test_memory_is_bounded_and_forgets(tokenizer):
    encoder = tokens.ItemEncoder(items=300)
    for seed in range(12):
        texts = [" ".join(new_words(200, seed)) + " the quick fox!!", "the quick fox", "", None, " "]
        assert split(encoder, texts) == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert len(encoder.known) == len(encoder.packed) == len(encoder.uses) <= 300 + 210
        assert {"the", "quick", "fox", "!!", ""} <= set(encoder.known.to_pylist())
        assert len(set(encoder.known.to_pylist())) == len(encoder.known)
    assert split(encoder, [None, ""]) == [[], []]
    assert split(tokens.ItemEncoder(), []) == [] and split(tokens.ItemEncoder(), [None]) == [[]]
