"""Exact token ids of a library tokenizer, memoised by white-space field.

The normalizer, splitter and merges of the word-level BPE file never look across white space, and its special
strings hold none. So the ids of a text are those of its fields (cut at ASCII white space) in turn. A column of
texts is cut and its distinct fields are found by Arrow; each distinct field is looked up or encoded once, and
the ids are put together by position.
"""

from __future__ import annotations

import json
import os
import re
import string
from array import array
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import give_back, worker_cache

#: ASCII punctuation but the apostrophe, which may open a word of the splitter's, and `<`, which may open a special string.
MARKS = "".join(c for c in string.punctuation if c not in "'<")
LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha() and c not in "ªµº")
_LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_WORD = "^[a-zß-öø-ÿ]+$"
#: The splitter of the word-level file on lower-case ASCII and Latin-1 letters; fixed values.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
SAFE = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: So many new items are encoded as one text.
TOGETHER = 16_384
# tasks run side by side already
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


class Fields(NamedTuple):
    """The fields of a column of texts by number, and the two items of each distinct field by number."""

    items: pa.Array
    item_of: np.ndarray
    ends: pa.Array
    end_of: np.ndarray
    at: np.ndarray
    starts: np.ndarray


def distinct_fields(texts: pa.Array, cut: pa.ListArray | None = None) -> Fields:
    """The distinct fields of a column of texts, the field at each place, and where each text's fields begin.

    A field of letters and any marks after them is two items, its word in lower case and the marks (or nothing): the
    splitter parts them and the tokenizer lower-cases. Any other field is one item and nothing.
    `cut`: the texts' fields, where they are known.
    """
    cut = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null("")) if cut is None else cut
    coded = cut.flatten().dictionary_encode()
    fields = coded.dictionary
    bare = pc.ascii_rtrim(fields, MARKS)
    more = pc.not_equal(pc.binary_length(fields), pc.binary_length(bare))
    plain = pc.match_substring_regex(bare, _LETTERS)
    items = pc.if_else(plain, pc.utf8_lower(bare), fields).dictionary_encode()
    marked = pc.and_(plain, more)
    ends = pa.concat_arrays([pa.array([""]), pc.utf8_ltrim(fields.filter(marked), LETTERS)]).dictionary_encode()
    end_of = np.zeros(len(fields), np.int32)
    end_of[marked.to_numpy(zero_copy_only=False)] = ends.indices.to_numpy()[1:]
    starts = np.asarray(cut.offsets) - cut.offsets[0].as_py()
    return Fields(items.dictionary, items.indices.to_numpy(), ends.dictionary, end_of, coded.indices.to_numpy(), starts)


def distinct_items(texts: pa.Array, cut: pa.ListArray | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct items of a column of texts, the number of each item in turn, and where each text's items begin."""
    f = distinct_fields(texts, cut)
    both = np.empty((len(f.at), 2), np.int64)
    both[:, 0] = f.item_of[f.at]
    both[:, 1] = f.end_of[f.at] + len(f.items)
    return f.items.to_pylist() + f.ends.to_pylist(), both.ravel(), f.starts * 2


def parts_of(batch: pa.RecordBatch, column: int, size: int):
    """Slices of a batch whose texts have about `size` bytes together; what was freed meanwhile is returned after each."""
    length = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(length) // size
    edge = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edge[:-1], edge[1:]):
        if b > a:
            yield batch.slice(a, b - a)
            give_back()


class Generations:
    """A bounded memory: what was used since the last turn is kept when the table is full, the rest goes."""

    def __init__(self, limit: int):
        self.limit, self.now, self.old = limit, {}, {}

    def missing(self, keys: set) -> list:
        """Turn if full; move what the older table knows to the newer; the keys that neither knows."""
        if len(self.now) > self.limit:
            self.now, self.old = {}, self.now
        new, old = keys.difference(self.now), self.old
        if not new or not old:
            return list(new)
        again = new.intersection(old)
        self.now.update((k, old[k]) for k in again)
        return list(new.difference(again))


class ItemEncoder:
    """texts -> ids; keeps the ids of at most `items` items before each part, and forgets those of the fewest parts first.

    Items and ids are held in Arrow arrays: no new word is a Python object.
    """

    def __init__(self, file: str = "word_bpe_49k.json", items: int = 200_000):
        self.tok = Tokenizer.from_file(public_tokenizers.path(file))
        self.tok.no_truncation()
        self.tok.no_padding()
        vocab = self.tok.get_vocab(with_added_tokens=True)
        top = max(vocab.values()) + 1
        self.code, self.dtype = ("H", "<u2") if top <= 1 << 16 else ("I", "<u4")
        self.limit, self.known, self.packed, self.uses = items, pa.array([], pa.string()), pa.array([], pa.large_binary()), np.zeros(0, np.int32)
        self.ends = np.zeros(top, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        spec = json.loads(self.tok.to_str())
        self.by_field = spec["model"].get("end_of_word_suffix") == "</w>"
        # for words of lower-case letters only: the same model, without what cannot change them
        spec |= {"added_tokens": [], "normalizer": None, "post_processor": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
        self.bare = Tokenizer.from_str(json.dumps(spec)) if self.by_field else self.tok

    def pack(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def _binary(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """The packed ids of items of these numbers of ids."""
        stops = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]) * ids.itemsize
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(stops), pa.py_buffer(ids.tobytes())])

    def _encode_apart(self, tok: Tokenizer, parts: pa.Array, counts: np.ndarray) -> pa.Array:
        """The packed ids of each part, encoded as one text; counts: the splitter's words in each, which end in word-end tokens."""
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(parts)], parts), " ")[0].as_py()
        ids = np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != counts.sum():  # the splitter parts some of them in another way
            return self._encode_each(tok, parts)
        return self._binary(ids, np.diff(stops[np.cumsum(counts) - 1], prepend=0))

    def _encode_each(self, tok: Tokenizer, parts: pa.Array) -> pa.Array:
        return pa.array([self.pack(tok.encode(x, add_special_tokens=False).ids) for x in parts.to_pylist()], pa.large_binary())

    def _encode(self, items: pa.Array) -> pa.Array:
        """The packed ids of items; words, and other items of safe characters, are encoded many at a time."""
        word = pc.match_substring_regex(items, _WORD).to_numpy(zero_copy_only=False)
        safe = pc.match_substring_regex(items, f"^{SAFE.pattern}$").to_numpy(zero_copy_only=False) & ~pc.match_substring(items, "<|").to_numpy(zero_copy_only=False) & ~word
        groups, made = [np.flatnonzero(x) for x in (word, safe, ~word & ~safe)], []
        for tok, group in zip((self.bare, self.tok), groups):
            for at in range(0, len(group), TOGETHER):
                part = items.take(pa.array(group[at : at + TOGETHER]))
                counts = np.ones(len(part), np.int64) if tok is self.bare else pc.count_substring_regex(pc.utf8_lower(part), WORDS.pattern).to_numpy()
                made.append(self._encode_apart(tok, part, counts))
        made.append(self._encode_each(self.tok, items.take(pa.array(groups[2]))))
        return pa.concat_arrays(made).take(pa.array(np.argsort(np.concatenate(groups))))

    def _places(self, items: pa.Array) -> np.ndarray:
        """The place in the memory of each of some distinct items; new ones are learned."""
        found = pc.index_in(items, value_set=self.known)
        new = items.filter(found.is_null())
        at = found.fill_null(-1).to_numpy().copy()
        self.uses[at[at >= 0]] += 1
        if len(new):
            at[at < 0] = np.arange(len(self.known), len(self.known) + len(new))
            self.packed = pa.concat_arrays([self.packed, self._encode(new)])
            self.known = pa.concat_arrays([self.known, new])
            self.uses = np.concatenate([self.uses, np.ones(len(new), np.int32)])
        return at

    def _forget(self) -> None:
        """Beyond the limit, half of it stays: what the most parts used, the newer first; older uses count half from then on."""
        if len(self.known) > self.limit:
            stay = np.sort(len(self.uses) - 1 - np.argsort(-self.uses[::-1], kind="stable")[: self.limit // 2])
            self.known, self.packed, self.uses = self.known.take(pa.array(stay)), self.packed.take(pa.array(stay)), self.uses[stay] >> 1

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a column of texts, one after another, and where each text's begin (and the last one's end)."""
        if not self.by_field:
            packed = [self.pack(self.tok.encode(t, add_special_tokens=False).ids) if t else b"" for t in texts.to_pylist()]
            return np.frombuffer(b"".join(packed), self.dtype), np.cumsum([0, *(len(x) // int(self.dtype[-1]) for x in packed)])
        self._forget()
        f = distinct_fields(texts)
        item_at, end_at = (self._places(x) for x in (f.items, f.ends))
        packed = pc.binary_join_element_wise(self.packed.take(pa.array(item_at[f.item_of])), self.packed.take(pa.array(end_at[f.end_of])), pa.scalar(b"", pa.large_binary())).take(pa.array(f.at))
        _, stops, raw = packed.buffers()
        ends = np.frombuffer(stops, np.int64)[: len(packed) + 1] // int(self.dtype[-1])
        return np.frombuffer(raw or b"", self.dtype, ends[-1]), ends[f.starts]


@worker_cache
def encoder(file: str) -> ItemEncoder:
    """One encoder for all tasks of a Python worker: loading the file and learning common fields happen once."""
    return ItemEncoder(file)
