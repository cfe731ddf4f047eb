"""Token counts by a compiled finite-state tokenizer.

A merge tokenizer's ids of a string are the only sequence of tokens whose neighbours each encode to themselves.
So the last token of every prefix follows from the last tokens of the shorter prefixes that some token could
still extend. Those are finitely many, and make the states of a deterministic transducer over bytes: a
transition carries the change of the number of tokens of the prefix, and that of the word if it ended there
(word-end tokens differ). States are made when first reached; the table is cleared at a bound.

White space puts the transducer in its start state. A chunk's state map is therefore a constant but for the
field open at its edges: (field before the first white space, count inside, field after the last). Maps
compose associatively. Every text is cut into chunks; the maps of all chunks of a batch are made together, and a
parallel prefix scan composes them, a level of all texts at a time.

Bytes come from the library's own normalizer and splitter; for fields of ASCII and Latin-1 letters a plain form of
both does the same. Only fields that may hold a special string (`<|`) take an escape transition: the library counts them.

Cases: a null or empty text has no tokens; texts of any length go in chunks; an open field is a rope of its chunks'
pieces until white space closes it; each row is counted on its own, so ties and repeats do not matter; a null id is
kept; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import json

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import giving_back, worker_cache
from .tokens import SAFE, WORDS, Generations, distinct_items, parts_of


def byte_symbols() -> dict[int, str]:
    """The printable symbol of each byte in byte-level vocabularies: printable bytes stand for themselves, others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTransducer:
    def __init__(self, spec: dict, bound: int = 200_000):
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        plain, final = set(), set()
        for t in model["vocab"]:
            (final if t.endswith(self.suffix) else plain).add(t.removesuffix(self.suffix))
        self.plain, self.final, self.bound = plain, final, bound
        self.heads = {t[:k] for t in plain | final for k in range(1, len(t))}
        self.symbols = byte_symbols()
        self.good: dict[tuple, bool] = {}
        self.clear()

    def clear(self) -> None:
        # a state: the open suffixes of the prefix, each with the last token before it and the count up to there, less the prefix's own
        self.states: list[tuple] = [(("", None, 0),)]
        self.index = {self.states[0]: 0}
        self.steps: list[dict[int, tuple[int, int, int]]] = [{}]

    def merge(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), 1 << 60))
            if (symbols[best], symbols[best + 1]) not in self.rank:
                break
            symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
        return symbols

    def fits(self, before: str | None, token: str, end: bool) -> bool:
        """Whether the token, after the one before it, encodes to itself."""
        key = (before, token, end)
        if key not in self.good:
            text = (before or "") + token
            parts = [*text[:-1], text[-1] + self.suffix] if end else [*text]
            self.good[key] = self.merge(parts) == [*([before] if before else []), token + self.suffix if end else token]
        return self.good[key]

    def step(self, state: int, byte: int) -> tuple[int, int, int]:
        """Make a transition: next state, emitted tokens, emitted tokens if the word ends here."""
        c = self.symbols[byte]
        now = sorted(self.states[state], key=lambda s: -len(s[0]))
        token, count = next((h + c, n + 1) for h, before, n in now if h + c in self.plain and self.fits(before, h + c, False))
        last = next(n + 1 for h, before, n in now if h + c in self.final and self.fits(before, h + c, True))
        new = [(h + c, before, n - count) for h, before, n in now if h + c in self.heads]
        key = (*new, ("", token, 0))
        if key not in self.index:
            self.index[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        out = self.steps[state][byte] = (self.index[key], count, last)
        return out

    def count(self, word: bytes) -> int:
        if len(self.states) > self.bound or len(self.good) > 4 * self.bound:
            self.good.clear()
            self.clear()
        state = total = last = 0
        steps = self.steps
        for b in word:
            state, emitted, ended = steps[state].get(b) or self.step(state, b)
            last = total + ended
            total += emitted
        return last


class FieldCounter:
    """The number of tokens of a field; up to `limit` fields are kept."""

    def __init__(self, file: str = "word_bpe_49k.json", limit: int = 200_000):
        path = public_tokenizers.path(file)
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.bytes = {c: b for b, c in byte_symbols().items()}
        self.words = WordTransducer(spec)
        self.known = Generations(limit)

    def by_library(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)

    def field(self, field: str) -> int:
        if "<|" in field:
            return self.by_library(field)
        if SAFE.fullmatch(field):
            return sum(self.words.count(w.encode()) for w in WORDS.findall(field.lower()))
        parts = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(field))
        return sum(self.words.count(bytes(map(self.bytes.__getitem__, w))) for w, _ in parts if w)

    def counts(self, fields: list[str]) -> np.ndarray:
        new = self.known.missing(set(fields))
        self.known.now.update((f, self.field(f)) for f in new)
        return np.fromiter(map(self.known.now.__getitem__, fields), np.int64, len(fields))


@worker_cache
def field_counter(file: str) -> FieldCounter:
    """One counter for all tasks of a Python worker: its transducer goes on growing."""
    return FieldCounter(file)


#: A chunk's state map: (field at the left edge, count inside, field at the right edge); (text, None, None) without white space.
#: Fields at the edges are ropes: a text, or a pair of ropes.
StateMap = tuple


def text_of(rope) -> str:
    parts, open_ = [], [rope]
    while open_:
        x = open_.pop()
        if isinstance(x, str):
            parts.append(x)
        else:
            open_ += (x[1], x[0])
    return "".join(parts)


def state_maps(counter: FieldCounter, chunks: list[str]) -> list[StateMap]:
    column = pa.array(chunks, pa.string())
    cut = pc.ascii_split_whitespace(column)
    items, at, _ = distinct_items(column, cut)
    total = np.concatenate([[0], np.cumsum(counter.counts(items)[at].reshape(-1, 2).sum(axis=1))])
    flat, offsets = cut.flatten(), np.asarray(cut.offsets) - cut.offsets[0].as_py()
    first, last = offsets[:-1], offsets[1:] - 1
    inside = (total[last] - total[np.minimum(first + 1, last)]).tolist()
    left, right = (flat.take(pa.array(x)).to_pylist() for x in (first, last))
    return [(x, n, y) if more else (x, None, None) for x, n, y, more in zip(left, inside, right, (last > first).tolist())]


def compose(counter: FieldCounter, pairs: list[tuple[StateMap, StateMap]]) -> list[StateMap]:
    """The maps of pairs of neighbours; the fields that close between them are counted together."""
    edges = [text_of((a[2], b[0])) if a[1] is not None and b[1] is not None else "" for a, b in pairs]
    out = []
    for (a, b), n in zip(pairs, counter.counts(edges).tolist()):
        if a[1] is None:
            out.append(((a[0], b[0]), b[1], b[2]))
        elif b[1] is None:
            out.append((a[0], a[1], (a[2], b[0])))
        else:
            out.append((a[0], a[1] + n + b[1], b[2]))
    return out


def scan(counter: FieldCounter, rows: list[list[StateMap]]) -> list[list[StateMap]]:
    """Inclusive prefix scans of all rows: pairs are composed, their prefixes found, and the odd places filled in; depth is logarithmic."""
    if all(len(r) < 2 for r in rows):
        return rows
    pairs = iter(compose(counter, [p for r in rows for p in zip(r[::2], r[1::2])]))
    halves = scan(counter, [[next(pairs) for _ in range(len(r) // 2)] for r in rows])
    rest = iter(compose(counter, [(h[i // 2 - 1], r[i]) for r, h in zip(rows, halves) for i in range(2, len(r), 2)]))
    return [[(h[i // 2] if i % 2 else next(rest)) if i else r[0] for i in range(len(r))] for r, h in zip(rows, halves)]


def count_texts(counter: FieldCounter, texts: list[str | None], chunk: int) -> np.ndarray:
    """The number of tokens of each text."""
    cut = [[t[i : i + chunk] for i in range(0, len(t), chunk)] if t else [] for t in texts]
    maps = iter(state_maps(counter, [c for x in cut for c in x]))
    wholes = [r[-1] if r else ("", None, None) for r in scan(counter, [[next(maps) for _ in x] for x in cut])]
    edges = counter.counts([text_of(x) if x else "" for w in wholes for x in (w[0], w[2])])
    return edges.reshape(-1, 2).sum(axis=1) + np.array([w[1] or 0 for w in wholes], np.int64)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str = "word_bpe_49k.json", limit: int = 2048, chunk: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; no shuffle. chunk: characters."""

    def run(batches):
        counter = field_counter(tokenizer)
        for b in (p for batch in batches for p in parts_of(batch, 1, 4 << 20)):
            size = pc.binary_length(b.column(1)).fill_null(0).cast(pa.int64())
            n = count_texts(counter, b.column(1).to_pylist(), chunk)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_bytes": size, "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array(n > limit)})

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(giving_back(run, field_counter), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
