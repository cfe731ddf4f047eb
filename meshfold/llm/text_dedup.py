"""Near-duplicate texts: SimHash and band candidates, verified by similarity, one document of each group kept.

Texts are similar if the Jaccard similarity of their sets of five-word shingles is at least 0.8. Candidates are
texts whose fingerprints of five-word shingles differ in at most 2 bits, found by the pigeonring filter with
exact keys of 25 bits, and texts that agree in one of 20 bands of four MinHash values of their shingles; at a
similarity of 0.8 a pair misses all bands with a chance of 3e-5, above it with less. Pairs of a band go on if their
fingerprints stay within the ring's last budget (24 of 64 bits; the mean at 0.8 is 10) and a sketch of their shingle
sets (one bit of the least shingle of each of 512 ranges of hashes) is not below 0.8 by more than three standard
errors. What goes on is verified on the whole texts.

Three rounds of candidates: each band's texts with its least one, and the ring's; then, in bands whose texts are
still in different components, the best partner of each text outside the band's largest component; then all pairs of
such bands whose texts are in different components. So a dense group costs about as many verifications as it has
texts, and no link between components is left out. Pairs within a band's largest component are never formed, and
large bands are dealt out block by block.

Texts move once, to leave one row of each distinct text; what has a candidate is looked up from there.

Cases: null texts count as empty ones; texts without words are alike; a text of fewer words than a shingle is
one shingle; of a group the smallest doc_id stays (a null one only if there is no other), as one row even if
that row is repeated; an empty table gives no rows; all columns of the documents pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, giving_back, materialize, slices
from .components import stars
from .simhash import SEED, group_numbers, majority, ring_links, same_key_pairs, shingle_hashes, whole_groups

WORDS, LEAST, BITS, SEGMENTS, WIDE, BINS = 5, 0.8, 2, 5, 24, 512
BANDS, ROWS = 20, 4
#: Odd multipliers and addends of the MinHash functions; fixed values.
_MINHASH = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.array([[1], [0]], np.uint64)


def sketch(hashes: np.ndarray) -> bytes:
    """Which of 512 ranges hold a hash, and the last bit of the least one in each."""
    h = np.sort(hashes)
    bins = (h >> np.uint64(55)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]]) if len(h) else np.zeros(0, np.int64)
    out = np.zeros((2, BINS), np.uint8)
    out[0, bins[first]] = 1
    out[1, bins[first]] = (h[first] & np.uint64(1)).astype(np.uint8)
    return np.packbits(out, axis=1).tobytes()


def bands(hashes: np.ndarray) -> np.ndarray:
    """One 32-bit key for each band of the set's MinHash values."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[at : at + 1024, None] * _MINHASH[0] + _MINHASH[1]).min(axis=0))
    key = np.zeros(BANDS, np.uint64)
    for x in least.reshape(BANDS, ROWS).T:
        key = (key ^ x) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return (key >> np.uint64(32)).astype(np.uint32).view(np.int32)


def estimates(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of sketches (16 words each): the estimated similarity, and whether it is not clearly below the bound."""
    both = a[:, :8] & b[:, :8]
    n_both = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
    n_any = np.maximum(np.bitwise_count(a[:, :8] | b[:, :8]).sum(axis=1, dtype=np.int64), 1)
    agree = np.bitwise_count(both & ~(a[:, 8:] ^ b[:, 8:])).sum(axis=1, dtype=np.int64)
    error = np.sqrt(np.maximum(n_both - least * n_any, 0) + least * (1 - least) * n_any)
    near = (2 * agree - n_both >= least * n_any - 3 * error - 1e-9) | ((a[:, :8] | b[:, :8]) == 0).all(axis=1)
    return (2 * agree - n_both) / n_any, near


def similar(a: str | None, b: str | None, words: int = WORDS) -> float:
    x, y = (set(shingle_hashes(t, words).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x or y else 1.0


def _described(rows: DataFrame) -> DataFrame:
    """Rows (key, i, t) -> key, i, fp, sketch, bands; texts stay where they are."""

    def run(batches):
        for b in slices(batches, 256):
            hashes = [shingle_hashes(t, WORDS) for t in b.column(2).to_pylist()]
            fp = pa.array(np.array([majority(h) for h in hashes], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp, pa.array([sketch(h) for h in hashes], pa.binary()), pa.array([bands(h) for h in hashes], pa.list_(pa.int32()))], names=["key", "i", "fp", "sketch", "bands"])

    kind = rows.schema["i"].dataType.simpleString()
    return rows.mapInArrow(giving_back(run), f"key binary, i {kind}, fp long, sketch binary, bands array<int>")


def _distinct_texts(rows: DataFrame) -> DataFrame:
    """One row for each distinct text: node (a number of its own), key, i (its least id) and n (rows with that id)."""
    marks = [F.first(c).alias(c) for c in ("fp", "sketch", "bands")]
    each = rows.groupBy("key", "i").agg(F.count("*").alias("n"), *marks)
    least = F.min_by(F.struct("i", "n"), F.struct(F.col("i").isNull(), F.col("i"))).alias("x")
    return each.groupBy("key").agg(least, *marks).select(F.monotonically_increasing_id().alias("node"), "key", "x.i", "x.n", "fp", "sketch", "bands")


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def _in_bands(texts: DataFrame, count: int) -> DataFrame:
    """(start, part, node, low): the bands that hold more than one node, and the least of each."""
    rows = texts.select("node", F.posexplode("bands").alias("start", "part"))
    shared = materialize(rows.groupBy("start", "part").agg(F.min("node").alias("low"), F.count("*").alias("c")).where("c > 1").drop("c"), "shared-bands", rows=count)
    out = materialize(rows.join(shared, ["start", "part"]).select("start", "part", "node", "low"), "in-bands", rows=count)
    discard(shared)
    return out


def _ring_pairs(texts: DataFrame, count: int) -> DataFrame:
    """Pairs (a, b) of nodes: each with the least one of its fingerprint, and the least ones of linked fingerprints."""
    lows = materialize(texts.groupBy("fp").agg(F.min("node").alias("low")), "fingerprint-lows", rows=count)
    same = texts.select("fp", "node").join(lows, "fp").where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    links = ring_links(lows.select("fp"), BITS, SEGMENTS)
    ends = links.join(lows.select(F.col("fp").alias("a"), F.col("low").alias("x")), "a").join(lows.select(F.col("fp").alias("b"), F.col("low").alias("y")), "b")
    return same.union(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


_UNIT = ["start", "part", "lo", "hi"]


def _open_units(banded: DataFrame, roots: DataFrame, texts: DataFrame, cap: int, count: int) -> DataFrame:
    """The texts of bands that hold several components, dealt out by units (pairs of blocks of at most about cap texts).

    The texts outside the band's largest component meet each other and that component's; its own texts do not meet.
    """
    named = materialize(banded.join(roots, "node", "left").select("start", "part", "node", F.coalesce("root", "node").alias("comp")), "band-comps", rows=count)
    sizes = named.groupBy("start", "part", "comp").agg(F.count("*").alias("c"))
    bands_ = sizes.groupBy("start", "part").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("all")).where("all > most")
    blocks = lambda c: F.ceil(c / cap).cast("int")
    bands_ = materialize(bands_.select("start", "part", "main", blocks(F.col("all") - F.col("most")).alias("others"), blocks(F.col("most")).alias("mains")), "open-bands", rows=count)
    rows = named.join(bands_, ["start", "part"])
    inside = F.col("comp") == F.col("main")
    own = F.when(inside, F.col("others") + F.pmod(F.xxhash64("node"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("node"), F.col("others"))).cast("int")
    last = F.when(inside, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    rows = rows.select("start", "part", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "comp", inside.alias("inside"))
    # the marks join on the node, which is in at most 20 bands
    out = materialize(rows.join(texts.select("node", "fp", "sketch", "bands"), "node"), "open-units")
    for used in (named, bands_):
        discard(used)
    return out


def _candidates(units: DataFrame, best_only: bool) -> DataFrame:
    """Pairs (a, b) of open bands in different components: all that go on, or the best one of each text outside the largest."""

    def run(batches):
        for t in whole_groups(batches, _UNIT, 20_000):
            node, comp, fp, own = t["node"].to_numpy(), t["comp"].to_numpy(), t["fp"].to_numpy().view(np.uint64), t["own"].to_numpy()
            start, cross, inside = t["start"].to_numpy(), t["lo"].to_numpy() != t["hi"].to_numpy(), t["inside"].to_numpy(zero_copy_only=False)
            marks = np.frombuffer(b"".join(t["sketch"].to_pylist()), "<u8").reshape(-1, 16)
            keys = t["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            best, partner = np.full(len(node), -np.inf), np.full(len(node), -1)
            for i, j in same_key_pairs(group_numbers(t, _UNIT), 1 << 16):
                ok = (comp[i] != comp[j]) & ~(cross[i] & (own[i] == own[j]))
                i, j = i[ok], j[ok]
                ok = np.bitwise_count(fp[i] ^ fp[j]) <= WIDE
                i, j = i[ok], j[ok]
                if not best_only:  # a pair counts in its first band only
                    ok = (keys[i] == keys[j]).argmax(axis=1) == start[i]
                    i, j = i[ok], j[ok]
                score, near = estimates(marks[i], marks[j], LEAST)
                i, j, score = i[near], j[near], score[near]
                if not best_only:
                    yield _pairs(node[i], node[j])
                    continue
                for x, y in ((i, j), (j, i)):
                    order = np.argsort(-score, kind="stable")
                    _, one = np.unique(x[order], return_index=True)
                    one = order[one]
                    one = one[(score[one] > best[x[one]]) & ~inside[x[one]]]
                    best[x[one]], partner[x[one]] = score[one], y[one]
            some = np.flatnonzero(partner >= 0)
            yield _pairs(node[some], node[partner[some]])

    rows = units.repartition(*(F.col(c) for c in _UNIT)).sortWithinPartitions(*_UNIT)
    return rows.mapInArrow(giving_back(run), "a long, b long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, cap: int, count: int) -> DataFrame:
    """The pairs (a, b) whose whole texts (node, t) are similar. A text a meets up to about cap texts b in a task."""
    hubs = materialize(pairs.groupBy("a").agg(F.ceil(F.count("*") / cap).cast("int").alias("blocks")), "hubs", rows=count)
    first = hubs.join(texts, hubs.a == texts.node).select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("s"), F.lit(None).cast("long").alias("b"), "t")
    own = pairs.join(hubs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("s"), "b")
    rows = first.union(own.join(texts, own.b == texts.node).select("a", "s", "b", "t"))

    def run(batches):
        held = np.zeros(0, np.uint64)
        for p in slices(batches, 64):
            b, keep = p.column(2), []
            for other, t in zip(b.to_pylist(), p.column(3).to_pylist()):
                own = np.unique(shingle_hashes(t, WORDS))
                if other is None:
                    held = own
                    keep.append(False)
                else:
                    joint = len(np.intersect1d(held, own, assume_unique=True))
                    keep.append(joint >= LEAST * (len(held) + len(own) - joint) - 1e-9)
            yield p.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    dealt_ = rows.repartition("a", "s").sortWithinPartitions("a", "s", F.col("b").asc_nulls_first())
    out = materialize(dealt_.mapInArrow(giving_back(run), "a long, b long"), "verified")
    discard(hubs)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, cap: int = 2048) -> DataFrame:
    """The documents with one of each group of similar texts kept."""
    names = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))  # no name of a column can meet one of ours
    place = {c: F.col(f"c{names.index(c)}") for c in (id_col, text_col)}
    text = F.coalesce(place[text_col].cast("string"), F.lit(""))
    key = F.unhex(F.sha2(text, 256))
    rows = materialize(_described(plain.select(key.alias("key"), place[id_col].alias("i"), text.alias("t"))), "described")
    texts = materialize(_distinct_texts(rows), "texts")
    discard(rows)
    count = texts.count()
    banded = _in_bands(texts, count)
    asked = materialize(banded.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).union(_ring_pairs(texts, count)).distinct(), "candidates", rows=count)

    # the one time that texts move: a row of each distinct one stays
    some = banded.select("node").union(asked.select("a")).union(asked.select("b")).distinct()
    chosen = texts.select("key", "i", "n", "node").join(some.withColumn("asked", F.lit(True)), "node", "left")
    chosen = materialize(chosen.select(F.col("key").alias("_key"), "i", "n", "node", F.coalesce("asked", F.lit(False)).alias("asked")), "chosen", rows=count)
    whole = plain.withColumn("key", key).join(chosen.hint("shuffle_hash"), (F.col("key") == F.col("_key")) & place[id_col].eqNullSafe(F.col("i"))).drop("key", "_key", "i")
    whole = materialize(whole, "whole")
    once = whole.where("n = 1").union(whole.where("n > 1").dropDuplicates(["node"]))
    found = once.where("asked").select("node", text.alias("t"))

    first = _verified(asked, found, cap, count)
    roots = stars(first)
    links = first
    for best_only in (True, False):
        units = _open_units(banded, roots, texts, cap, count)
        pairs = materialize(_candidates(units, best_only), "candidates")
        discard(units)
        if pairs.head(1):
            links = links.union(_verified(pairs, found, cap, count))
            discard(roots)
            roots = stars(links)
        discard(pairs)
    own = once.where("asked").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = own.select("node", "root", place[id_col].alias("i"))
    kept = ids.groupBy("root").agg(F.min_by("node", F.struct(F.col("i").isNull(), F.col("i"), F.col("node"))).alias("node"))
    kept = materialize(kept.select("node"), "kept", rows=count)
    for used in (texts, banded, asked, roots):
        discard(used)
    out = once.where("not asked").union(once.where("asked").join(kept, "node", "left_semi").select(*once.columns))
    return out.select(*plain.columns).toDF(*names)
