"""Near-duplicate texts by b-bit MinHash.

Method. Texts are lower-cased, freed of white space and cut into their distinct character n-grams (three characters
where ``TESTDATA.md`` says so; ``words`` gives word shingles). Equal texts form one class, represented by its least
key, and only representatives are compared. A representative gets ``BANDS * ROWS`` minima; the minima of a band hash to
one band key, and representatives that share a band key are candidates. Of the minima the lowest two bits are kept and
packed as two bit planes; the similarity estimated from them by bit counts, corrected for the quarter of chance
matches, removes candidates that are far below the threshold. An exact count of common n-grams follows.

Scale. Band keys are 64-bit numbers, so the candidate search shuffles 16 bytes per band and representative. Pairs within
a band key, and pairs of rows within two linked classes, come from one path at every size: members are spread by hash
over blocks of about ``BLOCK`` and each pair of blocks is a group of its own, so a hot band key or a class that holds a
third of all rows is cut into many groups of bounded size. Estimates read 64 bytes per side; texts are only fetched for
what is left, and their n-grams compared there.

Recall. A pair of similarity 0.7 shares a band key with probability 0.998, one of 0.75 with 0.99991 (48 bands of six
minima); the estimate is allowed an error of four standard deviations.

Defined results. NULL texts are left out. Texts without any n-gram (shorter than three characters once squeezed) only
match equal texts. Repeated keys count as repeated rows of the same text. Empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise
from .components import connected_components

BANDS, ROWS, PLANE_WORDS = 48, 6, 4
SAMPLED = 64 * PLANE_WORDS  # minima of which the low bits are kept
BLOCK = 1024
SLACK = 4 * (0.25 / SAMPLED) ** 0.5 / 0.75
_CHUNK = 128

_rng = np.random.RandomState(20240229)
_SALT = _rng.randint(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_MULT = (_rng.randint(0, 1 << 31, BANDS * ROWS, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_BAND = _rng.randint(0, 1 << 62, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BUFFER = np.empty((_CHUNK, BANDS * ROWS), dtype=np.uint32)
_BAND_SALT = _rng.randint(0, 1 << 62, BANDS, dtype=np.uint64)


#: White space as ``str.split`` knows it.
WHITE = r"(?U)[\s\x1c-\x1f]+"


def squeeze(text: str) -> str:
    return "".join(text.lower().split())


def grams(text: str, n: int = 3) -> np.ndarray:
    """The distinct n-grams (n <= 3) of a squeezed text, each packed into one 64-bit number without collisions."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    if len(points) < n:
        return np.empty(0, dtype=np.int64)
    packed = points[: len(points) - n + 1].copy()
    for i in range(1, n):
        packed = (packed << 21) | points[i : len(points) - n + 1 + i]
    return np.unique(packed)


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64: spreads neighbouring n-grams over all bits."""
    z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def minima(features: np.ndarray) -> np.ndarray:
    """The minimum of every hash function over the features, in chunks that stay in the processor's cache."""
    low = (_mix(features) >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(_SALT), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(low), _CHUNK):
        part = low[k : k + _CHUNK]
        hashed = _BUFFER[: len(part)]
        np.bitwise_xor(part[:, None], _SALT[None, :], out=hashed)
        np.multiply(hashed, _MULT[None, :], out=hashed)
        np.minimum(best, hashed.min(axis=0), out=best)
    return best


def signature(best: np.ndarray, field: str = "") -> tuple[np.ndarray, np.ndarray]:
    """(band keys, which differ between fields; two bit planes of the low bits)."""
    salt = np.uint64(zlib.crc32(field.encode()))
    bands = _mix((best.reshape(BANDS, ROWS).astype(np.uint64) * _BAND).sum(axis=1, dtype=np.uint64) ^ _BAND_SALT ^ (salt << np.uint64(20)))
    low = best[:SAMPLED]
    planes = np.concatenate([np.packbits((low >> np.uint32(b)).astype(np.uint8) & 1).view(np.int64) for b in (0, 1)])
    return bands.view(np.int64), planes


_LONGS = pa.list_(pa.int64())
_SIGNED = pa.schema([("rid", pa.int64()), ("bands", _LONGS), ("planes", _LONGS)])
SIGNED = "rid bigint, bands array<bigint>, planes array<bigint>"


def _word_features(text: str, n: int) -> np.ndarray:
    words = text.lower().split()
    if len(words) < n:
        return np.empty(0, dtype=np.int64)
    import xxhash

    return np.unique(np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + n])) for i in range(len(words) - n + 1)], dtype=np.uint64).view(np.int64))


def _features(n: int, words: bool):
    return (lambda text: _word_features(text, n)) if words else (lambda text: grams(text, n))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)), pa.array(np.concatenate(arrays)))


def _sign(n: int, words: bool):
    """(rid, field_name, norm) -> band keys and bit planes."""
    features = _features(n, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                bands, planes = [], []
                for field, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    f = features(text)
                    b, p = signature(minima(f), field or "") if len(f) else (np.empty(0, np.int64), np.zeros(2 * PLANE_WORDS, np.int64))
                    bands.append(b)
                    planes.append(p)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(bands), _lists(planes)], schema=_SIGNED)

    return run


def _compare(n: int, words: bool, threshold: float):
    """(a, b, x, y) -> (a, b, similarity) of the texts x and y, where it reaches the threshold."""
    features = _features(n, words)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                fx, fy = features(x), features(y)
                common = len(np.intersect1d(fx, fy, assume_unique=True))
                total = len(fx) + len(fy) - common
                if total and common >= threshold * total - 1e-9:
                    found.append((a, b, common / total))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], schema.field(k).type) for k in range(3)], schema=schema)

    return run


def classes(rows: DataFrame, words: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, representatives): every row with its class id, and one text per class with the size of the class.

    ``rows`` has field_name, key and text. Texts are equal if two 64-bit hashes of their normal forms are; the class id is
    the least key.
    """
    norm = F.trim(F.regexp_replace(F.lower("text"), r"(?U)\s+", " ")) if words else F.regexp_replace(F.lower("text"), WHITE, "")
    normed = rows.where("text is not null").select("field_name", "key", norm.alias("norm")).withColumn("h", F.xxhash64("norm")).withColumn("h2", F.xxhash64(F.lit(1), "norm"))
    reps = normed.groupBy("field_name", "h", "h2").agg(F.min(F.struct("key", "norm")).alias("first"), F.count("*").alias("n_rows"))
    reps = reps.select("field_name", "h", "h2", "n_rows", F.col("first.key").alias("cid"), F.col("first.norm").alias("norm"), F.monotonically_increasing_id().alias("rid"))
    reps = materialise(reps, "classes")
    members = normed.select("field_name", "key", "h", "h2").join(reps.select("field_name", "h", "h2", "cid", "rid", "n_rows"), ["field_name", "h", "h2"]).select("field_name", "key", "cid", "rid", "n_rows")
    return materialise(members, "members"), reps


def blocks(n: Column, block: int) -> Column:
    """The number of blocks for n members."""
    return F.greatest(F.ceil(n / block), F.lit(1)).cast("int")


def pairs_within(rows: DataFrame, group: str, size: str, key: str, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: the pairs of distinct keys that share a group, made in pairs of blocks.

    A group of n rows has g = n / ``block`` blocks; a row goes to the g pairs of blocks that hold its own.
    """
    g = blocks(F.col(size), block)
    placed = rows.select(group, F.col(key).alias("_k"), g.alias("_g"), F.pmod(F.xxhash64(key), g).cast("int").alias("_i"))
    spread = lambda low, high, one, other: placed.withColumn("_j", F.explode(F.sequence(low, high))).select(group, F.col(one).alias("_p"), F.col(other).alias("_q"), "_k")
    left = spread(F.col("_i"), F.col("_g") - 1, "_i", "_j").withColumnRenamed("_k", "x")
    right = spread(F.lit(0), F.col("_i"), "_j", "_i").withColumnRenamed("_k", "y")
    apart = ((F.col("_p") < F.col("_q")) & (F.col("x") != F.col("y"))) | (F.col("x") < F.col("y"))
    return left.join(right, [group, "_p", "_q"]).where(apart).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def candidates(signed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: representatives that share a band key.

    Band keys are counted with partial aggregation and only shared ones are written, so that the planner knows their size
    when it joins them with their members.
    """
    bands = signed.select("rid", F.explode("bands").alias("band"))
    sizes = materialise(bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "bands")
    shared = materialise(bands.join(sizes, "band"), "shared")
    return pairs_within(shared, "band", "n", "rid", block).distinct()


def estimate(x: Column, y: Column) -> Column:
    """Similarity from two pairs of bit planes: differing positions by bit count, corrected for chance matches."""
    apart = None
    for w in range(PLANE_WORDS):
        bits = F.bit_count(x[w].bitwiseXOR(y[w]).bitwiseOR(x[PLANE_WORDS + w].bitwiseXOR(y[PLANE_WORDS + w])))
        apart = bits if apart is None else apart + bits
    return ((1 - apart / SAMPLED) - 0.25) / 0.75


def _both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    one = table.select(F.col("rid").alias("a"), F.col(column).alias("x"))
    two = table.select(F.col("rid").alias("b"), F.col(column).alias("y"))
    return pairs.join(one, "a").join(two, "b")


def similar_classes(reps: DataFrame, threshold: float, n: int = 3, words: bool = False, block: int = BLOCK) -> DataFrame:
    """(a, b, similarity): ids (``rid``) of representatives that reach the threshold."""
    signed = materialise(reps.select("rid", "field_name", "norm").mapInArrow(_sign(n, words), SIGNED), "signed")
    near = _both(candidates(signed, block), signed, "planes").where(estimate(F.col("x"), F.col("y")) >= threshold - SLACK).select("a", "b")
    near = materialise(near, "near")
    asked = near.select(F.col("a").alias("rid")).unionByName(near.select(F.col("b").alias("rid"))).distinct()  # only their texts are moved
    return _both(near, reps.select("rid", "norm").join(asked, "rid", "left_semi"), "norm").select("a", "b", "x", "y").mapInArrow(_compare(n, words, threshold), "a bigint, b bigint, similarity double")


def near_pairs(rows: DataFrame, threshold: float = 0.7, n: int = 3, block: int = BLOCK) -> DataFrame:
    """(field_name, key_a, key_b): all pairs of rows of one field that are near duplicates or equal, least key first.

    Two linked classes give pairs of blocks of their rows, as many as their sizes ask for; a class of several rows is
    linked with itself. Rows of classes without a link aren't read again.
    """
    members, reps = classes(rows)
    sizes = reps.select("rid", blocks(F.col("n_rows"), block).alias("g"))
    links = similar_classes(reps, threshold, n, block=block).select("a", "b")
    sized = links.join(sizes.withColumnsRenamed({"rid": "a", "g": "ga"}), "a").join(sizes.withColumnsRenamed({"rid": "b", "g": "gb"}), "b")
    own = reps.where("n_rows > 1").select(F.col("rid").alias("a"), F.col("rid").alias("b"), blocks(F.col("n_rows"), block).alias("ga"), blocks(F.col("n_rows"), block).alias("gb"))
    grid = sized.unionByName(own).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ga") - 1)))
    grid = grid.withColumn("j", F.explode(F.sequence(F.when(F.col("a") == F.col("b"), F.col("i")).otherwise(0), F.col("gb") - 1)))
    grid = materialise(grid.select("a", "b", "i", "j"), "links")
    linked = grid.select(F.col("a").alias("rid")).unionByName(grid.select(F.col("b").alias("rid"))).distinct()
    placed = members.join(linked, "rid", "left_semi").withColumn("at", F.pmod(F.xxhash64("key"), blocks(F.col("n_rows"), block)).cast("int"))
    one = placed.select("field_name", F.col("rid").alias("a"), F.col("at").alias("i"), F.col("key").alias("x"))
    two = placed.select(F.col("rid").alias("b"), F.col("at").alias("j"), F.col("key").alias("y"))
    inner = (F.col("a") == F.col("b")) & (F.col("i") == F.col("j"))
    out = grid.join(one, ["a", "i"]).join(two, ["b", "j"]).where(~inner | (F.col("x") < F.col("y")))
    return out.select("field_name", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))


def near_groups(rows: DataFrame, threshold: float = 0.7, n: int = 3, words: bool = False, block: int = BLOCK) -> DataFrame:
    """One row per row: its class (equal texts), its group (classes connected by links) and its class's links.

    With word shingles of five words and a threshold of 0.8 this is the usual near-duplicate stage of a corpus.
    """
    members, reps = classes(rows, words)
    links = materialise(similar_classes(reps, threshold, n, words, block).select("a", "b"), "links")
    ends = links.select(F.col("a").alias("rid")).unionByName(links.select(F.col("b").alias("rid")))
    degree = ends.groupBy("rid").agg(F.count("*").alias("n_links"))
    parts = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "rid")
    least = parts.join(reps.select("rid", "cid"), "rid").groupBy("component").agg(F.min("cid").alias("group_id"))
    parts = parts.join(least, "component").select("rid", "group_id")
    out = members.join(parts, "rid", "left").join(degree, "rid", "left")
    return out.select("field_name", "key", F.col("cid").alias("class_id"), F.coalesce("group_id", "cid").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
