"""Near-duplicates of documents by circulant MinHash.

Two permutations of a universe of 2 ** 22 shingle numbers make the whole signature: the
first scatters a shingle, the second, shifted circularly by one place more for each
coordinate, ranks it. The ranks of a shingle under all shifts lie side by side in memory,
so a signature is the minimum of as many slices as the text has shingles. Bands of
coordinates propose buckets; every link is confirmed on the full shingle sets.

A bucket's members are held against the one of them that shares buckets with the most
others. Where that leaves a bucket in several components, its members may hold links that
avoid that one, and all its pairs would grow with its square. There two texts of different components can only link if they
share one of the rarest shingles of each, early enough that the rest can still reach the
threshold; only such pairs are made, and none that links is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, components, kept, rows_of, scratch, words_of

UNIVERSE_BITS = 22
#: 28 bands of 5: a pair at similarity 0.8 shares no band with probability 1.5e-5.
BANDS, ROWS = 28, 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * _ODD[5]
    x = x ^ (x >> np.uint64(29))
    x = x * _ODD[0]
    return x ^ (x >> np.uint64(32))


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; all its words if fewer than k."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    size = min(n, k)
    out = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        out = mix64(out + h[j : n - size + 1 + j] * _ODD[j % 8])
    return np.unique(out)


def shingle_set(words: list[bytes], k: int) -> set:
    """The shingles themselves, for confirming links."""
    return set(zip(*(words[i:] for i in range(k)))) if len(words) >= k else {tuple(words)} if words else set()


class Circulant:
    """Signatures of ``size`` coordinates from two permutations."""

    def __init__(self, size: int, bits: int = UNIVERSE_BITS, seed: int = 5):
        rng = np.random.default_rng(seed)
        universe = 1 << bits
        self.mask, self.size = np.uint64(universe - 1), size
        self.scatter = rng.permutation(universe).astype(np.uint32)
        ranks = rng.permutation(universe).astype(np.uint32)
        ranks = np.concatenate([ranks, ranks[:size]])
        self.shifted = np.lib.stride_tricks.sliding_window_view(ranks, size)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        place = self.scatter[hashes & self.mask]
        best = np.full(self.size, 0xFFFFFFFF, np.uint32)
        for k in range(0, len(place), 2048):
            np.minimum(best, self.shifted[place[k : k + 2048]].min(axis=0), out=best)
        return best


def ascii_lower(words: list[bytes]) -> list[bytes]:
    return [w.lower() for w in words]


def signatures(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS, lower: bool = True) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash (hi, lo) of the shingle set and its band hashes."""
    names = ["doc_id", "n_shingles", "hi", "lo", "bands"]
    keep = f"circulant {bands * rows}"

    def make():
        signer = kept(keep, lambda: Circulant(bands * rows))
        salt = mix64(np.arange(1, bands + 1, dtype=np.uint64))

        def each(batch: pa.RecordBatch):
            n, hi, lo, sig = [], [], [], np.zeros((batch.num_rows, bands * rows), np.uint32)
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = text.encode("utf-8", "surrogatepass") if text else b""
                hashes = shingle_hashes((data.lower() if lower else data).split(), k)
                digest = xxhash.xxh3_128_intdigest(hashes.tobytes())
                n.append(len(hashes))
                hi.append((digest >> 64) - (1 << 63))
                lo.append((digest & ((1 << 64) - 1)) - (1 << 63))
                if len(hashes):
                    sig[i] = signer.signature(hashes)
            key = np.broadcast_to(salt, (batch.num_rows, bands)).copy()
            for j in range(rows):
                key = mix64(key + sig[:, j::rows].astype(np.uint64) * _ODD[j % 8])
            offsets = np.arange(0, batch.num_rows * bands + 1, bands, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key.reshape(-1).view(np.int64)))
            yield batch_of(names, [batch.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), lists])

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), make, f"doc_id {kind}, n_shingles long, hi long, lo long, bands array<long>", keep=keep)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the asked ids; a repeated doc_id takes part with its least text."""
    return rows_of(docs.select("doc_id", "text"), ids).groupBy("doc_id").agg(F.min("text").alias("text"))


def confirmed(docs: DataFrame, pairs: DataFrame, k: int, percent: int, lower: bool = True) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * shared >= percent * union."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = scratch(texts_of(docs, ids), "texts")
    joined = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    joined = joined.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")

    def make():
        last = [None, None]

        def of(text):
            data = text.encode("utf-8", "surrogatepass")
            return shingle_set((data.lower() if lower else data).split(), k)

        def each(batch: pa.RecordBatch):
            good = []
            for b, ta, tb in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if last[0] != b:
                    last[:] = b, of(tb)
                x, y = of(ta), last[1]
                shared = len(x & y)
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            keep = pa.array(good, pa.bool_())
            yield batch_of(["a", "b"], [batch.column(0).filter(keep), batch.column(1).filter(keep)])

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(joined.select("a", "b", "ta", "tb"), make, f"a {kind}, b {kind}")


def rare_pairs(docs: DataFrame, members: DataFrame, k: int, percent: int, lower: bool = True) -> DataFrame:
    """Pairs (a, b), a > b, of ``members (id, c)`` with different c that may reach percent.

    Shingles are ordered by the number of members that have them, rarest first; those that
    only one component has stand before all others, for no pair across components shares
    them. Of a pair that links, the first shared shingle stands early in both: what follows
    it must still hold the least intersection. So each member goes, under each shingle of
    its head, to those it shares it with, and the pairs whose tails are too short are not
    made. Complete: the order is the same for all, and no list of a shingle is cut.
    """
    kind = members.schema["id"].dataType.simpleString()
    texts = texts_of(docs, members.select(F.col("id").alias("doc_id"))).join(members, F.col("doc_id") == F.col("id"))

    def make():
        def each(batch):
            ids, comps = batch.column(0), batch.column(1)
            found = []
            for text in batch.column(2).to_pylist():
                data = text.encode("utf-8", "surrogatepass") if text else b""
                found.append(shingle_hashes((data.lower() if lower else data).split(), k))
            n = np.fromiter(map(len, found), np.int64, len(found))
            own = pa.array(np.repeat(np.arange(len(n)), n))
            yield batch_of(["id", "c", "n", "shingle"], [ids.take(own), comps.take(own), pa.array(np.repeat(n, n)), pa.array(np.concatenate(found).view(np.int64))])

        return each

    rows = scratch(arrow_map(texts.select("id", "c", "text"), make, f"id {kind}, c {kind}, n long, shingle long"), "shingles")
    shared = rows.groupBy("shingle").agg(F.count("*").alias("df"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1")
    tail = rows.join(shared.select("shingle", "df"), "shingle").groupBy("id", "c", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("s"))
    least = F.ceil(F.col("n") * percent / 100).cast("int")
    heads = tail.where(F.size("s") >= least).select("id", "c", "n", F.size("s").alias("m"), F.posexplode(F.slice("s", F.lit(1), F.size("s") - least + 1)).alias("at", "x"))
    heads = scratch(heads.select("id", "c", "n", F.col("x.shingle").alias("shingle"), (F.col("m") - F.col("at")).alias("room")), "heads")
    several = heads.groupBy("shingle").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("shingle")
    heads = heads.join(several, "shingle")
    both = heads.alias("x").join(
        heads.alias("y"),
        F.expr(f"x.shingle = y.shingle and x.c < y.c and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and {100 + percent} * least(x.room, y.room) >= {percent} * (x.n + y.n)"),
    )
    return both.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct()


def minhash_groups(docs: DataFrame, k: int = 5, percent: int = 80, lower: bool = True, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Groups of near-duplicates: doc_id, n_shingles, component_id, kept.

    docs: doc_id, text; other columns are not read. Texts with equal shingle sets form a
    class, which takes part once, as its smallest doc_id. Each class is first held
    against the lead of every band bucket it is in; the members of buckets that still
    span several components meet by their rarest shingles (``rare_pairs``). No partner is
    capped, and no pairs within a component are made. Null and empty texts have no
    shingles and are linked with nothing; a null doc_id is kept. Repeated rows get the
    same component; rows that repeat a doc_id with other texts are one document, of which
    the least text is compared. An empty table gives an empty table.
    """
    signed = scratch(signatures(docs, k, bands, rows, lower), "signatures")
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("hi", "lo", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    classes = scratch(classes, "classes")
    exploded = classes.select("id", F.explode("bands").alias("bucket"))
    sizes = exploded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = scratch(exploded.join(sizes, "bucket"), "members")
    # the member that shares its buckets with the most others lies nearest the group's middle
    degree = members.groupBy("id").agg(F.sum("n").alias("degree"))
    leads = members.join(degree, "id").groupBy("bucket").agg(F.max(F.struct("degree", "id"))["id"].alias("lead"))
    tried = members.join(leads, "bucket").where("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b"))
    tried = scratch(tried.distinct(), "tried")
    links = scratch(confirmed(docs, tried, k, percent, lower), "links")
    found = components(links)
    own = scratch(members.join(found, "id", "left").select("bucket", "id", F.coalesce("component_id", "id").alias("c")), "own")
    mixed = own.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("bucket")
    rest = scratch(own.join(mixed, "bucket").select("id", "c").distinct(), "open")
    tried = tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = scratch(rare_pairs(docs, rest, k, percent, lower).join(tried, ["a", "b"], "left_anti"), "pairs")
    more = scratch(confirmed(docs, pairs, k, percent, lower), "more")
    found = components(links.unionByName(more))
    to = classes.select("hi", "lo", "n_shingles", "id").join(found, "id", "left").select("hi", "lo", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    to = scratch(to, "class_components")
    full = signed.where("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "hi", "lo").join(to, ["hi", "lo", "n_shingles"])
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = full.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
