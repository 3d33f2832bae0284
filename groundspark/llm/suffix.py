"""Suffix-array dedup of byte strings that repeat.

Sorting every suffix of a corpus would move hundreds of times its size. A repeated window
shows as a repeated anchor gram (see ``anchors``), so only suffixes that start at anchors
whose gram may repeat (by the sketch of ``substring``) are sorted, each with the bytes to
its left that its windows reach. Equal contexts are one suffix with a count.

The sort is a merge sort that knows common prefixes. Suffixes are ordered by a hash of the
core that they share at least, then by their bytes; each task sorts its suffixes and sends
them, cut where the order's ranges end, as front-coded runs: of every suffix the length
shared with the one before and the rest. A loser tree merges the runs of a range; each
contender carries the length it shares with the last winner, so two that differ there need
no look at their bytes, and two that agree are compared behind it only. The merged common
prefixes then tell which windows repeat.

A core with very many contexts is not left to one task: the offsets at which its windows
hold the anchor are halved, and each half goes on as contexts of its own, cut to what the
half's windows reach. What these share is a longer core, so they part, or become equal and
are counted; a single offset is a window itself. Eight halvings end any group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import anchors
from .common import arrow_map, batch_of, divided, every, numbered, rows_of, scratch, unused
from .minhash import _ODD, mix64
from .substring import cell_bits, estimated_repeated, runs_of, sketch

WINDOW, GRAM = 200, 32
#: Bytes of documents that are handled at once.
CHUNK = 1 << 18
#: Contexts of a core that one task merges; a core with more of them is halved.
GROUP = 4096
#: Contexts that a range of the order holds by its mean.
RANGE = 16_384
#: Suffixes of a run.
RUN = 1 << 14


# --- sorted runs ---------------------------------------------------------------------


def shared(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of a and b, of which ``at`` bytes are known."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[at:n], "big") ^ int.from_bytes(b[at:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Of sorted strings: length shared with the one before, length of the rest, rests."""
    lcp, last = np.zeros(len(strings), np.uint16), b""
    rests = []
    for i, s in enumerate(strings):
        lcp[i] = k = shared(last, s)
        rests.append(s[k:])
        last = s
    return lcp, np.fromiter(map(len, rests), np.uint16, len(rests)), b"".join(rests)


def front_decode(lcp: np.ndarray, rest: np.ndarray, data: bytes):
    """The (string, length shared with the one before) of a run, one by one."""
    last, at = b"", 0
    for k, n in zip(lcp.tolist(), rest.tolist()):
        last = last[:k] + data[at : at + n]
        at += n
        yield last, k


def merge_runs(runs: list):
    """Merge sorted runs by a loser tree that keeps common prefixes, one string at a time.

    runs: iterables of (string, length shared with the one before in its run). Yields, in
    order, (run, place in it, length shared with the string before, string).
    """
    size = 1
    while size < len(runs):
        size *= 2
    streams = [iter(r) for r in runs] + [iter(())] * (size - len(runs))
    heads = [next(s, None) for s in streams]
    place = [0] * size
    # per stream: its string or None, and what it shares with the last winner
    text = [h[0] if h else None for h in heads]
    known = [0] * size
    losers = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser then knows what it shares with the winner."""
        if text[a] is None or text[b] is None:
            return (b, a) if text[a] is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        k = shared(text[a], text[b], known[a])
        x, y = text[a][k : k + 1], text[b][k : k + 1]
        if x < y or x == y and a < b:
            known[b] = k
            return a, b
        known[a] = k
        return b, a

    level = list(range(size))
    node = size
    while len(level) > 1:
        node //= 2
        up = []
        for i in range(0, len(level), 2):
            winner, loser = play(level[i], level[i + 1])
            losers[node + i // 2] = loser
            up.append(winner)
        level = up
    winner = level[0]
    while text[winner] is not None:
        yield winner, place[winner], known[winner], text[winner]
        place[winner] += 1
        head = next(streams[winner], None)
        # the next of the same run shares with the winner what its run says
        text[winner], known[winner] = head if head else (None, 0)
        node = (winner + size) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def repeated_windows(lcp: np.ndarray, lefts: list[bytes], counts: np.ndarray, windows: np.ndarray, window: int, gram: int) -> list[np.ndarray]:
    """Which windows of sorted anchor suffixes repeat: places within each context.

    lcp: shared with the suffix before. A context's left part ends at the anchor; its
    window that starts d bytes before the anchor repeats if another one has the same d
    bytes on the left and shares window - d on the right. Suffixes that share so much lie
    side by side, so for each d a number of the stretch and a hash of d bytes decide.
    """
    n = len(lefts)
    off = np.fromiter(map(len, lefts), np.int64, n)
    reach = window - gram
    back = np.zeros((reach + 1, n), np.uint8)
    for i, left in enumerate(lefts):
        back[: len(left), i] = np.frombuffer(left, np.uint8)[::-1]
    out_suffix, out_place = [], []
    hashes = np.zeros(n, np.uint64)
    for d in range(reach + 1):
        if d:
            hashes = mix64(hashes + (back[d - 1].astype(np.uint64) + np.uint64(1)) * _ODD[1])
        own = np.flatnonzero((off >= d) & (off - windows < d))
        if len(own) < 2:
            continue
        stretch = np.cumsum(lcp < window - d).astype(np.uint64)
        key = mix64(hashes[own] + stretch[own] * _ODD[2])
        _, inverse = np.unique(key, return_inverse=True)
        again = np.bincount(inverse)[inverse] > 1
        out_suffix.append(own[again])
        out_place.append(off[own[again]] - d)
    suffix = np.concatenate(out_suffix) if out_suffix else np.zeros(0, np.int64)
    at = np.concatenate(out_place) if out_place else np.zeros(0, np.int64)
    by = np.lexsort((at, suffix))
    suffix, at = suffix[by], at[by]
    edges = np.searchsorted(suffix, np.arange(n + 1))
    found = [at[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
    return [np.arange(w) if c > 1 else f for f, c, w in zip(found, counts.tolist(), windows.tolist())]


# --- anchors of documents ------------------------------------------------------------


def _byte_chunks(batch: pa.RecordBatch):
    """Ids, texts as bytes, their lengths and all bytes as integers, some documents at a time."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    held, first, total = [], 0, 0
    texts = batch.column(1).to_pylist()
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass") if text else b""
        texts[i] = None
        held.append(data)
        total += len(data)
        if total >= CHUNK or i + 1 == len(texts):
            lengths = np.fromiter(map(len, held), np.int64, len(held))
            yield ids[first : i + 1], held, lengths, np.frombuffer(b"".join(held), np.uint8).astype(np.uint64) + np.uint64(1)
            held, first, total = [], i + 1, 0


def byte_anchor_hashes(window: int, gram: int):
    def of(batch: pa.RecordBatch):
        for _, _, lengths, flat in _byte_chunks(batch):
            yield anchors(flat, lengths, window, gram)[3]

    return of


def occurrences(rows: DataFrame, bitmaps, window: int, gram: int) -> DataFrame:
    """Anchors that may repeat: id, gram hash, hash of the context (hi, lo), first window, windows, anchor's place in the context."""
    names = ["id", "gram", "hi", "lo", "first", "windows", "off"]

    def make():
        bits = bitmaps.value

        def each(batch):
            for ids, texts, lengths, flat in _byte_chunks(batch):
                at, index, place, hashes = anchors(flat, lengths, window, gram)
                if not len(at):
                    continue
                own = np.flatnonzero(estimated_repeated(bits, hashes))
                if not len(own):
                    continue
                first = np.searchsorted(index, own)
                count = np.searchsorted(index, own, side="right") - first
                first = at[first]
                starts = np.cumsum(lengths) - lengths
                doc = np.searchsorted(starts, first, side="right") - 1
                off, first = place[own] - first, first - starts[doc]
                digest = [xxhash.xxh3_128_digest(texts[d][f : f + n + window - 1]) for d, f, n in zip(doc.tolist(), first.tolist(), count.tolist())]
                both = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                yield batch_of(names, [pa.array(ids[doc]), pa.array(hashes[own].view(np.int64)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(off.astype(np.int32))])

        return each

    return arrow_map(rows, make, "id long, gram long, hi long, lo long, first int, windows int, off int")


def contexts_of(rows: DataFrame, classes: DataFrame, window: int) -> DataFrame:
    """The bytes of classes' contexts, each cut from its document."""
    fields = ["gram", "hi", "lo", "first", "windows", "off", "copies", "contexts"]
    asked = classes.groupBy("id").agg(F.collect_list(F.struct(*fields)).alias("asked"))
    joined = rows_of(rows, asked, "id").select("text", "asked")
    schema = "gram long, hi long, lo long, windows int, off int, copies long, contexts long, context binary"
    names = ["gram", "hi", "lo", "windows", "off", "copies", "contexts", "context"]

    def make():
        def each(batch):
            texts = batch.column(0).to_pylist()
            lists = batch.column(1)
            ends = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            col = {f: flat.field(i) for i, f in enumerate(fields)}
            owner = np.repeat(np.arange(len(texts)), ends).tolist()
            data = [t.encode("utf-8", "surrogatepass") for t in texts]
            cut = [data[d][f : f + w + window - 1] for d, f, w in zip(owner, col["first"].to_pylist(), col["windows"].to_pylist())]
            yield batch_of(names, [*(col[c] for c in names[:-1]), pa.array(cut, pa.binary())])

        return each

    return arrow_map(joined, make, schema)


# --- the distributed merge sort --------------------------------------------------------

_RUN_NAMES = ["target", "lcp", "rest", "rests", "left", "lefts", "meta"]
_RUN_SCHEMA = "target int, lcp binary, rest binary, rests binary, left binary, lefts binary, meta binary"
#: Bytes of the core's hash that stand before a suffix.
HEAD = 8
#: Contexts of whole cores that are resolved in one step.
STEP = 8192


def sorted_runs(contexts: DataFrame, targets: int) -> DataFrame:
    """Front-coded sorted runs of each task's suffixes, one row a range that gets any.

    The order starts with a hash, so its ranges are even without a sample of splitters.
    """

    def make():
        held: list[tuple] = []

        def flush():
            held.sort(key=lambda r: r[0])
            i = 0
            while i < len(held):
                target, j = int.from_bytes(held[i][0][:HEAD], "big") * targets >> 64, i
                while j < len(held) and int.from_bytes(held[j][0][:HEAD], "big") * targets >> 64 == target:
                    j += 1
                part = held[i:j]
                lcp, rest, rests = front_code([r[0] for r in part])
                left = np.fromiter((len(r[1]) for r in part), np.uint16, len(part))
                meta = np.array([r[2] for r in part], np.int64)  # gram, hi, lo, windows, copies
                row = [lcp.tobytes(), rest.tobytes(), rests, left.tobytes(), b"".join(r[1] for r in part), meta.tobytes()]
                yield batch_of(_RUN_NAMES, [pa.array([target], pa.int32()), *(pa.array([x], pa.binary()) for x in row)])
                i = j
            held.clear()

        def each(batch):
            heads = batch.column(0).to_numpy(zero_copy_only=False).astype(">i8").tobytes()
            for i, (g, h, k, w, o, c, x) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(7)))):
                held.append((heads[HEAD * i : HEAD * (i + 1)] + x[o:], x[:o], (g, h, k, w, c)))
                if len(held) >= RUN:
                    yield from flush()

        each.finish = flush
        return each

    return arrow_map(contexts.select("gram", "hi", "lo", "windows", "off", "copies", "context"), make, _RUN_SCHEMA)


def merged_repeats(runs: DataFrame, targets: int, window: int, gram: int) -> DataFrame:
    """Merge each range's runs; gram, hi, lo and the runs of repeated window starts.

    A worker holds a range's runs as they are coded, and the contexts of some cores.
    """
    names = ["gram", "hi", "lo", "runs"]

    def resolve(group: list[tuple]):
        lcps, lefts, meta = zip(*group)
        meta = np.array(meta, np.int64).reshape(-1, 5)
        found = repeated_windows(np.array(lcps) - HEAD, list(lefts), meta[:, 4], meta[:, 3], window, gram)
        some = np.array([len(f) > 0 for f in found], bool)
        cols = [pa.array(meta[some, i].copy()) for i in range(3)]
        return batch_of(names, [*cols, pa.array([runs_of(f) for f in found if len(f)], pa.list_(pa.int32()))])

    def merged(rows: list[dict]):
        streams, lefts, metas = [], [], []
        for r in rows:
            streams.append(front_decode(np.frombuffer(r["lcp"], np.uint16), np.frombuffer(r["rest"], np.uint16), r["rests"]))
            lefts.append((np.concatenate([[0], np.cumsum(np.frombuffer(r["left"], np.uint16), dtype=np.int64)]), r["lefts"]))
            metas.append(np.frombuffer(r["meta"], np.int64).reshape(-1, 5))
        group: list[tuple] = []
        for run, place, lcp, _ in merge_runs(streams):
            if len(group) >= STEP and lcp < HEAD:
                yield resolve(group)
                group = []
            ends, data = lefts[run]
            group.append((lcp, data[ends[place] : ends[place + 1]], metas[run][place]))
        if group:
            yield resolve(group)

    def run(batches):
        held, target = [], None
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if row["target"] != target and held:
                    yield from merged(held)
                    held = []
                target = row["target"]
                held.append(row)
        if held:
            yield from merged(held)

    # as many tasks as ranges: a run is large for its one row, so their number must not shrink
    return runs.repartition(targets, "target").sortWithinPartitions("target").mapInArrow(run, "gram long, hi long, lo long, runs array<int>")


def halved(parts: DataFrame, window: int) -> DataFrame:
    """Each context cut to the windows of either half of its offsets, with the core's new hash.

    Offset: how many bytes of a window stand before the anchor. A half's core is what all
    windows of its offsets hold.
    """
    names = ["g0", "h0", "l0", "shift", "gram", "hi", "lo", "windows", "off", "copies", "least", "most", "context"]

    def make():
        def each(batch):
            rows = []
            for g0, h0, l0, shift, windows, off, copies, least, most, x in zip(*(batch.column(i).to_pylist() for i in range(10))):
                middle = (least + most) // 2
                for d0, d1 in ((least, middle), (middle + 1, most)):
                    low, high = max(d0, off - windows + 1), min(d1, off)
                    if low > high:
                        continue
                    first = off - high
                    part = x[first : off + window - low]
                    core = part[high - d0 : high + window - d1]
                    digest = xxhash.xxh3_128_intdigest(part)
                    gram = xxhash.xxh3_64_intdigest(core, seed=d0 * 1000 + d1)
                    rows.append((g0, h0, l0, shift + first, gram - (1 << 63), (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63), high - low + 1, high, copies, d0, d1, part))
            if rows:
                kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] + [pa.int32()] * 2 + [pa.binary()]
                yield batch_of(names, [pa.array(c, t) for c, t in zip(zip(*rows), kinds)])

        return each

    schema = "g0 long, h0 long, l0 long, shift int, gram long, hi long, lo long, windows int, off int, copies long, least int, most int, context binary"
    return arrow_map(parts.select("g0", "h0", "l0", "shift", "windows", "off", "copies", "least", "most", "context"), make, schema)


def resolved(contexts: DataFrame, window: int, gram: int) -> DataFrame:
    """gram, hi, lo and runs of repeated window starts of ``contexts``, distinct rows of
    (gram, hi, lo, windows, off, copies, contexts, context) of which several share a gram."""
    spark = contexts.sparkSession
    fewest = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def merge(rows: DataFrame) -> DataFrame:
        targets = max(fewest, -(-rows.count() // RANGE))
        return scratch(merged_repeats(sorted_runs(rows, targets), targets, window, gram), "merged")

    found = merge(contexts.where(F.col("contexts") <= GROUP))
    hot = contexts.where(F.col("contexts") > GROUP)
    if hot.isEmpty():
        return found
    parts = hot.select(F.col("gram").alias("g0"), F.col("hi").alias("h0"), F.col("lo").alias("l0"), F.lit(0).alias("shift"), "windows", "off", "copies", F.lit(0).alias("least"), F.lit(window - gram).alias("most"), "context")
    while not parts.isEmpty():
        parts = scratch(halved(parts, window), "halves")
        classes = parts.groupBy("gram", "hi", "lo").agg(F.sum("copies").alias("copies"), F.first(F.struct("windows", "off", "context")).alias("x")).select("gram", "hi", "lo", "x.windows", "x.off", "copies", "x.context")
        classes = scratch(classes, "half_classes")
        sizes = scratch(classes.groupBy("gram").agg(F.count("*").alias("contexts"), F.sum("copies").alias("n")).where("n > 1").select("gram", "contexts"), "half_sizes")
        known = classes.join(sizes, "gram")
        own = known.where("contexts = 1").select("gram", "hi", "lo", F.array(F.lit(0), "windows").alias("runs"))
        own = own.unionByName(merge(known.where((F.col("contexts") > 1) & (F.col("contexts") <= GROUP))))
        back = parts.select("g0", "h0", "l0", "shift", "gram", "hi", "lo").join(own, ["gram", "hi", "lo"])
        back = back.select(F.col("g0").alias("gram"), F.col("h0").alias("hi"), F.col("l0").alias("lo"), F.transform("runs", lambda p: p + F.col("shift")).alias("runs"))
        found = found.unionByName(back)
        parts = parts.join(sizes.where(F.col("contexts") > GROUP).select("gram"), "gram").select("g0", "h0", "l0", "shift", "windows", "off", "copies", "least", "most", "context")
    return found.groupBy("gram", "hi", "lo").agg(F.flatten(F.collect_list("runs")).alias("runs"))


# --- the operator ------------------------------------------------------------------------


def repeated_spans(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Starts of repeated windows: (id, runs) with runs = [first, end, first, end, ...].

    rows: id (long, no two alike), text.
    """
    spark = rows.sparkSession
    bitmaps = spark.sparkContext.broadcast(sketch(rows, byte_anchor_hashes(window, gram), cell_bits(rows, 1, window, gram)))
    places = scratch(occurrences(rows, bitmaps, window, gram), "places")
    classes = places.groupBy("gram", "hi", "lo").agg(F.count("*").alias("copies"), F.min(F.struct("id", "first", "windows", "off")).alias("at"))
    classes = scratch(classes.select("gram", "hi", "lo", "copies", "at.*"), "classes")
    grams = classes.groupBy("gram").agg(F.count("*").alias("contexts"), F.sum("copies").alias("n")).where("n > 1").select("gram", "contexts")
    known = scratch(classes.join(grams, "gram"), "known")
    # one context only: it repeats as a whole
    whole = known.where("contexts = 1").select("gram", "hi", "lo", F.array(F.lit(0), "windows").alias("runs"))
    contexts = scratch(contexts_of(rows, known.where("contexts > 1"), window), "contexts")
    found = whole.unionByName(resolved(contexts, window, gram))
    found = scratch(found, "found")
    marked = places.select("id", "gram", "hi", "lo", "first").join(found, ["gram", "hi", "lo"])
    marked = marked.select("id", F.transform("runs", lambda p: p + F.col("first")).alias("runs"))
    return marked.groupBy("id").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def removed_mask(n: int, runs, window: int) -> np.ndarray:
    delta = np.zeros(n + window + 1, np.int32)
    r = np.array(runs or [], np.int64)
    np.add.at(delta, r[0::2], 1)
    np.add.at(delta, r[1::2] - 1 + window, -1)
    return np.cumsum(delta)[:n] > 0


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Remove each byte under a ``window``-byte string that also starts elsewhere.

    docs: doc_id (integer), text; other columns are not read. Every occurrence goes, the
    first one too; matches stay within documents and are judged on the input. Returns
    doc_id, n_bytes, n_removed, n_spans, kept_sha256. Null and empty texts have no bytes.
    Each row is a document of its own, whether its doc_id is null, repeated or neither;
    repeated rows repeat each other's strings. An empty table gives an empty table. What
    is left of a text may not be whole UTF-8.
    """
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "id")
    cuts = scratch(repeated_spans(rows.select("id", "text"), window, gram), "cuts")
    names = ["id", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    schema = "id long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def make():
        def each(batch):
            n, removed, spans, kept = [], [], [], []
            runs = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * batch.num_rows
            for text, r in zip(batch.column(2).to_pylist(), runs):
                data = text.encode("utf-8", "surrogatepass") if text else b""
                n.append(len(data))
                gone = removed_mask(len(data), r, window) if r else None
                removed.append(int(gone.sum()) if r else 0)
                spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()) if r else 0)
                kept.append(hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes() if r else data).hexdigest())
            yield batch_of(names, [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())])

        return each

    apart, maybe = divided(rows, cuts, "id")
    whole, cut = arrow_map(apart.select("id", "doc_id", "text"), make, schema), arrow_map(maybe.select("id", "doc_id", "text", "runs"), make, schema)
    return whole.unionByName(cut).select(names[1:])


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with the repeated bytes cut from ``text``; all columns and rows stay.

    A character that a cut leaves in part goes as a whole. Null and empty texts stay as they
    are; doc_id is not read, so rows that repeat one or have none are rows like all others;
    repeated rows lose what they repeat of each other. An empty table gives an empty table.
    """
    columns = docs.columns
    key, runs = unused(columns, "row_number"), unused(columns, "runs")
    keyed = numbered(docs, key)
    cuts = scratch(repeated_spans(keyed.select(F.col(key).alias("id"), "text"), window, gram), "cuts")
    cuts = cuts.select(F.col("id").alias(key), F.col("runs").alias(runs))
    at = columns.index("text")

    def make():
        def each(batch):
            texts = []
            for text, found in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if found:
                    data = text.encode("utf-8", "surrogatepass")
                    left = np.frombuffer(data, np.uint8)[~removed_mask(len(data), found, window)].tobytes()
                    text = left.decode("utf-8", "ignore")
                texts.append(text)
            arrays = batch.columns[: len(columns)]
            arrays[at] = pa.array(texts, pa.string())
            yield batch_of(columns, arrays)

        return each

    apart, maybe = divided(keyed, cuts, key)
    return apart.select(every(columns)).unionByName(arrow_map(maybe.select(*every(columns), runs), make, docs.schema))
