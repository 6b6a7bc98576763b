"""Removal of repeated byte strings with suffix arrays by induced sorting, in shards.

Every 100-byte window has an anchor: the 40-byte gram of least hash in it, the leftmost of equals. Equal windows have
equal anchors at equal offsets, so windows need to be compared only where their anchors are equal. Consecutive windows
with one anchor form a run, whose context is the bytes they cover.

1. Anchors are counted; those that occur twice or more set a bit in a bitmap, which is broadcast and has a greatest size.
2. Runs whose anchor's bit is set are dealt out by anchor; runs of an anchor that very many places have are dealt out window
   by window, by the window's hash. Within a batch, contexts that came before settle at once.
3. Contexts of equal anchors stand in one shard. A suffix array orders the shard's suffixes, the permuted common
   prefixes tell which windows are equal, and all but the first of equal windows are removed.
4. A document's removed stretches meet its text again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, prepare, write_table
from .shingles import P1, mix, texts
from .suffix_array import common_prefixes, suffix_array

WINDOW, GRAM = 100, 40
GRAMS = WINDOW - GRAM + 1
#: Bits of the map of repeated anchors: BITS_EACH for an anchor within these bounds (128 KB and 128 MB). A set bit by chance
#: only sends a run that nothing meets.
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 20, 1 << 30
#: An anchor with more places than this is hot. A shard holds the distinct contexts of an anchor in memory, about 150 bytes each.
HOT = 500_000
#: Hot anchors that are broadcast (8 bytes each), the hottest first.
MOST_HOT = 4_000_000
#: A shard takes whole anchors until it has this many bytes.
SHARD_BYTES = 1 << 20
#: Stands for a missing doc_id: after all others.
NO_ID = (1 << 63) - 1

_rng = np.random.default_rng(20240607)
BYTE_HASHES = _rng.integers(0, 1 << 63, 256, np.int64).astype(np.uint64)


def runs(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window, number of windows and anchor position of each run of b, WINDOW bytes or longer."""
    h = BYTE_HASHES[np.frombuffer(b, np.uint8)]
    wide = {}
    for width in (1, 2, 4, 8, 16):
        wide[2 * width] = h = mix(h[:-width] * P1 + h[width:])
    grams = mix(wide[32][: len(b) - GRAM + 1] * P1 + wide[8][32:])
    # hash and position in one number, so that the least is the leftmost of the least
    n = len(grams)
    ranked = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // GRAMS)
    padded = np.full(blocks * GRAMS, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = ranked
    grid = padded.reshape(blocks, GRAMS)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - GRAMS + 1
    least = np.minimum(right[:m], left[GRAMS - 1 : GRAMS - 1 + m])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    count = np.diff(np.append(first, m))
    return grams[at[first]], first, count, at[first]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [runs(b)[0] for b in texts(batch, "text") if b and len(b) >= WINDOW]
        a, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n)], names=["a", "n"])


RUN_SCHEMA = "a long, doc_id long, text_key long, first int, n int, context binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["a", "doc_id", "text_key", "first", "n", "context"])


def text_key(b: bytes) -> int:
    return xxhash.xxh3_64_intdigest(b) - (1 << 63)


def _repeated_runs(bitmap, hot):
    """Runs with a repeated anchor. A row without context is a stretch that is removed already: an earlier row of the batch has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, many = np.frombuffer(bitmap.value, np.uint64), frozenset(hot.value)
        size = np.uint64(64 * len(bits))
        for batch in batches:
            docs = {}
            for i, b in zip(batch.column(0).to_pylist(), texts(batch, "text"), strict=True):
                if b and len(b) >= WINDOW:
                    docs[(NO_ID if i is None else i, text_key(b))] = b
            seen, rows = set(), []
            for (doc, key), b in sorted(docs.items()):
                a, first, n, _ = runs(b)
                slot = a % size
                hit = np.flatnonzero((bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1))
                parts = []
                for anchor, f, c in zip(a[hit].view(np.int64).tolist(), first[hit].tolist(), n[hit].tolist(), strict=True):
                    if anchor in many:
                        parts += [(text_key(b[k : k + WINDOW]), k, 1) for k in range(f, f + c)]
                    else:
                        parts.append((anchor, f, c))
                gone_from = gone_to = -1  # removed runs that touch are one stretch
                for anchor, f, c in parts:
                    context = b[f : f + c + WINDOW - 1]
                    if context in seen:
                        if f == gone_to:
                            gone_to = f + c
                        else:
                            if gone_to > gone_from:
                                rows.append((anchor, doc, key, gone_from, gone_to - gone_from, None))
                            gone_from, gone_to = f, f + c
                    else:
                        seen.add(context)
                        rows.append((anchor, doc, key, f, c, context))
                if gone_to > gone_from:
                    rows.append((anchor, doc, key, gone_from, gone_to - gone_from, None))
                if len(rows) >= 20_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    return run


def _settle(groups: list[dict[bytes, tuple]], out: list[tuple]) -> None:
    """groups: for each anchor the first row (doc_id, text_key, first, n) of each context. Appends removed windows to out."""
    contexts, owners = [c for g in groups for c in g], [o for g in groups for o in g.values()]
    if not contexts:
        return
    order = sorted(range(len(owners)), key=lambda i: owners[i][:3])
    owners, contexts = [owners[i] for i in order], [contexts[i] for i in order]
    lengths = np.array([len(c) + 1 for c in contexts])
    starts = np.cumsum(lengths) - lengths
    s = np.frombuffer(b"".join(c + b"\0" for c in contexts), np.uint8).astype(np.int64) + 2
    s[starts + lengths - 1] = 1
    s = np.append(s, 0)
    sa = suffix_array(s, 258)
    equal_to_before = common_prefixes(s, sa) >= WINDOW
    group = np.cumsum(~equal_to_before)
    owner = np.repeat(np.arange(len(contexts)), lengths)
    offset = np.arange(len(s) - 1) - starts[owner]
    is_window = np.zeros(len(s), bool)
    is_window[:-1] = offset < np.array([o[3] for o in owners])[owner]
    mine = is_window[sa]
    at, group = sa[mine], group[mine]
    # owners are in order, so the least position of a group is its first window
    least = np.full(group.max() + 1, len(s), np.int64) if len(group) else np.empty(0, np.int64)
    np.minimum.at(least, group, at)
    gone = np.sort(at[least[group] != at])
    if not len(gone):
        return
    breaks = np.flatnonzero((np.diff(gone) != 1) | (np.diff(owner[gone]) != 0)) + 1
    for a, b in zip([0, *breaks.tolist()], [*breaks.tolist(), len(gone)], strict=True):
        o = owners[owner[gone[a]]]
        out.append((o[0], o[1], o[2] + int(offset[gone[a]]), b - a))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor, document and position; shards are built and settled as they pass by."""

    def emit(out):
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "text_key", "first", "n"])

    groups, group, held, current, out = [], {}, 0, None, []
    for batch in batches:
        for a, doc, key, first, n, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if context is None:
                out.append((doc, key, first, n))
                continue
            if a != current:
                if len(group) > 1:
                    groups.append(group)
                    held += sum(map(len, group))
                    if held >= SHARD_BYTES:
                        _settle(groups, out)
                        groups, held = [], 0
                group, current = {}, a
            before = group.setdefault(context, (doc, key, first, n))
            if before[:3] != (doc, key, first):  # else the same document in another row, or the first one
                out.append((doc, key, first, n))
        if len(out) > 10_000:
            yield emit(out)
            out = []
    if len(group) > 1:
        groups.append(group)
    _settle(groups, out)
    yield emit(out)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        rows = []
        for i, b, gone in zip(ids, texts(batch, "text"), batch.column(2).to_pylist(), strict=True):
            b = b or b""
            pieces, end, spans, removed = [], 0, 0, 0
            for first, n in sorted((x["first"], x["n"]) for x in gone or ()):
                a, z = first, first + n + WINDOW - 1
                if a > end or not spans:
                    pieces.append(b[end:a])
                    spans += 1
                removed += max(0, z - max(a, end))
                end = max(end, z)
            pieces.append(b[end:])
            rows.append((i, len(b), removed, spans, b"".join(pieces)))
        i, n, r, s, kept = zip(*rows, strict=True) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int64()), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"],
        )


def substring_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", with_bytes: bool = True) -> DataFrame:
    """One row for each input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_bytes.

    Each byte that a WINDOW-byte string covers which also starts earlier (smaller doc_id, or same document and earlier
    start) is removed. Strings never cross documents and are judged on the input. kept_bytes need not be valid UTF-8.
    Null texts count as empty; texts under WINDOW bytes lose nothing. A missing doc_id stands after all others. Rows
    that repeat an id come in the order of a hash of their texts; rows that repeat id and text count as one document,
    and each has its result. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    repeated = source.select("text").mapInArrow(_anchors, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).where("n > 1")
    repeated = write_table(repeated, "substring-anchors")
    n_bits = min(MOST_BITS, max(LEAST_BITS, 1 << (repeated.count() * BITS_EACH).bit_length()))
    slot = F.pmod("a", F.lit(n_bits).cast("bigint"))  # a power of two: the same for signed and unsigned
    marked = write_table(
        repeated.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(a, {n_bits}L) % 64 as int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits")), "substring-bitmap",
    )
    bits = np.zeros(n_bits // 64, np.uint64)
    for part in marked.toLocalIterator(prefetchPartitions=False):  # MOST_BITS / 64 rows at most
        bits[part.word] = np.uint64(part.bits & 0xFFFFFFFFFFFFFFFF)
    bitmap = spark.sparkContext.broadcast(bits.tobytes())
    hot = [r.a for r in repeated.where(f"n > {HOT}").orderBy(F.desc("n"), "a").limit(MOST_HOT).select("a").collect()]
    hot = spark.sparkContext.broadcast(hot)
    drop_table(marked, repeated)
    found = source.mapInArrow(_repeated_runs(bitmap, hot), RUN_SCHEMA)
    # stretches that are settled already are spread; runs meet by anchor
    dealt = found.repartition(F.when(F.col("context").isNull(), F.xxhash64("doc_id", "first")).otherwise(F.col("a")))
    gone = dealt.sortWithinPartitions("a", "doc_id", "text_key", "first").mapInArrow(_removed, "doc_id long, text_key long, first int, n int")
    gone = gone.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "n")).alias("gone"))
    gone = write_table(gone, "substring-gone")
    keyed = source.mapInArrow(_with_key, "doc_id long, text string, id long, text_key long")
    rows = keyed.alias("d").join(
        gone.select(F.col("doc_id").alias("g_id"), F.col("text_key").alias("g_key"), "gone"),
        (F.col("id") == F.col("g_id")) & (F.col("d.text_key") == F.col("g_key")),
        "left",
    )
    out = rows.select("d.doc_id", "text", "gone").mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
    return out if with_bytes else out.drop("kept_bytes")


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        keys = [text_key(b or b"") for b in texts(batch, "text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([NO_ID if i is None else i for i in ids], pa.int64()), pa.array(keys, pa.int64())],
            names=["doc_id", "text", "id", "text_key"],
        )
