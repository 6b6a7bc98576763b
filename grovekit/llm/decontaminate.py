"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders. Windows of such templates, and of the words themselves, are joined by
hash with those of the benchmark; windows of a document and an item that lie on one diagonal form an alignment. The values
in its slots must map one to one from item to document: that admits re-parameterised questions and turns chance matches
away. Where some clash, the windows that agree count if they cover more of the item. Capitalised words that start a
sentence or line are read both as words and as names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, write_table
from .shingles import P1, mix, texts

#: Tokens of a window, literal ones among them at least (with other values), share of an item's tokens that consistent
#: alignments cover.
WINDOW, MIN_LITERALS, MIN_COVER = 8, 4, 0.5
#: Share of an item's tokens in windows that agree where others on their diagonal clash; verbatim tokens in a row that
#: count whatever their share.
CLASH_COVER, VERBATIM_RUN = 0.75, 20
#: Bytes of texts that are cut into windows at once, bits of the filter before the search.
CHUNK, FILTER_BITS = 1 << 20, 22
#: Benchmark windows whose hashes are broadcast (8 bytes each) to thin out the documents' windows; beyond that the join alone does it.
BROADCAST_WINDOWS = 2_000_000

# Units, taken as such after a number.
UNITS = frozenset(
    "kg g mg lb lbs oz km m cm mm mi mile miles ft foot feet inch inches yd yard yards l ml liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years kmh mph "
    "percent dollar dollars cent cents euro euros pound pounds degree degrees".split()
)
STRIP = b" \t.,;:!?\"'()[]{}<>*#%&$=|~`^_-+/\\"
BREAK = b"\x00"


class Tokens(dict):
    """Raw token to row of a table of its properties, for the tokens of this process up to a fixed number."""

    LIMIT = 300_000

    def __init__(self):
        super().__init__()
        self.new: list[tuple[int, bool, bool, bool, bool, bool]] = []
        self.hashes, self.flags, self.filled = np.empty(1024, np.uint64), np.empty((5, 1024), bool), 0

    def __missing__(self, raw: bytes) -> int:
        bare = raw.strip(STRIP)
        text = bare.decode("utf-8", "replace")
        low = text.lower()
        number = any(c.isdigit() for c in text)
        literal = xxhash.xxh64_intdigest(low.encode())
        ends = raw == BREAK or raw.rstrip(b"\"')]*#%&$")[-1:] in (b".", b"!", b"?", b":")
        # hash, is there a word, is it a number, a capitalised word, a unit, does a sentence end
        self.new.append((literal, bool(bare) and raw != BREAK, number, text[:1].isupper() and not number, low in UNITS, ends))
        self[raw] = n = len(self)
        return n

    def lookup(self, parts: list[bytes]) -> tuple[np.ndarray, ...]:
        if len(self) > self.LIMIT:
            self.clear()
            self.filled = 0
        ids = np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))
        if self.new:
            end = self.filled + len(self.new)
            if end > len(self.hashes):
                self.hashes = np.resize(self.hashes, 2 * end)
                flags = np.empty((5, 2 * end), bool)
                flags[:, : self.filled] = self.flags[:, : self.filled]
                self.flags = flags
            self.hashes[self.filled : end] = [r[0] for r in self.new]
            self.flags[:, self.filled : end] = np.array([r[1:] for r in self.new], bool).T
            self.filled = end
            self.new.clear()
        return self.hashes[ids], *(f[ids] for f in self.flags)


NUMBER, NAME, UNIT = np.uint64(0xA1), np.uint64(0xB2), np.uint64(0xC3)


def template(docs: list[bytes], tokens: Tokens) -> tuple[np.ndarray, ...]:
    """Of each word of some texts: the text's number, its template hash with words that start a sentence or line read as
    they are, the one with capitalised ones read as names, the hash of its value, and whether it is a slot in either."""
    parts, sizes = [], []
    for b in docs:
        own = b.replace(b"\n", b" \x00 ").split()
        parts.append(BREAK)
        parts += own
        sizes.append(len(own) + 1)
    value, word, number, capital, unit, ends = tokens.lookup(parts)
    # a sentence starts after a token that ends one; blank tokens in between keep that
    marks = np.where(word | ends, np.arange(len(parts)), -1)
    before = np.concatenate(([-1], np.maximum.accumulate(marks)[:-1]))
    starts = (before < 0) | ends[before]
    is_number = number & word
    after_number = np.concatenate(([False], is_number[:-1]))
    named, unit = capital & word, unit & after_number
    out, slots = [], []
    for name in (named & ~starts, named):
        t = value.copy()
        t[name], t[unit], t[is_number] = NAME, UNIT, NUMBER
        out.append(t[word])
        slots.append((is_number | name | unit)[word])
    return np.repeat(np.arange(len(docs)), sizes)[word], *out, value[word], *slots


def windows(t: np.ndarray, k: int) -> np.ndarray:
    if len(t) < k:
        return np.empty(0, np.uint64)
    m = len(t) - k + 1
    h = t[:m].copy()
    for i in range(1, k):
        h *= P1
        h ^= h >> np.uint64(33)
        h += t[i : i + m]
    return mix(h)


def signed(h: np.uint64) -> int:
    return int(h) - (1 << 64) if int(h) >> 63 else int(h)


#: mask: places of slots in a window; plain: read as words where a sentence or line starts; slots: values of the slots.
SCHEMA = "id long, at int, size int, h long, slots array<long>, mask int, plain boolean, tokens int"
TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.bool_(), pa.int32()]
VERBATIM = np.uint64(0xD4)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])


def window_row(i: int, at: int, k: int, h: np.uint64, value: np.ndarray, slot: np.ndarray, plain: bool, n: int) -> tuple:
    return (i, at, k, signed(h), value[slot].view(np.int64).tolist(), sum(1 << int(p) for p in np.flatnonzero(slot)), plain, n)


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the benchmark in all readings; a text under WINDOW words is one window."""
    tokens = Tokens()
    for batch in batches:
        rows = []
        for i, b in zip(batch.column(0).to_pylist(), texts(batch, "text"), strict=True):
            if i is None or not b:
                continue
            _, t, named, value, slot, slot_named = template([b], tokens)
            n = len(t)
            k = min(WINDOW, n)
            if not k:
                continue
            unsure = slot_named & ~slot
            # quoted within a sentence, an item's first word looks like a name
            unsure[0] = not slot[0]
            named[0] = named[0] if slot[0] else NAME
            for at, h in enumerate(windows(value ^ VERBATIM, k)):
                rows.append(window_row(i, at, k, h, value[at : at + k], np.zeros(k, bool), True, n))
            for at in range(n - k + 1):
                places = np.flatnonzero(unsure[at : at + k]).tolist()
                for m in range(len(places) + 1):
                    if (~slot[at : at + k]).sum() - m < min(MIN_LITERALS, k - (m > 0)):
                        break
                    for chosen in combinations(places, m):
                        own, s = t[at : at + k].copy(), slot[at : at + k].copy()
                        for p in chosen:
                            own[p], s[p] = named[at + p], True
                        rows.append(window_row(i, at, k, windows(own, k)[0], value[at : at + k], s, not m or chosen == (0,) and at == 0, n))
        yield batch_of(rows)


def _windows(sizes: list[int], wanted=None):
    """Windows of documents of each size: the words themselves, and the templates in both readings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, low = Tokens(), np.uint64((1 << FILTER_BITS) - 1)
        keep = None if wanted is None else np.frombuffer(wanted.value, np.uint64)
        if keep is not None:
            sieve = np.zeros(1 << FILTER_BITS, bool)
            sieve[keep & low] = True

        def found(ids: list[int], docs: list[bytes]) -> pa.RecordBatch:
            rows = []
            doc, t, named, value, slot, slot_named = template(docs, tokens)
            first = np.searchsorted(doc, np.arange(len(docs) + 1))
            verbatim, none = value ^ VERBATIM, np.zeros(len(t), bool)
            for k in sizes:
                if len(t) < k:
                    continue
                inside = doc[: len(t) - k + 1] == doc[k - 1 :]
                plain = windows(t, k)
                for h, s, kind in ((windows(verbatim, k), none, 0), (plain, slot, 1), (windows(named, k), slot_named, 2)):
                    good = inside & sieve[h & low] if keep is not None else inside.copy()
                    if kind == 2:
                        good &= h != plain
                    at = np.flatnonzero(good)
                    if keep is not None and len(at):
                        at = at[keep[np.minimum(np.searchsorted(keep, h[at]), len(keep) - 1)] == h[at]]
                    for p in at.tolist():
                        own, d = s[p : p + k], int(doc[p])
                        if not kind or k - own.sum() >= min(MIN_LITERALS, k):
                            rows.append(window_row(ids[d], p - int(first[d]), k, h[p], value[p : p + k], own, kind < 2, int(first[d + 1] - first[d])))
            return batch_of(rows)

        for batch in batches:
            ids, docs, size = [], [], 0
            for i, b in zip(batch.column(0).to_pylist(), texts(batch, "text"), strict=True):
                if i is None or not b:
                    continue
                ids.append(i)
                docs.append(b)
                size += len(b)
                if size >= CHUNK:
                    yield found(ids, docs)
                    ids, docs, size = [], [], 0
            if docs:
                yield found(ids, docs)

    return run


def one_to_one(pairs: set[tuple[int, int]]) -> bool:
    return len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs)


def judged(n: int, met: list[dict]) -> tuple[int, float, bool, bool]:
    """Windows that count, the share of an item's n words that they cover, whether a slot has another value, whether it is
    a leak. met has windows of one document and item."""
    diagonals, sure, wide, run, count, changed = defaultdict(list), set(), set(), 0, 0, False
    for w in met:
        diagonals[w["diagonal"]].append((w["at"], w["size"], w["plain"], frozenset(zip(w["x"], w["y"], strict=True)), w))
    for ws in diagonals.values():
        places = defaultdict(set)
        for at, _, _, _, w in ws:
            slots = [at + p for p in range(w["size"]) if w["mask"] >> p & 1]
            for place, x, y in zip(slots, w["x"], w["y"], strict=True):
                places[x, y].add(place)
        pairs = set(places)
        if not one_to_one(pairs):  # the largest agreeing set, by the places of its values
            xs, ys, pairs = set(), set(), set()
            for x, y in sorted(places, key=lambda v: (-len(places[v]), v[0] != v[1], min(places[v]), v)):
                if x not in xs and y not in ys:
                    pairs.add((x, y))
                    xs.add(x)
                    ys.add(y)
        same = {w[0]: w[1] for w in ws if all(x == y for x, y in w[3])}
        agree = [w for w in ws if w[3] <= pairs or all(x == y for x, y in w[3])]
        plain = [w for w in ws if w[2]]
        if not one_to_one(set().union(*(w[3] for w in plain))):
            plain = []
        if len(pairs) == len(places):
            plain = ws
        for part, covered in ((plain, sure), (agree, wide), (plain, wide)):
            for at, size, *_ in part:
                covered.update(range(at, at + size))
        taken = plain + [w for w in agree if w not in plain]
        count += len({w[:2] for w in taken})
        changed |= any(x != y for w in taken for x, y in w[3])
        row, before = 0, None
        for at in sorted(same):
            row = row + 1 if before is not None and at == before + 1 else same[at]
            run, before = max(run, row), at
    leak = len(sure) >= MIN_COVER * n or len(wide) >= CLASH_COVER * n or run >= VERBATIM_RUN
    return count, len(wide) / n, changed, leak


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [judged(n, met) for n, met in zip(batch.column("tokens").to_pylist(), batch.column("met").to_pylist(), strict=True)]
        columns = [[r[c] for r in out] for c in range(4)]
        columns = [pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.float64(), pa.bool_(), pa.bool_()], strict=True)]
        found = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("item_id"), *columns[:3]], names=["doc_id", "item_id", "n_windows", "cover", "reparameterised"])
        yield found.filter(columns[3])


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """One row for each document and item that it leaks: doc_id, item_id, n_windows, cover, reparameterised.

    cover is the share of the item's words in windows that agree: MIN_COVER at least where no slots clash, else
    CLASH_COVER, or any with VERBATIM_RUN words in a row; reparameterised tells that some slot has another value than in
    the item. Items under WINDOW words count as one window. Null and blank texts and rows
    without an id leak nothing. Rows that repeat an id are one document. Empty tables give no rows. Other columns are
    not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select(F.col(item_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    items = write_table(items.mapInArrow(_item_windows, SCHEMA), "leak-items")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # WINDOW values at most
    wanted = None
    if items.count() <= BROADCAST_WINDOWS:
        hashes = np.array([r.h for r in items.select("h").distinct().toLocalIterator()], np.int64).view(np.uint64)
        wanted = spark.sparkContext.broadcast(np.sort(hashes).tobytes())
    source = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    found = source.mapInArrow(_windows(sizes, wanted), SCHEMA)
    met = found.alias("d").join(items.alias("i"), ["h", "size", "mask"]).select(
        F.col("d.id").alias("doc_id"), F.col("i.id").alias("item_id"), F.col("i.tokens").alias("tokens"),
        F.struct(
            (F.col("d.at") - F.col("i.at")).alias("diagonal"), F.col("i.at").alias("at"), "size", "mask",
            (F.col("i.plain") & F.col("d.plain")).alias("plain"), F.col("i.slots").alias("x"), F.col("d.slots").alias("y"),
        ).alias("w"),
    )
    aligned = met.groupBy("doc_id", "item_id").agg(F.first("tokens").alias("tokens"), F.collect_set("w").alias("met"))
    return aligned.mapInArrow(_judged, "doc_id long, item_id long, n_windows long, cover double, reparameterised boolean")
