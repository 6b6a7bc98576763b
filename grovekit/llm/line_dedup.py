"""Line deduplication by pairwise alignment.

Documents are paired through hashes of what they share. A rare line pairs all its holders. Other lines, the least runs of
neighbouring lines with as many characters as an informative one, two shared lines in a row and the whole sequence of
shared lines pair each holder with the earliest one, so that m holders make m pairs. Documents with equal lines are one
class: the later ones lose what the class shares and meet nobody else. A pair is aligned with patience diff on the hashes of
lines that any two documents share, and aligned blocks that are long enough, whose lines stand side by side in both
documents, go from the later one, as do further copies in it.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import drop_table, prepare, write_table
from .shingles import texts

#: Characters that a line, or lines that stand side by side, need to pair documents and to hold up a block.
MIN_CHARS = 24
#: A line is rare with at most so many documents as holders; all of them are paired, of equal ones the first.
RARE = 3


def text_key(b: bytes) -> int:
    return xxhash.xxh3_64_intdigest(b) - (1 << 63)


def line_hashes(b: bytes) -> list[tuple[int, int, int]]:
    """Number, hash and code points of each line that isn't blank. Blanks at a line's ends don't count."""
    out = []
    for i, line in enumerate(b.split(b"\n")):
        line = line.strip()
        if line:
            out.append((i, xxhash.xxh3_64_intdigest(line) - (1 << 63), len(line.decode())))
    return out


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All lines that aren't blank, with the hash of all of their document's lines as its class."""
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
    for batch in batches:
        columns = [[] for _ in types]
        for i, b in zip(batch.column(0).to_pylist(), texts(batch, "text"), strict=True):
            if i is None or not b:
                continue
            lines = line_hashes(b)
            own = xxhash.xxh3_128_digest(array("q", [h for _, h, _ in lines]).tobytes())
            numbers, hashes, sizes = zip(*lines, strict=True) if lines else ((), (), ())
            for column, values in zip(columns, ([i] * len(lines), [text_key(b)] * len(lines), [own] * len(lines), numbers, range(len(lines)), hashes, sizes), strict=True):
                column += values
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "key", "class", "line", "place", "h", "size"])


def run_hash(hashes: list[int]) -> int:
    return xxhash.xxh3_64_intdigest(array("q", hashes).tobytes()) - (1 << 63)


def pairing_hashes(mine: list[dict]) -> tuple[set[int], set[int]]:
    """Hashes through which a document's shared lines, in order, pair it: of informative lines, and of several lines. The
    least runs from a line and up to a line together meet each line of any block of MIN_CHARS."""
    h, size = [x["h"] for x in mine], [x["size"] for x in mine]
    apart = [x["place"] - i for i, x in enumerate(mine)]  # equal for lines side by side
    lines, out = {x for x, n in zip(h, size, strict=True) if n >= MIN_CHARS}, set()
    for i, n in enumerate(size):
        if n < MIN_CHARS:
            for step in (1, -1):
                j, total = i, n
                while total < MIN_CHARS and 0 <= j + step < len(h) and apart[j + step] == apart[i]:
                    j += step
                    total += size[j]
                if total >= MIN_CHARS:
                    out.add(run_hash(h[min(i, j) : max(i, j) + 1]))
        if i and max(n, size[i - 1]) >= MIN_CHARS:
            out.add(run_hash(h[i - 1 : i + 1]))
    if len(h) > 2:
        out.add(run_hash(h))
    return lines, out - lines


def _pairing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys, copies, hashes, lines = [], [], [], [], []
        for i, key, n, mine in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "copies", "mine")), strict=True):
            for is_line, found in zip((True, False), pairing_hashes(mine), strict=True):
                ids += [i] * len(found)
                keys += [key] * len(found)
                copies += [n] * len(found)
                hashes += found
                lines += [is_line] * len(found)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (ids, keys, copies, hashes)), pa.array(lines, pa.bool_())], names=["doc_id", "key", "copies", "h", "is_line"])


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of equal items. Items that are unique in both sequences anchor the alignment: their longest
    increasing chain is kept, equal neighbours extend it, and the gaps between are aligned likewise. In a gap without
    such items, the first of equal items counts as one item, the second as another, and so on."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1}
        unique = [(i, at[x]) for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and x in at]
        if not unique:
            at, seen = {}, Counter()
            for j, x in enumerate(b[b0:b1], b0):
                at[x, seen[x]] = j
                seen[x] += 1
            seen.clear()
            for i, x in enumerate(a[a0:a1], a0):
                if (x, seen[x]) in at:
                    unique.append((i, at[x, seen[x]]))
                seen[x] += 1
        tops, rows, back = [], [], []
        for i, j in unique:
            k = bisect_left(tops, j)
            if k == len(tops):
                tops.append(j)
                rows.append(len(back))
            else:
                tops[k], rows[k] = j, len(back)
            back.append(rows[k - 1] if k else -1)
        chain, k = [], rows[-1] if rows else -1
        while k >= 0:
            chain.append(unique[k])
            k = back[k]
        pa_, pb = a0, b0
        for i, j in reversed(chain):
            out.append((i, j))
            todo.append((pa_, i, pb, j))
            pa_, pb = i + 1, j + 1
        if chain:
            todo.append((pa_, a1, pb, b1))
    return sorted(out)


def deleted(mine: list[dict], theirs: list[dict]) -> list[int]:
    """Positions in mine of the blocks that align with theirs, and of further copies of these blocks. The lines of a block
    stand side by side in both documents and have MIN_CHARS together."""
    h = [x["h"] for x in mine]
    beside = [k > 0 and mine[k]["place"] == mine[k - 1]["place"] + 1 for k in range(len(h))]
    blocks, last = [], None
    for i, j in patience(h, [x["h"] for x in theirs]):
        if last is None or (i, j) != (last[0] + 1, last[1] + 1) or not beside[i] or theirs[j]["place"] != theirs[j - 1]["place"] + 1:
            blocks.append([])
        blocks[-1].append(i)
        last = (i, j)
    held_up = lambda block: sum(mine[k]["size"] for k in block) >= MIN_CHARS
    blocks = [block for block in blocks if held_up(block)]
    gone = [k for block in blocks for k in block]
    lines, place = {h[k] for k in gone}, set(gone)
    follow = {(h[i], h[j]) for block in blocks for i, j in zip(block, block[1:], strict=False)}
    copy: list[int] = []
    for k in range(len(h) + 1):
        more = k < len(h) and k not in place and h[k] in lines
        if copy and not (more and beside[k] and copy[-1] == k - 1 and (h[k - 1], h[k]) in follow):
            gone += copy if held_up(copy) else []
            copy = []
        if more:
            copy.append(k)
    return gone


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone = []
        for mine, theirs in zip(batch.column("mine").to_pylist(), batch.column("theirs").to_pylist(), strict=True):
            gone.append([mine[k]["line"] for k in deleted(mine, theirs)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(gone, pa.list_(pa.int32()))], names=["doc_id", "key", "gone"])


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, removed, kept, shas = [], [], [], []
        for b, gone in zip(texts(batch, "text"), batch.column(batch.schema.get_field_index("gone")).to_pylist(), strict=True):
            lines, out = b.split(b"\n") if b else [], _lost(b or b"", gone)
            text = b"\n".join(x for i, x in enumerate(lines) if i not in out)
            n_lines.append(len(lines))
            removed.append(sorted(out))
            kept.append(text)
            shas.append(hashlib.sha256(text).hexdigest())
        columns = [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(removed, pa.list_(pa.int32())), pa.array(shas, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_lines", "removed", "kept_sha256", "kept_text"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = pa.array([text_key(b or b"") for b in texts(batch, "text")], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keys], names=["doc_id", "text", "key"])


#: Stands for all lines of a document that aren't blank.
ALL = -1


def _lost(b: bytes, gone: list[int] | None) -> set[int]:
    return {n for n, _, _ in line_hashes(b)} if gone == [ALL] else set(gone or ())


def removed_lines(source: DataFrame) -> DataFrame:
    """doc_id, key, gone: numbers of the lines to delete, or ALL, for documents that lose any."""
    lines = write_table(source.mapInArrow(_lines, "doc_id long, key long, class binary, line int, place int, h long, size int"), "lines")
    # holders of a line by (doc_id, key); one row for each line and task after partial aggregation, also for hot lines
    doc = F.struct("doc_id", "key")
    classes = write_table(lines.groupBy("doc_id", "key", "class").agg(F.sum("size").alias("chars")), "lines-classes")
    first = classes.groupBy("class").agg(F.min(doc).alias("first"), F.count("*").alias("copies"))
    ranked = write_table(classes.join(first.hint("merge"), "class").select("doc_id", "key", "chars", "copies", (F.col("first") == doc).alias("is_first")), "lines-ranked")
    shared = lines.groupBy("h").agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
    shared = write_table(shared.where("lo <> hi").select("h"), "lines-shared")
    kept = lines.join(shared, "h").groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("line", "place", "h", "size"))).alias("mine"))
    sequences = write_table(kept.join(ranked.where("is_first").select("doc_id", "key", "copies"), ["doc_id", "key"]), "lines-sequences")
    drop_table(lines, shared, classes)
    holders = write_table(sequences.mapInArrow(_pairing, "doc_id long, key long, copies long, h long, is_line boolean"), "lines-holders")
    of_h = holders.groupBy("h").agg(F.min(doc).alias("first"), F.max(doc).alias("hi"), F.sum("copies").alias("n"), F.max("is_line").alias("line")).where("first <> hi")
    of_h = write_table(of_h, "lines-firsts")  # apart from the join, so that a very common line's holders are dealt anew there
    met = write_table(holders.join(of_h.drop("hi"), "h").where("first < struct(doc_id, key)").select("h", doc.alias("later"), "first", "n", "line"), "lines-met")
    # a rare line's holders but for the earliest: RARE - 1 of them at most
    others = met.where(f"line and n between 3 and {RARE}").groupBy("h").agg(F.array_sort(F.collect_list("later")).alias("ds"))
    among = others.select(F.explode(F.flatten(F.transform("ds", lambda x: F.transform(F.filter("ds", lambda y: y < x), lambda y: F.struct(x.alias("later"), y.alias("first")))))).alias("p")).select("p.*")
    pairs = met.select("later", "first").union(among).distinct().select("later.doc_id", "later.key", F.col("first.doc_id").alias("f_id"), F.col("first.key").alias("f_key"))
    theirs = sequences.select(F.col("doc_id").alias("f_id"), F.col("key").alias("f_key"), F.col("mine").alias("theirs"))
    gone = pairs.join(sequences.drop("copies"), ["doc_id", "key"]).join(theirs, ["f_id", "f_key"]).select("doc_id", "key", "mine", "theirs")
    gone = gone.mapInArrow(_aligned, "doc_id long, key long, gone array<int>").where("size(gone) > 0")
    gone = gone.groupBy("doc_id", "key").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    copies = ranked.where(f"not is_first and chars >= {MIN_CHARS}").select("doc_id", "key", F.array(F.lit(ALL)).alias("gone"))
    out = write_table(gone.unionByName(copies), "lines-gone")
    drop_table(holders, sequences, met, ranked, of_h)
    return out


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each input row: doc_id, n_lines, removed (line numbers from 0), kept_sha256, kept_text.

    Later means a larger doc_id. Lines are judged on the input, and the earliest holder of a line keeps it. Null texts
    count as empty and have no lines; rows without an id are compared with nothing. Rows that repeat an id come in the
    order of a hash of their texts, rows that repeat id and text are one document. An empty table gives no rows. Other
    columns are not read.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    gone = removed_lines(source)
    rows = source.mapInArrow(_keyed, "doc_id long, text string, key long").join(gone, ["doc_id", "key"], "left").select("doc_id", "text", "gone")
    return rows.mapInArrow(_rebuilt, "doc_id long, n_lines long, removed array<int>, kept_sha256 string, kept_text string")


def delete_repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with all its columns, texts without their repeated lines and n_chars set anew; rows that lose all of their
    text go. The cases are those of line_dedup()."""
    prepare(docs.sparkSession)
    gone = removed_lines(docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")))
    gone = gone.select(F.col("doc_id").alias("_gk_id"), F.col("key").alias("_gk_match"), F.col("gone").alias("_gk_gone"))
    # columns by place, so that no name of docs matters
    place, names = docs.columns.index, [f"c{i}" for i in range(len(docs.columns))]
    plain, at, id_at = docs.toDF(*names), place(text), place(doc_id)
    size_at = place(n_chars) if n_chars in docs.columns else None
    schema = plain.schema

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([text_key(b or b"") for b in texts(batch, names[at])], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=[*names, "match"])

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[: len(names)]
            out, keep = [], []
            for b, lost in zip(texts(batch, names[at]), batch.column(len(names)).to_pylist(), strict=True):
                if lost:
                    lost = _lost(b, lost)
                    b = b"\n".join(x for i, x in enumerate(b.split(b"\n")) if i not in lost)
                out.append(b)
                keep.append(not lost or bool(b.strip()))
            columns[at] = pa.array(out, pa.binary()).cast(pa.string())
            if size_at is not None:
                columns[size_at] = pa.array([None if b is None else len(b.decode()) for b in out], columns[size_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    with_key = plain.mapInArrow(keyed, StructType([*schema.fields, StructField("match", LongType())]))
    met = with_key.join(gone, (F.col(names[id_at]) == F.col("_gk_id")) & (F.col("match") == F.col("_gk_match")), "left")
    return met.select(*names, "_gk_gone").mapInArrow(rebuilt, schema).toDF(*docs.columns)
