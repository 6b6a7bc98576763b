"""Near-duplicate documents by bottom-k sketches from one hash function.

1. Hashes of shingles that very many documents hold are found by counting; they rank after all others. Any one order
   gives whole results, this one keeps inverted lists short.
2. A document keeps the first values of its shingle set in that order: as many as two sets of similarity t must share
   one of (size - ceil(t * size) + 1). It also keeps the least hashes as a sketch. Equal sets become one class.
3. Inverted lists of kept values yield candidates in rounds. In a round every member of a list meets one centre, so a
   list of m costs m pairs, not m * m. Members that already are in one component meet no more. A last round takes the
   pairs of different components that are left in a list, so no link is lost. A value's places in two documents bound
   their overlap if it is the first that they share; pairs that cannot reach the similarity so don't meet there.
4. The sketch of the union and counts of values by cell bound the similarity; pairs that can't reach it go.
5. The rest is verified on full shingle sets, with integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, prepare, write_table
from .components import connected_components
from .shingles import WordHashes, set_key, shingle_set, texts

SKETCH = 64
#: Cells by which a set's values are counted: two sets share no more values of a cell than the smaller count.
CELL_BITS = 7
#: A value counted more often than this is common; at most MAX_COMMON of them are ranked last (8 bytes each, broadcast).
#: Values among a document's least are always counted, others where REPEATS of 2000 documents have them.
COMMON, MAX_COMMON, REPEATS = 48, 250_000, 4
#: Rounds with one centre a list; what is left after them is paired in full.
STAR_ROUNDS = 2
#: Documents of a round whose texts are picked by a broadcast of ids (8 bytes each); beyond that by a shuffled join.
BROADCAST_IDS = 100_000


def n_kept(n: int, num: int, den: int) -> int:
    return n - -(-n * num // den) + 1


def _values(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            rows = texts(batch, "text")
            for i in range(0, len(rows), 2000):
                sets = [s for t in rows[i : i + 2000] if len(s := shingle_set(t, k, words))]
                if sets:
                    v, n = np.unique(np.concatenate(sets), return_counts=True)
                    least = np.unique(np.concatenate([s[: n_kept(len(s), num, den)] for s in sets]))
                    counted = n >= REPEATS
                    counted[np.searchsorted(v, least)] = True
                    v, n = v[counted], n[counted]
                else:
                    v, n = np.empty(0, np.uint64), np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(n)], names=["v", "n"])

    return run


def _sketches(k: int, num: int, den: int, common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = WordHashes(), np.frombuffer(common.value, np.uint64)
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), texts(batch, "text")
            for i in range(0, len(rows), 500):
                sizes, keys, sketches, cells, kept, offsets = [], [], [], [], [], [0]
                for t in rows[i : i + 500]:
                    s = shingle_set(t, k, words)
                    sizes.append(len(s))
                    keys.append(set_key(s))
                    sketches.append(s[:SKETCH].tobytes())
                    cells.append(np.bincount((s >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS).astype(np.uint32).tobytes())
                    if len(s):
                        p = n_kept(len(s), num, den)
                        if len(last):
                            late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                            own = s[~late]
                            s = own if len(own) >= p else np.concatenate([own, s[late][: p - len(own)]])
                        kept.append(s[:p])
                        offsets.append(offsets[-1] + p)
                    else:
                        offsets.append(offsets[-1])
                values = np.concatenate(kept).view(np.int64) if kept else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[i : i + 500], pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()), pa.array(cells, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values)),
                    ],
                    names=["doc_id", "n", "key", "sketch", "cells", "kept"],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), texts(batch, "text")
            for i in range(0, len(rows), 500):
                sets = [shingle_set(t, k, words) for t in rows[i : i + 500]]
                columns = [pa.array(ids[i : i + 500], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "full"])

    return run


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


def _plausible(num: int, den: int):
    """The sketch of the union tells how many of its least values both sets have. Beyond its reach they share no more values
    than the smaller rest has, and in no cell more than the smaller count: a pair that goes can't be a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b", "cells_a", "cells_b", "n_a", "n_b"))
            keep = []
            for x, y, u, v, n, m in zip(*columns, strict=True):
                if (num + den) * int(np.minimum(np.frombuffer(u, np.uint32), np.frombuffer(v, np.uint32)).sum()) < num * (n + m):
                    keep.append(False)
                    continue
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                # a sketch shorter than SKETCH is its whole set; the union's least values are exact up to the shorter reach
                union = np.union1d(x, y)[:SKETCH]
                both = np.intersect1d(x, y, assume_unique=True)
                shared = int(np.searchsorted(both, union[-1], "right"))
                rest = min(n - int(np.searchsorted(x, union[-1], "right")), m - int(np.searchsorted(y, union[-1], "right")))
                keep.append((num + den) * (shared + rest) >= num * (n + m))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield kept.select(["a", "b"])

    return run


def _verified(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("full_a").to_pylist(), batch.column("full_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                inter = _overlap(x, y)
                keep.append(den * inter >= num * (len(x) + len(y) - inter))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def near_dedup(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id, kept.

    Documents whose sets of word shingles have a similarity of num/den or more are linked; component_id is the least id
    that links reach. Null and blank texts have no shingles and are linked with nothing. Rows that repeat an id are one
    document to the links; a row without an id is linked with nothing, has no component and is kept. An empty table gives
    no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    last = spark.sparkContext.broadcast(_common_values(source, words, num, den).tobytes())
    scan = write_table(
        source.mapInArrow(_sketches(words, num, den, last), "doc_id long, n long, key binary, sketch binary, cells binary, kept array<long>"), "near-scan"
    )
    linkable = scan.where("n > 0 and doc_id is not null")
    classes = write_table(
        linkable.groupBy("key").agg(F.min("doc_id").alias("rep")), "near-classes"
    )
    reps = linkable.join(classes, "key").where("doc_id = rep").dropDuplicates(["doc_id", "key"]).select("rep", "n", "key", "sketch", "cells", "kept")
    lists = _lists(reps, num, den)
    heads = write_table(reps.join(lists.select("rep").distinct(), "rep", "left_semi").select("rep", "n", "sketch", "cells"), "near-heads")
    links = _links(source, heads, lists, words, num, den)
    same = linkable.join(classes, "key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    components = connected_components(links.select("a", "b").union(same), "near")
    out = scan.select("doc_id", F.col("n").alias("n_shingles")).join(components.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _common_values(source: DataFrame, words: int, num: int, den: int) -> np.ndarray:
    """The values in most sketches, MAX_COMMON at most: the counts' histogram by powers of two tells where to cut."""
    counts = source.select("text").mapInArrow(_values(words, num, den), "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))
    counts = write_table(counts.where(f"n > {COMMON}").withColumn("power", F.floor(F.log2(F.col("n").cast("double"))).cast("int")), "near-common")
    room, least = MAX_COMMON, 64
    for power, n in sorted(((r.power, r["count"]) for r in counts.groupBy("power").count().collect()), reverse=True):
        if n > room:
            break
        room, least = room - n, power
    out = np.array([r.v for r in counts.where(f"power >= {least}").select("v").toLocalIterator()], np.int64)
    drop_table(counts)
    return np.sort(out.view(np.uint64))


def _lists(reps: DataFrame, num: int, den: int) -> DataFrame:
    """v, class, rep, n, rest: kept values that more than one document has. class: sizes within a factor t, by logarithm.
    rest: how many values of the document stand at or after v in the order."""
    size = F.floor(F.log(F.col("n").cast("double")) / (math.log(den / num) * 1.0001))
    postings = reps.select(F.posexplode("kept").alias("at", "v"), size.cast("int").alias("class"), "rep", "n")
    postings = write_table(postings.select("v", "class", "rep", "n", (F.col("n") - F.col("at")).alias("rest")), "near-postings")
    shared = postings.groupBy("v").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("v")
    lists = write_table(postings.join(shared, "v", "left_semi"), "near-lists")
    drop_table(postings)
    return lists


def _links(source: DataFrame, heads: DataFrame, lists: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """a, b: verified links that join all that any links would join."""
    found, tried, label = None, None, None
    for turn in range(STAR_ROUNDS + 1):
        if turn:
            if found.limit(1).count() == 0:
                label = lists.select("rep").distinct().withColumn("component", F.col("rep"))
            else:
                label = connected_components(found, "near-round").withColumnRenamed("id", "rep")
            marked = lists.join(label, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
            mixed = marked.groupBy("v").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("v")
            open_lists = write_table(marked.join(mixed, "v", "left_semi"), "near-open")
            drop_table(lists)
            lists = open_lists.drop("component")
            lists.scratch_path = open_lists.scratch_path
        else:
            open_lists = lists.withColumn("component", F.col("rep"))
        pairs = _star_pairs(open_lists, turn, num, den) if turn < STAR_ROUNDS else _rest_pairs(open_lists, num, den)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = write_table(pairs, "near-pairs")
        n_pairs = pairs.count()
        if not n_pairs and turn:
            if turn < STAR_ROUNDS:  # the centres met nobody new; pairs that met no centre are left to the last round
                continue
            break
        tried = pairs if tried is None else tried.union(pairs)
        good = _verify(source, heads, pairs, words, num, den)
        found = good if found is None else found.union(good)
    return found


def _star_pairs(lists: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """Pairs of a member and its list's centre, of the same size class or the one below; a turn's centre is another one.

    Centres are the least members by a hash of the turn after the first, so that later turns reach other members.
    """
    rank = F.col("rep") if turn == 0 else F.xxhash64("rep", F.lit(turn))
    centres = lists.groupBy("v", "class").agg(F.min(F.struct(rank.alias("rank"), "rep", "n", "rest", "component")).alias("c")).select("v", "class", "c.*")
    reach = centres.select("v", F.explode(F.array("class", F.col("class") + 1)).alias("class"), F.col("rep").alias("c_rep"), F.col("n").alias("c_n"), F.col("rest").alias("c_rest"), F.col("component").alias("c_component"))
    near = lists.join(reach, ["v", "class"]).where(
        f"rep <> c_rep and component <> c_component and {num + den} * least(rest, c_rest) >= {num} * (n + c_n)"
    )
    return near.select(F.least("rep", "c_rep").alias("a"), F.greatest("rep", "c_rep").alias("b")).distinct()


def _rest_pairs(lists: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of members of one list that are in different components still."""
    x = lists.alias("x")
    y = lists.select("v", F.explode(F.array("class", F.col("class") + 1)).alias("class"), "rep", "n", "rest", "component").alias("y")
    near = x.join(y, ["v", "class"]).where(
        f"x.rep <> y.rep and x.component <> y.component and {num + den} * least(x.rest, y.rest) >= {num} * (x.n + y.n)"
    )
    return near.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def _verify(source: DataFrame, heads: DataFrame, pairs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    side = lambda s: heads.select(F.col("rep").alias(s), F.col("sketch").alias(f"sketch_{s}"), F.col("cells").alias(f"cells_{s}"), F.col("n").alias(f"n_{s}"))
    likely = write_table(
        pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_plausible(num, den), "a long, b long").distinct(), "near-likely"
    )
    ids = likely.select(F.col("a").alias("doc_id")).union(likely.select(F.col("b").alias("doc_id"))).distinct()
    ids = write_table(ids, "near-ids")
    picked = source.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge"), "doc_id", "left_semi")
    full = write_table(picked.mapInArrow(_sets(words), "doc_id long, key binary, full binary").dropDuplicates(["doc_id", "key"]), "near-sets")
    side = lambda s: full.select(F.col("doc_id").alias(s), F.col("full").alias(f"full_{s}")).hint("merge")
    good = likely.join(side("a"), "a").join(side("b"), "b").mapInArrow(_verified(num, den), "a long, b long")
    good = write_table(good.distinct(), "near-verified")
    drop_table(full, ids, likely)
    return good
