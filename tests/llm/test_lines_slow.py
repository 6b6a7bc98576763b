"""Line dedup against a slow version that compares all pairs of documents, line text by line text."""

import random
from collections import Counter

import pytest

from grovekit.llm.line_dedup import MIN_CHARS, RARE, delete_repeated_lines, line_dedup, patience


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, removed int")


def items(seq):
    """Informative lines, and runs of lines, through which a document pairs; seq has (place, text) of shared lines."""
    long = lambda x: len(x) >= MIN_CHARS
    texts = [x for _, x in seq]
    lines, runs = {x for x in texts if long(x)}, set()
    for i in range(len(seq)):
        for j in range(i, len(seq)):
            apart = seq[j][0] - seq[i][0] == j - i
            total = lambda a, b: sum(map(len, texts[a : b + 1]))
            if j > i and apart and total(i, j) >= MIN_CHARS and (total(i, j - 1) < MIN_CHARS or total(i + 1, j) < MIN_CHARS):
                # a least run from its first line on, or up to its last line; lines that are long alone start none
                if not long(texts[i]) and total(i, j - 1) < MIN_CHARS or not long(texts[j]) and total(i + 1, j) < MIN_CHARS:
                    runs.add(tuple(texts[i : j + 1]))
            if j == i + 1 and (long(texts[i]) or long(texts[j])):
                runs.add((texts[i], texts[j]))
    if len(seq) > 2:
        runs.add(tuple(texts))
    return lines, runs


def slow(rows):
    docs = {i: [(n, x.strip()) for n, x in enumerate(t.split("\n")) if x.strip()] for i, t in rows if i is not None and t}
    gone = {i: set() for i in docs}
    first, copies = {}, Counter()
    for i in sorted(docs):
        copies[first.setdefault(tuple(x for _, x in docs[i]), i)] += 1
    for lines, f in first.items():
        for i in docs:
            if i != f and tuple(x for _, x in docs[i]) == lines and sum(map(len, lines)) >= MIN_CHARS:
                gone[i] = {n for n, _ in docs[i]}
    reps = sorted(first.values())
    holders = {}
    for i in reps:
        for x in {x for _, x in docs[i]}:
            holders.setdefault(x, []).append(i)
    seq = {i: [(k, x) for k, (_, x) in enumerate(docs[i]) if len(holders[x]) > 1] for i in reps}
    found = {i: items(seq[i]) for i in reps}
    earliest, count = {}, {}
    for i in reps:
        for kind in (0, 1):
            for x in found[i][kind]:
                earliest.setdefault((kind, x), i)
                count[kind, x] = count.get((kind, x), 0) + copies[i]
    for i in reps:
        for j in reps:
            shared = [(kind, x) for kind in (0, 1) for x in found[i][kind] & found[j][kind]]
            if j < i and any(earliest[x] == j or x[0] == 0 and count[x] <= RARE for x in shared):
                mine, theirs = seq[i], seq[j]
                blocks, last = [], None
                for a, b in patience([x for _, x in mine], [x for _, x in theirs]):
                    if last is None or (mine[a][0], theirs[b][0]) != (last[0] + 1, last[1] + 1):
                        blocks.append([])
                    blocks[-1].append(a)
                    last = (mine[a][0], theirs[b][0])
                blocks = [x for x in blocks if sum(len(mine[k][1]) for k in x) >= MIN_CHARS]
                lost = {k for x in blocks for k in x}
                follow = {(mine[x[k]][1], mine[x[k + 1]][1]) for x in blocks for k in range(len(x) - 1)}
                known = {mine[k][1] for k in lost}
                copies, copy = [], []
                for k, (place, x) in enumerate(mine):
                    ok = x in known and k not in lost
                    if copy and not (ok and mine[k - 1][0] == place - 1 and copy[-1] == k - 1 and (mine[k - 1][1], x) in follow):
                        copies.append(copy)
                        copy = []
                    if ok:
                        copy.append(k)
                copies.append(copy)
                lost |= {k for c in copies if sum(len(mine[k][1]) for k in c) >= MIN_CHARS for k in c}
                gone[i] |= {docs[i][mine[k][0]][0] for k in lost}
    return {i: sorted(gone.get(i, ())) for i, _ in rows}


@pytest.mark.parametrize("seed, lines, docs", [(1, 40, 80), (2, 14, 60), (3, 200, 80)])
def test_lines_against_the_slow_version(spark, seed, lines, docs):
    r = random.Random(seed)
    pool = [f"{k} " + "é" * r.choice((1, 4, 8, 12, 22, 30, 60)) for k in range(lines)]
    rows, blocks = [], []
    for i in range(docs):
        body = [r.choice(pool) if r.random() < 0.6 else f"own line {i} {k} {'x' * r.choice((1, 30))}" for k in range(r.randint(1, 9))]
        if blocks and r.random() < 0.5:
            at = r.randint(0, len(body))
            body[at:at] = r.choice(blocks)
        if r.random() < 0.4:
            blocks.append(body[: r.randint(1, 6)])
        if rows and r.random() < 0.15:
            body = rows[-1][1].split("\n")
        for _ in range(r.choice((0, 0, 1))):
            body.insert(r.randint(0, len(body)), "")
        rows.append((i, "\n".join(body)))
    want = slow(rows)
    got = {x.doc_id: list(x.removed) for x in line_dedup(frame(spark, rows)).collect()}
    assert got == want
    assert sum(map(len, want.values())) > 40 and any(len(holders) for holders in want.values())


def test_blocks_are_contiguous(spark):
    own = lambda d, k: f"the line number {k} that only document {d} has"
    shared = "a line of some length that two documents share"
    rows = [(i, "\n".join(["short", *(own(i, k) for k in range(5)), shared])) for i in (1, 2)]
    rows += [(3, f"{shared} x\n{shared} x"), (4, f"{shared} x\n{shared} x")]
    got = {x.doc_id: list(x.removed) for x in line_dedup(frame(spark, rows)).collect()}
    assert got == {1: [], 2: [6], 3: [], 4: [0, 1]}


def test_long_texts_and_odd_columns(spark):
    big = "\n".join(f"line {k % 50_000} of a very long text" for k in range(60_000))
    rows = [(1, big, 1), (2, big + "\nand its end", 2), (3, "x" * 2_000_000, 3), (3, "x" * 2_000_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `my col` int").withColumn("gone", docs_col()).withColumnRenamed("gone", "a.b")
    got = delete_repeated_lines(docs)
    assert got.columns == docs.columns
    left = {(x.doc_id, x["my col"]): x.text for x in got.collect()}
    assert left[1, 1] == big and left[2, 2] == "and its end" and left[3, 3] == rows[2][1]


def docs_col():
    from pyspark.sql import functions as F

    return F.lit("gone")
