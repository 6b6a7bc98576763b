"""Deduplication operators against brute force."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import grovekit.llm.substring_dedup as substring_dedup_module
from grovekit.llm.exact_dedup import DigestIndex, exact_dedup
from grovekit.llm.line_dedup import delete_repeated_lines, line_dedup, patience
from grovekit.llm.near_dedup import near_dedup
from grovekit.llm.queries import ORACLES
from grovekit.llm.shingles import WordHashes, shingle_set
from grovekit.llm.substring_dedup import WINDOW, substring_dedup
from grovekit.llm.suffix_array import common_prefixes, suffix_array

SCHEMA = "doc_id bigint, text string, kept int, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, "x") for i, t in rows], SCHEMA)


def corpus(seed, n=60, words=400):
    """Prose of few words, with exact and near copies, shared passages, long repeats, nulls and blanks."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeéß", k=r.randint(2, 7))) for _ in range(words)]
    prose = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage, out = prose(45), []
    for i in range(n):
        kind = r.random()
        if kind < 0.2 and out:
            text = r.choice(out)
        elif kind < 0.5 and out:
            w = (r.choice(out) or "").split(" ")
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            text = " ".join(w)
        else:
            w = prose(r.choice((0, 1, 2, 30, 80, 160)))
            if r.random() < 0.4:
                k = r.randint(0, len(w))
                w[k:k] = passage
            text = " ".join(w)
        out.append(text)
    out += [None, "", "  \n ", "aB " * 200, "x" * 900, "x" * 450]
    return list(enumerate(out))


def test_exact(spark):
    rows = corpus(1) + [(500, "Abc É"), (501, "aBC É"), (502, "abc é"), (None, "abc é"), (503, None)]
    got = exact_dedup(frame(spark, rows)).toPandas()
    groups = {}
    lower = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    want = sorted((i if i is not None else -1, max(x for x in g if x is not None), len(g), i is not None and i == max(x for x in g if x is not None), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert sorted(map(tuple, got.fillna(-1).astype({"doc_id": "int64", "keep_id": "int64"}).itertuples(index=False))) == want
    same = exact_dedup(frame(spark, [(1, "a"), (1, "a"), (0, "a")])).collect()
    assert sorted(r.kept for r in same) == [False, False, True] and {r.group_size for r in same} == {3}
    assert exact_dedup(frame(spark, [])).count() == 0


def test_exact_index_across_batches(spark):
    index = DigestIndex(spark, buckets=3)
    first = index.append(frame(spark, [(1, "a"), (2, "b"), (3, "A")])).collect()
    second = index.append(frame(spark, [(9, "a"), (8, "c"), (7, "c")])).collect()
    third = index.append(frame(spark, [(4, "c")])).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in first} == {(1, 3, False), (2, 2, True), (3, 3, True)}
    assert {(r.doc_id, r.keep_id, r.kept, r.group_size) for r in second} == {(9, 3, False, 3), (8, 8, True, 2), (7, 8, False, 2)}
    assert [(r.keep_id, r.kept) for r in third] == [(8, False)]
    assert spark.table(index.name).count() == 3


def test_exact_index_counts_and_retries(spark):
    index = DigestIndex(spark, "digests_of_a_test", buckets=2)
    try:
        rows = lambda *ids: frame(spark, [(i, "A" if i % 2 else "a") for i in ids])
        sizes = []
        for batch in ((1, 2), (3, 4), (5,)):
            sizes.append({x.group_size for x in index.append(rows(*batch)).collect()})
        assert sizes == [{2}, {4}, {5}]
        first = index.append(rows(5)).collect()  # the caller failed and tries again
        assert [(x.doc_id, x.keep_id, x.group_size, x.kept) for x in first] == [(5, 2, 5, False)]
        fresh = frame(spark, [(9, "new"), (8, "NEW"), (7, "a")])
        batch = index.dedup(fresh)  # nothing changes before the commit
        want = {(9, 9, 2, True), (8, 9, 2, False), (7, 2, 6, False)}
        as_rows = lambda df: {(x.doc_id, x.keep_id, x.group_size, x.kept) for x in df.collect()}
        assert as_rows(batch.rows) == want == as_rows(index.append(fresh)) == as_rows(index.append(fresh))
        batch.commit()
        spark.sql("drop table digests_of_a_test")  # another session, which knows the folder only
        spark.sql("drop table digests_of_a_test_again")
        index = DigestIndex(spark, "digests_of_a_test", buckets=7)
        assert index.buckets == 2 and index.table().count() == 2
        assert as_rows(index.append(fresh)) == want
        assert as_rows(exact_dedup(fresh, "digests_of_a_test")) == {(9, 9, 2, True), (8, 9, 2, False), (7, 7, 1, True)}
    finally:
        index.drop()


def test_exact_oracle(spark):
    documents = frame(spark, corpus(4)).toPandas()  # noqa: F841
    want = duckdb.sql(ORACLES["op10_exact_dedup"]).df().sort_values("doc_id")
    got = exact_dedup(spark.createDataFrame(documents)).toPandas().sort_values("doc_id")
    assert got[sorted(got.columns)].values.tolist() == want[sorted(want.columns)].values.tolist()


def shingles(t, k):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize("k, num", [(3, 85), (5, 80)])
def test_near(spark, k, num):
    rows = corpus(2, 90)
    got = {r.doc_id: r for r in near_dedup(frame(spark, rows + [(None, "a b c d")]), k, num, 100).collect()}
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for a in sets:
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * inter >= num * (len(sets[a]) + len(sets[b]) - inter):
                links += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert links > 20
    assert {i: (len(s), find(i), find(i) == i) for i, s in sets.items()} == {i: (got[i].n_shingles, got[i].component_id, got[i].kept) for i in sets}
    assert (got[None].component_id, got[None].kept) == (None, True)
    if k == 3:
        assert near_dedup(frame(spark, [])).count() == 0
        twice = near_dedup(frame(spark, [(1, "a b c d"), (1, "a b c d"), (0, "q r s t u")])).collect()
        assert sorted((r.doc_id, r.component_id) for r in twice) == [(0, 0), (1, 1), (1, 1)]


def test_near_links_that_meet_no_centre(spark):
    """a~b~c but not a~c, with a the centre of all their lists in both star rounds: b-c is left to the last round."""
    ids = [r.i for r in spark.range(1, 40).selectExpr("id i", "xxhash64(id, 1) h").orderBy("h").collect()]
    a = next(i for i in ids if i < 30)
    later = [i for i in ids[ids.index(a) + 1 :] if i > a][:2]
    r = random.Random(4)
    for _ in range(1000):
        w = [f"w{r.randint(0, 10**6)}" for _ in range(20)]
        rows = [(a, w), (later[0], [*w[:-1], "x"]), (later[1], ["y", *w[1:-1], "x"])]
        sets = [shingle_set(" ".join(x).encode(), 3, WordHashes()) for _, x in rows]
        if len({s[:3].tobytes() for s in sets}) == 1:
            break
    got = near_dedup(frame(spark, [(i, " ".join(x)) for i, x in rows]), 3, 85, 100).collect()
    assert {r.component_id for r in got} == {a}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=50), st.booleans())
def test_suffix_array(symbols, wide):
    s = [*symbols, 0]
    if wide:
        s = [x * 400 for x in s]
    sa = suffix_array(np.array(s), max(s) + 1)
    assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    lcp = common_prefixes(np.array(s), sa)
    for r in range(1, len(s)):
        a, b = s[sa[r] :], s[sa[r - 1] :]
        assert lcp[r] == next(i for i in range(len(s)) if i >= min(len(a), len(b)) or a[i] != b[i])


def removed(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda x: (x[0] is None, x[0])):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - WINDOW + 1):
            w = b[p : p + WINDOW]
            if w in seen:
                gone[p : p + WINDOW] = True
            seen.add(w)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_substrings(spark, monkeypatch):
    rows = corpus(3, 80, 25) + [(None, "x" * 500), (900, "y" * 300), (901, "y" * 299 + "z"), (902, "ab" * 200)]
    got = substring_dedup(frame(spark, rows).repartition(5)).collect()
    want = removed(rows)
    assert sum(v[1] for v in want.values()) > 3000
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert all(hashlib.sha256(r.kept_bytes).hexdigest() == r.kept_sha256 for r in got)
    monkeypatch.setattr(substring_dedup_module, "HOT", 3)
    again = substring_dedup(frame(spark, rows).repartition(3)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in again} == want
    assert substring_dedup(frame(spark, [])).count() == 0
    twice = substring_dedup(frame(spark, [(1, "abc" * 50), (1, "abc" * 50), (2, "abc" * 50)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in twice) == [(1, 147), (1, 147), (2, 150)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=30), st.lists(st.integers(0, 6), max_size=30))
def test_patience_aligns_equal_items_in_order(a, b):
    pairs = patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
    assert patience(a, a) == [(i, i) for i in range(len(a))]


def test_lines(spark):
    line = lambda k: f"this is the informative line number {k} of all"
    body = lambda *k: "\n".join(line(x) for x in k)
    rows = [
        (1, body(1, 2, 3)),
        (2, body(9, 2, 3) + "\n" + body(10)),  # a block of two
        (3, "short\n" + body(1)),
        (4, body(1, 2, 3)),  # a copy
        (5, "short\nother"),  # short lines alone hold nothing up
        (6, body(3, 1)),  # crossed: the longest chain has one line
        (7, None),
        (8, ""),
        (9, body(20, 20)),  # not unique within
        (None, body(1)),
    ]
    got = {r.doc_id: (r.n_lines, list(r.removed), r.kept_text) for r in line_dedup(frame(spark, rows)).collect()}
    assert got[1] == (3, [], body(1, 2, 3)) and got[2] == (4, [1, 2], body(9, 10)) and got[3] == (2, [1], "short")
    assert got[4] == (3, [0, 1, 2], "") and got[5][1] == [] and len(got[6][1]) == 1 and got[7] == (0, [], "") and got[9][1] == [] and got[None][1] == []
    kept = delete_repeated_lines(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "kept", "key"]
    left = {r.doc_id: r.text for r in kept.collect()}
    assert 4 not in left and left[2] == body(9, 10) and left[7] is None and left[8] == ""
    assert line_dedup(frame(spark, [])).count() == 0


def test_lines_keep_an_earliest_copy(spark):
    r = random.Random(8)
    rows = [(i, "\n".join(f"informative line {r.randint(0, 60)} with some more words" for _ in range(r.randint(1, 9)))) for i in range(120)]
    got = {x.doc_id: x.kept_text for x in line_dedup(frame(spark, rows)).collect()}
    first = {}
    for i, t in rows:
        for x in t.split("\n"):
            first.setdefault(x, i)
    assert all(x in got[i].split("\n") for x, i in first.items())
    assert sum(map(len, got.values())) < sum(len(t) for _, t in rows) / 2


def test_lines_pair_copies_of_a_crossed_document(spark):
    line = lambda k: f"this is the informative line number {k} of all"
    rows = [(1, f"{line(1)}\n{line(2)}"), (2, f"{line(2)}\n{line(1)}"), (3, f"{line(2)}\n{line(1)}"), (4, f"{line(8)}\n{line(2)}\n{line(1)}\n{line(9)}")]
    got = {r.doc_id: list(r.removed) for r in line_dedup(frame(spark, rows)).collect()}
    assert got[1] == [] and len(got[2]) == 1 and got[3] == [0, 1] and got[4] == [1, 2]


def test_lines_short_or_repeated(spark):
    line = lambda k: f"this is the informative line number {k} of all"
    verse = "one two three\nfour five six\n\nseven eight"
    rows = [
        (1, f"{verse}\nend of one"),
        (2, f"before it\n{verse}\nand after"),  # a block of short lines
        (3, "before it\nother\nfour five six"),  # short lines apart
        (4, f"{line(1)}\n{line(2)}"),
        (5, f"{line(1)}\n{line(2)}\n{line(3)}\n{line(1)}\n{line(2)}"),  # a passage twice
        (6, f"{line(4)}\n{line(5)}\n{line(4)}"),
        (7, f"{line(4)}\n{line(6)}"),  # twice in the earlier one
    ]
    got = {r.doc_id: list(r.removed) for r in line_dedup(frame(spark, rows)).collect()}
    assert got == {1: [], 2: [1, 2, 4], 3: [], 4: [], 5: [0, 1, 3, 4], 6: [], 7: [0]}
