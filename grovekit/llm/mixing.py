"""Temperature mixing of sources: budgeted block permutations.

A source's weight is its token share to the power of an exponent, normalised. The exponent is bisected so that the weights'
entropy meets a target, and moved towards 1 until no source repeats beyond a limit. A source's budget is then filled by
permutations of its documents, epoch after epoch: blocks in an order drawn anew in each epoch, the documents of a block
likewise.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_table, write_table

@dataclass(frozen=True)
class Mix:
    """entropy_share: the entropy aimed at, as a share of the sources' greatest. max_epochs: how often a source may
    repeat. budget: tokens of the result (None: as many as there are). block_tokens: tokens of a block, about."""

    entropy_share: float = 0.9
    max_epochs: float = 4.0
    budget: int | None = None
    block_tokens: int = 500_000
    seed: int = 17


def weights_at(tokens: dict, exponent: float) -> dict:
    total = sum(tokens.values())
    raw = {s: (t / total) ** exponent if t else 0.0 for s, t in tokens.items()}
    norm = sum(raw.values())
    return {s: x / norm for s, x in raw.items()}


def entropy(w: dict) -> float:
    return -sum(x * np.log(x) for x in w.values() if x > 0)


#: Exponents that are tried at once, and how often the stretch between two of them is searched again.
GRID, TURNS = 256, 4
GREATEST = 1024.0


def solve(measure: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], n: int, mix: Mix, budget: float, total: float) -> float:
    """The exponent at which the entropy of n sources is entropy_share of the greatest, moved towards 1 as far as the limit
    of repetitions asks. measure(exponents) gives their entropies and greatest weights per token share.

    Entropy falls with a growing exponent; the greatest repetition is least at 1 and grows on either side. An aim below
    what any exponent reaches (equal sources) leaves the exponent at 1.
    """
    aim, most = mix.entropy_share * np.log(n), mix.max_epochs * total / budget
    if most < 1 - 1e-12:
        raise ValueError(f"a budget of {budget} tokens repeats {total} tokens more than {mix.max_epochs} times")

    def last(low: float, high: float, holds, exponent=lambda x: x) -> float:
        """The last x from low on at which holds(entropies, weights) is true of its exponent; it is at low, and false from
        some x on."""
        for _ in range(TURNS):
            x = np.linspace(low, high, GRID)
            k = int(np.argmin(np.append(holds(*measure(exponent(x)))[1:], False)))
            low, high = x[k], x[min(k + 1, GRID - 1)]
        return float(low)

    h = measure(np.array([0.0, 1.0, GREATEST]))[0]
    if h[0] < aim or h[2] >= aim - 1e-9:
        exponent = 0.0 if h[0] < aim else 1.0
    else:
        ladder = 2.0 ** np.arange(11)
        high = float(ladder[np.argmax(measure(ladder)[0] < aim)])
        exponent = last(0.0, high, lambda e, _: e >= aim)
    if measure(np.array([exponent]))[1][0] > most:
        # from 1 towards the exponent, as far as the limit holds
        side = exponent - 1
        exponent = 1 + side * last(0.0, 1.0, lambda _, r: r <= most * (1 + 1e-12), lambda x: 1 + side * x)
    return exponent


def solve_exponent(tokens: dict, mix: Mix) -> float:
    """solve() for token counts by source."""
    t = np.array([x for x in tokens.values() if x], float)
    share = np.log(t / t.sum())

    def measure(a):
        raw = np.exp(np.outer(a, share) - (a * share.max())[:, None])
        w = raw / raw.sum(1, keepdims=True)
        return -(w * np.log(np.maximum(w, 1e-300))).sum(1), (w / np.exp(share)).max(1)

    return solve(measure, len(t), mix, mix.budget if mix.budget is not None else t.sum(), t.sum())


def _source_exponent(sources: DataFrame, n: int, total: int, mix: Mix, budget: float) -> tuple[float, float]:
    """The exponent, and the logarithm of the sum of token shares to its power. sources has a row a source and may be long:
    only sums over all of them, one for each exponent that is tried, come to the driver."""
    share = F.log(F.col("total") / float(total))
    top = sources.agg(F.max(share)).first()[0]

    def sums(a: np.ndarray):
        # relative to the largest source, so that no power overflows
        logs = F.transform(F.expr(f"array({', '.join(f'{x!r}D' for x in a.tolist())})"), lambda x: x * (F.col("s") - top))
        each = sources.select(share.alias("s")).select("s", F.posexplode(logs).alias("k", "log"))
        rows = each.groupBy("k").agg(F.sum(F.exp("log")).alias("z"), F.sum(F.exp("log") * F.col("log")).alias("m"), F.max(F.col("log") - F.col("s")).alias("r")).orderBy("k").collect()
        return (np.array([row[c] for row in rows]) for c in ("z", "m", "r"))

    def measure(a: np.ndarray):
        z, m, r = sums(a)
        return np.log(z) - m / z, np.exp(r) / z

    exponent = solve(measure, n, mix, budget, total)
    z, _, _ = sums(np.array([exponent]))
    return exponent, float(np.log(z[0]) + exponent * top)


#: Sources that a broadcast may hold (about 100 bytes each); beyond that a merge join takes its place.
BROADCAST_SOURCES = 100_000
#: Blocks of a source that are put in order together; the parts of an order are then shifted by the sums of those before.
PART = 4096


def _key(text: str):
    """Tells texts apart: a digest, null for a missing text's own."""
    return F.coalesce(F.md5(F.col(f"`{text}`").cast("string").cast("binary")), F.lit("none"))


def mix_sources(docs: DataFrame, mix: Mix | None = None, text: str = "text", doc_id: str = "doc_id", source: str = "source", with_key: bool = False) -> DataFrame:
    """One row for each time that a document is taken: doc_id, source, epoch, block, n_tokens, place.

    Tokens are words between white space. place in [0, 1) orders the whole mix with all sources spread evenly. A source
    gets its budget to within one document. Null sources are one source, null and blank texts have no tokens and are not
    taken, null ids stay null. Rows that repeat count as rows. An empty table gives no rows. Other columns are not read.
    """
    mix = mix or Mix()
    body = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[\\s]+", " "))
    tokens = F.when(body == "", F.lit(0)).otherwise(F.length(body) - F.length(F.translate(body, " ", "")) + 1)
    slim = write_table(
        docs.select(
            F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), tokens.cast("bigint").alias("tokens"),
            _key(text).alias("key"),
        ), "mix-docs",
    )
    sources = write_table(slim.where("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("total")), "mix-sources")
    n, total = sources.agg(F.count("*"), F.sum("total")).first()
    if not n:
        empty = "doc_id bigint, source string, epoch int, block bigint, n_tokens bigint, place double" + (", key string" if with_key else "")
        return docs.sparkSession.createDataFrame([], empty)
    budget = mix.budget if mix.budget is not None else total
    exponent, norm = _source_exponent(sources, n, total, mix, float(budget))
    quota = F.exp(exponent * F.log(F.col("total") / float(total)) - norm) * float(budget)
    sources = sources.withColumn("quota", quota).select(
        F.col("source").alias("of"), "total", "quota", F.ceil(F.col("quota") / F.col("total") - 1e-9).cast("int").alias("epochs"),
        F.greatest(F.lit(1), F.round(F.col("total") / mix.block_tokens)).cast("bigint").alias("blocks"),
    )
    side = F.broadcast(sources) if n <= BROADCAST_SOURCES else sources.hint("merge")
    seed = F.lit(mix.seed)
    rows = slim.where("tokens > 0").join(side, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "tokens", "key", "total", "quota", "epochs", "blocks", F.pmod(F.xxhash64("key", seed), F.col("blocks")).alias("block")
    )
    blocks = rows.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"), *(F.first(c).alias(c) for c in ("total", "quota", "epochs", "blocks")))
    blocks = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1))).withColumn("draw", F.xxhash64("block", "epoch", seed))
    # the order by draw, in parts: a part's start is the sum of the parts before it
    part = F.floor((F.shiftright("draw", 33) + (1 << 30)) * F.ceil(F.col("blocks") / PART) / float(1 << 31)).cast("bigint")
    blocks = write_table(blocks.withColumn("part", part), "mix-ordered")
    parts = blocks.groupBy("source", "epoch", "part").agg(F.sum("block_tokens").alias("part_tokens"))
    upto = (W.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("part_tokens").over(W.partitionBy("source", "epoch").orderBy("part").rowsBetween(*upto)), F.lit(0)))
    turn = W.partitionBy("source", "epoch", "part").orderBy("draw", "block").rowsBetween(*upto)
    begun = blocks.withColumn("inside", F.coalesce(F.sum("block_tokens").over(turn), F.lit(0))).alias("b").join(
        parts.alias("p"), F.expr("b.source <=> p.source and b.epoch = p.epoch and b.part = p.part")
    ).select("b.*", (F.col("b.epoch") * F.col("total") + F.col("before") + F.col("inside")).alias("start"))
    begun = write_table(begun.where("start < quota").select("source", "block", "epoch", "start", "quota"), "mix-blocks")
    drop_table(blocks)
    taken = (
        rows.select("doc_id", "source", "tokens", "key", "block").alias("r")
        .join(begun.alias("b"), F.expr("r.source <=> b.source and r.block = b.block"))
        .select("doc_id", "r.source", "epoch", "r.block", "tokens", "key", "start", "quota")
    )
    within = W.partitionBy("source", "block", "epoch").orderBy(F.xxhash64("key", "epoch", seed), "key", "doc_id").rowsBetween(*upto)
    placed = taken.withColumn("at", F.col("start") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    columns = ["doc_id", "source", "epoch", "block", F.col("tokens").alias("n_tokens"), (F.col("at") / F.col("quota")).alias("place")]
    return placed.where("at < quota").select(*columns, *(["key"] if with_key else []))


def mixed_texts(docs: DataFrame, mix: Mix | None = None, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix with its documents: all columns of docs (but for its id and source), then those of mix_sources(), a row for
    each time that a document is taken. Columns of docs that clash with the mix's own are named doc_<name>. One of the rows
    that repeat id and text stands for all of them. The cases are those of mix_sources()."""
    taken = mix_sources(docs, mix, text, doc_id, source, with_key=True)
    own = [c for c in taken.columns if c != "key"]
    others, named = [c for c in docs.columns if c not in (doc_id, source)], set(own)
    aliases = []
    for c in others:
        name = c
        while name in named:
            name = f"doc_{name}"
        named.add(name)
        aliases.append(name)
    bodies = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("_gk_id"), _key(text).alias("_gk_key"), *(F.col(f"`{c}`").alias(a) for c, a in zip(others, aliases, strict=True)))
    bodies = bodies.dropDuplicates(["_gk_id", "_gk_key"])
    met = taken.join(bodies, taken["doc_id"].eqNullSafe(F.col("_gk_id")) & (taken["key"] == F.col("_gk_key")))
    return met.select(*(taken[c] for c in own), *(F.col(f"`{a}`") for a in aliases))
