"""Personal data by bootstrapped contextual extraction, on DataFrame functions only.

Seeds are the base spans (email, ip, card, phone). The words before a seed form a lexical pattern, and so do the words after it.
Patterns and the identifier-like tokens beside them make a graph; rounds of scoring move trust from known tokens to patterns
and from trusted patterns to unseen tokens, until nothing changes. Those tokens are reported as kind id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NO_SPANS, drop_table, find_spans, joined, sha_hex, tagged, write_table

# The base patterns, over texts in which inner() has marked the separators.
MARK, OTHER = "\u0001", "\u0002"
EMAIL = f"(?:\\G|(?<![A-Za-z0-9._%+\\-{MARK}]))[A-Za-z0-9._%+\\-{MARK}]++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9\\-{MARK}]++"
IP = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = f"[0-9][0-9{MARK}]{{11,}}+"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"

#: An identifier-like token: five or more letters, digits and joiners, at least four of them digits.
CANDIDATE = "(?<![^\\s\"'(\\[<:=#])(?=[A-Za-z._/-]*+[0-9])[A-Za-z0-9][A-Za-z0-9._/-]{4,}+"

#: Lexical patterns: the two words that end right before a token, and the two that begin right after it. Words are whole
#: runs of letters, however long; what stands between them doesn't count.
WORD = "[\\p{L}#]++"
LEFT = f"(?<![\\p{{L}}#])({WORD}[\\x20:=]{{1,3}}{WORD})[\\x20:=.#(\"']{{1,4}}$"
RIGHT = f"^[\\x20,;:)\"'-]{{1,4}}({WORD}[\\x20:=]{{1,3}}{WORD})"

#: A pattern needs this many distinct trusted tokens, this mean trust of all distinct tokens beside it, and has to stand
#: beside a token in this share of its occurrences in all texts: word pairs of plain prose don't.
MIN_SUPPORT, MIN_CONFIDENCE, MIN_SHARE = 3, 0.6, 0.1
#: Patterns that a broadcast may hold (about 30 bytes each); beyond that a merge join takes its place.
BROADCAST_PATTERNS = 200_000
#: One text in so many is looked at first for patterns that occur too often; the result doesn't depend on it.
PART = 64

NOTHING = "cast(array() as array<struct<s:int,k:int,e:int,kind:string>>)"


def contexts(before: Column, after: Column) -> tuple[Column, Column]:
    """Patterns on either side of a token, lower-cased, empty where there aren't two words; before and after reach to the
    neighbouring tokens of the kind."""
    pair = lambda c, pattern: F.regexp_replace(F.lower(F.regexp_extract(c, pattern, 1)), "[\\x20:=]+", " ")
    return pair(before, LEFT).alias("left"), pair(after, RIGHT).alias("right")


SIDES = ",left:string,right:string"


def inner(text: Column, before: str, separators: str, after: str) -> Column:
    """Marks each separator that stands between the two classes; offsets stay as they are.

    A run of such separators and class characters is then one class in a pattern, which needs no repeated group; those
    overflow the matcher's stack on long runs.
    """
    clean = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, OTHER)).otherwise(text)
    return F.regexp_replace(clean, f"(?<={before}){separators}(?={after})", MARK)


def luhn(t: Column) -> Column:
    digits = F.regexp_replace(t, "[^0-9]", "")
    n = F.length(digits)

    def add(acc, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return n.between(12, 19) & (F.aggregate(F.sequence(F.lit(0), F.least(n, F.lit(19)) - 1), F.lit(0), add) % 10 == 0)


def low_octets(t: Column) -> Column:
    def low(p):
        z = F.regexp_replace(p, "^0+", "")
        return (F.length(z) <= 3) & (F.concat(F.lit("0"), F.substring(z, F.lit(1), F.lit(3))).cast("int") <= 255)

    return F.forall(F.split(t, "\\."), low)


def base_columns(text: Column) -> dict[str, Column]:
    """Base spans with the patterns beside them."""
    when = lambda test, spans: F.when(test, spans).otherwise(NO_SPANS(SIDES))
    find = lambda t, pattern: find_spans(t, pattern, contexts, SIDES)
    digits = lambda t: F.length(F.regexp_replace(t, "[^0-9]", ""))
    label = "[A-Za-z0-9-]"
    return {
        "email": when(F.contains(text, F.lit("@")), find(inner(text, label, "\\.", label), EMAIL)),
        "ip": F.filter(when(F.rlike(text, F.lit("[0-9]\\.[0-9]")), find(text, IP)), lambda x: low_octets(x["t"])),
        "card": F.filter(
            when(F.rlike(text, F.lit("[0-9](?:[ -]?[0-9]){11}")), find(inner(text, "[0-9]", "[ -]", "[0-9]"), CARD)),
            lambda x: luhn(x["t"]),
        ),
        "phone": F.filter(when(F.rlike(text, F.lit("\\+[0-9]")), find(text, PHONE)), lambda x: digits(x["t"]).between(9, 15)),
    }


def candidates(text: Column) -> Column:
    """Identifier-like tokens without the joiners at their ends, and the patterns beside them."""
    digits = lambda t: F.length(F.regexp_replace(t, "[^0-9]", ""))
    seen = F.when(F.rlike(text, F.lit("[0-9]")), find_spans(text, CANDIDATE, contexts, SIDES)).otherwise(NO_SPANS(SIDES))
    bare = lambda t: F.regexp_extract(t, "^(.*[A-Za-z0-9])", 1)
    return F.transform(
        F.filter(seen, lambda x: digits(x["t"]) >= 4),
        lambda x: F.struct(
            x["s"].alias("s"), (x["s"] + F.length(bare(x["t"]))).alias("e"), bare(x["t"]).alias("t"), x["left"].alias("left"), x["right"].alias("right")
        ),
    )


def find_pii(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rounds: int | None = None) -> DataFrame:
    """One row for each input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found.

    Null texts count as empty and have no spans; null ids stay null. Rows that repeat an id or a text each keep their
    own row. An empty table gives no rows. Other columns are not read. Discovered tokens have kind id; one that overlaps
    a base span is not reported. rounds bounds the rounds of scoring; None goes on until nothing changes.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body")).select(
        "doc_id", "body", *(c.alias(k) for k, c in base_columns(F.col("body")).items()), candidates(F.col("body")).alias("cand")
    )
    kinds = ("email", "ip", "card", "phone")
    base = F.concat(*(tagged(F.col(k), i, k) for i, k in enumerate(kinds)))
    mark = lambda seed: lambda x: F.struct(x["s"], x["e"], F.lower(x["t"]).alias("t"), x["left"], x["right"], F.lit(seed).alias("seed"))
    scanned = found.select(
        "doc_id", *(F.size(k).cast("bigint").alias(f"n_{k}") for k in kinds), base.alias("base"),
        F.when(F.size("cand") + F.size(base) > 0, F.sha2("body", 256)).alias("body_key"),
        F.concat(F.transform(F.concat(*kinds), mark(True)), F.transform("cand", mark(False))).alias("marks"),
    )
    scanned = write_table(scanned, "pii-scan")
    marks = scanned.where("size(marks) > 0").select("doc_id", "body_key", F.explode("marks").alias("m")).select("doc_id", "body_key", "m.*")
    marks = marks.dropDuplicates(["doc_id", "body_key", "s", "e", "seed"])
    # candidates that overlap a seed are the seed's: the latest end of the seeds that begin before a mark's end
    within, upto = W.partitionBy("doc_id", "body_key"), (W.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("seed"), F.col("e"))).over(within.orderBy("s", F.desc("seed")).rowsBetween(*upto))
    ahead = F.min(F.when(F.col("seed"), F.col("s"))).over(within.orderBy(F.desc("s"), "seed").rowsBetween(*upto))
    free = marks.withColumn("reach", reach).withColumn("ahead", ahead).where("seed or (coalesce(reach, -1) <= s and coalesce(ahead, e) >= e)").drop("reach", "ahead")
    free = write_table(free.where("left <> '' or right <> ''"), "pii-marks")
    beside = free.select(
        "doc_id", "body_key", "s", "e", "t", "seed",
        F.explode(F.array(F.concat(F.lit("<"), "left"), F.concat(F.lit(">"), "right"))).alias("p"),
    ).where("length(p) > 1")
    # the graph has an edge for each pattern and distinct token; a pattern or token that is in many rows is summed first
    edges = write_table(beside.groupBy("p", "t").agg(F.max("seed").alias("seed"), F.count("*").alias("n")), "pii-edges")
    trusted = bootstrap(specific(edges, docs.select(body.alias("body"))), rounds)
    known = beside.where("not seed").join(trusted, ["p", "t"], "left_semi")
    more = known.groupBy("doc_id", "body_key").agg(
        F.collect_set(F.struct("s", F.lit(len(kinds)).alias("k"), "e", F.lit("id").alias("kind"))).alias("more")
    )
    has = F.exists("marks", lambda m: ~m["seed"])
    plain = scanned.where(~has).withColumn("more", F.expr(NOTHING))
    rest = scanned.where(has).alias("a").join(more.alias("b"), F.expr("a.doc_id <=> b.doc_id and a.body_key = b.body_key"), "left").select(
        "a.*", F.coalesce("b.more", F.expr(NOTHING)).alias("more")
    )
    return plain.unionByName(rest).select(
        "doc_id", *(f"n_{k}" for k in kinds),
        sha_hex(joined(F.col("base"))).alias("base_sha256"),
        joined(F.concat("base", "more")).alias("spans"),
        F.size("more").cast("bigint").alias("n_found"),
    )


def specific(edges: DataFrame, bodies: DataFrame) -> DataFrame:
    """The edges of patterns that can reach the support and of whose occurrences in all texts MIN_SHARE have a token.

    A pattern that occurs too often in a part of the texts alone does so in all of them: that part throws out the pairs of
    common words, of which larger tables bring ever more to the support. What is left is counted in all texts.
    """
    wide = write_table(edges.groupBy("p").agg(F.count("*").alias("support"), F.sum("n").alias("n")).where(f"support >= {MIN_SUPPORT}").select("p", "n", F.substring("p", 2, 1 << 30).alias("pair")), "pii-wide")
    part = bodies.where(F.pmod(F.xxhash64("body"), F.lit(PART)) == 0)
    wide = write_table(occurrences(wide, part, "left").where(f"n >= {MIN_SHARE} * coalesce(all, 0)").select("p", "n", "pair"), "pii-asked")
    good = occurrences(wide, bodies, "inner").where(f"n >= {MIN_SHARE} * all").select("p")
    return write_table(edges.join(good, "p", "left_semi"), "pii-specific")


def occurrences(wide: DataFrame, bodies: DataFrame, how: str) -> DataFrame:
    """wide with all: how often each pattern's words stand side by side in bodies."""
    n_wide = wide.count()
    if not n_wide:
        return wide.withColumn("all", F.lit(0).cast("bigint"))
    words = bodies.select(F.regexp_extract_all(F.lower("body"), F.lit(WORD), F.lit(0)).alias("w")).where("size(w) > 1")
    pairs = words.select(F.explode(F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))).alias("pair"))
    asked = wide.select("pair").distinct()
    met = pairs.join(F.broadcast(asked) if n_wide <= BROADCAST_PATTERNS else asked.hint("merge"), "pair", "left_semi")
    return wide.join(met.groupBy("pair").agg(F.count("*").alias("all")), "pair", how)


def bootstrap(edges: DataFrame, rounds: int | None) -> DataFrame:
    """p, t: pairs of a trusted pattern and an unseen token beside it.

    A pattern's confidence is the mean trust of the distinct tokens beside it; it counts once MIN_SUPPORT of them are
    trusted. An unseen token gets its trust when a pattern of that kind first meets it: the confidence of the best one.
    Seeds are trusted fully, others not at first. Trust only grows, token by token, so that the rounds come to an end.
    """
    trust = write_table(edges.where("seed").select("t", F.lit(1.0).alias("trust")).distinct(), "pii-trust")
    while True:
        state = edges.join(trust, "t", "left")
        patterns = state.groupBy("p").agg((F.sum(F.coalesce("trust", F.lit(0.0))) / F.count("*")).alias("confidence"), F.count("trust").alias("support"))
        good = write_table(patterns.where(f"support >= {MIN_SUPPORT} and confidence >= {MIN_CONFIDENCE}").select("p", "confidence"), "pii-patterns")
        fresh = edges.join(good, "p").groupBy("t").agg(F.max("confidence").alias("trust")).join(trust.select("t"), "t", "left_anti")
        following = write_table(trust.unionByName(fresh), "pii-trust")
        more = following.count() > trust.count()
        rounds = rounds - 1 if rounds is not None else None
        drop_table(trust)
        trust = following
        if not more or rounds == 0:
            return edges.where("not seed").join(good.select("p"), "p", "left_semi").select("p", "t")
        drop_table(good)
