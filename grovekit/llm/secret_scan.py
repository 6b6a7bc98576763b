"""Secret scan by multipart credential linking, on DataFrame functions only.

Strong parts are found by pattern: assigned secrets, access identifiers and long hex strings. Weak parts (opaque tokens,
identifier assignments, account addresses, endpoints) mean little alone. Parts of one document are joined on intervals
within a scope, and a weak part is reported only where a part of a complementary type stands in its scope: a secret
beside an identifier or endpoint, an identifier or endpoint beside a secret.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_SPANS, find_spans, joined, let, sha_hex, tagged, write_table

# The base patterns and the order of their kinds.
NAME = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = NAME + "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = "AKIA[A-Z0-9]{16,}+"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}+"

#: What the base patterns take: weak parts are looked for in the rest of a text.
BASE = f"(?:{NAME}[\"']?\\x20*+[:=]\\x20*+[\"']?[A-Za-z0-9+/_.=-]{{6,}}+|{ACCESS}|{HEX})"

#: Weak parts: kind to pattern and type. An opaque token has 20 or more characters of three classes and never starts inside
#: a longer run; an account is an e-mail address; an endpoint is a URL's scheme and host, or an IPv4 address.
IDENTITY, SECRET, PLACE = 0, 1, 2
WEAK = {
    "secret": ("(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_=-]{20,}+(?![.@])", SECRET),
    "identifier": ("(?i:(?<![a-z0-9_])(?:client|account|user|access|key|app|tenant)[_-](?:id|key|name)[\"']?\\x20*+[:=]\\x20*+[\"']?[a-z0-9_.@-]{4,}+)", IDENTITY),
    "account": ("(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\\.[A-Za-z0-9.-]*[A-Za-z0-9]", IDENTITY),
    "endpoint": ("(?i:(?<![a-z0-9_])(?:https?|amqps?|postgres(?:ql)?|mysql|mongodb|redis)://[a-z0-9.:-]++)|(?<![0-9.])[0-9]{1,3}(?:\\.[0-9]{1,3}){3}(?::[0-9]{1,5})?(?![0-9.]*[0-9])", PLACE),
}

#: Code points between two parts of one credential, at most: this bounds a scope, not a text.
SCOPE = 200

NOTHING = "cast(array() as array<struct<s:int,k:int,e:int,kind:string>>)"


def base_columns(text: Column) -> dict[str, Column]:
    """Base spans of a text. Cheap containment tests come before the patterns."""
    when = lambda test, spans: F.when(test, spans).otherwise(NO_SPANS())
    names = let(F.lower(text), lambda t: reduce(lambda a, b: a | b, (F.contains(t, F.lit(n)) for n in NAMES)))
    return {
        "assign": F.filter(when(names, find_spans(text, ASSIGN)), lambda x: F.length(F.regexp_extract(x["t"], ASSIGN, 2)) >= 6),
        "access": when(F.contains(text, F.lit("AKIA")), find_spans(text, ACCESS)),
        "hex": when(F.rlike(text, F.lit("[0-9a-f]{24}")), find_spans(text, HEX)),
    }


def weak_columns(text: Column) -> dict[str, Column]:
    """Weak parts of a text, each kind leftmost and non-overlapping in what the base patterns leave."""
    likely = {
        "secret": F.rlike(text, F.lit("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")),
        "identifier": F.rlike(text, F.lit("[_-](?:[Ii][Dd]|[Kk][Ee][Yy]|[Nn][Aa][Mm][Ee])")),
        "account": F.contains(text, F.lit("@")),
        "endpoint": F.contains(text, F.lit("://")) | F.rlike(text, F.lit("[0-9]\\.[0-9]")),
    }
    out = {}
    for kind, (pattern, _) in WEAK.items():
        spans = F.filter(find_spans(text, f"{BASE}|(?:{pattern})"), lambda x: ~F.rlike(x["t"], F.lit(f"^{BASE}")))
        if kind == "secret":
            spans = F.filter(spans, lambda x: F.rlike(x["t"], F.lit("[0-9]")) & F.rlike(x["t"], F.lit("[a-z]")) & F.rlike(x["t"], F.lit("[A-Z]")))
        out[kind] = F.when(likely[kind], spans).otherwise(NO_SPANS())
    return out


def _part(spans: Column, rank: int, kind: str, type_: int, weak: bool) -> Column:
    return F.transform(
        spans,
        lambda x: F.struct(
            x["s"].alias("s"), x["e"].alias("e"), F.lit(rank).alias("k"), F.lit(kind).alias("kind"),
            F.lit(type_).alias("type"), F.lit(weak).alias("weak"),
        ),
    )


def scan_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """One row for each input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans (see the module's docstring).

    Null texts count as empty and have no spans; null ids stay null. Rows that repeat an id or a text each keep their
    own row; the parts of equal (id, text) rows are linked once. An empty table gives no rows. Other columns are not
    read. Base spans may overlap spans of other kinds; weak parts never start inside what a base pattern takes.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body")).select(
        "doc_id", "body", *(c.alias(k) for k, c in base_columns(F.col("body")).items()), *(c.alias(f"weak_{k}") for k, c in weak_columns(F.col("body")).items())
    )
    strong = [(k, t) for k, t in (("assign", SECRET), ("access", IDENTITY), ("hex", SECRET))]
    parts = F.concat(
        *(_part(F.col(k), i, k, t, False) for i, (k, t) in enumerate(strong)),
        *(_part(F.col(f"weak_{k}"), i, k, t, True) for i, (k, (_, t)) in enumerate(WEAK.items(), len(strong))),
    )
    scanned = write_table(
        found.select(
            "doc_id",
            *(F.size(k).cast("bigint").alias(f"n_{k}") for k, _ in strong),
            F.concat(*(tagged(F.col(k), i, k) for i, (k, _) in enumerate(strong))).alias("base"),
            let(
                parts,
                lambda p: F.when(
                    F.exists(p, lambda x: x["weak"])
                    & F.exists(p, lambda x: x["type"] == SECRET)
                    & F.exists(p, lambda x: x["type"] != SECRET),
                    p,
                ),
            ).alias("parts"),
            F.sha2("body", 256).alias("body_key"),
        ),
        "secret-scan",
    )
    linked = link_parts(scanned.where("parts is not null").select("doc_id", "body_key", "parts").dropDuplicates(["doc_id", "body_key"]), scope)
    alone = scanned.where("parts is null").withColumn("more", F.expr(NOTHING))
    with_parts = scanned.where("parts is not null").alias("a").join(
        linked.alias("b"), F.expr("a.doc_id <=> b.doc_id and a.body_key = b.body_key"), "left"
    ).select("a.*", F.coalesce("b.more", F.expr(NOTHING)).alias("more"))
    return alone.unionByName(with_parts).select(
        "doc_id", *(f"n_{k}" for k, _ in strong),
        sha_hex(joined(F.col("base"))).alias("base_sha256"),
        joined(F.concat("base", "more")).alias("spans"),
        F.size("more").cast("bigint").alias("n_linked"),
    )


def link_parts(rows: DataFrame, scope: int) -> DataFrame:
    """doc_id, body_key, more: the weak parts that have a complementary part within scope.

    The interval join runs on bins as wide as the scope. Complementary parts are reduced to the least and greatest
    offset of a type in each bin, so a probe meets two bins on either side, however many parts a document has.
    """
    part = rows.select("doc_id", "body_key", F.explode("parts").alias("p")).select("doc_id", "body_key", "p.*")
    key = ["doc_id", "body_key"]
    group = F.when(F.col("type") == SECRET, F.lit(SECRET)).otherwise(F.lit(IDENTITY))
    ends = part.select(
        *key, group.alias("g"),
        F.explode(F.array(
            F.struct(F.lit(True).alias("is_start"), F.col("s").alias("at")),
            F.struct(F.lit(False).alias("is_start"), F.col("e").alias("at")),
        )).alias("x"),
    ).select(*key, "g", "x.is_start", F.floor(F.col("x.at") / scope).alias("bin"), "x.at")
    bins = ends.groupBy(*key, "g", "is_start", "bin").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    # after a part: starts from its end on, at most scope away; before it: ends up to its start, at most scope away
    after, before = F.floor(F.col("e") / scope), F.floor(F.col("s") / scope)
    probe = part.where("weak").select(
        *key, "s", "e", "k", "kind", (1 - group).alias("g"),
        F.explode(F.array(
            F.struct(F.lit(True).alias("is_start"), after.alias("bin")), F.struct(F.lit(True).alias("is_start"), (after + 1).alias("bin")),
            F.struct(F.lit(False).alias("is_start"), before.alias("bin")), F.struct(F.lit(False).alias("is_start"), (before - 1).alias("bin")),
        )).alias("x"),
    ).select(*key, "s", "e", "k", "kind", "g", "x.*")
    # hi of the nearer bin and lo of the farther one are the ones that can reach; comparing all four keeps one condition
    near = F.expr(
        "p.doc_id <=> b.doc_id and p.body_key = b.body_key and p.g = b.g and p.is_start = b.is_start and p.bin = b.bin and ("
        f"case when p.is_start then (b.hi between p.e and p.e + {scope}) or (b.lo between p.e and p.e + {scope})"
        f" else (b.hi between p.s - {scope} and p.s) or (b.lo between p.s - {scope} and p.s) end)"
    )
    return (
        probe.alias("p").join(bins.alias("b"), near, "left_semi")
        .groupBy(*key)
        .agg(F.sort_array(F.collect_set(F.struct("s", "k", "e", "kind"))).alias("more"))
    )
