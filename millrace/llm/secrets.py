"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds are found by themselves: assignments to secret names, access
identifiers and long hexadecimal strings. Weak candidates (identifiers, secrets
and endpoints that prove nothing alone) are reported only if complementary parts
co-occur in their scope: an identifier needs a secret, a secret an identifier, an
endpoint both. The parts are joined as intervals: positions are dealt into bins
as wide as the scope, each bin is reduced to its first and last part of a role,
and a candidate looks into its own and the two neighbouring bins, so the join is
exact and never pairs all parts of a text.

Defined results: null and empty texts have no spans; repeated rows get equal
results, a null id too; extra columns are ignored; an empty table gives no rows.
Positions are in code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
WEAK_ID = r"""(?i:client|access|account|tenant|user)_?(?i:key_?)?(?i:id|name)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"""(?i:https?|s3|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+"""

#: Widest distance, in code points, between the starts of parts that belong together.
SCOPE = 200
#: Kinds in the order in which spans at the same start are listed, and the part each can play.
KINDS = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}
NEEDS = {"weak_id": ["secret"], "weak_secret": ["id"], "endpoint": ["id", "secret"]}
SPAN = "array<struct<start:int,rank:int,end:int>>"
#: Matches whose positions are summed up in one go.
BLOCK = 512


def located(text: Column, pattern: str, kind: str, guard: Column) -> Column:
    """Spans of a pattern's leftmost matches that do not overlap.

    The gaps that split() leaves and the matches add up to positions. Sums run
    over blocks, so a text with very many matches stays near linear.
    """
    rank = list(KINDS).index(kind)
    both = F.array(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")))

    def sizes(v: Column) -> Column:
        steps = F.transform(v["hits"], lambda h, i: F.length(h) + F.length(F.get(v["gaps"], i)))
        return F.struct(v["gaps"].alias("gaps"), v["hits"].alias("hits"), steps.alias("steps"))

    def block(v: Column, b: Column) -> Column:
        first, last = b * BLOCK, F.least((b + 1) * BLOCK, F.size(v["hits"])) - 1
        before = F.aggregate(F.slice(v["steps"], F.lit(1), first), F.lit(0), lambda a, x: a + x)
        empty = F.struct(before.alias("at"), F.array().cast(SPAN).alias("out"))

        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(v["gaps"], i))
            end = acc["at"] + F.get(v["steps"], i)
            span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(F.sequence(first, last), empty, step, lambda acc: acc["out"])

    def whole(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(v["hits"]) - 1) / BLOCK).cast("int"))
        spans = F.flatten(F.transform(blocks, lambda b: block(v, b)))
        if kind == "assign":  # a match counts only if its value has eight characters; a shorter one still uses up its text
            spans = F.filter(spans, lambda s, i: F.length(F.regexp_extract(F.get(v["hits"], i), ASSIGN, 1)) >= 8)
        return F.when(F.size(v["hits"]) > 0, spans).otherwise(F.array().cast(SPAN))

    found = F.get(F.transform(F.transform(both, sizes), whole), F.lit(0))
    return F.when(guard, found).otherwise(F.array().cast(SPAN))


def written(spans: Column) -> Column:
    """kind:start:end, by start and then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, the base kinds' spans, and linked (the weak candidates that are reported)."""
    t = F.col("text")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = own.select(
        "doc_id",
        F.monotonically_increasing_id().alias("rid"),
        located(t, ASSIGN, "assign", t.rlike(ASSIGN)).alias("assign"),
        located(t, ACCESS, "access", t.contains("AKIA")).alias("access"),
        located(t, HEX, "hex", t.rlike(HEX)).alias("hex"),
        located(t, WEAK_ID, "weak_id", t.rlike(WEAK_ID)).alias("weak_id"),
        located(t, WEAK_SECRET, "weak_secret", t.rlike(WEAK_SECRET)).alias("weak_secret"),
        located(t, ENDPOINT, "endpoint", t.contains("://")).alias("endpoint"),
    )
    # Row numbers are written once with the spans; the joins below read them and no text.
    compact = stored(found)
    base = F.concat("assign", "access", "hex")
    weak = F.filter(F.concat(*NEEDS), lambda w: ~F.exists(base, lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    parts = compact.where(F.size(F.concat(*NEEDS)) > 0).select("rid", F.explode(F.concat(base, weak)).alias("s"))
    names, roles = F.array(*map(F.lit, KINDS)), F.array(*map(F.lit, KINDS.values()))
    parts = parts.select("rid", "s", F.get(names, F.col("s.rank")).alias("kind"), F.get(roles, F.col("s.rank")).alias("role"), F.floor(F.col("s.start") / SCOPE).alias("bin"))
    ends = parts.groupBy("rid", "bin", "role").agg(F.min("s.start").alias("low"), F.max("s.start").alias("high"))
    needs = F.create_map(*(x for k, v in NEEDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    asked = parts.where(F.col("kind").isin(*NEEDS)).withColumn("need", F.try_element_at(needs, F.col("kind")))
    near = asked.select("rid", "s", "need", F.explode("need").alias("role"), "bin").select("rid", "s", "need", "role", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    met = near.join(ends, ["rid", "bin", "role"]).where((F.col("high") >= F.col("s.start") - SCOPE) & (F.col("low") <= F.col("s.start") + SCOPE))
    proven = met.groupBy("rid", "s").agg(F.size(F.collect_set("role")).alias("n"), F.max(F.size("need")).alias("of")).where("n = of")
    linked = proven.groupBy("rid").agg(F.collect_list("s").alias("linked"))
    none = F.array().cast(SPAN)
    return compact.join(linked, "rid", "left").select("doc_id", "assign", "access", "hex", F.coalesce("linked", none).alias("linked"))


def report(spans: DataFrame) -> DataFrame:
    """The digest columns of the scan's contract."""
    base = F.concat("assign", "access", "hex")
    return spans.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.concat(base, F.col("linked"))).alias("spans"),
    )
