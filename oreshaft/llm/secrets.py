"""Secret scanning with an incremental, content-addressed blob ledger.

Every version of every path is a blob, addressed by the SHA-256 of its content.
The ledger is a table in the shared folder: one row for each blob and rule
version that has been scanned, with the spans found. A scan reduces the versions
to distinct blobs, anti-joins them with the ledger for each rule version, scans
only what is left, appends it to the ledger, and joins the spans back to all
paths by address. All of it is DataFrame work: a rule's matches and the pieces
between them come from two regular expression calls, and running sums of their
lengths give code point spans.

Each distinct blob's text is shuffled once at most; copies are collapsed before
the shuffle. Only addresses and spans take part in the joins back, and a hot
blob's partition is one that Spark splits.

Two scans at once may append the same pair twice; their spans are one on reading.

Nulls: a null content is the empty blob; null paths and versions are kept as
they are. Repeated rows each get their spans. An empty table gives an empty result;
columns named blob or spans are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch

SPAN = "struct<start:int,kind:int,stop:int>"
#: Matches that are put together by one array.
CHUNK = 512


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost non-overlapping matches of pattern whose group has at least `least` characters."""

    kind: str
    pattern: str
    group: int
    least: int


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"

#: Rule versions: the order in a version is that of kinds at one start. Version 2 adds headers of private keys.
RULES = {
    1: (Rule("assign", ASSIGN, 1, 8), Rule("access", ACCESS, 0, 16), Rule("hex", HEX, 0, 32)),
    2: (Rule("pem", r"-----BEGIN(?:\x20[A-Z]+)*\x20PRIVATE\x20KEY-----", 0, 0),),
}
KINDS = [r.kind for v in sorted(RULES) for r in RULES[v]]


def spans_of(text: Column, rule: Rule) -> Column:
    """The rule's matches in text as an array of SPAN, ascending."""
    quick = rf"[0-9a-f]{{{rule.least}}}" if rule.kind == "hex" else rule.pattern
    pattern = rf"[0-9a-f]{{{rule.least},}}" if rule.kind == "hex" else rule.pattern  # same matches: a run is taken whole either way
    kind = KINDS.index(rule.kind)
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    inner = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(rule.group + 1))
    sizes = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    found = F.struct(whole.alias("w"), inner.alias("g"), sizes.alias("gap"))

    none = F.array().cast(f"array<{SPAN}>")

    def step(f: Column):
        def add(acc: Column, i: Column) -> Column:
            a = acc["at"] + F.element_at(f["gap"], i)
            b = a + F.char_length(F.element_at(f["w"], i))
            span = F.struct(a.alias("start"), F.lit(kind).alias("kind"), b.alias("stop"))
            keep = F.char_length(F.element_at(f["g"], i)) >= rule.least
            return F.struct(b.alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        return add

    def walk(f: Column) -> Column:
        """Spans by running sums, CHUNK matches at a time: an array that grows by a copy for each match would take their square."""
        n = F.size(f["w"])

        def chunk(acc: Column, c: Column) -> Column:
            own = F.aggregate(F.sequence(c * CHUNK + 1, F.least(c * CHUNK + CHUNK, n)), F.struct(acc["at"].alias("at"), none.alias("out")), step(f))
            return F.element_at(F.transform(F.array(own), lambda o: F.struct(o["at"].alias("at"), F.concat(acc["out"], F.array(o["out"])).alias("out"))), 1)

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
        return F.when(n > 0, F.flatten(F.aggregate(F.sequence(F.lit(0), ((n - 1) / CHUNK).cast("int")), start, chunk)["out"])).otherwise(none)

    some = F.element_at(F.transform(F.array(found), walk), 1)
    return F.when(text.rlike(quick), some).otherwise(none)


def _once(spans: Column) -> Column:
    """Sorted spans without repeats."""
    return F.element_at(F.transform(F.array(spans), lambda s: F.filter(s, lambda x, i: (i == 0) | (x != F.get(s, i - 1)))), 1)


LEDGER = f"blob string, rule_version int, spans array<{SPAN}>"


class Ledger:
    """The scanned (blob, rule_version) pairs under path, in one folder for each scan."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or Scratch(spark).path("ledger", keep=True)

    def rows(self) -> DataFrame | None:
        """The ledger so far; None before the first scan."""
        try:
            return self.spark.read.schema(LEDGER).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def scan(self, versions: DataFrame, content: str = "content", rule_versions: tuple[int, ...] = (1, 2)) -> DataFrame:
        """versions' columns but content, with blob and spans; scans what no earlier call did."""
        text = F.coalesce(F.col(f"`{content}`").cast("string"), F.lit(""))
        rest = [c for c in versions.columns if c != content and c.lower() not in ("blob", "spans")]
        addressed = versions.select(*(f"`{c}`" for c in rest), F.sha2(text, 256).alias("blob"), text.alias("__text"))
        known = self.rows()
        blobs, seen = addressed.select("blob", "__text"), None
        if known is not None:
            seen = known.where(F.col("rule_version").isin(*rule_versions)).groupBy("blob").agg(F.collect_set("rule_version").alias("seen"))
            blobs = blobs.join(seen.where(F.size("seen") == len(rule_versions)), "blob", "left_anti")
        blobs = blobs.groupBy("blob").agg(F.first("__text").alias("__text"))
        blobs = blobs.join(seen, "blob", "left") if seen is not None else blobs.withColumn("seen", F.lit(None).cast("array<int>"))
        pairs = F.array(*(
            F.when(~F.coalesce(F.array_contains("seen", v), F.lit(False)), F.struct(F.lit(v).alias("rule_version"), F.array_sort(F.concat(*(spans_of(F.col("__text"), r) for r in RULES[v]))).alias("spans")))
            for v in rule_versions
        ))
        blobs.select("blob", F.explode(pairs).alias("p")).where("p is not null").select("blob", "p.rule_version", "p.spans").write.mode("append").parquet(self.path)
        spans = self.rows().where(F.col("rule_version").isin(*rule_versions) & (F.size("spans") > 0)).groupBy("blob").agg(_once(F.array_sort(F.flatten(F.collect_list("spans")))).alias("spans"))
        return addressed.drop("__text").join(spans, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")))


def listed(spans: Column, kinds: list[str] | None = None) -> Column:
    """kind:start:end, comma-joined, of the spans of the kinds (all by default)."""
    names = F.array(*map(F.lit, KINDS))
    wanted = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*(KINDS.index(k) for k in kinds)))
    return F.array_join(F.transform(wanted, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")
