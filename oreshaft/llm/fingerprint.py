"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

A text's five-word shingles are hashed once. The hash's leading bits choose one
of `BINS` bins, each bin keeps its least hash, an empty bin takes the value of a
bin chosen by a sequence of universal hashes of (bin, attempt) (optimal
densification; after ATTEMPTS of them, the occupied bin whose hash with the empty
one is least, which is one more universal choice), and the low BITS bits of all
bins are packed into longs. Likeness is the share of equal bins, corrected for
equal bits by chance: (share - 2**-BITS) / (1 - 2**-BITS), held within 0 to 1.

Shingle hashes stay inside their row as an array: they are neither exploded nor
shuffled. A text of fewer words, but not none, is one shingle; a text without
words, or null, has no fingerprint (null), is wholly like another such and
unlike all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import SPACE

SHINGLE = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
BITS = 8
PER_LONG = 64 // BITS
ATTEMPTS = 12
_SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+", -1))


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """Hashes of the text's n-word shingles, with repeats."""

    def of(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))
        return F.when(F.size(w) >= n, each).when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w), F.size(w)))).otherwise(F.array().cast("array<bigint>"))

    return let(words(text), of)


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS).cast("int")


def fingerprint(text: Column) -> Column:
    """BINS packed bins of BITS bits as an array of longs, or null."""

    def least(s: Column) -> Column:  # sorted hashes: a bin's are together, its least first
        return F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1))))

    def binned(firsts: Column) -> Column:
        held = F.map_from_arrays(F.transform(firsts, _bin), firsts)
        return let(held, lambda m: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.try_element_at(m, b)))

    def filled(v: Column, firsts: Column) -> Column:
        def at(x: Column, b: Column) -> Column:
            tries = (F.get(v, F.pmod(F.xxhash64(b, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(ATTEMPTS))
            rest = F.array_min(F.transform(firsts, lambda y: F.struct(F.xxhash64(b, _bin(y)).alias("r"), y.alias("y"))))["y"]
            return F.coalesce(x, *tries, rest)

        return F.transform(v, at)

    def packed(full: Column) -> Column:
        def one(j: Column) -> Column:
            return F.aggregate(F.slice(full, j * PER_LONG + 1, PER_LONG), F.lit(0).cast("bigint"), lambda a, x: F.shiftleft(a, BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << BITS) - 1).cast("bigint"))))

        return F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)), one)

    made = let(F.sort_array(shingle_hashes(text)), lambda s: let(least(s), lambda f: F.when(F.size(f) > 0, let(binned(f), lambda v: let(filled(v, f), packed)))))
    return made


def likeness(a: Column, b: Column) -> Column:
    """The bias-corrected likeness of two fingerprints."""
    low = 0x0101010101010101 if BITS == 8 else None

    def equal(x: Column, y: Column) -> Column:  # bins of a long that agree: bytes of x xor y that are zero
        d = x.bitwiseXOR(y)
        for s in (4, 2, 1):
            d = d.bitwiseOR(F.shiftrightunsigned(d, s))
        return PER_LONG - F.bit_count(d.bitwiseAND(F.lit(low)))

    share = F.aggregate(F.zip_with(a, b, equal), F.lit(0), lambda s, x: s + x) / F.lit(float(BINS))
    chance = 2.0**-BITS
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (share - chance) / (1 - chance)))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(near)


def text_of(fp: Column) -> Column:
    """A fingerprint as hexadecimal text; empty for none."""
    return F.coalesce(F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")), ""), F.lit(""))


def with_next(docs: DataFrame, columns: list[str], doc_id: str = "doc_id", tie: str = "text") -> DataFrame:
    """docs with a struct `next` of the given columns from the next row in descending doc_id; the first follows the last.

    Rows are dealt to ranges of ids (as many as shuffle partitions), a range to a task,
    and shuffled once. The first row of a range also goes, as a ghost, to the range before it, so
    that no range needs another. Null ids come last, equal ids by a hash of the
    tie column. Driver: one id for each range.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx(doc_id, [i / parts for i in range(1, parts)], 100_000)).first()[0] or [] if parts > 1 else []
    cuts = sorted(set(cuts))
    step = max(1, int(len(cuts) ** 0.5))
    if cuts:
        every, coarse = (F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>") for x in (cuts, cuts[step - 1 :: step]))
        below = lambda a: F.size(F.filter(a, lambda c: c < F.col(doc_id)))
        part = F.coalesce(let(below(coarse), lambda k: k * step + below(F.slice(every, k * step + 1, step))), F.lit(0))
    else:
        part = F.lit(0)
    dealt = docs.withColumn("__part", part)
    firsts = {r["__part"]: r["first"] for r in dealt.groupBy("__part").agg(F.max(doc_id).alias("first")).collect()}
    there = sorted(firsts)
    before = {p: there[(i + 1) % len(there)] for i, p in enumerate(there)}
    number = docs.schema[doc_id].dataType.simpleString()

    def lookup(d: dict, kind: str) -> Column:  # d's value for the row's range, from a constant array
        listed = ",".join("" if d.get(p) is None else str(d[p]) for p in range(len(cuts) + 1))
        return F.nullif(F.get(F.split(F.lit(listed), ","), F.col("__part")), F.lit("")).cast(kind)

    own = F.struct(F.col("__part").alias("p"), F.lit(False).alias("ghost"))
    ghost = F.struct(lookup(before, "int").alias("p"), F.lit(True).alias("ghost"))
    placed = dealt.withColumn("__at", F.explode(F.when(F.col(doc_id).eqNullSafe(lookup(firsts, docs.schema[doc_id].dataType.simpleString())), F.array(own, ghost)).otherwise(F.array(own))))
    placed = placed.repartitionById(len(cuts) + 1, F.col("__at.p"))  # a range is a task
    w = Window.partitionBy("__at.p").orderBy("__at.ghost", F.col(doc_id).desc_nulls_last(), F.xxhash64(tie), F.col(tie))
    return placed.withColumn("next", F.lead(F.struct(*columns)).over(w)).where("not __at.ghost").drop("__part", "__at")


def edited(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, fp, edited (text), edited_fp, next_fp: each text beside its edited form."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("fp", fingerprint(F.col("text")))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    mixed = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    following = with_next(base, ["text", "fp"])
    return following.select("doc_id", n.cast("bigint").alias("n_chars"), "fp", mixed.alias("edited"), F.col("next.fp").alias("next_fp")).withColumn("edited_fp", fingerprint(F.col("edited")))
