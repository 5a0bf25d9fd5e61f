"""Windows and zones around byte regions, their statistics, and intervals against kept blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import byte_at, cut, hex_of, source_tag
from .ranking import tag_lists
from .stats import byte_entropy

ZONES = ("prologue", "epilogue", "pre_context", "post_context")


def boundary_windows(regions: DataFrame, window: int = 64) -> DataFrame:
    """regions' columns but content, with zone and hexed: bytes before and behind the start and the end, clamped to the blob."""
    s, e, c = F.col("start"), F.col("end"), F.col("content")
    spans = {"start_pre": (s - window, s), "start_post": (s, s + window), "end_pre": (e - window, e), "end_post": (e, e + window)}
    return _zones(regions, {z: hex_of(cut(c, a, b)) for z, (a, b) in spans.items()})


def _zones(regions: DataFrame, zones: dict) -> DataFrame:
    keep = [c for c in regions.columns if c != "content"]
    pairs = F.array(*(F.struct(F.lit(z).alias("zone"), h.alias("hexed")) for z, h in zones.items()))
    return regions.select(*keep, F.inline(pairs))


def clamped(regions: DataFrame) -> DataFrame:
    """Regions with bounds inside their blob; those that are empty then are dropped."""
    n = F.octet_length("content")
    return regions.withColumn("start", F.greatest(F.lit(0), F.col("start"))).withColumn("end", F.least(n, F.col("end"))).where("start < `end`")


def region_zones(regions: DataFrame, window: int = 16, context: int = 32) -> DataFrame:
    """Zones inside (prologue, epilogue) and around (pre_context, post_context) clamped regions, with the region's tag."""
    s, e, c = F.col("start"), F.col("end"), F.col("content")
    zones = {"prologue": (s, F.least(s + window, e)), "epilogue": (F.greatest(s, e - window), e), "pre_context": (s - context, s), "post_context": (e, e + context)}
    tagged = clamped(regions).withColumn("tag", source_tag(F.col("device"), F.col("file_name"), F.col("start")))
    return _zones(tagged, {z: hex_of(cut(c, a, b)) for z, (a, b) in zones.items()})


def region_dump(regions: DataFrame, window: int = 16, context: int = 32) -> DataFrame:
    """One row for each region: tag, the four zones, and how many bytes between prologue and epilogue are left out."""
    zones = region_zones(regions, window, context)
    wide = zones.groupBy("doc_id", "tag", "start", "end").pivot("zone", list(ZONES)).agg(F.first("hexed"))
    return wide.withColumn("omitted", F.greatest(F.lit(0), F.col("end") - F.col("start") - 2 * window))


def route_groups(regions: DataFrame, groups: dict[str, list[str]], by: str = "device") -> DataFrame:
    """Each region in its device's group (none: ungrouped) and in the group combined."""
    own = F.lit("ungrouped")
    for name, devices in groups.items():
        own = F.when(F.col(by).isin(*devices), name).otherwise(own)
    return regions.withColumn("grp", F.explode(F.array(own, F.lit("combined"))))


def region_counts(regions: DataFrame) -> DataFrame:
    """Regions that hold bytes and regions skipped as empty."""
    ok = F.greatest(F.lit(0), F.col("start")) < F.least(F.octet_length("content"), F.col("end"))
    return regions.agg(F.count_if(ok).alias("regions"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("skipped"))


def alignment(regions: DataFrame) -> DataFrame:
    """(what, align, aligned, total): starts, ends and lengths divisible by 2 and 4."""
    r = clamped(regions)
    what = F.array(*(F.struct(F.lit(w).alias("what"), F.lit(a).alias("align"), (v % a == 0).alias("ok")) for w, v in (("start", F.col("start")), ("end", F.col("end")), ("length", F.col("end") - F.col("start"))) for a in (2, 4)))
    return r.select(F.inline(what)).groupBy("what", "align").agg(F.count_if("ok").alias("aligned"), F.count("*").alias("total"))


def length_stats(regions: DataFrame) -> DataFrame:
    n = F.col("end") - F.col("start")
    return clamped(regions).agg(F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.avg(n).alias("mean_len"), F.median(n).alias("median_len"))


def length_mods(regions: DataFrame, mods=(2, 3, 4)) -> DataFrame:
    n = F.col("end") - F.col("start")
    each = F.array(*(F.struct(F.lit(m).alias("m"), (n % m).cast("int").alias("rest")) for m in mods))
    return clamped(regions).select(F.inline(each)).groupBy("m", "rest").agg(F.count("*").alias("n"))


def edge_bytes(regions: DataFrame, top: int = 20) -> DataFrame:
    """(edge, b, n, seen): the top bytes at a region's first and last place, before and behind it; ties by first region."""
    s, e, c = F.col("start"), F.col("end"), F.col("content")
    one = lambda a: hex_of(cut(c, a, a + 1))
    edges = {"first": one(s), "last": one(e - 1), "before": F.when(s > 0, one(s - 1)).otherwise(""), "after": one(e)}
    counts = _zones(clamped(regions), edges).where("hexed <> ''").groupBy("zone", "hexed").agg(F.count("*").alias("n"), F.min("doc_id").alias("seen"))
    return _top(counts, ["zone"], [F.col("n").desc(), F.col("seen")], top).select(F.col("zone").alias("edge"), byte_at(F.col("hexed"), F.lit(0)).alias("b"), "n", "seen")


def edge_pairs(regions: DataFrame, top: int = 20) -> DataFrame:
    """(edge, pair, n, sources, tags, more): the top first and last byte pairs of regions of two bytes or more, with their first tags."""
    s, e, c = F.col("start"), F.col("end"), F.col("content")
    r = clamped(regions).where("`end` - start >= 2").withColumn("tag", source_tag(F.col("device"), F.col("file_name"), s))
    each = _zones(r, {"first": hex_of(cut(c, s, s + 2)), "last": hex_of(cut(c, e - 2, e))}).select("zone", "hexed", "doc_id", "tag")
    counts = each.groupBy("zone", "hexed").agg(F.count("*").alias("n"), F.min("doc_id").alias("seen"))
    best = _top(counts, ["zone"], [F.col("n").desc(), F.col("seen")], top)
    met = each.join(F.broadcast(best.select("zone", "hexed")), ["zone", "hexed"])
    return best.join(tag_lists(met, ["zone", "hexed"]), ["zone", "hexed"]).select(F.col("zone").alias("edge"), F.col("hexed").alias("pair"), "n", "sources", "tags", "more")


def _top(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def zone_entropy(zones: DataFrame, by: tuple[str, ...] = ("zone",)) -> DataFrame:
    """Entropy of all bytes of a zone taken together; zones without bytes are left out."""
    at = F.explode(F.sequence(F.lit(0), (F.char_length("hexed") / 2).cast("int") - 1))
    each = zones.where("hexed <> ''").select(*by, "hexed", at.alias("i")).select(*by, byte_at(F.col("hexed"), F.col("i")).alias("b"))
    return byte_entropy(each.groupBy(*by, "b").agg(F.count("*").alias("n")), list(by))


#: Entropy bounds and labels of a position's role, by version.
ROLES = {
    2: ((3.0, "OPCODE?"), (5.0, "mixed"), (None, "operand")),
    3: ((2.0, "★OPCODE★"), (3.5, "opcode?"), (5.0, "mixed"), (None, "operand")),
}


def positional_entropy(zones: DataFrame, window: int = 16, version: int = 2, by: tuple[str, ...] = ("zone",)) -> DataFrame:
    """(zone, pos, entropy, top_value, top_count, total, role): zones cut to `window` bytes or padded with zero bytes."""
    padded = F.rpad(F.col("hexed"), 2 * window, "0")
    each = zones.select(*by, "doc_id", padded.alias("hexed"), F.explode(F.sequence(F.lit(0), F.lit(window - 1))).alias("pos")).select(*by, "pos", "doc_id", byte_at(F.col("hexed"), F.col("pos")).alias("b"))
    counts = each.groupBy(*by, "pos", "b").agg(F.count("*").alias("n"), F.min("doc_id").alias("seen"))
    best = counts.groupBy(*by, "pos").agg(F.max_by("b", F.struct("n", -F.col("seen"))).alias("top_value"), F.max("n").alias("top_count"), F.sum("n").alias("total"))
    out = byte_entropy(counts, [*by, "pos"]).join(best, [*by, "pos"])
    role = F.lit(ROLES[version][-1][1])
    for bound, name in ROLES[version][-2::-1]:
        role = F.when(F.col("entropy") < bound, name).otherwise(role)
    return out.withColumn("role", role)


def interval_hits(regions: DataFrame, kept: DataFrame, on: list[str], offset: int, block_bytes: int) -> DataFrame:
    """regions' columns with contained and overlaps: in one kept block as a whole, and touching any.

    Blocks lie on a grid, so a region is opened into the grid cells that it meets
    and joined with blocks by cell: an equi-join, with as many rows as cells. A
    region without a cell (before the header) meets none; an empty one can be
    contained, but overlaps only if it lies strictly inside.
    """
    keep = regions.columns
    cell = lambda x: F.floor((x - offset) / block_bytes)
    lo = F.greatest(F.lit(0), cell(F.col("start")) - F.when(F.col("end") <= F.col("start"), 1).otherwise(0))
    hi = F.greatest(cell(F.greatest(F.col("start"), F.col("end") - 1)), lo)
    keyed = regions.withColumn("__r", F.struct(*(F.col(c) for c in keep)))
    cells = keyed.withColumn("block", F.explode(F.sequence(lo, hi)))
    blocks = kept.select(*on, F.col("block").cast("bigint").alias("block"), F.col("start").alias("b0"), F.col("stop").alias("b1"))
    met = cells.join(blocks, [*on, "block"], "left")
    contained = (F.col("start") >= F.col("b0")) & (F.col("end") <= F.col("b1"))
    overlaps = ~((F.col("end") <= F.col("b0")) | (F.col("start") >= F.col("b1")))
    return met.groupBy("__r").agg(F.coalesce(F.bool_or(contained), F.lit(False)).alias("contained"), F.coalesce(F.bool_or(overlaps), F.lit(False)).alias("overlaps")).select("__r.*", "contained", "overlaps")


def hit_summary(hits: DataFrame, by: str = "device", exists: str | None = None) -> DataFrame:
    """Counts and rates for each device and for all (__OVERALL__)."""
    gone = F.lit(0).cast("bigint") if exists is None else F.count_if(~F.col(exists))
    out = hits.rollup(by).agg(
        F.grouping(by).alias("g"), F.count("*").alias("candidates_total"), F.count_if("contained").alias("contained_hits"),
        F.avg(F.col("contained").cast("int")).alias("contained_rate"), F.count_if("overlaps").alias("overlap_hits"),
        F.avg(F.col("overlaps").cast("int")).alias("overlap_rate"), gone.alias("missing_rows"),
    )
    return out.withColumn(by, F.when(F.col("g") == 1, "__OVERALL__").otherwise(F.col(by))).drop("g")


