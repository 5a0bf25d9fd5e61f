"""Whole reports as named tables: what a run over blobs and regions gives, section by section.

A section is a DataFrame, planned but not run. Parameters have the defaults that
reports are known by; every one of them takes effect.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import decode, mining, regions, signatures, stats
from ..sources import sinks


@dataclass(frozen=True)
class Miner:
    """Parameters of the pattern miner. Version 3 splits regions by device group and mines shorter evidence."""

    version: int = 2
    window: int = 16
    context: int = 32
    ngram_min: int = 2
    ngram_max: int = 8
    top: int = 40
    min_occ: int | None = None
    lengths: tuple[int, ...] | None = None
    threshold: float | None = None
    fixed_below: float = 1.0
    groups: dict[str, list[str]] = field(default_factory=dict)
    template_min_occ: int | None = None

    @property
    def least(self) -> int:
        return self.min_occ or {2: 3, 3: 2}[self.version]

    @property
    def spans(self) -> tuple[int, ...]:
        return self.lengths or tuple({2: range(2, 7), 3: range(2, 9)}[self.version])


def miner(found: DataFrame, p: Miner | None = None) -> dict[str, DataFrame]:
    """Sections of the pattern miner over regions (doc_id, device, file_name, content, start, end)."""
    p = p or Miner()
    zones = regions.region_zones(found, p.window, p.context)
    grams = mining.ngrams(zones, p.ngram_min, p.ngram_max, extra=("device", "tag"))
    hits = signatures.scan(zones, signatures.registry(p.version))
    inner = zones.where(F.col("zone").isin("prologue", "epilogue"))
    threshold = p.threshold if p.threshold is not None else 3.0
    made = mining.templates(inner, p.spans, p.template_min_occ or p.least, threshold, p.fixed_below)
    return {
        "counts": regions.region_counts(found),
        "alignment": regions.alignment(found),
        "lengths": regions.length_stats(found),
        "length_mods": regions.length_mods(found),
        "edge_bytes": regions.edge_bytes(found),
        "edge_pairs": regions.edge_pairs(found),
        "zone_entropy": regions.zone_entropy(zones),
        "positional_entropy": regions.positional_entropy(zones, p.window, p.version),
        "patterns": mining.with_sources(mining.top_patterns(mining.counted(grams), top=p.top, least=p.least), grams),
        "cross_device": mining.cross_device(grams.where("zone = 'prologue'")),
        "templates": mining.dedup_templates(made).orderBy(F.desc("sources"), F.desc("n"), "k", "seen"),
        "signatures": signatures.report(hits),
        "architectures": signatures.scores(hits),
        "dump": regions.region_dump(found, p.window, p.context),
    }


def grouped_miner(found: DataFrame, p: Miner) -> dict[str, dict[str, DataFrame]]:
    """The miner's sections for each device group that has regions by its parameters, and for all regions (combined).

    Templates of each group and of all regions need at least max(2, regions // 8)
    windows, and those of a group an entropy below 2.5 at their anchors, unless the
    parameters say otherwise. Other patterns keep the parameters' minimum. The regions
    of each group are counted here, as the plan depends on their number.
    """
    routed = regions.route_groups(found, p.groups)
    out = {}
    for name in (*p.groups, "combined"):
        own = routed.where(F.col("grp") == name).drop("grp")
        use = p
        if p.template_min_occ is None:
            use = replace(use, template_min_occ=max(2, regions.region_counts(own).first()["regions"] // 8))
        if name != "combined" and p.threshold is None:
            use = replace(use, threshold=2.5)
        out[name] = miner(own, use)
    return out


def boundary(found: DataFrame, window: int = 64, lo: int = 4, hi: int = 16, top: int = 30, kgrams: tuple[int, ...] = (4, 6, 8, 10, 12)) -> dict[str, DataFrame]:
    """Windows around region bounds with their top prefixes, suffixes and k-grams."""
    w = regions.boundary_windows(found, window)
    at = lambda *z: w.where(F.col("zone").isin(*z))
    best = lambda counts: mining.top_patterns(counts, top=top, longest_first=True)
    return {
        "windows": w,
        "prologue_prefix": best(mining.prefixes(at("start_post"), lo, hi)),
        "prologue_suffix": best(mining.suffixes(at("start_pre"), lo, hi)),
        "epilogue_suffix": best(mining.suffixes(at("end_pre"), lo, hi)),
        "epilogue_prefix": best(mining.prefixes(at("end_post"), lo, hi)),
        "kgrams": mining.top_grams(at("start_post", "end_pre"), kgrams, top),
    }


def motif_ranking(windows: DataFrame, k: int = 8, wild: int = 3, contiguous: bool = False, least: int = 4, top: int = 40, powers: tuple[float, float, float] = (1.0, 1.0, 1.0), max_hits: int = 10) -> dict[str, DataFrame]:
    """Motifs of windows behind starts and before ends, each region's best hits, and regions ranked by them."""
    both = windows.where(F.col("zone").isin("start_post", "end_pre"))
    mined = mining.motifs(both, k, wild, contiguous, least, top)
    hits = mining.motif_hits(both, mined, powers)
    shown = hits.withColumn("n", F.col("w")).withColumn("seen", F.col("rank"))
    return {
        "motifs": mined,
        "hits": mining.top_patterns(shown, ("doc_id", "zone"), max_hits).drop("n", "seen"),
        "ranking": mining.rank_by_motifs(both, hits),
    }


def similarity(blobs: DataFrame, offset: int = 6000, code_only: bool = False, block_bytes: int = 4096, min_ratio: float = 0.8) -> dict[str, DataFrame]:
    """Histograms by device, all distances, their matrices and the closest pairs; code_only counts kept blocks alone."""
    counts = stats.codeonly_histogram(blobs, "device", offset, block_bytes, min_ratio) if code_only else stats.histogram(blobs, "device", offset)
    shares = stats.normalised(counts)
    metrics = ["jsd", "chi2", "cosine" if code_only else "sorted_cosine"]
    pairs = stats.similarity(shares, metrics)
    files = stats.files_counted(blobs, offset=offset)
    out = {"histogram": sinks.wide_histogram(shares, files), "pairs": pairs, "closest": stats.closest(pairs, "jsd")}
    return out | {f"matrix_{m}": sinks.matrix(pairs, m) for m in metrics}


def code_regions(blobs: DataFrame, found: DataFrame, on: list[str], offset: int = 6001, block_bytes: int = 2048, min_ratio: float = 0.9, only_ok: bool = False) -> dict[str, DataFrame]:
    """Block figures, return rates, the map of kept blocks, and which regions lie in or touch them.

    Regions whose blob is absent stay, as hits of nothing, and are counted as missing.
    """
    table = decode.blocks(blobs, offset, block_bytes)
    there = blobs.select(*on, F.lit(True).alias("exists")).distinct()
    known = found.join(there, on, "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    hits = regions.interval_hits(known, decode.kept(table, min_ratio), on, offset, decode.block_size(block_bytes))
    return {
        "blocks": decode.block_meta(table, on, min_ratio),
        "rates": decode.return_rates(table, "device", min_ratio, only_ok),
        "map": decode.codeonly_map(table, on, min_ratio),
        "hits": hits,
        "summary": regions.hit_summary(hits, exists="exists"),
    }
