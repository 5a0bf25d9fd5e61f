"""Sinks: matrices, histograms, records, documents and blobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(pairs: DataFrame, metric: str, digits: int = 6) -> DataFrame:
    """A square table (device, one column for each device) of formatted values."""
    return pairs.groupBy(F.col("d1").alias("device")).pivot("d2").agg(F.first(F.format_string(f"%.{digits}f", metric))).orderBy("device")


def wide_histogram(shares: DataFrame, files: DataFrame, by: str = "device", digits: int = 10) -> DataFrame:
    """(by, num_files, b00 … bff): formatted shares, with the files counted (by, num_files)."""
    return shares.join(files, by).select(by, "num_files", *(F.format_string(f"%.{digits}f", F.get("p", F.lit(b))).alias(f"b{b:02x}") for b in range(256)))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Headed, quotes doubled as in RFC 4180."""
    df.write.csv(path, header=True, mode=mode, quote='"', escape='"')


def write_document(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A JSON object for each row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def boundary_document(windows: DataFrame, top: dict[str, DataFrame]) -> DataFrame:
    """(candidates, top lists) as JSON rows: windows as zone maps, patterns with counts."""
    each = windows.groupBy("doc_id", "device", "file_name", "start", "end").agg(F.map_from_entries(F.collect_list(F.struct("zone", "hexed"))).alias("windows_hex"))
    out = each.select(F.lit("candidate").alias("section"), F.to_json(F.struct("*")).alias("value"))
    for name, rows in top.items():
        out = out.unionByName(rows.select(F.lit(name).alias("section"), F.to_json(F.struct("pattern", "n")).alias("value")))
    return out


def write_blobs(blobs: DataFrame, folder: str, suffix: str = "_codeonly.bin") -> None:
    """content to folder/device/file_name + suffix through pyarrow's file systems; written under another name first."""
    from pyarrow import fs

    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def run(rows):
        target, root = fs.FileSystem.from_uri(uri)
        for r in rows:
            target.create_dir(f"{root}/{r['device']}", recursive=True)
            path = f"{root}/{r['device']}/{r['file_name'].removesuffix('.dat')}{suffix}"
            with target.open_output_stream(path + ".part", compression=None) as out:
                out.write(bytes(r["content"]))
            target.move(path + ".part", path)

    blobs.select("device", "file_name", "content").foreachPartition(run)
