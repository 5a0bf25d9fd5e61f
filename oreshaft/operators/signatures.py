"""Masked byte signatures of instruction sets, scanned for in zones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import windows
from .ranking import tag_lists

#: Signatures by version, as name and pattern (?? is any byte), in the order of reports.
SIGNATURES = {
    2: """
ARM-Thumb PUSH {LR} | ?? b5
ARM-Thumb PUSH {r4-r7,LR} | f0 b5
ARM-Thumb PUSH {r4,LR} | 10 b5
ARM-Thumb PUSH generic | ?? b5
ARM-Thumb POP {PC} | ?? bd
ARM-Thumb BX LR | 70 47
ARM-Thumb SUB SP | ?? b0
ARM-Thumb BL (high) | ?? ??
ARM-Thumb BL (low) | ?? ??
RL78 PUSH AX | c1
RL78 PUSH BC | c5
RL78 PUSH DE | c3
RL78 PUSH HL | c7
RL78 POP AX | c0
RL78 POP BC | c4
RL78 POP DE | c2
RL78 POP HL | c6
RL78 RET | d7
RL78 RETI | 61 fc
RL78 CALL !addr16 | 9a ?? ??
RL78 CALL $addr20 | fc ?? ??
RL78 CALLT | ??
RL78 BR !addr16 | 9b ?? ??
RL78 BR $addr20 | fe ?? ?? ??
RL78 MOVW SP,#imm | cb f8 ?? ??
RL78 SUB SP,#imm | da ??
RL78 NOP | 00
RX PUSHM | 6e ??
RX POPM | 6f ??
RX RTS | 02
RX BSR.W | 39 ?? ??
RX SUB SP | 71 ?? ??
SH2 MOV.L Rm,@-R15 | 2f ??
SH2 MOV.L @R15+,Rm | 6f ??
SH2 RTS | 0b 00
SH2 JSR @Rm | ?? ??
SH2 BSR disp | ?? b0
8051 PUSH direct | c0 ??
8051 POP direct | d0 ??
8051 RET | 22
8051 RETI | 32
8051 LCALL | 12 ?? ??
8051 ACALL | ??
8051 LJMP | 02 ?? ??
8051 NOP | 00
AVR PUSH Rr | ?? ??
AVR POP Rd | ?? ??
AVR RET | 08 95
AVR RETI | 18 95
AVR RCALL | ?? ??
AVR CALL | ?? ??
PIC18 CALL | ?? ec
PIC18 RETURN | 12 00
PIC18 RETFIE | 10 00
Generic 0xFF padding | ff ff ff ff
Generic 0x00 padding | 00 00 00 00
Generic 0xCC padding | cc cc cc cc
""",
    3: """
Thumb PUSH {..,LR} | ?? b5
Thumb POP {..,PC} | ?? bd
Thumb BX LR | 70 47
Thumb SUB SP,#imm | ?? b0
Thumb ADD SP,#imm | ?? b0
Thumb MOV r8-r12,Rm (high) | ?? 46
Thumb BL hi | ?? ??
Thumb BL lo | ?? ??
Thumb NOP | c0 46
Thumb PUSH {r4,LR} | 10 b5
Thumb PUSH {r4,r5,LR} | 30 b5
Thumb PUSH {r4-r7,LR} | f0 b5
Thumb POP {r4,PC} | 10 bd
Thumb POP {r4,r5,PC} | 30 bd
Thumb POP {r4-r7,PC} | f0 bd
RL78 PUSH AX | c1
RL78 PUSH BC | c5
RL78 PUSH DE | c3
RL78 PUSH HL | c7
RL78 POP AX | c0
RL78 POP BC | c4
RL78 POP DE | c2
RL78 POP HL | c6
RL78 RET | d7
RL78 RETI | 61 fc
RL78 CALL !addr16 | 9a ?? ??
RL78 CALL $addr20 | fc ?? ??
RL78 BR !addr16 | 9b ?? ??
RL78 BR $addr20 | fe ?? ?? ??
RL78 SUBW SP,#imm | da ??
RL78 ADDW SP,#imm | da ??
V850 PREPARE | ?? 07
V850 DISPOSE | ?? 06
V850 JMP [LP] | e0 07 e0 01
V850 JR disp22 | ?? 07 ?? ??
V850 JARL disp22,LP | ?? 07 ?? ??
V850 ST.W reg,[SP+off] | ?? 73
V850 LD.W [SP+off],reg | ?? 73
V850 MOV imm5,reg | ?? ??
V850 ADD SP,imm | ?? 17
V850 NOP | 00 00
RX PUSHM | 6e ??
RX POPM | 6f ??
RX RTS | 02
RX BSR.W | 39 ?? ??
SH2 MOV.L Rm,@-R15 | ?? 2f
SH2 MOV.L @R15+,Rm | ?? 6f
SH2 RTS | 0b 00
SH2 BSR disp12 | ?? ??
0xFF padding | ff ff ff ff
0x00 padding | 00 00 00 00
""",
}


def registry(version: int = 2) -> list[tuple[str, str]]:
    """(name, pattern without spaces) of a version's signatures."""
    rows = (line.rpartition(" | ") for line in SIGNATURES[version].strip().splitlines())
    return [(name, pattern.replace(" ", "")) for name, _, pattern in rows]


def scan(zones: DataFrame, signatures: list[tuple[str, str]]) -> DataFrame:
    """zones' columns but hexed, with ordinal, name, pattern and off: each signature's first match in each zone."""
    keep = [c for c in zones.columns if c not in ("hexed", "ordinal", "name", "pattern", "off")]
    source = zones.select(*keep, "hexed")
    names, patterns = (pa.array([x[i] for x in signatures], pa.string()) for i in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, cells, size in windows.rows_of(b.column(len(keep))):
                off = np.stack([windows.first_matches(cells, size, p) for _, p in signatures])
                ordinal, at = np.nonzero(off >= 0)
                row, which = pa.array(rows[at]), pa.array(ordinal.astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(row) for i in range(len(keep))), which, names.take(which), patterns.take(which), pa.array(off[ordinal, at].astype(np.int32))], names=[*keep, "ordinal", "name", "pattern", "off"])

    schema = T.StructType([source.schema[c] for c in keep]).add("ordinal", "integer").add("name", "string").add("pattern", "string").add("off", "integer")
    return source.mapInArrow(run, schema)


def scores(hits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(arch, hits): hits by the first word of a signature's name."""
    return hits.groupBy(*by, F.split("name", " ")[0].alias("arch")).agg(F.count("*").alias("hits"))


def report(hits: DataFrame, by: tuple[str, ...] = ("zone",), shown: int = 6) -> DataFrame:
    """(ordinal, name, by, hits, sources, tags, more) in the registry's order: the first `shown` tags and how many others there are.

    A tag's signatures in a group are bits of longs, so that a task holds a row for each
    tag and not for each of its hits.
    """
    key = ["ordinal", *by]
    o = F.col("ordinal")
    sets = hits.groupBy(*by, "tag", F.floor(o / 62).cast("int").alias("__w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (o % 62).cast("int"))).alias("__bits"))
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(61)), lambda i: F.call_function("shiftright", F.col("__bits"), i).bitwiseAND(F.lit(1).cast("bigint")) == 1))
    each = sets.select(*by, "tag", "__w", bit.alias("__b")).select((F.col("__w") * 62 + F.col("__b")).alias("ordinal"), *by, "tag")
    return hits.groupBy("ordinal", "name", *by).agg(F.count("*").alias("hits")).join(tag_lists(each, key, shown, distinct=True), key).select("ordinal", "name", *by, "hits", "sources", "tags", "more")
