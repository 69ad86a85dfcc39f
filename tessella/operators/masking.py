"""Masking of alignments and profiles by the complexity of their symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import alphabet as A
from tessella.operators import msa, seg

#: Match columns from either end in which columns are masked.
ENDS = 40
RESIDUE_SYMBOLS = [str(c) for c in range(A.STOP)]


def _masked_cells(table: DataFrame, series: DataFrame, size: int, trigger: float, extension: float, high: bool) -> DataFrame:
    """Codes of ``table`` replaced by X where ``series(id, pos, symbol, msa_id, seq_id, at)`` lies in a segment."""
    entropies = seg.window_entropy(series, size, RESIDUE_SYMBOLS)
    found = seg.segments(entropies, size, trigger, extension, high)
    hidden = seg.masked(series, found).where("masked").select("id", "pos")
    cells = series.join(hidden, ["id", "pos"], "left_semi").select("msa_id", "seq_id", F.col("at").alias("pos"), F.lit(True).alias("_hide"))
    out = table.join(cells, ["msa_id", "seq_id", "pos"], "left")
    return out.withColumn("code", F.when(F.col("_hide"), F.lit(A.X)).otherwise(F.col("code")).cast("int")).drop("_hide")


def mask_sequences(table: DataFrame, size: int = 12, trigger: float = 2.2, extension: float = 2.5) -> DataFrame:
    """Residues in low-complexity segments of each sequence become X; gaps do not count as positions."""
    own = Window.partitionBy("msa_id", "seq_id").orderBy("pos")
    rows = table.where(A.is_residue(F.col("code"))).withColumn("k", F.row_number().over(own).cast("long"))
    series = rows.select(
        F.concat_ws("|", "msa_id", F.col("seq_id").cast("string")).alias("id"), F.col("k").alias("pos"), F.col("code").cast("string").alias("symbol"),
        "msa_id", "seq_id", F.col("pos").alias("at"),
    )
    return _masked_cells(table, series, size, trigger, extension, False)


def mask_columns(table: DataFrame, size: int = 30, trigger: float = 3.5, extension: float = 3.3, ends: int = ENDS) -> DataFrame:
    """Residues in high-complexity stretches down the outer match columns become X; the query stays.

    A column is read by sequence order over its residues other than X.
    """
    states = msa.match_states(table)
    count = F.max("state").over(Window.partitionBy("msa_id"))
    outer = states.withColumn("n", count).where((F.col("state") <= ends) | (F.col("state") > F.col("n") - ends)).select("msa_id", "pos")
    query = F.col("seq_id") == F.min("seq_id").over(Window.partitionBy("msa_id"))
    cells = table.withColumn("q", query).where(~F.col("q") & (F.col("code") < A.X)).join(outer, ["msa_id", "pos"], "left_semi")
    down = Window.partitionBy("msa_id", "pos").orderBy("seq_id")
    series = cells.withColumn("k", F.row_number().over(down).cast("long")).select(
        F.concat_ws("|", "msa_id", F.col("pos").cast("string")).alias("id"), F.col("k").alias("pos"), F.col("code").cast("string").alias("symbol"),
        "msa_id", "seq_id", F.col("pos").alias("at"),
    )
    return _masked_cells(table, series, size, trigger, extension, True)


def mask_profile(positions: DataFrame, size: int = 12, trigger: float = 2.2, extension: float = 2.5, distance: float = 12.96) -> DataFrame:
    """``positions(id, pos, residue, x)``: vectors nearer than ``distance`` are one symbol; positions in low-complexity segments become X.

    A masked position gets the background frequencies and no information.
    """
    series = seg.classified(positions.select("id", "pos", F.col("x").alias("vector")), distance)
    kinds = [str(k) for k in range(series.agg(F.max(F.col("symbol").cast("int")).alias("m")).first()["m"] or 0)]
    entropies = seg.window_entropy(series, size, [*kinds, str(len(kinds))])
    hidden = seg.masked(series, seg.segments(entropies, size, trigger, extension)).select("id", "pos", "masked")
    background = F.array(*map(F.lit, A.BACKGROUND))
    out = positions.join(hidden, ["id", "pos"])
    return out.withColumns(
        {
            "residue": F.when(F.col("masked"), F.lit(A.X)).otherwise(F.col("residue")),
            "x": F.when(F.col("masked"), background).otherwise(F.col("x")),
            "information": F.when(F.col("masked"), F.lit(0.0)),
        }
    )
