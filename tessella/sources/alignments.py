"""Alignment files: FASTA, STOCKHOLM 1.0, search reports; readers give ``(msa_id, seq_id, title, seq)``."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.alphabet import GAP, SYMBOLS

ROWS = "msa_id string, seq_id long, title string, seq string"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, value)``: one row for each file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def fasta(files: DataFrame) -> DataFrame:
    """FASTA texts ``(path, value)`` to rows; white space inside sequences is skipped, text before the first title too.

    Rows of one file must have equal lengths; a file whose rows differ raises.
    An empty file gives no rows.
    """
    parts = files.select(F.col("path").alias("msa_id"), F.posexplode(F.split(F.concat(F.lit("\n"), "value"), "\n>")).alias("seq_id", "record"))
    rows = parts.where("seq_id > 0").select(
        "msa_id",
        (F.col("seq_id") - 1).cast("long").alias("seq_id"),
        F.trim(F.regexp_extract("record", "^([^\\n\\r]*)", 1)).alias("title"),
        F.regexp_replace(F.regexp_replace("record", "^[^\\n]*", ""), "\\s+", "").alias("seq"),
    )
    width = F.max(F.length("seq")).over(Window.partitionBy("msa_id"))
    unequal = F.raise_error(F.concat(F.lit("rows of different lengths in "), "msa_id")).cast("string")
    checked = rows.withColumn("_width", width)
    return checked.withColumn("seq", F.when(F.length("seq") == F.col("_width"), F.col("seq")).otherwise(unequal)).drop("_width")


def without_query_gaps(rows: DataFrame) -> DataFrame:
    """Rows without the columns in which the first row has a gap."""
    first = F.first("seq").over(Window.partitionBy("msa_id").orderBy("seq_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    pairs = F.arrays_zip(F.split("seq", "").alias("c"), F.split(first, "").alias("q"))
    return rows.withColumn("seq", F.array_join(F.transform(F.filter(pairs, lambda x: x["q"] != "-"), lambda x: x["c"]), ""))


def to_fasta(rows: DataFrame, width: int = 60) -> DataFrame:
    """Each alignment as one FASTA text ``(msa_id, value)``, lines of ``width`` symbols."""
    record = F.concat(F.lit(">"), F.coalesce("title", F.lit("")), F.lit("\n"), F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n"), F.lit("\n"))
    listed = F.array_sort(F.collect_list(F.struct("seq_id", record.alias("r"))))
    return rows.groupBy("msa_id").agg(F.array_join(F.transform(listed, lambda x: x["r"]), "").alias("value"))


def parse_stockholm(text: str) -> list[tuple[str, str]]:
    """The first alignment as (title, row), with a query made of its columns' most frequent symbols put first.

    Columns are match columns where the first row has an upper-case letter or
    ``-``; other columns are gaps of the query.  The first row goes to the end.
    Blocks of a name are joined in order; ``.``, ``_`` and ``~`` are gaps.
    """
    names: dict[str, str] = {}
    title = ""
    for line in text.splitlines():
        if line.strip() == "//":
            break
        if m := re.match(r"#=GF\s+(AC|DE)\s+(.*)", line):
            title = f"{title} {m[2]}".strip()
        elif line.strip() and not line.startswith("#"):
            name, _, row = line.strip().partition(" ")
            names[name] = names.get(name, "") + row.strip()
    if not names:
        return []
    rows = list(names.items())
    match = [c.isupper() or c == "-" for c in rows[0][1]]
    clean = [(name, re.sub(r"[._~]", "-", row).upper()) for name, row in rows]
    if len({len(row) for _, row in clean}) > 1:
        raise ValueError("rows of different lengths")
    query = ""
    for k, is_match in enumerate(match):
        seen = Counter(row[k] for _, row in clean if row[k] != SYMBOLS[GAP])
        query += min(seen, key=lambda c: (-seen[c], SYMBOLS.find(c))) if is_match and seen else SYMBOLS[GAP]
    return [(title or rows[0][0], query), *clean[1:], clean[0]]


def stockholm(files: DataFrame) -> DataFrame:
    """STOCKHOLM texts ``(path, value)`` to rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, i, t, s) for p, v in zip(frame["path"], frame["value"], strict=True) for i, (t, s) in enumerate(parse_stockholm(v))]
            yield pd.DataFrame(rows, columns=["msa_id", "seq_id", "title", "seq"])

    return files.mapInPandas(run, ROWS)


def alignments(files: DataFrame) -> DataFrame:
    """Either format, told by the first line."""
    known = F.col("value").startswith("# STOCKHOLM")
    return stockholm(files.where(known)).unionByName(fasta(files.where(~known)))


HIT = "path string, round long, hit string, evalue double, q_beg long, q_end long, s_beg long, s_end long, q_aln string, s_aln string"


def parse_report(text: str) -> list[tuple]:
    """Pairwise alignments of a search report: (round, hit, E, query span, subject span, aligned rows)."""
    out, hit, now, round_ = [], "", None, 0

    def flush() -> None:
        nonlocal now
        if now and now["q"]:
            out.append((now["round"], now["hit"], now["e"], now["qb"], now["qe"], now["sb"], now["se"], now["q"], now["s"]))
        now = None

    for line in text.splitlines():
        if m := re.match(r"Results\s+from\s+round\s+(\d+)", line):
            flush()
            round_ = int(m[1])
        elif line.startswith(">"):
            flush()
            hit = line[1:].strip()
        elif m := re.search(r"Score\s*=.*Expect[^=]*=\s*([0-9.eE+-]+)", line):
            flush()
            value = m[1].rstrip(",")
            now = {"round": round_, "hit": hit, "e": float(f"1{value}" if value.startswith("e") else value), "q": "", "s": "", "qb": None, "qe": 0, "sb": None, "se": 0}
        elif now and (m := re.match(r"(Query|Sbjct):?\s+(\d+)\s*([A-Za-z*-]+)\s+(\d+)", line)):
            k = m[1][0].lower()
            if now[f"{k}b"] is None:
                now[f"{k}b"] = int(m[2])
            now[f"{k}e"] = int(m[4])
            now[k] += m[3].upper()
    flush()
    return out


def report_hits(files: DataFrame) -> DataFrame:
    """Search reports ``(path, value)`` to hits."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, *h) for p, v in zip(frame["path"], frame["value"], strict=True) for h in parse_report(v)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in HIT.split(", ")])

    return files.mapInPandas(run, HIT)


def stacked(hits: DataFrame, query_length: int, most_evalue: float, round_: int | None = None) -> DataFrame:
    """Hits as rows over the query's positions: insertions of the subject are left out, what is not aligned is a gap."""
    kept = hits.where(F.col("evalue") <= most_evalue)
    kept = kept.where(F.col("round") == round_) if round_ is not None else kept

    def placed(q: str, s: str, begin: int) -> str:
        body = "".join(y for x, y in zip(q, s, strict=True) if x != "-")
        return ("-" * (begin - 1) + body).ljust(query_length, "-")

    @F.pandas_udf("string")
    def row(q: pd.Series, s: pd.Series, begin: pd.Series) -> pd.Series:
        return pd.Series([placed(*x) for x in zip(q, s, begin, strict=True)])

    order = F.row_number().over(Window.partitionBy("path").orderBy("evalue", "hit", "q_beg")).cast("long")
    return kept.select(F.col("path").alias("msa_id"), order.alias("seq_id"), F.col("hit").alias("title"), row("q_aln", "s_aln", "q_beg").alias("seq"))
