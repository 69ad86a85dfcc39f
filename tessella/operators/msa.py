"""Column statistics of multiple alignments.

An alignment is a table of cells ``(msa_id, seq_id, pos, code)``: one row for
each sequence and column, gaps included.  The sequence with the least id is the
query.  Group sizes are those of single alignments; no step gathers more than
one column of one alignment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import alphabet as A

PSEUDO_COUNTS = 120.0
LEAST_LENGTH = 30
OCCUPANCY = 400
#: The weight of pseudo-frequencies is NUMERATOR / n ** EXPONENT, at most 1.
NUMERATOR, EXPONENT = 0.65, 0.90
#: Fixed values of the weight by entropy, which first mixes in two counts of the background.
ENTROPY_NUMERATOR, ENTROPY_EXPONENT, ENTROPY_LEAST, ENTROPY_COUNTS = 0.0806, 0.53, 0.0001, 2.0


def cells(sequences: DataFrame) -> DataFrame:
    """``(msa_id, seq_id, seq)`` to cells; shorter rows of an alignment are filled up with gaps."""
    width = F.max(F.length("seq")).over(Window.partitionBy("msa_id"))
    full = sequences.withColumn("seq", F.coalesce("seq", F.lit(""))).withColumn("seq", F.rpad("seq", width, A.SYMBOLS[A.GAP]))
    parts = full.where(F.length("seq") > 0).select("msa_id", "seq_id", F.posexplode(F.split("seq", "")).alias("pos", "symbol"))
    return parts.select("msa_id", "seq_id", (F.col("pos") + 1).alias("pos"), A.encode(F.col("symbol")).alias("code"))


def sequences(table: DataFrame) -> DataFrame:
    """Cells to ``(msa_id, seq_id, seq)``."""
    by = table.groupBy("msa_id", "seq_id").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("c"))
    return by.select("msa_id", "seq_id", F.array_join(F.transform("c", lambda x: A.decode(x["code"])), "").alias("seq"))


def trimmed(table: DataFrame) -> DataFrame:
    """Cells with ``used``: false before a sequence's first and after its last residue, the query exempt."""
    own = Window.partitionBy("msa_id", "seq_id")
    residue = F.when(A.is_residue(F.col("code")), F.col("pos"))
    inside = F.coalesce(F.col("pos").between(F.min(residue).over(own), F.max(residue).over(own)), F.lit(False))
    queries = table.groupBy("msa_id").agg(F.min("seq_id").alias("_query"))
    marked = table.join(queries, "msa_id").withColumn("used", (F.col("seq_id") == F.col("_query")) | inside)
    return marked.select(*table.columns, "used")


def column_counts(table: DataFrame) -> DataFrame:
    """Sequences, residues and different residues of each column that has a residue."""
    residue = A.is_residue(F.col("code"))
    return (
        table.groupBy("msa_id", "pos")
        .agg(
            F.count("*").alias("n_sequences"),
            F.count_if(residue).alias("n_residues"),
            F.count_distinct(F.when(residue, F.col("code"))).alias("n_distinct"),
        )
        .where("n_residues > 0")
    )


def without_gappy_columns(table: DataFrame, most: float) -> DataFrame:
    """Cells of columns with a share of gaps below ``most``."""
    share = F.avg(F.when(F.col("code") == A.GAP, 1.0).otherwise(0.0)).over(Window.partitionBy("msa_id", "pos"))
    return table.withColumn("gap_share", share).where(F.col("gap_share") < most)


def match_states(table: DataFrame) -> DataFrame:
    """Columns in which the query has a residue other than X: ``(msa_id, pos, code, state)``, states from 1."""
    query = F.col("seq_id") == F.min("seq_id").over(Window.partitionBy("msa_id"))
    found = table.withColumn("q", query).where("q").where(A.is_residue(F.col("code")) & (F.col("code") != A.X))
    return found.select("msa_id", "pos", "code", F.row_number().over(Window.partitionBy("msa_id").orderBy("pos")).cast("long").alias("state"))


def shared_codes(code: Column) -> Column:
    """A symbol as an array of (code, weight): B and Z count half for each of their two residues."""
    one = lambda c, w: F.struct(F.lit(c).cast("int").alias("code"), F.lit(w).alias("w"))
    return (
        F.when(code == A.B, F.array(one(A.N, 0.5), one(A.D, 0.5)))
        .when(code == A.Z, F.array(one(A.Q, 0.5), one(A.E, 0.5)))
        .when(code < A.RESIDUES, F.array(F.struct(code.cast("int").alias("code"), F.lit(1.0).alias("w"))))
    )


def residue_table(spark) -> DataFrame:
    """``(code, bg)`` of the 20 residues."""
    return spark.range(A.RESIDUES).select(F.col("id").cast("int").alias("code"), A.background(F.col("id")).alias("bg"))


def query_background(table: DataFrame, pseudo: float = PSEUDO_COUNTS) -> DataFrame:
    """Residue probabilities of each query row, blended with ``pseudo`` counts of the background."""
    seen = match_states(table).select("msa_id", F.explode(shared_codes(F.col("code"))).alias("s"))
    counts = seen.groupBy("msa_id", F.col("s.code").alias("code")).agg(F.sum("s.w").alias("n"))
    whole = table.select("msa_id").distinct()
    grid = whole.crossJoin(F.broadcast(residue_table(table.sparkSession)))
    n = F.coalesce("n", F.lit(0.0))
    total = F.sum(n).over(Window.partitionBy("msa_id"))
    weight = pseudo / (2 * total + pseudo)
    prob = (1 - weight) * n / F.greatest(total, F.lit(0.5)) + weight * F.col("bg")
    return grid.join(counts, ["msa_id", "code"], "left").select("msa_id", "code", prob.alias("prob"))


def sequence_weights(table: DataFrame) -> DataFrame:
    """Position-based weights: in each match column a residue's weight is shared by its bearers; sums to 1 per alignment."""
    states = match_states(table).select("msa_id", "pos")
    residues = table.join(states, ["msa_id", "pos"]).where(A.is_residue(F.col("code")))
    each = residues.groupBy("msa_id", "pos", "code").agg(F.count("*").alias("n"))
    kinds = F.least(F.count("*").over(Window.partitionBy("msa_id", "pos")), F.lit(A.RESIDUES))
    share = each.select("msa_id", "pos", "code", (1.0 / (F.col("n") * kinds)).alias("w"))
    raw = residues.join(share, ["msa_id", "pos", "code"]).groupBy("msa_id", "seq_id").agg(
        (F.sum("w") / F.greatest(F.count("*") + 1, F.lit(LEAST_LENGTH))).alias("w")
    )
    return raw.select("msa_id", "seq_id", (F.col("w") / F.sum("w").over(Window.partitionBy("msa_id"))).alias("weight"))


def match_frequencies(table: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted residue frequencies of match columns, ambiguous symbols shared: ``(msa_id, pos, code, freq, n)``.

    ``n`` is the number of residues of the column; a column whose residues all
    are X has no rows.
    """
    states = match_states(table).select("msa_id", "pos")
    used = table.join(states, ["msa_id", "pos"]).where(A.is_residue(F.col("code"))).join(weights, ["msa_id", "seq_id"])
    n = F.count("*").over(Window.partitionBy("msa_id", "pos"))
    parts = used.withColumn("n", n).select("msa_id", "pos", "n", "weight", F.explode(shared_codes(F.col("code"))).alias("s"))
    sums = parts.groupBy("msa_id", "pos", "n", F.col("s.code").alias("code")).agg(F.sum(F.col("weight") * F.col("s.w")).alias("f"))
    return sums.select("msa_id", "pos", "code", (F.col("f") / F.sum("f").over(Window.partitionBy("msa_id", "pos"))).alias("freq"), "n")


def pseudo_weight(kind: str, beta: float = 10.0) -> Column:
    """Weight of pseudo-frequencies of a column with ``n`` residues, ``kinds`` of them different, and ``entropy`` bits.

    ``power``: NUMERATOR / n ** EXPONENT.  ``fixed``: beta against kinds - 1
    observations.  ``entropy``: falls with the relative entropy of the column.
    """
    if kind == "fixed":
        return beta / (F.greatest(F.col("kinds") - 1.0, F.lit(0.0)) + beta)
    if kind == "entropy":
        power = ENTROPY_NUMERATOR / F.pow(F.col("entropy"), F.lit(ENTROPY_EXPONENT))
        return F.when(F.col("entropy") > ENTROPY_LEAST, F.least(power, F.lit(1.0))).otherwise(1.0)
    return F.least(F.lit(NUMERATOR) / F.pow(F.col("n").cast("double"), F.lit(EXPONENT)), F.lit(1.0))


def target_frequencies(freqs: DataFrame, ratios: DataFrame | None = None, kind: str = "power", beta: float = 10.0) -> DataFrame:
    """Frequencies with pseudo-frequencies mixed in, for all 20 residues: ``(msa_id, pos, code, target, bg)``.

    ``ratios(code, other, ratio)`` are joint over independent probabilities of
    residue pairs; without them pseudo-frequencies are the background.  ``kind``
    names the weight (see ``pseudo_weight``).
    """
    spark = freqs.sparkSession
    base = residue_table(spark)
    columns = freqs.select("msa_id", "pos", "n").distinct().crossJoin(F.broadcast(base))
    grid = columns.join(freqs.drop("n"), ["msa_id", "pos", "code"], "left").withColumn("freq", F.coalesce("freq", F.lit(0.0)))
    column = Window.partitionBy("msa_id", "pos")
    mixed = (F.col("freq") * F.col("n") + ENTROPY_COUNTS * F.col("bg")) / (F.col("n") + ENTROPY_COUNTS)
    if kind == "entropy":
        grid = grid.withColumn("entropy", F.greatest(F.lit(0.0), F.sum(mixed * F.log2(mixed / F.col("bg"))).over(column)))
    if kind == "fixed":
        grid = grid.withColumn("kinds", F.count_if(F.col("freq") > 0).over(column))
    alpha = pseudo_weight(kind, beta)
    if ratios is None:
        pseudo = grid.withColumn("pseudo", F.col("bg"))
    else:
        mixed = (
            freqs.join(ratios.withColumnRenamed("other", "c").withColumnRenamed("code", "a"), F.col("code") == F.col("c"))
            .groupBy("msa_id", "pos", F.col("a").alias("code"))
            .agg(F.sum(F.col("freq") * F.col("ratio")).alias("r"))
        )
        pseudo = grid.join(mixed, ["msa_id", "pos", "code"], "left").withColumn("pseudo", F.col("bg") * F.coalesce("r", F.lit(0.0)))
    return pseudo.select("msa_id", "pos", "code", (alpha * F.col("pseudo") + (1 - alpha) * F.col("freq")).alias("target"), "bg")


def information(targets: DataFrame) -> DataFrame:
    """Information of each column in bits, at least 0."""
    bits = F.sum(F.when(F.col("target") > 0, F.col("target") * F.log2(F.col("target") / F.col("bg"))))
    return targets.groupBy("msa_id", "pos").agg(F.greatest(F.lit(0.0), bits).alias("information"))


def log_odds(targets: DataFrame, lam: float) -> DataFrame:
    """``score`` = ln(target / bg) / lambda; null where the target is 0."""
    return targets.withColumn("score", F.when(F.col("target") > 0, F.ln(F.col("target") / F.col("bg")) / lam))


def profile_probabilities(targets: DataFrame) -> DataFrame:
    """Column means of the targets by profile, normalised: ``(msa_id, code, prob)``."""
    mean = targets.groupBy("msa_id", "code").agg(F.avg("target").alias("m"))
    return mean.select("msa_id", "code", (F.col("m") / F.sum("m").over(Window.partitionBy("msa_id"))).alias("prob"))


def expected_kinds(freqs: DataFrame) -> DataFrame:
    """exp(entropy) of each column's frequencies: the expected number of different residues."""
    return freqs.groupBy("msa_id", "pos").agg(F.exp(-F.sum(F.col("freq") * F.ln("freq"))).alias("kinds"))


def occupancy(spark, size: int = OCCUPANCY) -> DataFrame:
    """``(n, kinds)``: expected number of different residues among n draws from the background."""
    total = sum((F.pow(F.lit(1.0 - p), F.col("n")) for p in A.BACKGROUND), start=F.lit(0.0))
    return spark.range(size).select(F.col("id").alias("n")).select("n", (A.RESIDUES - total).alias("kinds"))


def effective_sequences(freqs: DataFrame) -> DataFrame:
    """By alignment: the median over columns of the number of draws that shows as many different residues.

    The number of draws is read from ``occupancy`` with linear interpolation,
    rounded half-even; an even number of columns averages the two middle ones.
    """
    table = occupancy(freqs.sparkSession)
    step = table.select(
        "n", "kinds", F.lag("kinds").over(Window.orderBy("n")).alias("below")
    ).where("below is not null")
    kinds = expected_kinds(freqs)
    first = F.min(F.when(F.col("k.kinds") > F.col("c.kinds"), F.struct("k.n", "k.kinds", "k.below")))
    found = kinds.alias("c").crossJoin(F.broadcast(step.alias("k"))).groupBy("c.msa_id", "c.pos", "c.kinds").agg(first.alias("f"))
    draws = F.when(F.col("f").isNull(), F.lit(float(OCCUPANCY))).otherwise(
        F.col("f.n") - (F.col("f.kinds") - F.col("kinds")) / (F.col("f.kinds") - F.col("f.below"))
    )
    return found.select("msa_id", F.rint(draws).alias("n")).groupBy("msa_id").agg(F.median("n").alias("effective"))


def transitions(table: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted counts of moves between match, insert and delete states along each sequence.

    A match column is M with a residue and D without; another column is I with
    a residue and nothing without.  ``pos`` is the last match column before the
    move; 0 is the begin state.
    """
    states = match_states(table).select("msa_id", "pos", F.lit(True).alias("is_match"))
    seen = trimmed(table).where("used").join(states, ["msa_id", "pos"], "left")
    kind = (
        F.when(F.col("is_match") & A.is_residue(F.col("code")), "M")
        .when(F.col("is_match"), "D")
        .when(A.is_residue(F.col("code")), "I")
    )
    walk = Window.partitionBy("msa_id", "seq_id").orderBy("pos")
    moves = seen.withColumn("kind", kind).where("kind is not null")
    moves = moves.withColumns(
        {
            "before": F.lag("kind").over(walk),
            "at": F.max(F.when(F.col("is_match"), F.col("pos"))).over(walk.rowsBetween(Window.unboundedPreceding, -1)),
        }
    ).where("before is not null")
    return (
        moves.join(weights, ["msa_id", "seq_id"])
        .groupBy("msa_id", F.coalesce("at", F.lit(0)).alias("pos"), F.col("before").alias("from_state"), F.col("kind").alias("to_state"))
        .agg(F.sum("weight").alias("weight"))
    )


#: Default Dirichlet parameters of moves, by state left and state entered.
PRIOR = {"MM": 0.7939, "MI": 0.0278, "MD": 0.0135, "IM": 0.1551, "II": 0.1331, "ID": 0.0200, "DM": 0.9002, "DI": 0.0300, "DD": 0.5630}


def posterior_means(counts: DataFrame, by: list[str], states: list[tuple[str, float]], strength: float = 1.0) -> DataFrame:
    """(strength * count + alpha) / sum over ``states`` of the same, for groups ``by`` of ``counts(by..., state, n)``."""
    spark = counts.sparkSession
    prior = F.broadcast(spark.createDataFrame(states, "state string, alpha double"))
    grid = counts.select(*by).distinct().crossJoin(prior).join(counts, [*by, "state"], "left")
    raw = strength * F.coalesce("n", F.lit(0.0)) + F.col("alpha")
    return grid.select(*by, "state", (raw / F.sum(raw).over(Window.partitionBy(*by))).alias("prob"))


def build_profile(table: DataFrame, lam: float, ratios: DataFrame | None = None) -> DataFrame:
    """Alignment to profile: weights, frequencies, targets, log-odds for each match column and residue."""
    targets = target_frequencies(match_frequencies(table, sequence_weights(table)), ratios)
    return log_odds(targets, lam)
