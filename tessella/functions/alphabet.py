"""The residue alphabet: codes, checks and background frequencies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 20 residues, then B (N or D), Z (Q or E), X (any), stop and gap; secondary-structure states.
SYMBOLS = "ARNDCQEGHILKMFPSTWYVBZX*-"
STATES = "CEH"
RESIDUES = 20
B, Z, X, STOP, GAP = 20, 21, 22, 23, 24
N, D, Q, E = 2, 3, 5, 6

#: Published background frequencies of the residues, in the order of SYMBOLS.
BACKGROUND = (
    0.07805, 0.05129, 0.04487, 0.05364, 0.01925, 0.04264, 0.06295, 0.07377, 0.02199, 0.05142,
    0.09019, 0.05744, 0.02243, 0.03856, 0.05203, 0.07120, 0.05841, 0.01330, 0.03216, 0.06441,
)


def encode(symbol: Column) -> Column:
    """Code of a one-letter symbol in either case; J, O and U become X, white space a gap, anything else raises."""
    up = F.upper(symbol)
    at = F.instr(F.lit(SYMBOLS), up) - 1
    known = F.when(up.isin("J", "O", "U"), F.lit(X)).when(up.isin(" ", ".", "_", "~"), F.lit(GAP)).when((F.length(up) == 1) & (at >= 0), at)
    return F.coalesce(known, F.raise_error(F.concat(F.lit("not a residue: "), symbol)).cast("int")).cast("int")


def decode(code: Column) -> Column:
    return F.substring(F.lit(SYMBOLS), code + 1, F.lit(1))


def encode_state(symbol: Column) -> Column:
    """Code of a secondary-structure state; -1 for another symbol."""
    return F.instr(F.lit(STATES), F.upper(symbol)) - 1


def decode_state(code: Column) -> Column:
    return F.substring(F.lit(STATES), code + 1, F.lit(1))


def is_residue(code: Column) -> Column:
    """Residues proper and the ambiguous ones."""
    return code < STOP


def background(code: Column) -> Column:
    """Background frequency of a residue's code; 0 for other symbols."""
    return F.coalesce(F.get(F.array(*map(F.lit, BACKGROUND)), code.cast("int")), F.lit(0.0))
