"""Text tables: counts, score tables, substitution scores, options, parameters, mixture groups, profiles.

Parsers take a file's text; readers run them over ``(path, value)`` rows.  A
file that a reader cannot parse gives one row with ``error`` instead of failing
the job where the reader says so.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.alphabet import RESIDUES, SYMBOLS


def data_lines(text: str, comment: str = "#") -> list[str]:
    """Lines that are neither empty nor comments."""
    return [x for x in text.splitlines() if x.strip() and not x.lstrip().startswith(comment)]


def parsed(files: DataFrame, parser: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """Rows of ``parser`` with their ``path``; a text it rejects gives one row of nulls with ``error``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, value in zip(frame["path"], frame["value"], strict=True):
                try:
                    rows += [(path, *r, None) for r in parser(value)]
                except (ValueError, IndexError, KeyError) as e:
                    rows.append((path, *(None for _ in names), str(e)))
            yield pd.DataFrame(rows, columns=["path", *names, "error"], dtype=object)

    return files.mapInPandas(run, f"path string, {schema}, error string")


def readable(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that were read, and the skipped files with reasons."""
    return table.where("error is null").drop("error"), table.where("error is not null").select("path", "error")


def parse_counts(text: str) -> list[tuple]:
    """A count file to (a, b, n): b is -1 for residue counts, else a pair's second residue."""
    lines = data_lines(text.split("//")[0])
    if len(lines) < RESIDUES + 1:
        raise ValueError("too few lines of counts")
    out = []
    for k, line in enumerate(lines[: RESIDUES + 1]):
        values = [float(x) for x in line.split()]
        if len(values) != RESIDUES or min(values) < 0:
            raise ValueError("a line of counts needs 20 numbers that are not negative")
        out += [(k - 1, m, v) if k else (m, -1, v) for m, v in enumerate(values)]
    return out


COUNTS = "a int, b int, n double"


def render_counts(residues: dict[int, float], pairs: dict[tuple[int, int], float]) -> str:
    head = " ".join(f"{SYMBOLS[a]:>15}" for a in range(RESIDUES))
    row = lambda values: "".join(f" {v:15.4f}" for v in values)
    body = "\n".join(row(pairs.get((a, b), 0.0) for b in range(RESIDUES)) for a in range(RESIDUES))
    return f"## Residue counts\n##{head}\n{row(residues.get(a, 0.0) for a in range(RESIDUES))}\n## Pair counts\n##\n{body}\n//\n"


def render_scores(scores: list[list[float]], background: list[float], targets: list[list[float]], scale: float, parameters: dict[str, float]) -> str:
    """Substitution scores as whole numbers of 1 / scale bits, with probabilities and statistical parameters."""
    shown = SYMBOLS[: len(scores)]
    head = [f"## Scores in 1/{round(scale)} bit units", "     " + ", ".join(f"{k} = {v:.4f}" for k, v in parameters.items()), "# " + "   ".join(shown)]
    body = ["".join(f" {int(round(scale * v)):3d}" for v in row) for row in scores]
    probs = "".join(f" {v:8.6f}" for v in background)
    pairs = ["".join(f" {v:8.6f}" for v in row) for row in targets]
    return "\n".join([*head, *body, "## Background probabilities", probs, "## Target frequencies", *pairs, "//"]) + "\n"


def parse_scores(text: str) -> list[tuple]:
    """A score file to (kind, a, b, value): kinds ``score``, ``background``, ``target`` and the parameters' names."""
    lines = data_lines(text.split("//")[0])
    parameters = [("parameter:" + k.strip(), -1, -1, float(v)) for part in lines[0].split(",") for k, v in [part.split("=")]]
    rows = [[float(x) for x in line.split()] for line in lines[1:]]
    size = len(rows[0])
    if len(rows) != size + 1 + RESIDUES or any(len(r) != size for r in rows[:size]) or any(len(r) != RESIDUES for r in rows[size:]):
        raise ValueError("a row of the wrong length")
    out = [("score", a, b, v) for a, row in enumerate(rows[:size]) for b, v in enumerate(row)]
    out += [("background", a, -1, v) for a, v in enumerate(rows[size])]
    return parameters + out + [("target", a, b, v) for a, row in enumerate(rows[size + 1 :]) for b, v in enumerate(row)]


SCORES = "kind string, a int, b int, value double"


def parse_contexts(text: str) -> list[tuple]:
    """Context windows of frequencies, one window of rows between lines of ``*``: (window, row, residue, values)."""
    out, window, row = [], 0, 0
    for line in data_lines(text):
        words = line.split()
        if words == ["*"]:
            window, row = window + 1, 0
            continue
        if len(words[0]) != 1 or words[0].upper() not in SYMBOLS:
            raise ValueError(f"no residue: {words[0]}")
        out.append((window, row, words[0], [float(x) for x in words[1:]]))
        row += 1
    return out


CONTEXTS = "context int, row int, residue string, x array<double>"


def profile_dump(p: Profile) -> str:
    """A profile for reading: for each position log-odds, frequencies in percent, gap weight and information."""
    lines = [" " * 8 + "".join(f"{c:>5}" for c in SYMBOLS[:RESIDUES]) + "".join(f"{c:>4}" for c in SYMBOLS[:RESIDUES]) + "  gaps  info"]
    for i, residue in enumerate(p.residues):
        odds = "".join(f"{v:5.1f}" for v in p.scores[i][:RESIDUES])
        shares = "".join(f"{round(100 * v):4d}" for v in p.freqs[i][:RESIDUES])
        lines.append(f"{i + 1:5d} {residue} {odds}{shares} {p.weight[i]:5.2f} {p.information[i]:5.2f}")
    return "\n".join(lines) + "\n"


def parse_score_table(text: str) -> list[tuple]:
    """A triangular table to (row, col, score), rows and columns from 0; NA gives a null score."""
    lines = data_lines(text)
    head = next((i for i, x in enumerate(lines) if "Cardinality =" in x), None)
    if head is None:
        raise ValueError("no cardinality")
    size = int(lines[head].split("=")[1])
    rows = [x.split() for x in lines[head + 1 :]]
    if not 0 < size <= 4000 or len(rows) < size or any(len(r) <= i for i, r in enumerate(rows[:size])):
        raise ValueError("short of scores")
    return [(i, j, None if rows[i][j] == "NA" else float(rows[i][j])) for i in range(size) for j in range(i + 1)]


SCORE_TABLE = "row int, col int, score double"


def render_score_table(size: int, scores: dict[tuple[int, int], float | None]) -> str:
    cell = lambda v: f"{'NA':>9}" if v is None else f"{v:9.4f}"
    return f"Cardinality = {size}\n" + "".join("".join(cell(scores.get((i, j))) for j in range(i + 1)) + "\n" for i in range(size))


def parse_levels(text: str) -> list[tuple]:
    """Rows of ``LEVEL_TABLE`` of one file of a set of tables chosen by levels.

    The first line is ``name<e_low>_<e_high>= p1 p2 ... + s1 s2 ...``, both lists in
    hundredths.  Then each table: a line ``p_low p_high s_low s_high`` in
    hundredths, a line ``Cardinality = n`` (rows up to the diagonal follow) or
    ``Cardinality = n x m`` (whole rows), and its rows, ``NA`` for a missing cell.
    """
    lines = data_lines(text)
    head = re.fullmatch(r"\s*\w*?(\d+(?:\.\d+)?)_(\d+(?:\.\d+)?)\s*=([\d.\s]*)\+([\d.\s]*)", lines[0]) if lines else None
    if not head:
        raise ValueError("no levels")
    e = float(head[1]), float(head[2])
    known = [{float(x) / 100 for x in head[k].split()} for k in (3, 4)]
    out, at = [], 1
    while at < len(lines):
        own = [float(x) / 100 for x in lines[at].split()]
        size = re.fullmatch(r"\s*Cardinality\s*=\s*(\d+)(?:\s*x\s*(\d+))?\s*", lines[at + 1]) if at + 1 < len(lines) else None
        if len(own) != 4 or not size or not set(own[:2]) <= known[0] or not set(own[2:]) <= known[1]:
            raise ValueError(f"no table at line {at + 1}")
        n, m = int(size[1]), int(size[2]) if size[2] else None
        rows = [x.split() for x in lines[at + 2 : at + 2 + n]]
        if len(rows) < n or any(len(r) != (m or i + 1) for i, r in enumerate(rows)):
            raise ValueError("short of scores")
        out += [(*e, *own, i, j, None if x == "NA" else float(x)) for i, r in enumerate(rows) for j, x in enumerate(r)]
        at += 2 + n
    return out


LEVEL_TABLE = "e_low double, e_high double, p_low double, p_high double, s_low double, s_high double, row int, col int, score double"


def render_levels(rows: list[tuple], name: str = "scores") -> dict[tuple[float, float], str]:
    """A set of tables, rows as ``parse_levels`` gives them, to the text of each pair of levels of effective sequences."""
    sets: dict[tuple[float, float], dict[tuple[float, ...], dict[tuple[int, int], float | None]]] = {}
    for r in rows:
        sets.setdefault(tuple(r[:2]), {}).setdefault(tuple(r[2:6]), {})[r[6], r[7]] = r[8]
    number = lambda x: f"{x:g}"
    cell = lambda x: f"{'NA':>9}" if x is None else f" {x:.17g}"
    out = {}
    for e, tables in sets.items():
        known = [sorted({k[i] for k in tables} | {k[i + 1] for k in tables}) for i in (0, 2)]
        text = f"{name}{number(e[0])}_{number(e[1])}= {' '.join(number(100 * x) for x in known[0])} +{' '.join(number(100 * x) for x in known[1])}\n"
        for key, cells in tables.items():
            n, m = 1 + max(i for i, _ in cells), 1 + max(j for _, j in cells)
            triangle = all(j <= i for i, j in cells)
            text += " ".join(number(100 * x) for x in key) + f"\nCardinality = {n}" + ("\n" if triangle else f" x {m}\n")
            text += "".join("".join(cell(cells.get((i, j))) for j in range(i + 1 if triangle else m)) + "\n" for i in range(n))
        out[e] = text
    return out


def parse_context_scores(text: str, step: float = 0.5, reach: int = 2) -> list[tuple]:
    """A map of context scores to (key, score): missing keys take the one before, then a moving mean over 2 * reach + 1."""
    lines = data_lines(text)
    at = next((i for i, x in enumerate(lines) if "Cardinality =" in x), None)
    if at is None:
        raise ValueError("no cardinality")
    size = int(lines[at].split("=")[1])
    numbers = [float(x) for line in lines[at + 1 :] for x in line.split()]
    if len(numbers) < 2 * size:
        raise ValueError("short of scores")
    known = dict(zip(numbers[:size], numbers[size : 2 * size], strict=True))
    keys, now = [], numbers[0]
    while now <= numbers[size - 1] + 1e-9:
        keys.append(round(now, 6))
        now += step
    filled, last = [], known[numbers[0]]
    for k in keys:
        last = known.get(k, last)
        filled.append(last)
    return [(k, sum(filled[max(0, i - reach) : i + reach + 1]) / len(filled[max(0, i - reach) : i + reach + 1])) for i, k in enumerate(keys)]


CONTEXT_SCORES = "key double, score double"


def parse_ini(text: str) -> list[tuple]:
    """(section, key, value) of an INI text; ``#`` begins a comment anywhere."""
    section, out = "", []
    for raw in text.splitlines():
        line = raw.split("#")[0].strip()
        if m := re.fullmatch(r"\[(\w+)\]", line):
            section = m[1]
        elif "=" in line:
            key, value = line.split("=", 1)
            out.append((section, key.strip(), value.strip()))
    return out


INI = "section string, key string, value string"


def render_ini(rows: list[tuple[str, str, str]]) -> str:
    out, section = [], None
    for s, k, v in rows:
        if s != section:
            out.append(f"[{s}]")
            section = s
        out.append(f"{k} = {v}")
    return "\n".join(out) + "\n"


@dataclass(frozen=True)
class Options:
    """Search and construction options with their checks; unknown keys are rejected."""

    EVAL: float = 10.0
    NOHITS: int = 700
    NOALNS: int = 700
    SHOW: int = 1
    IDENTITY: int = 90
    PCFWEIGHT: float = 1.5
    MINALNFRN: int = 5
    MINALNPOS: int = 10
    SUBMAT: str = "Gonnet"
    SCOADJ: str = "no"
    SUPCLT: int = 5
    ADJWGT: float = 0.33
    MINPP: float = 0.28
    HCWINDOW: int = 12
    HCLOWENT: float = 3.3
    HCHIGHENT: float = 3.5
    INFCON: float = 0.17
    HSPMINSCORE: int = 0
    MASKAFTER: int = 0
    _ranges: dict = field(
        default_factory=lambda: {
            "EVAL": (0, None), "NOHITS": (1, None), "NOALNS": (1, None), "SHOW": (0, 1), "IDENTITY": (1, 100), "MINALNFRN": (1, 100),
            "MINALNPOS": (1, None), "ADJWGT": (0, 1), "MINPP": (0, 1), "HSPMINSCORE": (0, None),
        },
        repr=False,
        compare=False,
    )

    @classmethod
    def read(cls, text: str) -> Options:
        given = {}
        for section, key, value in parse_ini(text):
            if section == "OPTIONS":
                kind = type(getattr(cls, key, None))
                if kind is type(None) or key.startswith("_"):
                    raise ValueError(f"unknown option {key}")
                given[key] = kind(value)
        out = cls(**given)
        for key, (low, high) in out._ranges.items():
            v = getattr(out, key)
            if low is not None and v < low or high is not None and v > high:
                raise ValueError(f"{key} = {v} is out of range")
        return out


def parse_groups(text: str) -> list[tuple]:
    """Mixture groups to (group, table, dish, context rows flattened): groups, tables and samples end in ////, ;; and *."""
    group = table = dish = None
    values: list[float] = []
    out = []
    for line in data_lines(text):
        word = line.strip()
        if m := re.match(r"Group\s+(-?\d+);", word):
            group = int(m[1])
        elif m := re.match(r"Table\s+\d+\s+\(Id =\s*(-?\d+);\s*Dish id =\s*(-?\d+)\)", word):
            table, dish = int(m[1]), int(m[2])
        elif word == "*":
            if table is None:
                raise ValueError("a sample outside a table")
            out.append((group, table, dish, values))
            values = []
        elif word == ";;":
            table = None
        elif word == "////":
            group = None
        elif table is not None:
            values = values + [float(x) for x in word.split()]
    return out


GROUPS = "group_id long, table_id long, dish_id long, x array<double>"


def render_groups(rows: list[tuple[int, int, int, list[float]]]) -> str:
    """The text of ``parse_groups``, from rows in any order."""
    tree: dict[int, dict[tuple[int, int], list[list[float]]]] = {}
    for g, t, d, x in rows:
        tree.setdefault(g, {}).setdefault((t, d), []).append(x)
    dishes = {d for _, _, d, _ in rows}
    out = [f"Number of groups = {len(tree)}; Number of dishes = {len(dishes)}; Total number of samples = {len(rows)}; Context length = 1"]
    for g, tables in sorted(tree.items()):
        out.append(f"Group {g}; Number of tables = {len(tables)}")
        for i, ((t, d), samples) in enumerate(sorted(tables.items())):
            out.append(f"Table {i} (Id = {t}; Dish id = {d}); Number of samples = {len(samples)}")
            for x in samples:
                out += [" ".join(f"{v:.9g}" for v in x), "*"]
            out.append(";;")
        out.append("////")
    return "\n".join(out) + "\n"


@dataclass
class Profile:
    """A profile as its text form has it; ``scale`` is the factor of fixed-point numbers."""

    description: str
    name: str
    sequences: int
    effective: float
    background: list[float]
    posterior: list[float]
    begin: list[float]
    begin_expected: list[float]
    residues: str
    scores: list[list[float]]
    freqs: list[list[float]]
    moves: list[list[float]]
    expected: list[list[float]]
    weight: list[float]
    information: list[float]
    clusters: list[list[tuple[int, float]]]
    context: list[tuple[float, float, list[float]] | None]
    states: list[tuple[str, float, float, float] | None]
    footer: dict[str, float] = field(default_factory=dict)
    scale: int = 65536


INT_SCALE, STATE_SCALE, COLUMNS, MOVES = 1000, 10000, 25, 9


def render_profile(p: Profile, title: str = "Profile v1.0") -> str:
    """Fixed-point text: header, background, then for each position scores, frequencies, moves, expectations and optional blocks."""
    num = lambda values, scale=p.scale: " ".join(f"{int(round(v * scale)):7d}" for v in values)
    out = [title, f"DESC:    {p.description}", f"FILE:    {p.name}", "CMD:     ", f"LEN:     {len(p.residues)}", f"NOS:     {p.sequences}"]
    out += [f"EFFNOS:  {p.effective:.1f}", f"SCALE:   {p.scale}", "# scores / frequencies / moves / expectations / clusters / context / states"]
    out += [" " * 9 + "".join(f" {c:>7}" for c in SYMBOLS), f"   NULL   {num(p.background)}", f"   POST   {num(p.posterior)}"]
    out += [f"{'':10}{num(p.begin)}", f"{'':10}{num(p.begin_expected, INT_SCALE)}"]
    for i, residue in enumerate(p.residues):
        out.append(f"{i + 1:5d} {residue}   {num(p.scores[i])}")
        out += [f"{'':10}{num(p.freqs[i])}", f"{'':10}{num(p.moves[i])}"]
        out.append(f"{'':10}{num(p.expected[i], INT_SCALE)} {num([p.weight[i], p.information[i]])}")
        shown = p.clusters[i]
        out.append(f"{'':10}{num([sum(v for _, v in shown)])} {len(shown):7d}")
        if shown:
            out += [f"{'':10}{num([v for _, v in shown])}", f"{'':10}" + " ".join(f"{k:7d}" for k, _ in shown)]
        if p.context[i]:
            prior, norm, vec = p.context[i]
            out.append(f"{'':7}CV: {num([prior, norm], INT_SCALE)} {len(vec)} {num(vec, INT_SCALE)}")
        if p.states[i]:
            state, *probs = p.states[i]
            out.append(f"{'':7}SS:{state} {num(probs, STATE_SCALE)}")
    out += [f"{k} = {v:.6f}" for k, v in p.footer.items()]
    return "\n".join(out) + "\n*\n"


def parse_profile(text: str) -> Profile:
    """The inverse of ``render_profile``, up to fixed-point rounding; any first line ending in ``v<version>`` is taken."""
    lines = [x for x in text.splitlines() if not x.startswith("#")]
    if not lines or not re.search(r"v\d+(\.\d+)*\s*$", lines[0]):
        raise ValueError("not a profile")
    head = {m[1]: m[2].strip() for x in lines[1:8] if (m := re.match(r"(\w+):(.*)", x))}
    missing = {"LEN", "NOS", "EFFNOS", "SCALE"} - set(head)
    if missing:
        raise ValueError(f"no {', '.join(sorted(missing))} in the header")
    scale, size = int(head["SCALE"]), int(head["LEN"])
    at = next(i for i, x in enumerate(lines) if x.strip().startswith("NULL"))
    num = lambda words, s=scale: [int(w) / s for w in words]
    p = Profile(
        head.get("DESC", ""), head.get("FILE", ""), int(head["NOS"]), float(head["EFFNOS"]), num(lines[at].split()[1:]), num(lines[at + 1].split()[1:]),
        num(lines[at + 2].split()), num(lines[at + 3].split(), INT_SCALE), "", [], [], [], [], [], [], [], [], [], {}, scale,
    )
    at += 4
    for _ in range(size):
        first = lines[at].split()
        p.residues += first[1]
        p.scores.append(num(first[2:]))
        p.freqs.append(num(lines[at + 1].split()))
        p.moves.append(num(lines[at + 2].split()))
        rest = lines[at + 3].split()
        p.expected.append(num(rest[:3], INT_SCALE))
        p.weight.append(int(rest[3]) / scale)
        p.information.append(int(rest[4]) / scale)
        known = int(lines[at + 4].split()[1])
        at += 5
        p.clusters.append(list(zip(map(int, lines[at + 1].split()), num(lines[at].split()), strict=True)) if known else [])
        at += 2 if known else 0
        p.context.append(None)
        p.states.append(None)
        if lines[at].strip().startswith("CV:"):
            w = lines[at].split()[1:]
            p.context[-1] = (int(w[0]) / INT_SCALE, int(w[1]) / INT_SCALE, num(w[3:], INT_SCALE))
            at += 1
        if lines[at].strip().startswith("SS:"):
            w = lines[at].strip()[3:].split()
            p.states[-1] = (w[0], *num(w[1:], STATE_SCALE))
            at += 1
    if any(len(r) != COLUMNS for r in [*p.scores, *p.freqs]) or any(len(r) != MOVES for r in [*p.moves, p.begin]):
        raise ValueError("a row of the wrong length")
    for x in lines[at:]:
        if x.strip() == "*":
            return p
        if m := re.match(r"(.+) = (-?[\d.]+)$", x):
            p.footer[m[1]] = float(m[2])
    raise ValueError("no end of the profile")


def profile_rows(text: str) -> list[tuple]:
    """One row for each position: (name, effective, length, pos, residue, scores, freqs, moves, information, state)."""
    p = parse_profile(text)
    return [
        (p.name, p.effective, len(p.residues), i + 1, p.residues[i], p.scores[i], p.freqs[i], p.moves[i], p.information[i], p.states[i] and p.states[i][0])
        for i in range(len(p.residues))
    ]


PROFILE_ROWS = (
    "name string, effective double, length long, pos long, residue string, scores array<double>, freqs array<double>, moves array<double>, "
    "information double, state string"
)


def with_states(positions: DataFrame, predicted: DataFrame) -> DataFrame:
    """Positions with predicted states by ``(profile_id, pos)``; residues must agree in either case, ``*`` agrees with all."""
    found = positions.join(predicted.withColumnRenamed("residue", "_r"), ["profile_id", "pos"], "left")
    agree = F.col("_r").isNull() | F.col("_r").isin("*") | (F.col("residue") == "*") | (F.upper("_r") == F.upper("residue"))
    return found.where(F.when(~agree, F.raise_error(F.lit("residues of prediction and profile differ")).cast("boolean")).otherwise(F.lit(True))).drop("_r")
