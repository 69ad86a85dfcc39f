"""Secret scans by assignment-aware lexing.

Base spans come from three patterns.  The lexer then reads the assignments of
source and configuration syntax:

* ``name = value``, ``name: value``, ``"name": value``, ``name := value``,
  ``name => value``, ``name: type = value``, ``name ?= value``, ``name ??= value``,
  ``name ||= value``, and a quoted value on the line after;
* ``name += value``, which adds to what the name held before;
* ``name: |`` and ``name: >`` with the indented block below;
* ``#define name value``, ``setenv name value``, ``--name value``;
* ``<name>value</name>``, elements with attributes such as ``key="name"
  value="value"``, and calls such as ``set("name", "value")``.

A value is a sum (``+``, or strings that stand side by side) of literals and
names; a string with names in braces is the sum of its parts.  When all
assignments are known, a name stands for what it was assigned last before, else
first after.  Assignments and these uses are a graph: assignments that lead back
to each other count as one value, and with these drawn together each is looked
at once, so a text costs time in proportion to its length.  What a value is
worth is summed up from its parts: how often it holds each character (those
outside ASCII by their low seven bits), its first characters, and whether all
its words are letters.  Every literal that so reaches a name is scored by how
sensitive the name is and how random the whole value looks.  What is in
comments counts like the rest.

Positions are code points, ends exclusive.  A null text counts as empty;
repeated rows give repeated results; whole texts are read, whatever their
length.  A prefilter passes over texts without any sensitive word, in which letters
may have signs and white space between them as in names; that loses nothing.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "named")
#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")

#: Parts of names and how sensitive they make what they name.
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 2.5, "secret": 3.0, "token": 2.5, "apikey": 3.0, "accesskey": 3.0,
    "privatekey": 3.0, "signingkey": 3.0, "credential": 2.5, "credentials": 2.5, "authkey": 2.5, "encryptionkey": 3.0, "bearer": 2.0,
}
PLACEHOLDERS = frozenset(
    "null none true false undefined nil changeme change_me example placeholder password secret token redacted xxx todo your_password".split()
)
#: Last parts of names that hold something about a secret, not the secret.
ABOUT = frozenset(
    "count name names length len size type kind url uri path file dir field label limit ttl expiry expires expiration timeout max min policy hint id "
    "header param prefix".split()
)
#: Words that stand for a type where a value may stand.
TYPES = frozenset("string str text char varchar bytes byte int integer long short float double bool boolean number any object optional void".split())
LEAST_SCORE = 4.0
LEAST_LENGTH = 6
#: Rows of a batch that are redacted before they are handed on.
ROWS_AT_ONCE = 512
#: First characters that tell a placeholder, all of which are shorter.
HEAD = 24

_GAP = r"[^A-Za-z0-9]*"
#: Every name with a score holds a sensitive word, with nothing but signs and white space (two parts may be joined) between its letters.
_WORDS = "|".join(_GAP.join(f"[{c}{c.upper()}]" for c in w) for w in SENSITIVE)
#: What a text must hold for the lexer or a base pattern to find anything; ``assign`` names are sensitive words themselves.
MAYBE = rf"{_WORDS}|AKIA|[0-9a-f]{{24}}"
NAMED = re.compile(_WORDS)
_RUN = re.compile(r"[\w$.-]+")
_OPERATOR = re.compile(r"[\"'`\])]{0,3}[ \t]*+(:=|=>|(?:\+|\?\??|\|\|)?=(?![=~])|:(?!:))[ \t]*+")
_COMMAND = re.compile(r"(?<![^\s])(?:#[ \t]*+define[ \t]++|setenv[ \t]++|--)([A-Za-z][\w-]*+)[ \t]++(?![-=:])(?=\S)")
_NEXT_LINE = re.compile(r"\\?\n[ \t]*+(?=[\"'])")
_KEY_AFTER = re.compile(r"[ \t]*+:")
_BRACES = re.compile(r"\$?\{([^{}]*)\}")
_DOLLAR_BRACES = re.compile(r"\$\{([^{}]*)\}")
_NAME = re.compile(r"[A-Za-z_]\w*(?:\.\w+)*")
_TYPED = re.compile(r"[A-Za-z_][\w.]*+(?:<[^<>=\n]*>|\[[^\[\]=\n]*\])?[?!]?[ \t]*+=(?![=>])[ \t]*+")
_BLOCK = re.compile(r"[|>][+-]?[0-9]?[ \t]*+\n")
_STRING = re.compile(
    r"[A-Za-z@$]{0,2}(?:\"\"\"(?P<a>[^\"]*(?:\"{1,2}[^\"]+)*)\"\"\"|'{3}(?P<b>[^']*(?:'{1,2}[^']+)*)'{3}"
    r"|\"(?P<c>(?:[^\"\\\n]|\\.)*+)\"|'(?P<d>(?:[^'\\\n]|\\.)*+)'|`(?P<e>[^`\n]*)`)"
)
_BARE = re.compile(r"[A-Za-z0-9_$+/.~=-]+")
_PLUS = re.compile(r"\s*+\+\s*+")
_BESIDE = re.compile(r"[ \t]*+(?:\\\n[ \t]*+)?(?=[\"'])")
_TAG = re.compile(r"<(?P<name>[A-Za-z_][\w.:-]*+)[^<>]*>\s*+(?P<value>[^<>]*[^<>\s])\s*+</(?P=name)>")
_ELEMENT = re.compile(r"<[A-Za-z][^<>]*>")
_ATTRIBUTE = re.compile(r"([\w:.-]++)\s*+=\s*+(\"[^\"<>]*\"|'[^'<>]*')")
_CALL = re.compile(r"\(\s*+([\"'])([\w$.-]++)\1\s*+,\s*+(?=[\"'])")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


@dataclass(frozen=True)
class Operand:
    """A literal's text and place; one that is not quoted may be a name instead, and must be one where ``only_name``."""

    text: str
    start: int
    end: int
    quoted: bool
    only_name: bool = False


@dataclass(frozen=True)
class Assignment:
    at: int
    name: str
    value: tuple[Operand, ...]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three base patterns; matches that fail their length are dropped."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)])


def name_score(name: str) -> float:
    """The highest sensitivity of a part, or of two parts that stand together, of a name; 0 if its last part tells it is about a secret."""
    parts = [p.lower() for p in _PART.findall(name)]
    if parts and parts[-1] in ABOUT:
        return 0.0
    return max((SENSITIVE.get(x, 0.0) for x in parts + [a + b for a, b in zip(parts, parts[1:], strict=False)]), default=0.0)


@dataclass(frozen=True)
class Worth:
    """What the score of a value needs to know of it; sums of two are of the values one after the other."""

    chars: np.ndarray
    size: int
    head: str
    blank: bool
    prose: bool
    digits: bool
    letters: bool
    quoted: bool

    @staticmethod
    def of(text: str, quoted: bool) -> Worth:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = np.bincount(np.where(points < 128, points, 128 + points % 128), minlength=256).astype(float)
        words = text.split()
        prose = all(w.strip(".,;:!?'()").isalpha() for w in words)
        return Worth(chars, len(text), text[:HEAD], len(words) > 1, prose, text.isdigit(), text.isalpha(), quoted)

    def __add__(self, other: Worth) -> Worth:
        chars = self.chars + other.chars
        if chars.sum() > 1e12:  # only shares are asked for
            chars = chars / 1e6
        both = (self.head + other.head)[:HEAD] if len(self.head) < HEAD else self.head
        size = min(self.size + other.size, 1 << 40)
        return Worth(chars, size, both, self.blank or other.blank, self.prose and other.prose, self.digits and other.digits, self.letters and other.letters, self.quoted or other.quoted)

    def score(self, phrase: bool = False) -> float:
        """0 for placeholders, types, prose (unless a ``phrase`` is wanted) and short values; else bits of entropy and a bonus for mixed kinds.

        Numbers, and words that stand without quotes, lose a point.
        """
        word = self.head.lower() if self.size < HEAD else ""
        held = self.chars[self.chars > 0]
        if self.size < LEAST_LENGTH or word in PLACEHOLDERS | TYPES or self.head[0] in "$<{%" or len(held) < 4:
            return 0.0
        if self.blank and not phrase and self.prose:
            return 0.0
        share = held / held.sum()
        entropy = -float((share * np.log2(share)).sum())
        of_kinds = [self.chars[97:123].sum(), self.chars[65:91].sum(), self.chars[48:58].sum()]
        kinds = sum(n > 0 for n in of_kinds) + (self.chars.sum() - sum(of_kinds) > 1e-9 * self.chars.sum())
        plain = self.digits or not self.quoted and self.letters
        return max(0.0, entropy / 2 + 0.5 * (kinds > 1) - plain)


def _string(text: str, at: int) -> tuple[Operand | None, int]:
    """The string literal at a place, without its quotes, and where it ends."""
    m = _STRING.match(text, at)
    if not m:
        return None, at
    return Operand(m[m.lastgroup], m.start(m.lastgroup), m.end(m.lastgroup), True), m.end()


def _parts(text: str, found: Operand, begin: int) -> list[Operand]:
    """A string as it stands, or the parts between the names in braces where its prefix or quotes say that it has such."""
    opening = text[begin : found.start]
    braces = _BRACES if opening[:1] in ("f", "F", "$") or opening[1:2] in ("f", "F", "$") else _DOLLAR_BRACES if opening.endswith("`") else None
    holes = list(braces.finditer(text, found.start, found.end)) if braces else []
    if not holes:
        return [found]
    out, at = [], found.start
    for hole in holes:
        out.append(Operand(text[at : hole.start()], at, hole.start(), True))
        inner = hole[1].strip()
        if _NAME.fullmatch(inner):
            out.append(Operand(inner, hole.start(1), hole.end(1), False, True))
        at = hole.end()
    out.append(Operand(text[at : found.end], at, found.end, True))
    return [x for x in out if x.text]


def _operands(text: str, at: int) -> tuple[Operand, ...]:
    """The sum that begins at a place; calls and look-ups are no literals and end it."""
    out: list[Operand] = []
    while True:
        begin = at
        found, end = _string(text, at)
        if found:
            out += _parts(text, found, begin)
        else:
            m = _BARE.match(text, at)
            if not m or text[m.end() : m.end() + 1] in ("(", "["):
                break
            end = m.end()
            out.append(Operand(m[0], m.start(), end, False))
        follows = _PLUS.match(text, end) or (found and _BESIDE.match(text, end))
        if not follows:
            break
        at = follows.end()
    return tuple(out)


def _on_next_line(text: str, at: int) -> tuple[Operand, ...]:
    """The quoted value on the line after a place at which a line ends, unless it is a key itself."""
    follows = _NEXT_LINE.match(text, at)
    if not follows:
        return ()
    _, end = _string(text, follows.end())
    return () if _KEY_AFTER.match(text, end) else _operands(text, follows.end())


def _block(text: str, name_at: int, at: int) -> tuple[Operand, ...]:
    """The lines from ``at`` on that are indented further than the name's line, as one literal."""
    line = text.rfind("\n", 0, name_at) + 1
    margin = len(text[line:name_at]) - len(text[line:name_at].lstrip(" -"))
    begin = end = None
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        body = text[at:stop]
        inner = len(body) - len(body.lstrip(" "))
        if body.strip():
            if inner <= margin:
                break
            begin = at + inner if begin is None else begin
            end = at + len(body.rstrip())
        at = stop + 1
    return () if begin is None else (Operand(text[begin:end], begin, end, True),)


def assignments(text: str) -> list[Assignment]:
    """All assignments of a text, by place."""
    out = []
    for m in _RUN.finditer(text):
        name = m[0].lstrip("-.0123456789").rstrip(".-")
        op = _OPERATOR.match(text, m.end()) if name else None
        if not op:
            continue
        at = op.end()
        if op[1] == ":":
            block = _BLOCK.match(text, at)
            if block:
                out.append(Assignment(m.start(), name, _block(text, m.start(), block.end())))
                continue
            typed = _TYPED.match(text, at)
            at = typed.end() if typed else at
        value = _operands(text, at) or _on_next_line(text, at)
        before = (Operand(name, m.start(), m.end(), False, True),) if op[1] == "+=" else ()
        out.append(Assignment(m.start(), name, before + value))
    out += [Assignment(m.start(1), m[1], _operands(text, m.end())) for m in _COMMAND.finditer(text)]
    if "</" in text:
        out += [Assignment(m.start(), m["name"], (Operand(m["value"], m.start("value"), m.end("value"), True),)) for m in _TAG.finditer(text)]
    for e in _ELEMENT.finditer(text) if "<" in text else ():
        found = {m[1].lower(): (m[2][1:-1], m.start(2) + 1, m.end(2) - 1) for m in _ATTRIBUTE.finditer(text, e.start(), e.end())}
        names = [found[k][0] for k in ("key", "name", "id", "property") if k in found]
        values = [found[k] for k in ("value", "content", "default") if k in found]
        out += [Assignment(e.start(), n, (Operand(*v, True),)) for n in names for v in values]
    for m in _CALL.finditer(text):
        value, _ = _string(text, m.end())
        if value:
            out.append(Assignment(m.start(), m[2], (value,)))
    return sorted((a for a in out if a.value), key=lambda a: a.at)


def _plain(name: str) -> str:
    return name.removeprefix("this.").removeprefix("self.")


class Uses:
    """The assignments of a text as a graph: each value's literals, and the assignments whose values it uses."""

    def __init__(self, found: list[Assignment]) -> None:
        self.found = found
        self.of_name: dict[str, list[int]] = {}
        for i, one in enumerate(found):
            self.of_name.setdefault(_plain(one.name), []).append(i)
        self.places = {name: [found[i].at for i in own] for name, own in self.of_name.items()}
        self.values: dict[int, list[Operand | int]] = {}

    def held(self, name: str, at: int) -> int | None:
        """Which assignment a name stands for at a place: its last before, else its first after."""
        own, places = self.of_name[name], self.places[name]
        before, after = bisect_left(places, at), bisect_right(places, at)
        return own[before - 1] if before else own[after] if after < len(own) else None

    def value(self, i: int) -> list[Operand | int]:
        """Literals and used assignments of one value, in order."""
        if i not in self.values:
            out: list[Operand | int] = []
            for x in self.found[i].value:
                names = [] if x.quoted else [[_plain(x.text)], [_plain(n) for n in x.text.split("+") if n]]
                names = next((n for n in names if n and all(k in self.of_name for k in n)), None)
                if names is not None:
                    used = [self.held(n, self.found[i].at) for n in names]
                    out += [j for j in used if j is not None]
                elif not x.only_name:
                    out.append(x)
            self.values[i] = out
        return self.values[i]

    def groups(self, roots: list[int]) -> tuple[list[list[int]], dict[int, int]]:
        """Assignments that lead back to each other, everything a group uses before it, and each assignment's group."""
        order: dict[int, int] = {}
        low: dict[int, int] = {}
        place: dict[int, int] = {}
        group: dict[int, int] = {}
        out: list[list[int]] = []
        path: list[int] = []
        for root in roots:
            if root in order:
                continue
            todo = [(root, iter([j for j in self.value(root) if isinstance(j, int)]))]
            order[root] = low[root] = len(order)
            place[root] = len(path)
            path.append(root)
            while todo:
                i, rest = todo[-1]
                j = next(rest, None)
                if j is None:
                    todo.pop()
                    if todo:
                        low[todo[-1][0]] = min(low[todo[-1][0]], low[i])
                    if low[i] == order[i]:
                        members = sorted(path[place[i] :])
                        del path[place[i] :]
                        group.update((k, len(out)) for k in members)
                        out.append(members)
                elif j not in order:
                    order[j] = low[j] = len(order)
                    place[j] = len(path)
                    path.append(j)
                    todo.append((j, iter([k for k in self.value(j) if isinstance(k, int)])))
                elif j not in group:
                    low[i] = min(low[i], order[j])
        return out, group


def named_spans(text: str) -> list[tuple[int, int, int]]:
    """Literals that reach a sensitive name."""
    found = assignments(text)
    names = {name: name_score(name) for name in {one.name for one in found}}
    roots = [i for i, one in enumerate(found) if names[one.name]]
    if not roots:
        return []
    uses = Uses(found)
    groups, group = uses.groups(roots)
    asked = Counter(group[j] for g, members in enumerate(groups) for i in members for j in uses.value(i) if isinstance(j, int) and group[j] != g)
    at_root: dict[int, list[int]] = {}
    for i in roots:
        at_root.setdefault(group[i], []).append(i)
    worth: dict[int, Worth | None] = {}
    taken: set[int] = set()
    for g, members in enumerate(groups):
        total: Worth | None = None
        for x in (x for i in members for x in uses.value(i)):
            if isinstance(x, Operand):
                more = Worth.of(x.text, x.quoted)
            else:
                below = group[x]
                if below == g:
                    continue
                more = worth[below]
                asked[below] -= 1
                if not asked[below]:
                    del worth[below]
            total = more if total is None else total if more is None else total + more
        worth[g] = total
        for i in at_root.get(g, ()):
            score = total.score("passphrase" in found[i].name.lower()) if total else 0.0
            if score and names[found[i].name] + score >= LEAST_SCORE:
                taken.add(g)
        if not asked[g]:
            del worth[g]
    out = set()
    for g in range(len(groups) - 1, -1, -1):  # users before what they use
        if g in taken:
            for x in (x for i in groups[g] for x in uses.value(i)):
                if isinstance(x, Operand):
                    out.add((x.start, 3, x.end))
                else:
                    taken.add(group[x])
    return sorted(x for x in out if x[2] > x[0])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def spans_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, each by start and then kind."""
    base = base_spans(text)
    return base, sorted({*base, *(named_spans(text) if NAMED.search(text) else ())})


def redacted(text: str, mark: str = "<secret>") -> str:
    """``text`` with every stretch that spans cover replaced by ``mark``."""
    out, at = [], 0
    for start, _, end in spans_of(text)[1]:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        texts = batch["text"].fill_null("")
        maybe = pc.match_substring_regex(texts, MAYBE).to_pylist()
        rows = []
        for text, look in zip(texts, maybe, strict=True):
            base, every = spans_of(text.as_py()) if look else ([], [])
            kinds = Counter(kind for _, kind, _ in base)
            rows.append((kinds[0], kinds[1], kinds[2], hashlib.sha256(joined(base).encode()).hexdigest() if base else nothing, joined(every), len(every)))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """Spans of each row of ``docs(doc_id, text)``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets replaced in ``text`` (and ``n_chars``, where there is such a column, counted anew)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = whole.schema.get_field_index("text")
            for begin in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(begin, ROWS_AT_ONCE)
                texts = batch.column(at)
                maybe = pc.match_substring_regex(texts, MAYBE).fill_null(False)
                new = pa.array([redacted(t.as_py()) for t in texts.filter(maybe)], texts.type)
                yield batch.set_column(at, batch.schema.field(at), pc.replace_with_mask(texts, maybe, new)) if len(new) else batch

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
