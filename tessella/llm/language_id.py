"""Language identification by unigrams of pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary.  A text is the sequence of its
letter runs, lower-cased and each begun by the vocabulary's word mark; a run is
worth the sum, over all ways to cut it into pieces, of the product of their
probabilities in a language, which a forward pass over its letters computes.
A letter that is no piece counts as one of the same small probability in every
language.  A language's probabilities are fitted by expectation maximisation
over the same sum: a forward and a backward pass give each piece's expected
count, for all languages and distinct words at once, and Spark adds them up.

The prediction is the language of the largest posterior, its score that
posterior; shares of languages among the learned rows are the prior.  Texts
without a letter (null and empty ones too) are ``und``, with score 0.

Fitting reads at most about ``SAMPLE_DOCS`` texts of each language (a hash of id
and text below a share of the rows counted); a longer table changes the share,
not the work.  Runs over ``DENSE`` letters do not teach.  Scoring reads whole
texts: those runs go through a forward pass of their own, letter by letter.
Memory of a task is bounded by slices of about ``SLICE`` bytes of text, or by one
text longer than that.  More than ``MOST_LANGUAGES`` labels, whose model the driver
could not hold, are refused.  A table without a learnable row predicts ``und``
everywhere.  A null id counts as the empty string for the fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm._scratch import Scratch
from tessella.llm._text import SLICE, mix64

UNDETERMINED = "und"
FOLDS, HELD_OUT = 4, 2
SAMPLE_DOCS = 1000
MOST_LANGUAGES = 256
ROUNDS = 3
SMOOTHING = 0.05
#: Probability of a letter that is no piece, and letters of the longest run that is handled in columns.
UNKNOWN, DENSE = 1e-8, 48
#: Words whose sums a worker keeps.
CACHE = 400_000
MARK = "▁"
_NO_WORD = r"[^\p{L}\p{M}]+"
#: Keeps products of a run in range; each letter's factor is divided out in the end.
_LIFT = 1e4
_BASE = np.uint64(0x9E3779B97F4A7C15)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The pieces of a vocabulary that lower-case letter runs can hold, found by the hash of their letters."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        vocabulary = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(vocabulary.get_piece_size())
        special = [vocabulary.is_control, vocabulary.is_unknown, vocabulary.is_byte, vocabulary.is_unused]
        texts = pa.array([vocabulary.id_to_piece(i) for i in ids if not any(f(i) for f in special)])
        texts = texts.filter(pc.and_(pc.equal(texts, pc.utf8_lower(texts)), pc.match_substring_regex(texts, rf"^{MARK}?[\p{{L}}\p{{M}}]*$")))
        texts = texts.unique().to_pylist()
        hashes = np.zeros(len(texts), np.uint64)
        for _, rows in _by_length(texts):
            hashes[rows] = self.prefixes(np.array([[*map(ord, texts[i])] for i in rows], np.uint64))[:, -1]
        order = np.argsort(hashes)
        self.texts, self.hashes = [texts[i] for i in order], hashes[order]
        self.longest = max(map(len, texts))
        self.powers = np.array([pow(int(_BASE), k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces share a hash")

    @staticmethod
    def prefixes(points: np.ndarray) -> np.ndarray:
        """Hashes of all prefixes, the empty one first, of rows of code points."""
        out = np.zeros((points.shape[0], points.shape[1] + 1), np.uint64)
        mixed = mix64(points + np.uint64(1))
        for t in range(points.shape[1]):
            out[:, t + 1] = out[:, t] * _BASE + mixed[:, t]
        return out

    def ids(self, prefixes: np.ndarray, begin: np.ndarray | int, end: np.ndarray | int, length: int) -> np.ndarray:
        """Which piece stands between two places; the number of pieces where none does."""
        wanted = prefixes[:, end] - prefixes[:, begin] * self.powers[length]
        at = np.searchsorted(self.hashes, wanted)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == wanted, at, len(self.hashes))


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def _points(words: list[str]) -> np.ndarray:
    """Code points of words of one length, each after the word mark."""
    return np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for rows in np.split(order, cuts) if len(words) else ():
        yield int(sizes[rows[0]]), rows


@dataclass(frozen=True)
class Model:
    """Languages, the logarithms of their shares, and the probability of each piece (rows) in each (columns)."""

    path: str
    languages: tuple[str, ...]
    log_share: np.ndarray
    weights: np.ndarray

    def lifted(self) -> np.ndarray:
        """Weights times ``_LIFT`` to the letters of a piece, and a last row of zeros for what is no piece."""
        sizes = np.fromiter(map(len, pieces_of(self.path).texts), np.int64)
        return np.vstack([self.weights * (_LIFT**sizes)[:, None], np.zeros((1, len(self.languages)))])


def forward(pieces: Pieces, points: np.ndarray, lifted: np.ndarray, pick: np.ndarray | None = None) -> tuple[list[np.ndarray], dict[tuple[int, int], np.ndarray]]:
    """Sums over the segmentations of each prefix of equally long words, and the piece between each two places.

    With ``pick``, word i counts in language ``pick[i]`` only.
    """
    n, length = points.shape
    prefixes = pieces.prefixes(points)
    sums, found = [np.ones((n, 1 if pick is not None else lifted.shape[1]))], {}
    for t in range(1, length + 1):
        now = np.zeros_like(sums[0])
        for s in range(max(0, t - pieces.longest), t):
            ids = pieces.ids(prefixes, s, t, t - s)
            hit = np.flatnonzero(ids < len(pieces.hashes))
            if len(hit):
                weight = lifted[ids[hit]] if pick is None else lifted[ids[hit], pick[hit]][:, None]
                now[hit] += sums[s][hit] * weight
                found[s, t] = ids
            if s == t - 1:
                lone = np.flatnonzero(ids == len(pieces.hashes))
                now[lone] += sums[s][lone] * (UNKNOWN * _LIFT)
        sums.append(now)
    return sums, found


def _long(pieces: Pieces, word: str, lifted: np.ndarray) -> np.ndarray:
    """The logarithm of one long run's sum for each language: a forward pass that keeps the last sums only, scaled at each letter."""
    points = _points([word])[0]
    width, n = pieces.longest, len(pieces.hashes)
    ring, log = np.zeros((width, lifted.shape[1])), np.zeros(lifted.shape[1])
    ring[-1] = 1.0
    for at in range(0, len(points), SLICE):
        stretch = points[max(0, at - width) : at + SLICE]
        prefixes = pieces.prefixes(stretch[None, :])
        ends = np.arange(at - max(0, at - width) + 1, len(stretch) + 1)
        ids = np.full((len(ends), width), n)
        for k in range(1, width + 1):
            fit = ends >= k
            ids[fit, width - k] = pieces.ids(prefixes, ends[fit] - k, ends[fit], k)[0]
        for row in ids:
            weight = lifted[row]
            if row[-1] == n:
                weight[-1] = UNKNOWN * _LIFT
            now = (ring * weight).sum(0)
            ring[:-1] = ring[1:]
            ring[-1] = now
            ring /= now
            log += np.log(now)
    return log - len(points) * np.log(_LIFT)


def word_logs(words: list[str], model: Model, lifted: np.ndarray) -> np.ndarray:
    """For each word and language, the logarithm of the sum over all segmentations."""
    pieces = pieces_of(model.path)
    out = np.zeros((len(words), len(model.languages)))
    for size, rows in _by_length(words):
        if size <= DENSE:
            for part in np.array_split(rows, len(rows) // 4096 + 1):
                points = _points([words[i] for i in part])
                out[part] = np.log(forward(pieces, points, lifted)[0][-1]) - points.shape[1] * np.log(_LIFT)
        else:
            for i in rows:
                out[i] = _long(pieces, words[i], lifted)
    return out


def expected(words: list[str], language: np.ndarray, counts: np.ndarray, model: Model) -> np.ndarray:
    """Expected counts of each piece in each language over words that occur ``counts`` times in ``language``."""
    pieces, lifted = pieces_of(model.path), model.lifted()
    out = np.zeros_like(model.weights)
    for size, rows in _by_length(words):
        if size > DENSE:
            continue
        for part in np.array_split(rows, len(rows) // 4096 + 1):
            pick = language[part]
            sums, found = forward(pieces, _points([words[i] for i in part]), lifted, pick)
            last = len(sums) - 1
            rest = [np.zeros(len(part)) for _ in range(last)] + [counts[part] / sums[last][:, 0]]
            for t in range(last, 0, -1):
                for s in range(max(0, t - pieces.longest), t):
                    ids = found.get((s, t))
                    if ids is not None:
                        hit = np.flatnonzero(ids < len(pieces.hashes))
                        back = lifted[ids[hit], pick[hit]] * rest[t][hit]
                        rest[s][hit] += back
                        np.add.at(out, (ids[hit], pick[hit]), back * sums[s][hit, 0])
                    if s == t - 1:
                        lone = slice(None) if ids is None else np.flatnonzero(ids == len(pieces.hashes))
                        rest[s][lone] += rest[t][lone] * (UNKNOWN * _LIFT)
    return out


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Stretches of a column of about ``SLICE`` bytes, one text at least."""
    texts = texts.fill_null("")
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + SLICE, side="right")))
        yield texts.slice(at, to - at)
        at = to


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All letter runs of a slice and, for each, its row."""
    parts = pc.split_pattern_regex(pc.utf8_lower(texts.cast(pa.large_string())), pattern=_NO_WORD)
    flat = pc.list_flatten(parts)
    row = pc.list_parent_indices(parts).to_numpy()
    keep = pc.not_equal(flat, "")
    return flat.filter(keep), row[keep.to_numpy(zero_copy_only=False)]


def held_out(doc_id: Column) -> Column:
    text = F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS == HELD_OUT


def word_counts(sample: DataFrame) -> DataFrame:
    """``(lang, word, n)`` over ``sample(lang, text)``, counted in slices before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _slices(batch["text"]):
                words, row = _words(texts)
                langs = batch["lang"].slice(at, len(texts)).take(pa.array(row))
                at += len(texts)
                table = pa.table({"lang": langs, "word": words.cast(pa.string())}).group_by(["lang", "word"]).aggregate([([], "count_all")])
                yield from table.rename_columns(["lang", "word", "n"]).combine_chunks().to_batches()

    return sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, scratch: Scratch, path: str | None = None, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """The model of ``docs(doc_id, text, lang)``, whose rows may all be learned from; None if no row has a language and a letter."""
    path = path or default_path()
    spoken = docs.where(F.col("lang").isNotNull() & F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    shares = {r["lang"]: r["n"] for r in spoken.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if not shares:
        return None
    if len(shares) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = tuple(sorted(shares))
    part = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, sample_docs / shares[lang]))))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30) < F.element_at(part, F.col("lang"))
    tasks = docs.sparkSession.sparkContext.defaultParallelism
    counts = scratch.cut(word_counts(spoken.where(drawn).select("lang", "text")).repartition(tasks, "word"), "words")
    share = np.array([shares[x] for x in languages], float)
    n = len(pieces_of(path).texts)
    model = Model(path, languages, np.log(share / share.sum()), np.full((n, len(languages)), 1 / n))
    for _ in range(ROUNDS):
        sums = _expected_counts(counts, model) + SMOOTHING
        model = Model(path, languages, model.log_share, sums / sums.sum(0))
    return model


def _expected_counts(counts: DataFrame, model: Model) -> np.ndarray:
    """Expected counts over all words; what reaches the driver is bounded by pieces times languages."""
    sent = counts.sparkSession.sparkContext.broadcast(model)
    place = {x: i for i, x in enumerate(model.languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        out = np.zeros_like(own.weights)
        for batch in batches:
            language = np.array([place[x] for x in batch["lang"].to_pylist()], np.int64)
            out += expected(batch["word"].to_pylist(), language, batch["n"].to_numpy().astype(float), own)
        piece, lang = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(out[piece, lang])], ["piece", "lang", "n"])

    found = counts.mapInArrow(run, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros_like(model.weights)
    out[found["piece"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
    sent.unpersist()
    return out


class Scorer:
    """Scores texts by a model, with the sums of words met before."""

    def __init__(self, model: Model) -> None:
        self.model, self.lifted = model, model.lifted()
        self.known: dict[str, int] = {}
        self.logs = np.zeros((0, len(model.languages)))

    def of_words(self, words: list[str]) -> np.ndarray:
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > CACHE and self.known:
            self.known, self.logs, fresh = {}, self.logs[:0], words
        if fresh:
            self.known.update(zip(fresh, range(len(self.logs), len(self.logs) + len(fresh)), strict=True))
            self.logs = np.vstack([self.logs, word_logs(fresh, self.model, self.lifted)])
        return self.logs[[self.known[w] for w in words]]

    def totals(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log joint probabilities of each text and language, and which texts have a letter."""
        words, row = _words(texts)
        coded = words.dictionary_encode()
        logs = self.of_words(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        out = np.stack([np.bincount(row, logs[:, j], len(texts)) for j in range(logs.shape[1])], 1)
        return out + self.model.log_share, pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` (``text`` and whatever else) with ``lang_pred`` and ``score`` added; only ``text`` is looked at."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, score double"
    if model is None:
        return docs.withColumn("lang_pred", F.lit(UNDETERMINED)).withColumn("score", F.lit(0.0))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != "text"] + ["lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        labels = pa.array([*sent.value.languages, UNDETERMINED])
        for batch in batches:
            best, score = [np.zeros(0, np.int64)], [np.zeros(0)]
            for texts in _slices(batch["text"]):
                logs, spoken = scorer.totals(texts)
                odds = np.exp(logs - logs.max(1, keepdims=True))
                best.append(np.where(spoken, logs.argmax(1), len(labels) - 1))
                score.append(np.where(spoken, odds.max(1) / odds.sum(1), 0.0))
            found = [labels.take(pa.array(np.concatenate(best))), pa.array(np.concatenate(score))]
            yield pa.RecordBatch.from_arrays([*batch.drop_columns("text").columns, *found], names)

    return docs.mapInArrow(run, schema.replace("`text` string, ", ""))


def identify(docs: DataFrame, path: str | None = None, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Fold and predicted language of each row of ``docs(doc_id, text, lang)``; rows of the held-out fold teach nothing."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    model = fit(rows.where(~held_out(F.col("doc_id"))), Scratch(docs.sparkSession, "language"), path, sample_docs)
    return predict(rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
