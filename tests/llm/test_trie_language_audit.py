"""Prefix trie, language identification and filter audit against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import filter_audit, language_id, prefix_trie
from tessella.llm._scratch import Scratch

WORD = re.compile("[^\x20\x09-\x0d]+")
TURNS = "conv_id long, turn long, role string, text string, depth int, k1 long, range int, n_words string, path int, last string"
EXTRA = (1, 2, 3, "w", 4, "l")
DOCS = "doc_id long, text string, lang string, source string, part string, A int, digest string, lang_pred string, score double, good int"


def turns(rows):
    return [(*r, *EXTRA) for r in rows]


def brute_trie(rows):
    """Nodes as the contract words them, by listing every prefix of every conversation."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).digest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    new = {c: (lambda h, v=v, c=c: own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:])(zlib.crc32(str(c).encode()) % 4) for c, v in own.items()}
    members = defaultdict(list)
    for c in sorted(new):
        for k in range(len(new[c]) + 1):
            members[tuple(new[c][:k])].append(c)
    children, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        for k in range(len(p) + 1):
            leaves[p[:k]] += p not in children
            saved[p[:k]] += (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0
    ends = {p: ",".join(str(c) for c in m if len(new[c]) == len(p)) for p, m in members.items()}
    return Counter(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest())
        for p, m in members.items()
    )


def found_trie(frame):
    return Counter(tuple(r) for r in prefix_trie.trie(frame).collect())


def dialogues(seed, n=150, kinds=3):
    """Conversations of few different turns, so that they share prefixes; copies, repeated and missing turns among them."""
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(2 * n), n):
        out += [(c, t if rng.random() < 0.95 else None, "user" if t % 2 == 0 else "assistant", f"turn {t} says " + "so " * rng.randrange(kinds)) for t in range(rng.randrange(1, 8))]
    out += out[:5] + [(2 * n + 20 * k, t, "user", "the same words") for k in range(6) for t in range(9)]
    out += [(7, None, None, None), (7, None, "", ""), (1001, 1, None, "alone"), (1002, None, "system", None), (None, 1, "user", "nobody"), (-43, 2, "user", "a b c")]
    return out + [(500, t, "user", f"long {t} " + "x" * 50_000 * (t == 3)) for t in range(30)]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_listing_all_prefixes(spark, seed):
    rows = dialogues(seed)
    frame = spark.createDataFrame(turns(rows), TURNS).repartition(5)
    assert found_trie(frame) == brute_trie(rows)


def test_trie_sums_long_conversations_over_ranges_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 7)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 3)
    rows = [(c, t, "user", f"step {t} of all") for c in (3, 60, 61, 75) for t in range(400)]
    rows += [(c, t, "user", f"step {t} of all" if t < 200 + c else f"own {c}") for c in range(100, 140) for t in range(220 + c)]
    rows += [(c, 0, "user", "copies") for c in range(1000, 1100)]
    frame = spark.createDataFrame(turns(rows), TURNS).repartition(8)
    assert found_trie(frame) == brute_trie(rows)


def test_trie_takes_rounds_in_the_logarithm_only(spark, monkeypatch):
    """A binary trie of 2**7 conversations: every step to a light child halves, so seven rounds and the empty one."""
    written = []
    cut = Scratch.cut
    monkeypatch.setattr(Scratch, "cut", lambda self, df, name, **k: (written.append(name), cut(self, df, name, **k))[1])
    rows = [(20 * c + 20, t, "user", f"{c >> (6 - t) & 1}") for c in range(128) for t in range(7)]
    assert found_trie(spark.createDataFrame(turns(rows), TURNS)) == brute_trie(rows)
    assert written.count("handed") <= 9


def test_trie_of_an_empty_table_and_of_rows_without_conversation(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame(turns([(None, 1, "user", "x")]), TURNS)).count() == 0


def all_segmentations(word, prob):
    """The sum over all ways to cut a word, by recursion over its first piece."""
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, len(word) + 1):
        p = prob(word[:k])
        if p:
            total += p * all_segmentations(word[k:], prob)
    return total


@pytest.fixture(scope="module")
def pieces():
    return language_id.pieces_of(language_id.default_path())


def model_of(pieces, seed):
    weights = np.random.default_rng(seed).random((len(pieces.texts), 2))
    return language_id.Model(language_id.default_path(), ("aa", "bb"), np.log([0.5, 0.5]), weights / weights.sum(0))


def prob_of(pieces, model, j):
    at = {p: i for i, p in enumerate(pieces.texts)}
    return lambda x: model.weights[at[x], j] if x in at else language_id.UNKNOWN if len(x) == 1 else 0.0


def test_forward_sums_all_segmentations(pieces, monkeypatch):
    model = model_of(pieces, 3)
    words = ["a", "the", "there", "station", "ñandú", "größer", "qq", "中文x", "\U00010400\U0001d4d0"]
    wanted = [[math.log(all_segmentations(language_id.MARK + w, prob_of(pieces, model, j))) for j in (0, 1)] for w in words]
    assert language_id.word_logs(words, model, model.lifted()) == pytest.approx(np.array(wanted), rel=1e-9)
    monkeypatch.setattr(language_id, "DENSE", 0)  # every run letter by letter
    assert language_id.word_logs(words, model, model.lifted()) == pytest.approx(np.array(wanted), rel=1e-9)


def test_long_runs_do_not_underflow_and_go_on_over_stretches(pieces, monkeypatch):
    model = model_of(pieces, 4)
    word = "entstation" * 500
    whole = language_id.word_logs([word], model, model.lifted())
    monkeypatch.setattr(language_id, "SLICE", 64)
    assert language_id.word_logs([word], model, model.lifted()) == pytest.approx(whole, rel=1e-12)
    assert np.isfinite(whole).all()


def test_expected_counts_against_listing_segmentations(pieces):
    model = model_of(pieces, 5)
    words, language, counts = ["there", "them", "ünq"], np.array([0, 1, 0]), np.array([2.0, 1.0, 3.0])
    wanted = defaultdict(float)

    def walk(rest, parts, p, prob):
        if not rest:
            yield parts, p
        for k in range(1, len(rest) + 1):
            if prob(rest[:k]):
                yield from walk(rest[k:], [*parts, rest[:k]], p * prob(rest[:k]), prob)

    for w, j, n in zip(words, language, counts, strict=True):
        ways = list(walk(language_id.MARK + w, [], 1.0, prob_of(pieces, model, j)))
        for parts, p in ways:
            for x in parts:
                wanted[x, int(j)] += n * p / sum(q for _, q in ways)
    got = language_id.expected(words, language, counts, model)
    known = {(pieces.texts[i], j): got[i, j] for i, j in zip(*np.nonzero(got), strict=True)}
    assert known == pytest.approx({k: v for k, v in wanted.items() if k[0] in set(pieces.texts)}, rel=1e-9)


def spoken(n=160):
    rng = random.Random(8)
    own = {"en": "the of and thing there with ing tion", "de": "und der sch über nicht ein größe ung", "es": "el los que ción para señor año mente"}
    return [(i, " ".join(rng.choices(own[lang].split(), k=rng.randint(3, 40))).title(), lang) for i in range(n) for lang in [rng.choice(sorted(own))]]


def test_language_of_held_out_rows_and_odd_texts(spark):
    rows = spoken()
    rows = [(i, t, lang, "s", "p", 1, "d", "zz", 0.5, 9) for i, t, lang in rows]
    odd = {900: None, 901: "", 902: "12 + 4 = 16 !?", 903: "\n\t ", 904: "THE THING " * 60_000, 905: "ß" * 5000, 906: "thé of", 907: "中文"}
    rows += [(i, t, None, "s", None, 1, "d", "zz", 0.5, 9) for i, t in odd.items()] + [rows[3], (None, "the thing of", "en", "s", "p", 1, "d", "z", 0.5, 9)]
    got = defaultdict(list)
    for r in language_id.identify(spark.createDataFrame(rows, DOCS).repartition(3)).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, r in got.items():
        assert all(x.held_out == (zlib.crc32(str("" if i is None else i).encode()) % 4 == 2) and 0 <= x.score <= 1 for x in r)
    tested = [r for r in rows if r[2] and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(tested) > 20 and all(got[r[0]][0].lang_pred == r[2] for r in tested)
    assert {i: got[i][0].lang_pred for i in (900, 901, 902, 903)} == dict.fromkeys((900, 901, 902, 903), "und")
    assert got[900][0].score == 0 and got[904][0].lang_pred == "en" and "und" not in (got[905][0].lang_pred, got[907][0].lang_pred)


def test_held_out_rows_and_other_columns_teach_nothing(spark):
    rows = spoken(60)
    twisted = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    plain = [language_id.identify(spark.createDataFrame(r, "doc_id long, text string, lang string")).orderBy("doc_id").collect() for r in (rows, twisted)]
    assert [tuple(r)[:3] for r in plain[0]] == [tuple(r)[:3] for r in plain[1]]
    assert [r.score for r in plain[0]] == pytest.approx([r.score for r in plain[1]], rel=1e-6)


def test_language_without_anything_to_learn(spark):
    empty = spark.createDataFrame([], DOCS)
    assert language_id.identify(empty).count() == 0
    rows = [(1, "the thing", None), (2, None, "en"), (3, "123", "de")]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {(r.doc_id, r.lang_pred, r.score) for r in got} == {(i, "und", 0.0) for i in (1, 2, 3)}


def test_the_sample_is_bounded(spark):
    frame = spark.createDataFrame(spoken(400), "doc_id long, text string, lang string")
    words = Scratch(spark, "words")
    kept = []
    original = language_id.word_counts
    try:
        language_id.word_counts = lambda sample: (kept.append(sample.count()), original(sample))[1]
        model = language_id.fit(frame, words, sample_docs=20)
    finally:
        language_id.word_counts = original
    assert 20 < kept[0] < 120 and model.languages == ("de", "en", "es")
    assert model.weights.sum(0) == pytest.approx(np.ones(3))


def brute_audit(docs, labels):
    lowest = {}
    for i, text, _ in docs:
        if i is not None:
            lowest[text or ""] = min(i, lowest.get(text or "", i))
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    rows = []
    for i, text, part in docs:
        text = text or ""
        w = WORD.findall(text)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text))}
        fails["E"] = i is not None and i > lowest[text]
        rows.append((part or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out, sums = [], Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone, failing = [r for r in left if f in r[1]], [r for r in rows if r[0] == part and f in r[1]]
                left = [r for r in left if f not in r[1]]
                alone = sum(r[1] == {f} for r in failing)
                out.append((part, order, step, len(left), len(gone), len(failing) - len(gone), alone, sum(r[2] for r in gone), sum(r[3] for r in gone)))
                sums[part, f] += len(gone)
    return {(*r, sums[r[0], r[1][r[2] - 1]]) for r in out}


def test_audit_against_running_every_order(spark):
    rng = random.Random(6)
    kinds = [None, "", "short text", "Loud TEXT " * 40, "again and again " * 30, " ".join(f"w{i}" for i in range(60)), "cost $5 " + " ".join(f"v{i}" for i in range(70)), "x " * 60_000]
    docs = [(i, rng.choice(kinds), rng.choice([None, "", "a", "b"])) for i in range(120)]
    docs += [docs[0], docs[7], (None, "short text", "a"), (None, None, "only nulls"), (130, "ÀÉ " * 60, "c"), (131, "é #", "c")]
    labels = [(rng.randrange(140), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(90)] + [(None, 1, 1)]
    frame = spark.createDataFrame([(i, t, "en", s, "p", 1, "d", "z", 0.5, 9) for i, t, s in docs], DOCS).repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    got = filter_audit.audit(frame, marks)
    assert {tuple(r) for r in got.collect()} == brute_audit(docs, labels) and got.count() == 600 * len({s or "" for _, _, s in docs})


def test_each_state_is_executed_once(spark, monkeypatch):
    states = []
    cut = Scratch.cut
    monkeypatch.setattr(Scratch, "cut", lambda self, df, name, **k: (states.append(name), cut(self, df, name, **k))[1])
    rows = spark.createDataFrame([("p", True, False, True, False, False)], "part string, A boolean, B boolean, C boolean, good boolean, toxic boolean")
    edges = filter_audit.walk(rows, "ABC", Scratch(spark, "audit"))
    assert sorted(states) == ["state", "stateA", "stateAB", "stateAC", "stateB", "stateBC", "stateC"]
    assert {(r["applied"], r["filter"], r["removed"]) for r in edges.collect()} == {("", "A", 1), ("", "B", 0), ("", "C", 1), ("B", "A", 1), ("B", "C", 1)}
    assert {tuple(r)[1:5] for r in filter_audit.orders(edges, "ABC").where("filter_order = 'CAB'").collect()} == {("CAB", 1, 0, 1), ("CAB", 2, 0, 0), ("CAB", 3, 0, 0)}


def test_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "x", "en", "s", "p", 1, "d", "z", 0.5, 9)], DOCS)
    assert {r.kept for r in filter_audit.audit(one, labels).where("step = 5").collect()} == {0}
