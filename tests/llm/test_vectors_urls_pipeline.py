"""Embedding near-dedup, URL filters and the pipeline against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tessella.llm import embedding_dedup, secret_scan, url_filter
from tests.llm.test_documents import SCHEMA, brute_components, shingle_sets, texts  # noqa: F401


def brute_vectors(rows, least):
    good = [(i, np.array(v, float)) for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    up, links = list(range(len(rows))), Counter()

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, (i, a) in enumerate(good):
        for j, b in good[:n]:
            if len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least:
                links[i] += 1
                links[j] += 1
                up[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[top(i)] = min(x for x in (low.get(top(i)), d) if x is not None) if d is not None or low.get(top(i)) is not None else None
    return Counter((d, links[i], low[top(i)], d is not None and d == low[top(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("block", [1024, 7])
def test_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = []
    for i in range(40):
        base = rng.normal(size=24)
        rows.append((1000 - i, base.tolist()))
        for _ in range(i % 6):
            rows.append((len(rows), (base + rng.normal(size=24) * rng.choice([0.05, 0.2, 0.33])).tolist()))
    rows += [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [None, *[1.0] * 23]), (5004, [float("nan")] * 24), (5005, [float("inf"), *[0.0] * 23])]
    rows += [(6000, rows[0][1]), (6001, rows[0][1]), rows[3], (None, rows[0][1]), (7000, [1.0, 0.0]), (7001, [2.0, 0.01])]
    rows = [(d, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for d, v in rows]
    frame = spark.createDataFrame([(d, v, 1, "x") for d, v in rows], "vec_id long, embedding array<float>, label int, node string").repartition(4)
    got = Counter(map(tuple, embedding_dedup.near_vectors(frame, 0.95).collect()))
    assert got == brute_vectors(rows, 0.95)
    assert embedding_dedup.near_vectors(frame.limit(0)).count() == 0


def test_very_small_and_very_large_vectors_have_cosines(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)]
    rows += [(100 + k, [x * scale for x in rows[0][1]]) for k, scale in enumerate((1e-170, 1e-300, 1e200, 1e300))]
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.95).collect()}
    assert {got[d].component_id for d in (0, 100, 101, 102, 103)} == {got[0].component_id} and got[0].n_links >= 4


def test_only_the_sample_goes_to_the_driver(spark, monkeypatch):
    """The rows that are ordered for the sample do not grow with partitions or rows."""
    monkeypatch.setattr(embedding_dedup, "SAMPLE_ROWS", 200)
    rng = np.random.default_rng(3)
    sizes = []
    fit = embedding_dedup.fit
    monkeypatch.setattr(embedding_dedup, "fit", lambda sample, *rest: (sizes.append(len(sample)), fit(sample, *rest))[1])
    frame = spark.createDataFrame([(i, rng.normal(size=16).tolist()) for i in range(4000)], "vec_id long, embedding array<float>").repartition(40)
    assert embedding_dedup.near_vectors(frame, 0.95).count() == 4000
    assert 180 <= sizes[0] <= 200


def test_codes_survive_their_packing():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 32))
    index = embedding_dedup.fit(x, 100_000, 0.95)
    assert (index.unpacked(index.packed(x)) == index.keys(x)).all()


def test_recall_where_differences_lie_in_few_directions():
    """Wide vectors of a subspace, pairs at the threshold inside it."""
    rng = np.random.default_rng(2)
    basis = np.linalg.qr(rng.normal(size=(400, 30)))[0].T
    x = rng.normal(size=(3000, 30)) @ basis
    index = embedding_dedup.fit(x, 1_000_000, 0.95)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.normal(size=(3000, 30)) @ basis
    off -= (off * unit).sum(axis=1, keepdims=True) * unit
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    a, b = index.keys(unit), index.keys(0.95 * unit + math.sqrt(1 - 0.95**2) * off)
    assert (a == b).any(axis=1).mean() > 0.998
    assert (np.bitwise_count(a ^ b).sum(axis=1) <= index.reach).mean() > 0.998


def test_recall_at_the_threshold():
    """Pairs exactly at the threshold, on data with a strong common direction, share a table."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32)) + 2.0
    index = embedding_dedup.fit(x, 1_000_000, 0.95)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.normal(size=unit.shape)
    off -= (off * unit).sum(axis=1, keepdims=True) * unit
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    a, b = index.keys(unit), index.keys(0.95 * unit + math.sqrt(1 - 0.95**2) * off)
    assert (a == b).any(axis=1).mean() > 0.995
    assert (np.bitwise_count(a ^ b).sum(axis=1) <= index.reach).mean() > 0.995


def test_url_rules_and_propagation(spark):
    link = lambda *hosts: " ".join(f'<a href="https://{h}/x">' for h in hosts)
    rows = [
        (1, "https://a.Example.ORG/es/1", link("farm.net")),
        (2, "http://example.org/en/12?x#y", ""),
        (3, "http://example.org/en/2", link("good.info")),
        (4, "http://example.org", link("good.info", "GOOD.info")),
        (5, "http://notexample.org/es/", None),
        (6, "https://x.com/de/a", ""),
        (7, "https://x.com/fr/a", link("good.info")),
        (8, "https://spam.net/a", link("x.com", "a.example.org")),
        (9, "https://good.info/a", ""),
        (10, None, link("x.com")),
        (11, "no scheme", ""),
        (12, "https://x.com.evil.net/fr/", ""),
        (12, "https://x.com.evil.net/fr/", ""),
    ]
    frame = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in url_filter.judge(frame).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert (got[2].path, got[2].rule) == ("/en/12", "example.org/en/1")
    assert (got[3].rule, got[3].verdict) == ("org/", "allow")
    assert (got[4].path, got[4].rule) == ("", None)
    assert got[5].rule == "org/" and got[6].rule == "com/de/" and got[7].rule == "com/fr/" and got[12].rule is None
    assert got[8].verdict == "block" and got[9].verdict == "allow"
    assert (got[10].host, got[10].path, got[11].host, got[11].rule) == ("", "", "", None)
    assert url_filter.judge(frame).count() == len(rows) and url_filter.judge(frame.limit(0)).count() == 0
    for r in got.values():
        host = re.match(r".*?://([^/?#]*)", next(u for p, u, _ in rows if p == r.page_id) or "")
        assert r.host == (host[1].lower() if host else "")


def test_pagerank_against_power_iteration(spark):
    from tessella.llm._scratch import Scratch

    rng = random.Random(2)
    names = [f"h{i}" for i in range(12)]
    edges = {(rng.choice(names), rng.choice(names)): rng.randint(1, 4) for _ in range(25)}
    edges = {k: n for k, n in edges.items() if k[0] != k[1]}
    mass = {h: float(rng.randint(0, 2)) for h in names}
    seeds = spark.createDataFrame(list(mass.items()), "host string, mass double")
    graph = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n long")
    got = {r.host: r.score for r in url_filter.propagate(seeds, graph, Scratch(spark, "t")).collect()}
    seed = {h: m / sum(mass.values()) for h, m in mass.items()}
    now = dict(seed)
    for _ in range(url_filter.ROUNDS):
        lost = sum(s for h, s in now.items() if not any(a == h for a, _ in edges))
        into = Counter()
        for (a, b), n in edges.items():
            into[b] += n / sum(k for (x, _), k in edges.items() if x == a) * now[a]
        now = {h: (1 - url_filter.DAMPING + url_filter.DAMPING * lost) * seed[h] + url_filter.DAMPING * into[h] for h in names}
    assert got == pytest.approx(now, abs=1e-12)


def test_pipeline_stage_by_stage(spark, tmp_path):
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice("the of and to in is was for " .split() + [f"w{rng.randint(1, 900)}" for _ in range(9)]) for _ in range(n))
    rows = []
    for i in range(60):
        text = prose(rng.randint(30, 200))
        rows.append((i, text, "en", f"src{i % 5}", len(text)))
    rows += [(100 + i, rows[i][1] + " extra", "en", "src1", 1) for i in range(10)]
    rows += [(200, prose(80) + " password=b7db7aa4a5fcc78305", "fr", None, 1), (201, None, None, None, None), (202, "short", "en", "src2", 5), (203, "#*$ " * 90, "en", "src2", 5)]
    rows += [rows[4]]
    folder = f"{tmp_path}/sf"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "dedup", "secrets", "mix", "pack"]
    kept = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if n < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        kept[name] = docs.collect()
    good = {r.doc_id for r in kept["quality"]}
    assert not good & {201, 202, 203} and len(good) == 71
    before = [(r.doc_id, r.text) for r in kept["quality"]]
    wanted = sorted(d for d, _, _, k in brute_components(shingle_sets(before), 80) if k)
    assert sorted(r.doc_id for r in kept["dedup"]) == wanted
    changed = {r.doc_id: (r.text, r.n_chars) for r in kept["secrets"]}
    for r in kept["dedup"]:
        assert changed[r.doc_id] == (secret_scan.redacted(r.text), len(secret_scan.redacted(r.text)))
    assert "b7db7aa4a5fcc78305" not in changed[200][0]
    tokens = sum(len(r.text.split()) for r in kept["secrets"])
    taken = sum(len(r.text.split()) for r in kept["mix"])
    assert {r.doc_id for r in kept["mix"]} <= set(changed) and 0.4 * tokens < taken <= 0.8 * tokens
    assert {r.doc_id for r in kept["pack"]} == {r.doc_id for r in kept["mix"]}
    assert corpus_pipeline.run(spark, folder).count() == len(kept["pack"])
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/sf/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/sf").count() == 0


def test_dedup_keeps_one_row_of_each_component(spark):
    rng = random.Random(21)
    prose = lambda n: " ".join(f"w{rng.randint(1, 900)}" for _ in range(n))
    a, b, c, d, e = (prose(90) for _ in range(5))
    rows = [(None, a), (None, a), (None, a + " extra"), (None, b), (7, c), (7, d), (3, d + " extra"), (None, d), (5, e), (5, e), (None, e), (None, None), (9, "")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.dedup(spark, frame.repartition(3), "")
    assert out.columns == frame.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    first = next(k for k in got if k[1] and k[1].startswith(a))
    assert first in {(None, a), (None, a + " extra")}
    assert got == Counter([first, (None, b), (7, c), (3, d + " extra"), (5, e), (None, None), (9, "")])
