"""What leaves pairs of blocks: counts and lines against plain Python."""

from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.operators import search
from tessella.plans import catalogue


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of ``embeddings`` with some rows that have no label and some ids left out, and DuckDB on it."""
    rng = np.random.default_rng(4)
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, rng.normal(0, 0.15, 64).tolist(), None if i % 7 == 3 else i % 4) for i in range(260)]
    rows = [r for r in rows if r[0] % 50 != 17]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    return folder, con


def same(spark, tables, name, digits=None):
    folder, con = tables
    out = catalogue.QUERIES[name](spark, folder)
    names = sorted(out.columns)
    wanted = con.sql(f"SELECT {', '.join(names)} FROM ({catalogue.ORACLES[name]})").fetchall()
    flat = lambda r: tuple(x if digits is None or not isinstance(x, float) else round(x, digits) for x in r)
    assert Counter(flat(r) for r in out.select(*names).collect()) == Counter(flat(r) for r in wanted)


def test_counts_by_row_of_near_and_far_values():
    rng = np.random.default_rng(2)
    for spread in (5, 10**12):
        whole, rows = rng.integers(-spread, spread, (6, 40)), np.array([0, 1, 0, 2, 2, 1])
        got = {(int(r), int(v)): int(n) for r, v, n in zip(*search.counted(rows, whole), strict=True)}
        assert got == Counter((int(r), int(v)) for r, line in zip(rows, whole, strict=True) for v in line)
    assert [len(x) for x in search.counted(np.zeros(0, int), np.zeros((0, 3), int))] == [0, 0, 0]


def test_histograms_of_rows_and_columns_without_labels(spark, tables):
    same(spark, tables, "score_histogram_rowcol")


def test_counts_of_rows_and_columns_at_once():
    rng = np.random.default_rng(3)
    for spread, kinds in ((5, 3), (5, 40), (10**12, 2)):
        whole, names = rng.integers(-spread, spread, (7, 90)), rng.integers(0, kinds, 90)
        for (rows, value, n), by in zip(search.counted_sides(whole, names), (lambda i, j: i, lambda i, j: int(names[j])), strict=True):
            got = {(int(r), int(v)): int(c) for r, v, c in zip(rows, value, n, strict=True)}
            assert got == Counter((by(i, j), int(v)) for i, line in enumerate(whole) for j, v in enumerate(line))
    assert [len(x) for side in search.counted_sides(np.zeros((0, 3), int), np.zeros(3, int)) for x in side] == [0] * 6


def test_blocks_of_one_file_are_dealt_to_tasks(spark):
    """Rows that lie in one partition: all pairs of blocks, in more tasks than one, some rows of queries at a time."""
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (4 * search.BLOCK + 10, 3)).astype(float)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, x array<double>").coalesce(1)

    def sizes(qid, sid, score):
        return {"q": qid, "most": np.full(len(qid), score.size), "n": np.full(len(qid), len(sid)), "total": score.sum(1)}

    found = search.scored(table.where("id % 20 = 0"), table, "id", "x", sizes, "q long, most long, n long, total double").withColumn("task", F.spark_partition_id())
    rows = found.collect()
    assert len({r.task for r in rows}) == 5 and max(r.most for r in rows) <= search.CELLS
    n, total = Counter(), Counter()
    for r in rows:
        n[r.q] += r.n
        total[r.q] += r.total
    assert n == dict.fromkeys(range(0, len(x), 20), len(x)) and total == {i: x[i] @ x.sum(0) for i in n}


def test_counts_are_added_up_in_a_task(spark, monkeypatch):
    """What leaves a task has one row of a key while they fit, and loses no count when they do not."""
    rng = np.random.default_rng(6)
    keys, n = rng.integers(0, 9, (50, 20)), rng.integers(1, 5, (50, 20))
    parts = [pa.RecordBatch.from_pydict({"key": k, "n": c}) for k, c in zip(keys, n, strict=True)]
    wanted = Counter()
    for k, c in zip(keys.ravel().tolist(), n.ravel().tolist(), strict=True):
        wanted[k] += c
    for held in (search.HELD, 40, 10):
        monkeypatch.setattr(search, "HELD", held)
        got, rows = Counter(), [r for b in search._summed(iter(parts)) for r in b.to_pylist()]
        for r in rows:
            got[r["key"]] += r["n"]
        assert got == wanted and (len(rows) == 9) == (held > 10)
    assert list(search._summed(iter([]))) == []

    table = spark.createDataFrame([(i, [float(i % 3)]) for i in range(3 * search.BLOCK)], "id long, x array<double>").coalesce(1)

    def bins(qid, sid, score):
        return {"q": np.zeros(1, np.int64), "n": np.array([score.size])}

    rows = search.scored(table.where("id < 500"), table, "id", "x", bins, "q long, n long", summed=True).collect()
    assert len(rows) <= 3 and sum(r.n for r in rows) == 500 * 3 * search.BLOCK


def test_vectors_of_a_block():
    lists = pa.array([[9.0, 9.0], [1.0, 2.0], [None, 4.0], [5.0, 6.0]], pa.list_(pa.float64()))
    assert np.array_equal(search._matrix(lists.slice(1, 2)), [[1.0, 2.0], [np.nan, 4.0]], equal_nan=True)
    with pytest.raises(ValueError):
        search._matrix(pa.array([[1.0], [2.0, 3.0, 4.0]]))


def test_lines_of_hits_have_the_digits_of_c(spark):
    from tessella.plans._vectors import _hit_line

    scores = [19.76515, 19.77835, 19.75875, 0.00005, 12.0, -3.14155]  # the first three lie below what they look like
    rows = spark.createDataFrame([(i + 1, 40 * i, x) for i, x in enumerate(scores)], "rank int, subject_id long, score double")
    got = [r.text for r in rows.select("rank", _hit_line("rank", "subject_id", "score").alias("text")).orderBy("rank").collect()]
    wanted = duckdb.sql(" UNION ALL ".join(f"SELECT {i + 1} AS k, printf('%5d %10d %10.4f', {i + 1}, {40 * i}, {x!r}::DOUBLE) AS t" for i, x in enumerate(scores)))
    assert got == [t for _, t in sorted(wanted.fetchall())]
    assert got[:3] == ["    1          0    19.7651", "    2         40    19.7783", "    3         80    19.7587"]


def test_diagonals_of_profiles_with_gaps(spark, tmp_path):
    """Positions left out, and one without a vector; no cell is shuffled."""
    rng = np.random.default_rng(9)
    rows = [(i, None if i == 23 else [0.0] * 64 if i == 31 else rng.normal(0, 0.3, 64).tolist(), 0) for i in range(160) if i not in (4, 5, 77, 150)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("diagonal_average", "diagonal_autocorrelation"):
        same(spark, (str(tmp_path), con), name, 5)
        assert "Exchange hashpartitioning" not in catalogue.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_diagonals_of_positions_without_a_profile(spark, tmp_path, monkeypatch):
    """Vectors without an id: one nameless profile, as in SQL; in parts as at once."""
    from tessella.operators import align

    rng = np.random.default_rng(8)
    rows = [(i, None if i == 23 else rng.normal(0, 0.3, 64).tolist(), 0) for i in range(70)]
    schema = "vec_id long, embedding array<float>, label int"
    for k, added in enumerate(([rng.normal(0, 0.3, 64).tolist()], [None], rng.normal(0, 0.3, (3, 64)).tolist())):
        folder = f"{tmp_path}/{k}"
        spark.createDataFrame(rows + [(None, x, 0) for x in added], schema).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
        for name in ("diagonal_average", "diagonal_autocorrelation"):
            found = []
            for size in (align.NAMELESS, 7):
                monkeypatch.setattr(align, "NAMELESS", size)
                if len(added) == 1:
                    same(spark, (folder, con), name, 5)
                rows_of = catalogue.QUERIES[name](spark, folder).where("id is null").collect()
                found.append(Counter((r.q, r.s, r[3] if r[3] is None else round(r[3], 5)) for r in rows_of))
                assert len(rows_of) == len(con.sql(f"SELECT * FROM ({catalogue.ORACLES[name]}) WHERE id IS NULL").fetchall()) == 50 * len(added)
            assert found[0] == found[1]
            monkeypatch.undo()


def test_pairs_of_one_shape_are_aligned_together(spark, monkeypatch):
    """Profiles of several lengths and moves: few passes, each pair as on its own."""
    from tessella.operators import align

    rng = np.random.default_rng(3)
    rows = [(i, rng.dirichlet(np.full(6, 0.3), 12 + i % 3).tolist(), np.log(rng.dirichlet(np.ones(9), 13 + i % 3)).tolist() if i % 4 == 1 else None) for i in range(12)]
    scheme, share = align.Scheme(scale=6.0, offset=1.5), 0.28
    given = [(i, np.array(v), align.default_moves(len(v)) if t is None else np.array(t)) for i, v, t in rows]
    table = spark.createDataFrame(rows, "profile_id long, v array<array<double>>, moves array<array<double>>").coalesce(1)
    for together in (align.TOGETHER, 1):
        monkeypatch.setattr(align, "TOGETHER", together)
        found = align.align_profiles(table.where("profile_id < 3"), table, scheme, realign=True, least=share).collect()
        got = {(r.query_id, r.subject_id): (r.score, r.n_matched, [(p.q, p.s) for p in r.path]) for r in found}
        assert len(got) == len(found) == 36
        for i, x, a in given[:3]:
            for j, y, b in given:
                scores = 6.0 * (x @ y.T) - 1.5
                one = align.local(scores, a, b)
                path = align.most_accurate(align.posteriors(scores, a, b)[0], share)[1] if one.path else []
                assert got[i, j] == (pytest.approx(one.score), one.matches, path)
    assert [len(p) for p in align._alike([(2, 2)] * 5 + [(2, 3)])] == [1] * 6
    monkeypatch.undo()
    assert sorted(len(p) for p in align._alike([(2, 2)] * 5 + [(2, 3)])) == [1, 5]
