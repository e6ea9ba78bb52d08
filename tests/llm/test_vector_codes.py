"""Vector codes against a plain version: whole tables, odd rows, and that only changes are shuffled."""

import random

import brute
import numpy as np
import pytest
from chainloom.llm import common, vector_codes

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, v int, row string, code string"


def table(spark, rows):
    return spark.createDataFrame([(d, v, label, 1, "x", None) for d, v, label in rows], SCHEMA).repartition(3)


def coded(spark, rows, monkeypatch, **options):
    monkeypatch.setattr(vector_codes, "read", lambda *_: table(spark, rows))
    got = vector_codes.op11_vector_codes(spark, "")
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    found = got.collect()
    return sorted([tuple(x)[:4] for x in found], key=str), {x[4] for x in found}


def test_whole_table(spark):
    rows = [(x.vec_id, x.embedding, x.label) for x in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, sha = brute.vector_codes(rows)
    got = vector_codes.op11_vector_codes(spark, SF).collect()
    assert sorted(tuple(x)[:4] for x in got) == sorted(want) and {x[4] for x in got} == {sha}


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_rows(spark, monkeypatch, seed):
    """Repeated ids and vectors, null ids and labels, vectors that are left out, ties, negative sums, a label of most rows."""
    r = random.Random(seed)
    vector = lambda: [r.choice([-1.5, -0.25, -0.0001, 0.0, 0.0001, 0.3, 2.0]) for _ in range(16)]
    rows = [(r.randint(0, 40), vector(), r.choice([None, 7, 7, 7, 1])) for _ in range(120)]
    rows += [(None, vector(), 1), (None, None, 1), (3, [NAN] * 16, 1), (4, [0.1] * 15 + [INF], 2), (5, [0.1] * 15 + [None], 2), (6, [], 3), *rows[:30]]
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    want, sha = brute.vector_codes(rows)
    assert coded(spark, rows, monkeypatch) == (sorted(want, key=str), {sha})


def test_few_rows_lengths_and_large_values(spark, monkeypatch):
    rows = [(2, [0.5] * 8, None), (1, [0.25] * 8, None), (3, [1.0] * 9, None)]
    want, sha = brute.vector_codes(rows[1::-1])
    assert coded(spark, rows, monkeypatch) == (sorted(want, key=str), {sha})  # the vector of another length is left out
    got, _ = coded(spark, [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1), (3, [3e38] * 7 + [0.0], 1)], monkeypatch)
    assert len(got) == 3 and all(e >= 0 for _, _, e, _ in got)
    assert coded(spark, [(1, None, 1)], monkeypatch) == ([], set()) and coded(spark, [], monkeypatch) == ([], set())
    found, books = vector_codes.compressed(table(spark, [(k, [float(k)] * 5, 0) for k in range(9)]), parts=2, entries=3)
    assert [b.shape for b in books] == [(3, 2), (3, 3)] and found.count() == 9


def test_rounds_shuffle_changes_only(spark, monkeypatch):
    """Assignments are read without an exchange; only what moved gives contributions, and a settled round gives none."""
    seen = []
    kept = vector_codes.bucketed

    def watched(df, n):
        out = kept(df, n)
        seen.append((df, out))
        return out

    monkeypatch.setattr(vector_codes, "bucketed", watched)
    r = np.random.default_rng(3)
    rows = [(k, (r.normal(0, 0.01, 16) + 3 * (k % 16)).tolist(), 0) for k in range(400)]
    found, _ = vector_codes.compressed(table(spark, rows))
    assert found.count() == 400
    plans = [df._jdf.queryExecution().executedPlan().toString() for df, _ in seen[2:]]
    assert plans and all("Exchange" not in p and "ShuffledHashJoin" in p for p in plans)
    moved = [out.where("part is not null and place = -1 and delta > 0").agg({"delta": "sum"}).first()[0] or 0 for _, out in seen[1:]]
    assert moved[0] == 400 * 8 and moved[-1] == 0 and len(moved) < 7
