"""Similar pairs by hashed signs against all pairs."""

import numpy as np

from sparkloom.operators import lsh, memory


def _frame(spark, vectors, groups):
    rows = [(f"k{i:05d}", groups[i], i // 2, [float(x) for x in v] if v is not None else None) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id string, project string, created_at long, embedding array<float>").repartition(4)


def _pairs(df):
    rows = [tuple(r) for r in df.select("project", "earlier", "later").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_hashed_pairs_are_true_and_most_of_all(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(60, 32))
    vectors = [*(centres[r.integers(0, 60)] + 0.35 * r.normal(size=32) for _ in range(900)), None, np.zeros(0), np.zeros(32), np.ones(5), np.ones(5)]
    df = _frame(spark, vectors, ["p" if i % 3 else "q" for i in range(len(vectors))])
    exact, found = (_pairs(f(df, ["project"], ["created_at"], 0.85)) for f in (memory.similar_pairs, lsh.similar_pairs_hashed))
    assert found <= exact and len(exact) > 1_000
    assert len(found) >= 0.9 * len(exact)
    assert _pairs(lsh.similar_pairs_hashed(df.limit(0), ["project"], ["created_at"], 0.85)) == set()


def test_a_key_of_many_vectors_is_cut(spark, monkeypatch):
    monkeypatch.setattr(lsh, "BLOCK", 16)
    one = np.random.default_rng(4).normal(size=8)
    for n in (33, 64, 90):  # 3, 4 and 6 blocks
        df = _frame(spark, [one] * n, ["p"] * n)
        assert len(_pairs(lsh.similar_pairs_hashed(df, ["project"], ["created_at"], 0.9))) == n * (n - 1) // 2


def test_bands_follow_threshold_and_size():
    assert lsh.bands_for(1 << 20, 0.85, 0.95)[0] > lsh.bands_for(1 << 12, 0.85, 0.95)[0]
    for n, threshold in ((1_000, 0.35), (10**6, 0.85), (10**9, 0.85), (50, 0.99)):
        signs, bands = lsh.bands_for(n, threshold, 0.95)
        met = (1 - np.arccos(threshold) / np.pi) ** signs
        assert 1 - (1 - met) ** bands >= 0.95 and (bands <= lsh.MOST_BANDS or signs == 1)


def test_hashed_pairs_of_the_given_table(spark):
    import __spark_entry__

    queries = __spark_entry__.queries()
    exact, found = ({tuple(r) for r in queries[name](spark, "/root/testdata/sf0.01").select("earlier", "later").collect()} for name in ("near_dup_pairs", "hashed_pairs"))
    assert found <= exact and len(found) >= 0.9 * len(exact)
