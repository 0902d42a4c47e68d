"""Running lists of held queries: rows merge into the lists they concern, in tiles of both sides."""

import numpy as np
import pytest

from dossier.operators import blocks, similarity


def dense_block(matrix, ids, groups=None):
    block = {"ids": np.asarray(ids), "n": len(matrix), "matrix": matrix}
    if groups is not None:
        codes = np.unique(groups, return_inverse=True)[1]
        block.update(groups=np.asarray(groups, dtype=object), codes=codes, order=np.lexsort((ids, codes)))
    return block


def by_hand(scores, ids, k, groups=None):
    out = []
    for i, row in enumerate(np.round(scores, 9)):
        seen = set()
        for j in sorted(range(len(ids)), key=lambda j: (-row[j], ids[j])):
            mark = j if groups is None else groups[j]
            if len(seen) < k and mark not in seen:
                seen.add(mark)
                out.append((i, ids[j]))
    return sorted(out)


def pairs(found):
    return sorted(zip(found["query"].tolist(), found["id"].tolist(), strict=True))


@pytest.mark.parametrize("held_side", [True, False])
@pytest.mark.parametrize("n_groups", [None, 4, 90])
def test_tiles_of_both_sides_against_brute_force(monkeypatch, held_side, n_groups):
    monkeypatch.setattr(blocks, "CELLS", 5000)
    monkeypatch.setattr(blocks, "PIECE_ROWS", 150)
    rng = np.random.default_rng(5)
    q, c = rng.integers(-3, 4, (70, 3)).astype(float), rng.integers(-3, 4, (900, 3)).astype(float)  # many ties
    ids = rng.permutation(900)
    groups = None if n_groups is None else rng.integers(0, n_groups, 900)
    want = by_hand(q @ c.T, ids, 6, groups)
    if held_side:
        cut = [slice(i, i + 300) for i in range(0, 900, 300)]
        streamed = (dense_block(c[s], ids[s], None if groups is None else groups[s]) for s in cut)
        found = blocks.best_for_held(streamed, dense_block(q, np.arange(70)), 6, False, groups is not None, groups is not None)
    else:
        found = blocks.best_for_streamed(dense_block(q, np.arange(70)), dense_block(c, ids, groups), 6, False, groups is not None)
    assert pairs(found) == want


def test_a_merge_touches_only_the_lists_it_concerns(monkeypatch):
    rng = np.random.default_rng(1)
    held, n = dense_block(rng.normal(size=(3000, 8)), np.arange(3000)), 4000
    merged, add = [], blocks.Lists.add

    def seen(self, query, id, score, group=None):
        merged.append(len(query))
        return add(self, query, id, score, group)

    monkeypatch.setattr(blocks.Lists, "add", seen)
    rows = rng.normal(size=(n, 8))
    streamed = [dense_block(rows[i : i + 500], np.arange(i, i + 500)) for i in range(0, n, 500)]
    assert len(blocks.best_for_held(iter(streamed), held, 15, False)) == 3000 * 15
    # A list takes k log(n / k) rows or so; of 12 million pairs few reach a merge.
    assert sum(merged) < 3000 * 15 * 8


def test_null_ids_in_one_of_the_blocks():
    held = dense_block(np.ones((1, 1)), np.arange(1))
    streamed = [dense_block(np.ones((2, 1)), np.array([7, 5])), dense_block(np.ones((2, 1)), np.array([np.nan, 3.0]))]
    found = blocks.best_for_held(iter(streamed), held, 4, False)
    assert found["id"].tolist()[:3] == [3, 5, 7] and np.isnan(found["id"].iloc[3])


def test_a_small_file_with_much_to_compare_is_dealt_to_all_cores(spark, monkeypatch):
    rows = spark.range(0, 400, 1, 1).selectExpr("id AS person_id", "array(double(id % 7), double(id % 11)) AS embedding")
    queries = rows.withColumnRenamed("person_id", "query_id")
    few = similarity.top_k(queries, rows, 3).collect()
    dealt = []
    plain = similarity._Search.hold_queries
    monkeypatch.setattr(similarity, "SPREAD_PAIRS", 1)
    monkeypatch.setattr(
        similarity._Search, "hold_queries", lambda self, q, c: (dealt.append(c.rdd.getNumPartitions()), plain(self, q, c))[1]
    )
    assert sorted(similarity.top_k(queries, rows, 3).collect()) == sorted(few)
    assert dealt == [spark.sparkContext.defaultParallelism]


def test_full_lists_of_sparse_rows_are_only_compared_with(monkeypatch):
    rng = np.random.default_rng(2)
    dense = (rng.random((1500, 60)) < 0.2) * rng.random((1500, 60))

    def sparse(part, ids):
        r, c = np.nonzero(part)
        return {"ids": np.asarray(ids), "n": len(part), "rows": r, "keys": c, "values": part[r, c]}

    looked, plain = [], blocks.found_rows
    monkeypatch.setattr(blocks, "found_rows", lambda *a: (looked.append(1), plain(*a))[1])
    streamed = (sparse(dense[i : i + 100], np.arange(i, i + 100)) for i in range(0, 1500, 100))
    found = blocks.best_for_held(streamed, sparse(dense[:40], np.arange(40)), 3, True)
    scores = dense[:40] @ dense.T
    assert pairs(found) == by_hand(np.where(scores > 0, scores, -1), np.arange(1500), 3)
    assert len(looked) < 8  # the first of 15 blocks, before the lists have filled
