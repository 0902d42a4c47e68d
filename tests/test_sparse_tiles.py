"""Sparse rows in tiles: postings and sketches in single precision, exact scores for the cells that count."""

import numpy as np
import pytest
from helpers import rows

from dossier.operators import blocks, similarity
from dossier.plans import evaluation


def sparse(dense, ids, groups=None):
    r, c = np.nonzero(dense)
    block = {"ids": np.asarray(ids), "n": len(dense), "rows": r, "keys": c, "values": dense[r, c]}
    return block if groups is None else {**block, **blocks.group_order(np.asarray(groups, dtype=object), block["ids"])}


def zipf(n, keys, seed, signed=False):
    rng = np.random.default_rng(seed)
    dense = (rng.random((n, keys)) < 0.6 / np.arange(1, keys + 1) ** 0.7) * (rng.random((n, keys)) + 0.1)
    if signed:
        dense *= rng.choice([-1, 1], (n, keys))
    dense[n // 2 : n // 2 + 20] = dense[7]  # equal rows
    dense[3] = 0
    return dense / np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-300)


def by_hand(scores, ids, k, positive, groups=None):
    out = []
    for i, row in enumerate(np.round(scores, 9)):
        seen = set()
        for j in sorted(range(len(ids)), key=lambda j: (-row[j], ids[j])):
            mark = j if groups is None else groups[j]
            if len(seen) < k and mark not in seen and (row[j] > 0 or not positive):
                seen.add(mark)
                out.append((i, ids[j]))
    return sorted(out)


@pytest.mark.parametrize("positive", [False, True])
@pytest.mark.parametrize("signed", [False, True])
@pytest.mark.parametrize("n_groups", [None, 4, 400])
@pytest.mark.parametrize("held_side", [True, False])
def test_tiles_against_brute_force(monkeypatch, positive, signed, n_groups, held_side):
    monkeypatch.setattr(blocks, "TILE_ENTRIES", 9000)
    monkeypatch.setattr(blocks, "ROWS_PER_KEY", 40)
    monkeypatch.setattr(blocks, "LONG_POSTING", 30)
    monkeypatch.setattr(blocks, "SKETCH_CELLS", 9000)
    q, c = zipf(60, 300, 1, signed), zipf(1500, 300, 2, signed)
    ids = np.random.default_rng(3).permutation(1500)
    groups = None if n_groups is None else np.random.default_rng(4).integers(0, n_groups, 1500)
    want = by_hand(q @ c.T, ids, 5, positive, groups)
    part = lambda s: sparse(c[s], ids[s], None if groups is None else groups[s])
    if held_side:
        streamed = (part(slice(i, i + 400)) for i in range(0, 1500, 400))
        found = blocks.best_for_held(streamed, sparse(q, np.arange(60)), 5, positive, groups is not None, groups is not None)
    else:
        found = blocks.best_for_streamed(sparse(q, np.arange(60)), blocks.index_block(part(slice(None))), 5, positive, groups is not None)
    assert sorted(zip(found["query"].tolist(), found["id"].tolist(), strict=True)) == want


def test_only_cells_that_can_count_get_an_exact_score(monkeypatch):
    scored, plain = [], blocks.cell_scores
    monkeypatch.setattr(blocks, "cell_scores", lambda at, *a: (scored.append(len(at)), plain(at, *a))[1])
    q, c = zipf(50, 2000, 1), zipf(4000, 2000, 2)
    blocks.best_for_held(iter([sparse(c, np.arange(4000))]), sparse(q, np.arange(50)), 5, True)
    assert 0 < sum(scored) < 50 * 4000 / 20


def test_floors_of_a_sample_leave_the_lists_as_they_are(spark, monkeypatch):
    data = [(i, [int(k) for k in np.flatnonzero(v)], [float(x) for x in v[v > 0]]) for i, v in enumerate(zipf(400, 60, 5))]
    corpus = spark.createDataFrame(data, "person_id long, keys array<int>, w array<double>")
    queries = corpus.withColumnRenamed("person_id", "query_id")
    want = rows(similarity.top_k(queries, corpus, 4, vector=("keys", "w")))
    monkeypatch.setattr(similarity, "FLOOR_PAIRS", 1)
    monkeypatch.setattr(similarity, "SAMPLED", 3)
    floors, plain = [], similarity._Search.with_floors

    def seen(self, *a):
        floors.append(plain(self, *a))
        return floors[-1]

    monkeypatch.setattr(similarity._Search, "with_floors", seen)
    assert rows(similarity.top_k(queries, corpus, 4, vector=("keys", "w"), held_bytes=-1, tile_bytes=40_000)) == want
    assert floors[0].filter("floor > 0").count() > 300


def test_a_text_that_several_resumes_drew_is_matched_once(spark, monkeypatch):
    from dossier.plans import matching

    corpus = spark.createDataFrame([(i, f"T{i}", f"java spark w{i} w{i % 3}") for i in range(6)], "person_id int, title string, embedding_text string")
    index = matching.build_index(corpus, sparse=True, min_df=1, max_df=1.0)
    resumes = spark.createDataFrame([(i,) for i in range(40)], "resume_id int")
    matched, plain = [], evaluation.match

    def seen(queries, *a, **options):
        matched.append(queries.count())
        return plain(queries, *a, **options)

    monkeypatch.setattr(evaluation, "match", seen)
    done = evaluation.evaluate_matcher(index, resumes=resumes)
    assert matched[0] <= 6 and done.results.select("resume_id").distinct().count() == 40
