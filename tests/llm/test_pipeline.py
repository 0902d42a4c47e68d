"""The pipeline over a small table with nulls, repeated rows and clashing columns, stage by stage against plain versions."""

import os
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from dossier.sources.stages import shared_dir

from test_links_and_grades import shingles

SF = "/root/testdata/sf0.001"


def tables(folder):
    """The smallest documents with odd rows and columns, and their labels."""
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    text = docs[0]["text"]
    odd = [
        (9001, None), (9002, ""), (9003, "   \n"), (9001, None), (None, "a text without an id"), (None, "a text without an id"),
        (9004, text), (9005, text + " and some more"), (9006, text), (9006, text), (9006, "other words under the same id " * 12),
        (9007, "write to jane.doe@example.com or call " * 12),
    ]
    docs += [{"doc_id": i, "text": t, "lang": "en", "source": "odd", "n_chars": len(t or "")} for i, t in odd]
    for n, d in enumerate(docs):
        d |= {"kept": f"k{n}", "judged": n, "row": "r", "label": None, "key": 1.5}
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]
        + [("kept", pa.string()), ("judged", pa.int64()), ("row", pa.string()), ("label", pa.string()), ("key", pa.float64())]
    )
    pq.write_table(pa.Table.from_pylist(docs, schema), f"{folder}/documents.parquet")
    pq.write_table(pq.read_table(f"{SF}/labels.parquet"), f"{folder}/labels.parquet")
    return schema.names


def stages_of(spark, folder):
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    last = corpus_pipeline.run(spark, folder)
    new = [f for f in os.listdir(shared_dir(spark).removeprefix("file:")) if f.startswith("pipeline-") and f not in before]
    base = f"{shared_dir(spark)}/{new[0]}"
    return {name: spark.read.parquet(f"{base}/{i}-{name}") for i, (name, _) in enumerate(corpus_pipeline.STAGES)}, last


def representatives(docs):
    """Rows (doc_id, text) that stay, and how many rows without an id."""
    known = [d for d in docs if d["doc_id"] is not None]
    sets = [shingles(d["text"]) for d in known]
    parent = list(range(len(known)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(known)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            alike = 100 * shared >= 75 * (len(sets[i]) + len(sets[j]) - shared) if shared else False
            if alike or (not sets[i] and (known[i]["doc_id"], known[i]["text"]) == (known[j]["doc_id"], known[j]["text"])):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = defaultdict(list)
    for i, d in enumerate(known):
        groups[root(i)].append(d)
    return sorted(min(d["doc_id"] for d in g) for g in groups.values())


def test_pipeline(spark, tmp_path):
    files = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    names = tables(str(tmp_path))
    stages, last = stages_of(spark, str(tmp_path))
    done = {name: [r.asDict() for r in frame.collect()] for name, frame in stages.items()}
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].columns == names
    before = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()

    kept = {r["judged"]: r for r in done["quality_classifier"]}
    assert len(kept) == len(done["quality_classifier"]) and all(kept[r["judged"]] == r.asDict() for r in before if r["judged"] in kept)

    near = done["ngram_join"]
    assert sorted(r["doc_id"] for r in near if r["doc_id"] is not None) == representatives(done["quality_classifier"])
    assert sum(r["doc_id"] is None for r in near) == sum(r["doc_id"] is None for r in done["quality_classifier"])
    assert all(kept[r["judged"]] == r for r in near)

    private = {r["judged"]: r for r in done["personal_data"]}
    assert private.keys() == {r["judged"] for r in near}
    assert not any("jane.doe@example.com" in (r["text"] or "") for r in private.values())
    assert all(r["n_chars"] == len(r["text"]) for r in private.values() if r["text"] is not None)

    mixed = done["mix_sources"]
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in private.values()}
    # Rows that are alike share the columns of one of them.
    alike = Counter((r["doc_id"], r["text"], r["source"]) for r in private.values())
    for (_, judged), n in Counter((r["doc_id"], r["judged"]) for r in mixed).items():
        assert n <= 3 * alike[tuple(private[judged][c] for c in ("doc_id", "text", "source"))]

    tokenizer = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = Counter()
    for r in mixed:
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want[r["doc_id"]] += len(ids)
    got, sequences = Counter(), defaultdict(list)
    for r in done["pack_tokens"]:
        got[r["doc_id"]] += r["length"]
        assert len(np.frombuffer(r["ids"], "<u4")) == r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want and last.count() == len(done["pack_tokens"])
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_pipeline_of_nothing(spark, tmp_path):
    tables(str(tmp_path))
    for name in ("documents", "labels"):
        full = pq.read_table(f"{tmp_path}/{name}.parquet")
        pq.write_table(full.slice(0, 0), f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
