"""Exact duplicates, importance resampling and spelling variants against plain versions on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dossier.llm import block_names, resampling, spelling

DOCS = "doc_id long, text string, name string, row string, part string, n string"


def documents(spark, rows):
    """Documents with extra columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in rows], DOCS)


def long_text(n, seed):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdeé語") for _ in range(draw.randint(1, 9))) for _ in range(n))


# --- exact duplicates ------------------------------------------------------------------------------------------


def texts_with_copies():
    base = [None, "", "a", "b", "é", "aa", "x" * 16, "x" * 17, "x" * 32, "x" * 33, "ab" * 100, "ab" * 100 + "c", long_text(900, 1)]
    base += ["y" * 16 + "x" * 16, "x" * 16 + "y" * 16, long_text(900, 1)[:-1] + "!", "x" * 16 * 7, "x" * 16 * 8, "x" * 16 * 9]
    draw = random.Random(3)
    texts = [t for t in base for _ in range(draw.randint(1, 4))] + ["hot"] * 60 + ["y" * 500] * 20
    draw.shuffle(texts)
    return texts


def check_groups(rows, docs):
    want = defaultdict(list)
    for doc, text in docs:
        want[text or ""].append(doc)
    assert len(rows) == len(docs)
    by_text = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in want.items()}
    kept = Counter()
    for r in rows:
        ids = by_text[r["text_sha256"]]
        top = max((i for i in ids if i is not None), default=None)
        assert r["keep_id"] == top and r["group_size"] == len(ids) and r["doc_id"] in ids
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == top
    assert set(kept.values()) <= {1} and len(kept) == len(want)


@pytest.mark.parametrize("size", [16, 1024])
def test_groups_are_those_of_equal_texts(spark, size):
    docs = [(i, t) for i, t in enumerate(texts_with_copies())]
    check_groups(block_names.groups(documents(spark, docs), size=size).collect(), docs)


def test_repeated_and_null_ids(spark):
    docs = [(None, "a"), (None, "a"), (7, "a"), (7, "a"), (7, "b"), (None, "c"), (None, "c"), (None, None), (3, "")]
    check_groups(block_names.groups(documents(spark, docs), size=16).collect(), docs)


def test_clashing_digests_are_made_anew(spark):
    def weak(block, salt):
        # Two digests in all at first, then the usual ones.
        return F.pmod(F.length(block), F.lit(2)).cast("string").cast("binary") if salt < 2 else block_names.sha(block, salt)

    docs = [(i, t) for i, t in enumerate(texts_with_copies())]
    frame = documents(spark, docs)
    assert block_names.first_names(frame.select("text"), 16, weak)[1] == 2
    check_groups(block_names.groups(frame, size=16, digest=weak).collect(), docs)
    with pytest.raises(RuntimeError, match="share a digest"):
        block_names.groups(frame, size=16, digest=lambda block, salt: F.lit(b"one"))


def test_kept_documents_have_all_their_columns(spark):
    frame = documents(spark, [(1, "a"), (2, "a"), (3, None), (2, "a")])
    kept = block_names.dedup(frame)
    assert kept.columns == frame.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(2, "a", "x", "y", "z", "w"), (3, None, "x", "y", "z", "w")]


def test_no_documents(spark):
    empty = documents(spark, [])
    assert block_names.groups(empty).collect() == []
    assert resampling.resample(empty, empty).collect() == []
    assert spelling.variants(spelling.counts(empty)).collect() == []


def test_naming_needs_no_python(spark):
    docs = documents(spark, [(1, "a"), (2, "a")])
    plan = block_names.groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- importance resampling --------------------------------------------------------------------------------------


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return len(words), [" ".join(words[i : i + k]) for k in range(1, width + 1) for i in range(len(words) - k + 1)]


def plain_resample(docs, target, percent, least, width, buckets, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(doc, *plain_features(text, width)) for doc, text in docs]
    s, t = Counter(bucket(f) for _, _, fs in own for f in fs), Counter(bucket(f) for x in target for f in plain_features(x, width)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    rows = []
    for doc, n, fs in own:
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    enough = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    rank = {id(r): i + 1 for i, r in enumerate(enough[: percent * len(enough) // 100])}
    return sorted((tuple(r[:4]) + (rank.get(id(r)),) for r in rows), key=repr)


@pytest.mark.parametrize("width", [1, 2])
def test_resampling_equals_the_plain_version(spark, width):
    docs = [(i, long_text(random.Random(i).randint(0, 60), i).upper()) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "..."), (203, "ÀÉ 12-ab"), (None, long_text(40, 7)), (5, docs[5][1]), (204, long_text(5000, 9))]
    target = [long_text(50, 1000 + i) for i in range(5)] + [None, ""]
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(documents(spark, docs).repartition(5), wanted, percent=30, least_words=10, width=width, buckets=97)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_resample(docs, target, 30, 10, width, 97)


def test_equal_scores_go_to_smaller_ids(spark):
    rows = spark.createDataFrame([(9, i, s) for i, s in [(4, 1), (3, 2), (None, 2), (8, 2), (1, 0), (2, 1)]], "row long, id long, score long")
    got = {r["id"]: r["rank"] for r in resampling.ranked(rows, F.desc("score"), F.asc("id")).collect()}
    assert got == {None: 1, 3: 2, 8: 3, 2: 4, 4: 5, 1: 6}


def test_pieces_do_not_change_the_features():
    text = long_text(300, 5) + "-" * 50 + "w" * 90 + " end"
    for width in (1, 2, 3):
        n, whole = resampling.Splitter(width)(text)
        m, parts = resampling.Splitter(width, limit=17)(text)
        assert n == m and sorted(whole) == sorted(parts) and len(whole) == len(plain_features(text, width)[1])


# --- spelling variants -------------------------------------------------------------------------------------------


def plain_words(docs, least_length=6, least_count=5, delete=199):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % delete == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least_length and c >= least_count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n, times=5):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda v: (-n[v], v))
            if n[best] >= times * n[w]:
                form[w] = best
    rows = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(rows, key=repr)


def got_variants(frame):
    return sorted(((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()), key=repr)


def test_variants_equal_the_plain_version(spark):
    draw = random.Random(11)
    stems = ["".join(draw.choice("abé") for _ in range(draw.randint(6, 9))) for _ in range(25)]
    docs = []
    for i in range(300):
        words = [draw.choice(stems) for _ in range(30)]
        docs.append((i, " ".join(w.title() if draw.random() < 0.3 else w for w in words)))
    docs += [(400, None), (401, ""), (402, "short ÷×÷×÷×÷× x"), (None, " ".join(stems)), (1, docs[1][1]), (403, "-".join(stems * 50))]
    want = plain_words(docs, delete=7)
    frame = documents(spark, docs).repartition(4)
    words = spelling.counts(frame, delete=7)
    assert dict(map(tuple, words.collect())) == want
    assert got_variants(spelling.variants(words)) == plain_variants(want)


def test_edits_of_long_and_repetitive_words(spark):
    draw = random.Random(2)
    n = {}
    for size in (6, 7, 63, 64, 65, 66, 130, 700):
        for base in ("a" * size, "".join(draw.choice("abà") for _ in range(size))):
            for _ in range(12):
                at = draw.randrange(size)
                for w in (base[:at] + base[at + 1 :], base[:at] + "z" + base[at:], base[:at] + "ÿ" + base[at + 1 :], base):
                    n[w] = draw.choice([5, 25, 125, 700, 5000])
    words = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    assert got_variants(spelling.variants(words)) == plain_variants(n)


def test_a_tile_of_many_blocks():
    draw = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = sorted({a + b + "tail" for a in letters for b in letters[:8]} | {a + "tail" for a in letters})
    draw.shuffle(names)
    a, b = spelling.near_pairs(6, np.zeros(len(names), int), np.zeros(len(names), int), pa.array(names))
    got = {frozenset((names[i], names[j])) for i, j in zip(a, b, strict=True)}
    assert len(got) == len(a) > 0
    want = {frozenset((x, y)) for x in names for y in names if x < y and one_edit(x, y) and max(len(x), len(y)) == 6}
    # The zone holds the first two code points, where all these words differ.
    assert got == want
