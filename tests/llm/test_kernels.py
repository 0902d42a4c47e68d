"""Parts that need no session, against plain versions."""

import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from dossier.llm import chat, mixing, packing, paragraph_dedup, pii, rules, suffix_dedup, suffixes, words

WORD = re.compile(words.WORD)
TEXT = st.text(alphabet="abAB é\x85\x1c\n\t,.", max_size=60)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_shingles_count_distinct_windows(texts):
    data, offsets = words.utf8(pa.array(texts, pa.string()))
    _, owner = words.shingles(data, offsets)
    for i, t in enumerate(texts):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        want = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
        assert (owner == i).sum() == len(want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60))
def test_suffix_array(text):
    assert suffixes.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=30), min_size=1, max_size=5))
def test_shared_windows(contexts):
    ids = list(range(len(contexts)))
    want = set()
    for k, c in enumerate(contexts):
        for at in range(len(c) - 2):
            if any(c[at : at + 3] in contexts[j] for j in range(k)):
                want.add((k, at))
    assert set(suffix_dedup.shared_windows(contexts, ids, 3)) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(97, 99), min_size=1, max_size=60), st.integers(1, 30))
def test_suffixes_are_ordered_to_a_depth(text, depth):
    order, new = suffixes.ordered(np.array(text, np.uint8), depth, np.arange(len(text)))
    found = [text[i : i + depth] for i in order]
    assert found == sorted(found)
    assert new.tolist() == [k == 0 or found[k] != found[k - 1] for k in range(len(found))]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<[\\/s>INST]| a", max_size=40))
def test_escape_is_reversible_and_hides_control_strings(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not re.search(r"</?s>|\[/?INST\]", chat.escape(text))


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 60))
def test_best_fill_is_the_largest_subset_sum(counts, room):
    reach = {0}
    for k, n in counts.items():
        reach = {s + k * m for s in reach for m in range(n + 1) if s + k * m <= room}
    used = packing.best_fill(counts, room)
    assert all(n <= counts[k] for k, n in used.items())
    assert sum(k * n for k, n in used.items()) == max(reach)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab@.%1+ -()é", max_size=40))
def test_base_spans_are_those_of_the_patterns(text):
    want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    want += [
        ("ip", *m.span())
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
        if all(int(p) <= 255 for p in m[0].split("."))
    ]
    want += [
        ("card", *m.span())
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
        if 13 <= len(pii.digits(m[0])) <= 19 and pii.luhn(pii.digits(m[0]))
    ]
    want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(pii.digits(m[0])) <= 15]
    assert pii.base_spans(text) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=30))
def test_repeated_words(tokens):
    n = len(tokens)
    grams = [tuple(tokens[k : k + 3]) for k in range(n - 2)]
    covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    ids = np.array([ord(t) - 97 for t in tokens], np.int64)
    assert rules.repeated_words(ids) == len(covered)


def test_shares_respect_the_limit_and_sum_up():
    sizes = [100, 10, 1000, 0, 50]
    target = mixing.shares(sizes, [1, 2, 3, 1, 2])
    assert all(t <= 3 * n + 1e-9 for t, n in zip(target, sizes, strict=True))
    assert abs(sum(target) - sum(sizes)) < 1e-6
    assert mixing.shares([], []) == []


def test_counts_use_up_the_quotas_and_permutations_are_bijections():
    counts = mixing.draw_counts([5, 0, 1000, 37], 8, 1)
    assert counts.sum(axis=0).tolist() == [5, 0, 1000, 37] and (counts >= 0).all()
    for n in (1, 2, 7, 1000):
        out = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 9))
        assert sorted(out.tolist()) == list(range(n))


def test_tuning_uses_all_hashes():
    bands, rows = paragraph_dedup.tune()
    assert bands * rows == paragraph_dedup.HASHES and (1 - 0.75**rows) ** bands < 1e-4


def test_tuning_and_cuts():
    bands, rows = paragraph_dedup.tune()
    assert 1 - (1 - 0.75**rows) ** bands >= 0.98
    random.seed(2)
    passage = np.array([random.getrandbits(63) for _ in range(60)], np.uint64)
    found = []
    for _ in range(2):
        line = np.concatenate([np.array([random.getrandbits(63) for _ in range(40)], np.uint64), passage, passage[:5]])
        at = np.flatnonzero(paragraph_dedup.cuts(line, np.zeros(len(line), int)))
        found.append({int(a) - 40 for a in at if 45 <= a < 95})
    assert found[0] == found[1] and len(found[0]) >= 2


def test_long_secrets_are_candidates():
    token = "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-", k=700))
    text = f"api_key = {token} end"
    assert ("secret", 10, 710) in pii.candidates(text)
    assert ("secret", 10, 210) not in pii.candidates(text) and pii.candidates("a" * 19) == []


def test_slices_bound_what_a_task_holds():
    from dossier.llm.words import slices

    offsets = np.arange(9, dtype=np.int64) << 18
    assert list(slices(offsets)) == [(0, 2), (2, 4), (4, 6), (6, 8)]
    assert list(slices(np.array([0, 1 << 22, (1 << 22) + 5]))) == [(0, 1), (1, 2)]


def test_bands_of_short_paragraphs_are_few_and_meet_at_the_threshold():
    rng = np.random.default_rng(9)
    bands, rows = paragraph_dedup.tune()
    for n in range(1, 46):
        for _ in range(20):
            own = rng.integers(0, 1 << 63, 2 * n, np.uint64)
            x = own[:n]
            gone = int(rng.integers(0, n // 4 + 1))
            more = int(rng.integers(0, n // 3 + 1))
            y = np.r_[x[gone:], own[n : n + more]]
            of, key, lead = paragraph_dedup.band_keys(np.r_[x, x[:1], y], np.repeat([0, 1], [n + 1, len(y)]), bands, rows, 75)
            assert lead.sum() == 2 and (np.diff(of) >= 0).all()
            if n < 20:
                assert (of == 0).sum() <= n // 4 + 1 <= bands
            if 100 * (n - gone) >= 75 * (n + more):
                assert set(key[of == 0]) & set(key[of == 1])
