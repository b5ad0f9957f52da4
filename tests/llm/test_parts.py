"""The small building blocks against plain versions of themselves."""

import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import additive_model, bk_tree, chat, graph, lattice, perfect_hash, queries, simhash, token_files
from tracewell.llm.common import words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([*chat.MARKERS, "\\", "<", "s>", "/", "a", "[INST", "]", "é", "\n"]), max_size=12).map("".join))
def test_escape_is_reversible_and_hides_markers(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    bare = chat._UNESCAPE.sub("\0", escaped)  # what is escaped, taken away
    assert not any(m in bare for m in chat.MARKERS)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 5000])
def test_perfect_hash_is_minimal(n):
    keys = np.random.default_rng(1).integers(0, 2**63, n, dtype=np.uint64)
    keys = np.unique(keys)
    sizes, bits, slot = perfect_hash.build(keys)
    assert sorted(slot.tolist()) == list(range(len(keys)))
    assert (perfect_hash.slots(keys, sizes, bits) == slot).all()


def test_perfect_hash_refuses_equal_keys():
    with pytest.raises(ValueError):
        perfect_hash.build(np.array([5, 5], np.uint64))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**12 - 1), max_size=40), st.integers(0, 3))
def test_bk_tree_finds_all_within_the_radius(values, radius):
    tree = bk_tree.BKTree(radius)
    for v in values:
        tree.add(v)
    for v in values:
        assert sorted(tree.near(v)) == [i for i, w in enumerate(values) if (v ^ w).bit_count() <= radius]


def _classes(n, links):
    label = list(range(n))
    for _ in range(n):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**10 - 1), max_size=30, unique=True))
def test_spanning_links_connect_as_all_links_do(values):
    n = len(values)
    every = [(i, j) for i in range(n) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2]
    kept = bk_tree.spanning_links(values, 2)
    assert len(kept) < max(1, n) and _classes(n, kept) == _classes(n, every)
    half = n // 2
    across = [(i, j) for i in range(half) for j in range(half, n) if (values[i] ^ values[j]).bit_count() <= 2]
    found = [(i, half + j) for i, j in bk_tree.links_between(values[:half], values[half:], 2)]
    assert _classes(n, found) == _classes(n, across)


@pytest.mark.parametrize(("nodes", "radius"), [(10, 3), (10**6, 3), (10**11, 3), (100, 6)])
def test_pairs_within_the_radius_share_a_shard_key(nodes, radius):
    masks = [m & (2**64 - 1) for m in simhash.shard_masks(nodes, radius)]
    random = np.random.default_rng(2)
    for _ in range(200):
        a = int(random.integers(0, 2**63)) * 2 + int(random.integers(0, 2))
        b = a
        for bit in random.choice(64, radius, replace=False).tolist():
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def test_cut_runs_become_trees_and_stay_whole():
    import pandas as pd

    n = 25
    rows = pd.DataFrame({"combo": [0] * n + [1], "masked": [7] * n + [7], "fp": list(range(n)) + [3], "id": list(range(n)) + [99]})
    batches = [rows[i : i + 4] for i in range(0, len(rows), 4)]
    out = pd.concat(simhash._shards(iter(batches), 1, 6))
    cut = out[out.tree >= 0]
    assert sorted(cut.a) == list(range(n)) and cut.groupby("tree").size().max() <= 6 and sorted(cut.tree.unique()) == [0, 1, 2, 3, 4]


def _tiny_vocabulary():
    pieces = ["", "", "", " a", "b", "ab", " ab", "c", "bc", "", ""]
    byte_of = np.full(256, 9)
    byte_of[ord("x")] = 10
    return lattice.Vocabulary(pieces, byte_of, 2)


def _all_cuts(text, log_p, vocabulary):
    if not text:
        return 1.0
    total = 0.0
    for i, piece in enumerate(vocabulary.pieces):
        if piece and text.startswith(piece):
            total += math.exp(log_p[i]) * _all_cuts(text[len(piece) :], log_p, vocabulary)
    if text[0] not in vocabulary.pieces:
        spelt = math.exp(sum(log_p[vocabulary.byte_of[b]] for b in text[0].encode()))
        total += spelt * _all_cuts(text[1:], log_p, vocabulary)
    return total


def test_lattice_sums_over_all_cuts():
    vocabulary = _tiny_vocabulary()
    random = np.random.default_rng(3)
    log_p = np.log(random.dirichlet(np.ones(len(vocabulary.pieces))))
    own = lattice.Lattice(vocabulary, log_p)
    found = own.log_likelihood(["ab", "abc", "abbc", "x", "axb", "é", "abcabc", "ab"])
    for word, value in zip(["ab", "abc", "abbc", "x", "axb", "é", "abcabc", "ab"], found, strict=True):
        assert value == pytest.approx(math.log(_all_cuts(" " + word, log_p, vocabulary)), abs=1e-9)


def test_expected_counts_cover_every_character_and_learning_helps():
    vocabulary = _tiny_vocabulary()
    listed = ["ab", "abc", "abbc", "abcabc"]
    own = lattice.Lattice(vocabulary)
    counts = own.expected(listed)
    covered = sum(c * len(p) for c, p in zip(counts, vocabulary.pieces, strict=True)) + counts[vocabulary.byte_of].sum() * 0
    spaces = counts[9]  # the space has no piece of its own, so it may be spelt in bytes
    assert covered + spaces == pytest.approx(sum(len(w) + 1 for w in listed), abs=1e-6)
    better = lattice.Lattice(vocabulary, np.log((counts + 0.01) / (counts + 0.01).sum()))
    assert better.log_likelihood(listed).sum() > own.log_likelihood(listed).sum()


def test_additive_model_learns_a_pair_that_single_features_cannot():
    random = np.random.default_rng(4)
    x = random.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = additive_model.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert ((model.probability(x[3000:]) > 0.5) == y[3000:]).mean() > 0.93


def test_additive_model_without_both_classes_is_constant():
    for y in (np.ones(5), np.zeros(5), np.zeros(0)):
        p = additive_model.fit(np.zeros((len(y), 2)), y).probability(np.ones((3, 2)))
        assert len(set(p)) == 1 and (p[0] > 0.5) == (y.sum() > 0) or p[0] == 0.5


@pytest.mark.parametrize("n", [1, 2, 30, 1500])
def test_graph_finds_the_nearest(n):
    random = np.random.default_rng(5)
    x = graph.on_sphere((random.normal(size=(n, 16)) * random.uniform(0.2, 5, (n, 1))).astype(np.float32))
    own = graph.build(x)
    found, _ = own.search(x[:100], 64)
    k = min(10, n)
    want = np.argsort(-(x[:100] @ x.T), axis=1)[:, :k]
    assert np.mean([len(set(a) & set(b.tolist())) / k for a, b in zip(want.tolist(), found[:, :k], strict=True)]) > 0.95


def test_words_follow_the_ascii_rules():
    assert words("A B\tÉc\x1cd\n") == ["a b".encode(), "Éc\x1cd".encode()]
    assert words(None) == words(" \n") == []


@pytest.fixture(scope="module")
def encoder():
    return token_files.Encoder(queries.word_bpe(), "<u4")


_BITS = ["the", "The", " ", "\n", "\t", "\u00a0", "\x1c", "it's", "'s", "'", "don't,", "end.", "***", "!!", "é", "e\u0301", "\u0301", "Σ", "ΑΣ", "İ", "漢字", "12", ",", "a1.", "<|endoftext|>", "<|", "_", "😀", "ñll,", "ß", "\u200b"]


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(_BITS), max_size=10).map("".join), max_size=4))
def test_encoder_says_what_the_tokenizer_says(encoder, texts):
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    ids, ends = encoder(pa.array(texts, pa.string()), 7)
    assert [ids[a:b].tobytes() for a, b in zip([0, *ends][: len(ends)], ends, strict=True)] == [w + np.array([7], "<u4").tobytes() for w in want]
