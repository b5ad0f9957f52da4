"""Every registered query against DuckDB or a brute-force version on the small tables."""

import collections
import hashlib
import math
import os
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from check_oracle import compare, connect

from tracewell.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def frame(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pandas()


def run(spark, name):
    return queries.QUERIES[name](spark, SF).toPandas()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    n, problem = compare(spark, connect(SF), queries.QUERIES[name], queries.ORACLE_SQL[name], SF)
    assert problem == "" and n > 0


def test_queries_of_all_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_op1_recall_and_scores(spark):
    got = run(spark, "op1_graph_neighbours")
    e = frame("embeddings")
    x, ids = np.stack(e.embedding.to_list()).astype(float), e.vec_id.to_numpy()
    row = {v: i for i, v in enumerate(ids.tolist())}
    hit = asked = 0
    for q in ids[ids % 20 == 0].tolist():
        score = x @ x[row[q]]
        want = [i for i in np.lexsort((ids, -score)) if i != row[q]][:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and (np.diff(mine.score) <= 0).all()
        for v, s in zip(mine.vec_id, mine.score, strict=True):
            assert s == pytest.approx(sum(a * b for a, b in zip(x[row[q]], x[row[v]], strict=True)), abs=1e-12)
        hit, asked = hit + len({int(ids[i]) for i in want} & set(mine.vec_id)), asked + 20
    assert hit / asked >= 0.9


def test_op2_round_trip(spark):
    got = run(spark, "op2_chat_tokens").set_index("conv_id")
    turns = frame("conversations").sort_values(["conv_id", "turn"])
    groups = {k: list(zip(g.role, g.text, strict=True)) for k, g in turns.groupby("conv_id")}
    said = "</s>[INST] ok [/INST]"
    groups[-1] = [("user", said), ("assistant", said)]
    assert set(groups) == set(got.index)
    for k, rows in groups.items():
        learned = "".join(t for r, t in rows if r == "assistant")
        mine = got.loc[k]
        assert mine.n_turns == len(rows) and mine.loss_chars == len(learned)
        assert mine.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest()
        assert mine.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert mine.formatted_chars >= sum(len(t) for _, t in rows)


def test_op3_held_out_accuracy(spark):
    got = queries.QUERIES["op3_quality_scores"](spark, "/root/testdata/sf0.01").toPandas()
    labels = pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pandas()
    both = got.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert got.doc_id.is_unique and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (held.predicted == held.quality).mean() > 0.95


def test_op7_reads_back_what_the_tokenizer_says(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.word_bpe())
    got, start = run(spark, "op7_token_files").set_index("doc_id"), 0
    docs = frame("documents").sort_values("doc_id")
    assert len(got) == len(docs)
    for doc_id, text in zip(docs.doc_id, docs.text, strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        mine = got.loc[doc_id]
        assert (mine.start, mine.n_tokens, mine.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    return [w for w in lowered.split(" ") if w]


def plain_simhash(text, k=3):
    w = plain_words(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op8_fingerprints_and_classes(spark):
    got = run(spark, "op8_simhash_classes").set_index("doc_id")
    docs = frame("documents")
    prints = {i: plain_simhash(t) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if label[a] < label[b] and (prints[a] ^ prints[b]).bit_count() <= 3:
                    label[b], changed = label[a], True
    assert len(got) == len(docs)
    for i in prints:
        assert got.loc[i].fingerprint == f"{prints[i]:016x}" and got.loc[i].component_id == label[i]


def test_op10_counts_and_probabilities(spark):
    got = run(spark, "op10_lattice_scores").set_index("doc_id")
    docs = frame("documents")
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs.doc_id}
    count = collections.Counter()
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        if not held[i]:
            count.update([*plain_words(t), None])
    n, v = sum(count.values()), len(count)
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        tokens, mine = [*plain_words(t), None], got.loc[i]
        assert (mine.held_out, mine.n_tokens, mine.n_known, mine.train_tokens) == (held[i], len(tokens), sum(w in count for w in tokens), n)
        assert mine.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), rel=1e-9)
        assert mine.score < 0 and math.isfinite(mine.score)
