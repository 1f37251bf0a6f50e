"""Top-k search, the field's inference, the pipeline and the registered queries."""

from collections import Counter

import corpus_pipeline
import numpy as np

from textloom.llm import crf, topk
from textloom.llm import queries as registered

from .common import SF, none, odd, odd_rows


def top_by_hand(rows, asked, k):
    usable = [
        (i, np.array([int(np.floor(256 * float(x))) for x in v], object))
        for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for q, v in {(i, tuple(v)) for i, v in usable if i in asked}:
        v = np.array(v, object)
        scored = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), i) for i, x in usable if i != q and len(x) == len(v))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return out


def test_top_k(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    for block in (16_384, 4):
        got = topk.exact_top_k(table, table.filter("vec_id % 50 = 0"), block_rows=block).collect()
        assert sorted(map(tuple, got)) == sorted(top_by_hand(rows, {i for i, _ in rows if i % 50 == 0}, 5))


def test_top_k_odd(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.integers(-2, 3, 6)]) for i in range(60)]
    rows += [
        (100, None), (101, []), (102, [1.0, None, 2.0, 1.0, 1.0, 1.0]), (103, [float("nan")] * 6), (104, [float("inf")] * 6),
        (None, [1.0] * 6), (105, [1.0, 2.0]), (150, [2.0, 1.0]), (106, [1e15] * 6), (107, [0.0] * 6), (7, rows[7][1]),
        (0, rows[0][1])
    ]
    table = spark.createDataFrame([(*x, "clash", 1) for x in rows], "vec_id long, embedding array<double>, score string, rank int")
    got = topk.exact_top_k(table, table.filter("vec_id % 50 = 0")).collect()
    clamp = lambda x: max(-(2**63), min(2**63 - 1, x))
    assert sorted(map(tuple, got)) == sorted((q, n, i, clamp(s)) for q, n, i, s in top_by_hand(rows, {0, 50, 100, 150}, 5))
    assert topk.exact_top_k(none(spark, table.schema), none(spark, table.schema)).count() == 0


def test_top_k_computes_survivors_only():
    """What the levels turn away, own rows and what is multiplied are all pairs; the first threshold only saves work."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(20, 64))
    rows = np.floor(256 * (centres[r.integers(0, 20, 6000)] + 0.2 * r.normal(size=(6000, 64)))).astype(np.int64)
    ids = np.arange(6000)
    asked = ids % 50 == 0
    found = []
    for sampled in (False, True):
        block, best, work = topk.Block(ids[asked], rows[asked]), topk.Best(int(asked.sum()), 5), topk.Work()
        if sampled:
            some = r.permutation(6000)[:1500]
            block.start_from(ids[some], rows[some], 5)
        for at in range(0, 6000, 1000):
            topk.search_block(block, ids[at : at + 1000], rows[at : at + 1000], best, work)
        assert work.pairs == work.exact + work.own + sum(work.pruned) == 120 * 6000
        assert work.exact < 0.2 * work.pairs
        found.append((best.ids.tolist(), best.scores.tolist()))
    scores = rows[asked] @ rows.T
    scores[np.arange(120), ids[asked]] = -(1 << 62)
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :5]
    assert found[0] == found[1] == (order.tolist(), np.take_along_axis(scores, order, 1).tolist())


def test_field_inference():
    r = np.random.default_rng(0)
    lengths = np.array([1, 200, 64, 65, 7, 300])
    scores, trans = r.normal(size=(lengths.sum(), 3)) * 2, r.normal(size=(3, 3))
    post, best = crf.marginals(scores, lengths, trans), crf.viterbi(scores, lengths, trans)
    at = 0
    log = lambda a, axis: np.log(np.exp(a - a.max(axis, keepdims=True)).sum(axis)) + a.max(axis)
    for n in lengths:
        x = scores[at : at + n]
        a, b, top, back = [x[0]], [np.zeros(3)], x[0], []
        for t in range(1, n):
            a.append(log(a[-1][:, None] + trans, 0) + x[t])
            back.append((top[:, None] + trans).argmax(0))
            top = (top[:, None] + trans).max(0) + x[t]
            b.insert(0, log(trans + x[n - t] + b[0], 1))
        both = np.array(a) + np.array(b)
        assert np.allclose(np.exp(both - log(both, 1)[:, None]), post[at : at + n])
        path = [top.argmax()]
        for o in reversed(back):
            path.append(o[path[-1]])
        assert path[::-1] == best[at : at + n].tolist()
        at += n


def test_best_labels_of_a_long_line():
    """A line of 200 000 words takes steps by its blocks and gives a path as good as the plain recursion's."""
    r = np.random.default_rng(2)
    scores, trans = r.normal(size=(200_000, 4)), 2 * r.normal(size=(4, 4))
    best = crf.viterbi(scores, np.array([200_000]), trans).astype(int)
    top = scores[0].copy()
    for row in scores[1:]:
        top = (top[:, None] + trans).max(0) + row
    assert np.isclose(scores[np.arange(200_000), best].sum() + trans[best[:-1], best[1:]].sum(), top.max())


def test_stages_on_odd_tables(spark):
    """The values of each stage on nulls, empty and long texts, repeats, clashing columns; and an empty table."""
    rows = odd_rows()
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in stages.items():
        out = stage(spark, none(spark), "")
        assert out.count() == 0 and (name == "packing" or out.schema == none(spark).schema)
    told = {}
    for name in list(stages)[:-1]:
        out = stages[name](spark, odd(spark), "")
        assert out.schema == odd(spark).schema
        told[name] = [tuple(r) for r in out.collect()]
        # other columns stay as they are, and n_chars is that of the text where it was changed
        assert {(r[0], *r[5:]) for r in told[name]} <= {(r[0], *r[5:]) for r in rows}
    # quality: rejected are null, empty and short texts, and one of five words over and over
    long = [r for r in rows if r[1] and len(r[1].split()) >= 50]
    kept = Counter(r[0] for r in told["quality rules"])
    assert kept == Counter(r[0] for r in long if not r[1].startswith(("a b c d e", "line."))) and kept[6] == 3 and kept[None] == 1
    # line dedup: each row stays; of a host's lines those go that two documents and over a tenth of them share
    assert Counter(r[0] for r in told["line dedup"]) == Counter(r[0] for r in rows)
    lines = {r[0]: r[1] for r in told["line dedup"]}
    assert lines[0] is None and lines[1] == "" and lines[10] == rows[10][1] and lines[11] == rows[11][1]
    # near duplicates: texts without words stay, each by itself; one row of the texts that are alike; the first by doc_id
    near = Counter(r[0] for r in told["near duplicates"])
    assert near[6] == 1 and not {7, 8, 9} & set(near) and near[4] == 1 and near[5] == 0 and near[10] == near[11] == near[0] == near[1] == near[2] == 1
    # personal data: only texts that hold some are changed
    for r in told["personal data"]:
        given = next(x for x in rows if x[0] == r[0] and (x[1] is None) == (r[1] is None))
        assert r[1] == ("mail [EMAIL] or [PHONE]\n[CARD] at [IP]" if r[0] == 15 else given[1])
    # packing: every row once, as many ids as its tokens
    packed = stages["packing"](spark, odd(spark), "").collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(r[0] for r in rows)
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)


def test_pipeline(spark):
    """Every stage against the operators' own results, which are held against brute force elsewhere."""
    from textloom.llm import jaccard, pii, quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id: r.cleaned for r in quality.quality_rules(docs).collect() if r.kept}
    first = corpus_pipeline.quality_stage(spark, docs, SF)
    assert {r.doc_id: r.text for r in first.collect()} == kept
    second = corpus_pipeline.line_stage(spark, first, SF).cache()
    assert second.count() == len(kept)
    third = corpus_pipeline.near_duplicate_stage(spark, second, SF)
    own = [r.doc_id for r in jaccard.jaccard_join(second).collect() if r.component_id == r.doc_id]
    assert Counter(r.doc_id for r in third.collect()) == Counter(own)
    fourth = corpus_pipeline.personal_data_stage(spark, third, SF)
    assert all(not pii.base_spans(r.text) for r in fourth.collect())
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == set(own)


def test_queries_are_registered(spark):
    names = registered.queries()
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 13))
    assert set(registered.oracle_sql()) <= set(names)


def test_batches_sent_to_python_are_bounded(spark):
    from textloom.llm.common import CHUNK_BYTES, small_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for given, expected in (("8m", str(CHUNK_BYTES)), ("1m", "1m"), (str(CHUNK_BYTES), str(CHUNK_BYTES))):
        spark.conf.set(key, given)
        small_batches(spark)
        assert spark.conf.get(key).rstrip("b") in (expected, "1048576")
    spark.conf.unset(key)
