import math
import zlib
from collections import Counter

import numpy as np

from loam.llm import maxent
from loam.llm.queries import op2_maxent_lm
from loam.session import table


def base(rows):
    """doc_id, held_out, n_tokens, n_known, N and base score of each row, by the contract."""
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows]
    tokens = [maxent.tokens_of((t or "").encode()) for _, t in rows]
    counts = Counter(t for own, out in zip(tokens, held, strict=True) if not out for t in own)
    n, v = sum(counts.values()), len(counts)
    return [(d, out, len(own), sum(counts[t] > 0 for t in own), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)) for (d, _), out, own in zip(rows, held, tokens, strict=True)]


def compare(found, want):
    order = lambda r: (str(r[0]), r[2], r[5])
    found, want = sorted(found, key=order), sorted(want, key=order)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    assert all(math.isclose(f[5], w[5], rel_tol=1e-9) for f, w in zip(found, want, strict=True))


def test_counts_and_held_out_gain(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    found = [tuple(r) for r in op2_maxent_lm(spark, sf).collect()]
    compare(found, base(rows))
    held = [r for r in found if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held) + 0.05 * abs(sum(r[5] for r in held))


def test_small_dictionary_nulls_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(maxent, "DICTIONARY", 4)
    rows = [(i, f"a b c the the {'x' * (i % 5)} w{i} w{i % 7} A") for i in range(60)] + [(3, None), (None, "a b q q z"), (None, "a b q q z"), (9, ""), (10, "zz " * 3000)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id bigint, text string, n int").repartition(3)
    found = [tuple(r) for r in maxent.score(docs).collect()]
    compare(found, base(rows))
    assert all(r[6] < 0 and math.isfinite(r[6]) for r in found)


def test_empty_and_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert maxent.score(docs).collect() == []
    out = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = maxent.score(spark.createDataFrame([(out, "a b")], "doc_id bigint, text string")).collect()
    assert (row["train_tokens"], row["n_known"], row["base_score"]) == (0, 0, 0.0)


def _model(n):
    return maxent.model_of([b"", *(b"t%d" % i for i in range(1, n))], np.arange(n, 0, -1.0), np.full(maxent.CLASSES, 2.5), n, n)


def test_chances_over_all_leaves_sum_to_one():
    """Over the dictionary's tokens and, for each class, the tokens outside it; with weights of any value."""
    model = _model(20_000)
    start = maxent._start(model)
    for noise in (0.0, 0.3):
        weights = maxent._Weights(model, (start + noise * np.random.default_rng(1).normal(size=len(start))).astype("f4"))
        leaves = np.arange(20_000 + maxent.CLASSES)
        for past in ([5, 15_000, -80, 7], [maxent.BEFORE] * 4):
            history = np.tile(np.array(past, "i4"), (len(leaves), 1))
            chances = np.exp(weights.log_likelihood(history, leaves))
            assert math.isclose(chances.sum(), 1, rel_tol=1e-4)
            if not noise:  # each token has its share of the counts
                assert np.allclose(chances, np.concatenate((model.counts, model.outside)) / (model.counts.sum() + model.outside.sum()), rtol=1e-3)


def test_inside_the_leaf_of_others_chances_sum_to_one(spark):
    """The tokens outside a dictionary of one, by their smoothed counts, and one token never seen, for each class."""
    docs = spark.createDataFrame([(i, f"a b c the the {'x' * (i % 5)} w{i} w{i % 7} A") for i in range(60)], "doc_id bigint, text string")
    counts = {bytes(r["token"]): r["n"] for r in maxent.count_tokens(docs).collect()}
    model = maxent._vocabulary(maxent.count_tokens(docs))
    inside = {c: sum(n + 1 for t, n in counts.items() if t not in model.ids and maxent.class_of(t) == c) + 1 for c in range(maxent.CLASSES)}
    assert [inside[c] for c in range(maxent.CLASSES)] == model.outside.tolist()


def test_one_token_or_none():
    for n in (0, 1):
        model = maxent.model_of([b""][:n], np.ones(n), np.ones(maxent.CLASSES), n, n)
        leaves = np.arange(n + maxent.CLASSES)
        found = maxent._Weights(model, maxent._start(model)).log_likelihood(np.full((len(leaves), 4), maxent.BEFORE, "i4"), leaves)
        assert math.isclose(np.exp(found).sum(), 1, rel_tol=1e-4)


def test_rare_tokens_tell_and_are_told():
    """Tokens far down the dictionary and outside it are predicted, and predict, by themselves."""
    model = _model(20_000)
    weights = maxent._Weights(model, maxent._start(model))
    rows, forks = np.zeros(len(weights.table), "f4"), np.zeros(len(weights.forks), "f4")
    codes = model.codes([b"rare one", b"t15000", b"rare two", b"t15001"])
    history = np.full((4, maxent.HISTORY), maxent.BEFORE, "i4")
    history[1::2, 0] = codes[::2]
    leaves = model.leaves(codes)
    for _ in range(50):
        weights.step(history, leaves, rows, forks)
    swapped = history[[0, 3, 2, 1]]
    gain = weights.log_likelihood(history, leaves) - weights.log_likelihood(swapped, leaves)
    assert codes[1] == 15_000 and codes[0] < 0 and (gain[1::2] > 1).all()


def test_every_position_of_a_training_text_is_stepped_on_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b{i} c") for i in range(40)], "doc_id bigint, text string")
    taught = docs.filter(~maxent.is_held_out())
    steps = []

    def all_rounds(examples, start, local_pass, rounds, width):
        rows = examples.toArrow()
        with monkeypatch.context() as m:
            m.setattr(maxent._Weights, "step", lambda self, history, leaves, *seen: steps.append(len(leaves)))
            for number in range(rounds):
                weights, say = local_pass(start.copy(), rows, number)
                assert len(weights) == len(say) * width
        return start

    monkeypatch.setattr(maxent, "train_averaged", all_rounds)
    maxent.fit(docs, maxent.count_tokens(taught).cache())
    assert sum(steps) == 4 * taught.count()


def test_averages_keep_what_only_one_task_has_learned(spark):
    from loam.llm.averaging import BLOCK, train_averaged

    def local_pass(weights, rows, number):
        say = np.zeros(len(weights))
        for k in rows["k"].to_pylist():
            weights[k] += 1 + k
            say[k] += 1
        return weights, say

    examples = spark.createDataFrame([(k,) for k in (0, 1, BLOCK + 2)], "k bigint").repartition(3)
    found = train_averaged(examples, np.zeros(BLOCK + 5), local_pass, 2, 1)
    assert (found[0], found[1], found[2], found[BLOCK + 2]) == (2, 4, 0, 2 * (BLOCK + 3))


def test_small_tables_leave_many_training_tasks():
    """Tables of 5.8 million weights and 23 million positions on 6 cores: no single task; more tasks than cores: whole waves."""
    assert maxent._training_tasks(22_800_000, 5_767_200, 6) == 4
    assert maxent._training_tasks(114_000_000, 11_534_368, 6) == 6
    assert maxent._training_tasks(1_000_000_000, 23_068_704, 6) == 42
    assert [maxent._training_tasks(n, 2_883_616, 6) for n in (0, 1, 1 << 22, (1 << 22) + 1)] == [1, 1, 1, 2]


def test_several_tasks_still_learn_held_out_texts(spark, monkeypatch):
    monkeypatch.setattr(maxent, "TASK_EXAMPLES", 1 << 17)
    monkeypatch.setattr(maxent, "WEIGHT_EXAMPLES", 0)
    dealt = []
    trained = maxent.train_averaged
    monkeypatch.setattr(maxent, "train_averaged", lambda examples, *rest: dealt.append(examples.inputFiles()) or trained(examples, *rest))
    held = op2_maxent_lm(spark, "/root/testdata/sf0.01").filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert len(dealt[0]) > 1
    assert held["sum(score)"] > held["sum(base_score)"] + 0.05 * abs(held["sum(base_score)"])
