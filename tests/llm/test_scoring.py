import numpy as np
import pyarrow as pa

from palimpsest.llm import scoring as S


def tokens(texts, words=None, slots=None):
    none = np.zeros(0, np.uint64)
    return S._tokens(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]), none if words is None else words, none if slots is None else slots)


def test_probabilities_of_all_tokens_sum_to_one():
    network = S.Network()
    around = np.random.default_rng(1).integers(0, S.CLASSES * S.MEMBERS, (3, 2 * S.REACH)).astype(np.int32)
    every = np.arange(S.CLASSES * S.MEMBERS)
    for row in around:
        assert np.exp(network.log_probabilities(np.repeat(row[None], len(every), 0), every)).sum() == np.float64(1).__class__(1) or \
            abs(np.exp(network.log_probabilities(np.repeat(row[None], len(every), 0), every)).sum() - 1) < 1e-4


def test_gradient_agrees_with_differences():
    random = np.random.default_rng(2)
    network = S.Network(random.standard_normal(S.Network.SIZE).astype(np.float32) * np.float32(0.3))
    around, target = random.integers(0, 1024, (16, 2 * S.REACH)).astype(np.int32), random.integers(0, 1024, 16)
    before = network.flat.copy()
    network.train(around, target, 1.0)
    step = (network.flat - before).astype(np.float64)
    slope = (S.Network((before + 0.02 * step).astype(np.float32)).log_probabilities(around, target).mean()
             - S.Network((before - 0.02 * step).astype(np.float32)).log_probabilities(around, target).mean()) / 0.04
    assert abs(slope / (step @ step) - 1) < 0.05


def test_windows_stay_inside_their_text():
    line, place, first = tokens(["a b", None, "", "c", "d e f g"])
    assert np.diff(first).tolist() == [2, 0, 0, 1, 4]
    around = S._around(line, place)
    assert (around[0, :S.REACH] == 0).all() and around[0, S.REACH] == line[place[1]] and (around[2] == 0).all()


def test_scores_are_sums_over_whole_texts_and_tell_order_from_noise(spark):
    random = np.random.default_rng(5)
    plain = lambda: " ".join(["the cat sat on the mat and"] * int(random.integers(3, 30)))
    mixed = lambda text: " ".join(random.permutation(text.split()))
    rows = [(i, plain()) for i in range(1500)]
    rows += [(5000 + i, mixed(plain())) for i in range(20)] + [(6000, None), (6001, ""), (6002, "rare"), (6003, "the cat " * 20000), (1, rows[1][1]), (None, "the")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as score").repartition(3)
    got = S.pseudo_likelihoods(df).collect()
    assert len(got) == len(rows)
    by = {r["id"]: r for r in got}
    assert [(by[i]["n_tokens"], by[i]["score"], by[i]["mean_score"]) for i in (6000, 6001)] == [(0, 0.0, None)] * 2
    assert by[6002]["n_tokens"] == 1 and by[6002]["score"] < 0 and by[6003]["n_tokens"] == 40000
    ordered = np.mean([r["mean_score"] for r in got if r["id"] is not None and r["id"] < 1500])
    noise = np.mean([r["mean_score"] for r in got if r["id"] is not None and 5000 <= r["id"] < 6000])
    assert ordered > noise + 0.2
    assert S.pseudo_likelihoods(df.limit(0)).count() == 0


def test_rounds_train_every_position_of_every_text_once():
    _, place, first = tokens(["a b c d e", None, "f", "g h", "", "i " * 41])
    turns = np.concatenate([S._turn(first, number) for number in range(S.ROUNDS)])
    assert sorted(turns.tolist()) == list(range(len(place)))


def test_tasks_walk_over_all_positions():
    batch = pa.RecordBatch.from_arrays([pa.array(["one two three", "four", "five six " * 20])], names=["text"])
    batch = batch.append_column("shard", pa.array([0] * 3, pa.int64())).append_column("key", pa.array([1, 2, 3], pa.int64()))
    none, flat = (np.zeros(0, np.uint64), np.zeros(0, np.int32)), S.Network().flat.tobytes()
    weights = [next(S._train_task(flat, number)(S._line_task(*none)([batch]))).column("weight")[0].as_py() for number in range(S.ROUNDS)]
    assert sum(weights) == 44


def test_rare_words_have_their_share_of_their_slot(spark):
    filler = [f"frequent{n}" for n in range(900)]
    words = filler * 30 + ["contenting"] * 20 + ["xqzvkwping"] * 2
    rows = [(n, " ".join(words[n::40])) for n in range(40)] + [(100, "contenting"), (101, "xqzvkwping"), (102, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for known in (1 << 20, 900, 0):
        by = {r["id"]: r["score"] for r in S.pseudo_likelihoods(df, known=known).collect()}
        assert len(by) == len(rows) and by[102] == 0
        assert abs(by[100] - by[101] - np.log(21 / 3)) < 1e-6


def test_vocabulary_follows_the_distinct_words():
    assert [S.side_for(n) for n in (0, 10_000, 800_000, 1_000_000, 10_000_000)] == [32, 32, 32, 34, 58]


def test_scores_do_not_depend_on_partitions_or_tasks(spark):
    random = np.random.default_rng(11)
    rows = [(n, " ".join(f"w{int(x)}" for x in random.zipf(1.5, random.integers(0, 60)) % 300)) for n in range(400)] + [(400, None), (None, "w1 w2"), (7, "w3")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [sorted((r["id"] if r["id"] is not None else -1, r["n_tokens"], r["score"]) for r in S.pseudo_likelihoods(df.repartition(parts), shard_words=2000).collect())
             for parts in (1, 4, 16)]
    for other in found[1:]:
        assert [r[:2] for r in other] == [r[:2] for r in found[0]]
        assert np.allclose([r[2] for r in other], [r[2] for r in found[0]], rtol=1e-6)


def test_a_step_equals_its_definition_position_by_position():
    random = np.random.default_rng(3)
    flat = random.standard_normal(S.Network.SIZE).astype(np.float32) * np.float32(0.3)
    # classes without a token, a token that occurs often, and every class of a wider network
    for target in (np.array([5, 5, 5, 40, 1023, 70]), random.integers(0, 1024, 60)):
        around = random.integers(0, 9, (len(target), 2 * S.REACH)).astype(np.int32)
        network, old, new = S.Network(flat.copy()), S.Network(flat.astype(np.float64)), S.Network(flat.astype(np.float64))
        before = network.log_probabilities(around, target)
        network.train(around, target, 0.5)
        rate = 0.5 / len(target)
        for n, (near, token) in enumerate(zip(around, target)):
            group, member = divmod(int(token), S.MEMBERS)
            hidden = np.tanh(old.bias + sum(old.near[j][near[j]] for j in range(2 * S.REACH)))
            parts = [np.exp(v - v.max()) / np.exp(v - v.max()).sum() for v in (hidden @ old.group + old.group_bias, hidden @ old.member[group] + old.member_bias[group])]
            assert abs(before[n] - np.log(parts[0][group] * parts[1][member])) < 1e-5
            parts[0][group] -= 1
            parts[1][member] -= 1
            back = (old.group @ parts[0] + old.member[group] @ parts[1]) * (1 - hidden ** 2)
            new.group -= rate * np.outer(hidden, parts[0])
            new.group_bias -= rate * parts[0]
            new.member[group] -= rate * np.outer(hidden, parts[1])
            new.member_bias[group] -= rate * parts[1]
            new.bias -= rate * back
            for j in range(2 * S.REACH):
                new.near[j][near[j]] -= rate * back
        assert np.abs(network.flat - new.flat).max() < 1e-6


def test_hidden_units_stay_within_one_for_any_input():
    network = S.Network(np.full(S.Network.SIZE, 1e30, np.float32))
    assert (network.hidden(np.zeros((2, 2 * S.REACH), np.int32)) == 1).all()
    assert (S.Network(-network.flat).hidden(np.zeros((2, 2 * S.REACH), np.int32)) == -1).all()


def test_training_with_many_classes_does_not_run_away():
    random, side = np.random.default_rng(4), 47
    frequency = np.r_[np.full(S.RARE, 0.3 / S.RARE), 0.9 ** np.arange(side ** 2 - S.RARE) * 0.07]
    line = random.choice(side ** 2, 1 << 16, p=frequency / frequency.sum()).astype(np.int32)
    network = S.Network(None, side, side)
    for _ in range(40):
        part = random.integers(S.REACH, len(line) - S.REACH, S.BATCH)
        bias, outer = network.bias.copy(), network.outer.copy()
        network.train(S._around(line, part), line[part], S.RATE)
        assert np.linalg.norm(network.bias - bias) < S.LONGEST * 1.01 and np.linalg.norm(network.outer - outer) < S.LONGEST * 1.01
    # no worse than not knowing neighbours or counts
    assert network.log_probabilities(S._around(line, part), line[part]).mean() > -np.log(side ** 2)
    assert (np.abs(network.hidden(S._around(line, part))) > 0.999).mean() < 0.1


def test_far_values_leave_no_subnormal_numbers_and_the_same_probabilities():
    values = np.array([[0, -95, -300, 30], [100, 99, 12, 0], [-1, 0, 1, 2]], np.float32)
    true = np.exp(values.astype(float) - values.max(1, keepdims=True))
    true /= true.sum(1, keepdims=True)
    wrong = S._wrong(values.copy(), np.array([1, 0, 3]), np.float32(1))
    assert (np.abs(wrong) > np.finfo(np.float32).tiny).all()
    assert np.abs(wrong + np.eye(4)[[1, 0, 3]] - true).max() < 1e-6
    assert np.allclose(S._log_softmax(values.copy(), np.array([1, 0, 3])), [-125, np.log(true[1, 0]), np.log(true[2, 3])], rtol=1e-5)


def test_a_new_network_has_the_drawn_parameters_in_their_layers():
    drawn = np.random.default_rng(5).standard_normal(S.Network.SIZE).astype(np.float32) * np.float32(0.1)
    network = S.Network()
    parts = (network.near, network.bias, network.group, network.group_bias, network.member, network.member_bias)
    assert (np.concatenate([part.ravel() for part in parts]) == drawn).all()
