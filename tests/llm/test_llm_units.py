"""The operators' kernels without Spark: against brute force, round trips and bounds."""

import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("lexweave.llm")
from lexweave.llm import chat, hmm, minhash, packing, quality, token_output
from lexweave.llm.additive_ann import AdditiveCode, search_block
from lexweave.llm.line_dedup import _pack, kept_lines
from lexweave.llm.pq_dedup import Quantiser
from lexweave.llm.tokens import PieceEncoder, public_path


@pytest.mark.parametrize("name, keeps", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_remembered_pieces_give_the_ids_of_whole_texts(name, keeps):
    rng = random.Random(3)
    from tokenizers import Tokenizer

    alphabet = [*"abZéÀ1 \n\t\r'éÉ²½\x1c\x85\xa0 -_|<>.\x01\x00́Σ漢", "'s", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "word", " Straße", "  ", "\n\n"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + [None, "", "plain words\nand lines"]
    enc, plain = PieceEncoder(public_path(name), keeps, remember=200), Tokenizer.from_file(public_path(name))
    assert enc.direct
    ids, at = enc.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_words_met_again_are_not_forgotten():
    letters = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    enc, learnt = PieceEncoder(public_path("word_bpe_49k.json"), False, remember=300), []
    learn, common = enc._new_words, [f"x{letters(i)}" for i in range(100)]
    enc._new_words = lambda words: (learnt.extend(words), learn(words))
    for call in range(12):
        text = " ".join(common + [f"y{letters(1000 * call + i)}" for i in range(100)])
        ids, at = enc.encode(pa.array([text]))
        assert np.array_equal(ids, enc.whole(text)) and len(enc.known) <= 500 + len(common)
    assert all(learnt.count(w) == 1 for w in common)
    enc.remember = 100  # the common ones are more than half of it now
    enc.encode(pa.array(["once more"]))
    assert set(enc.known) == {"", "once", "more"}


def test_repair_and_expansion_of_ids_too_large_for_one_word_with_their_place():
    rng = np.random.default_rng(5)
    ids = np.concatenate((rng.integers(0, 40, 20_000), np.zeros(101, np.int64), rng.integers(0, 40, 20_000))).astype(np.uint32)
    ends = np.array([9, 20_050, len(ids) - 1])
    symbols, last, rules = token_output.repair(ids, ends)
    up = token_output.FIRST_RULE - 40
    far, far_last, far_rules = token_output.repair(ids + np.uint32(up), ends)
    near = lambda x: np.where(x < token_output.FIRST_RULE, x - up, x)
    assert np.array_equal(near(far), symbols) and np.array_equal(far_last, last) and np.array_equal(near(far_rules), rules)
    lengths = token_output.rule_lengths(rules)
    assert np.array_equal(token_output.expand(symbols, rules, lengths), ids)
    with pytest.raises(ValueError):
        token_output.expand(symbols, rules, lengths + np.arange(len(lengths), dtype=np.uint32) % 2)


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 6, n).astype(np.uint32) for n in (0, 1, 5000, 3, 800)] + [np.zeros(999, np.uint32)]
    docs = [np.append(d, 2).astype(np.uint32) for d in docs]
    ids, ends = np.concatenate(docs), np.cumsum([len(d) for d in docs]) - 1
    symbols, last, rules = token_output.repair(ids, ends)
    assert np.array_equal(token_output.expand(symbols, rules), ids) and len(symbols) < len(ids) * 0.8
    inside = np.setdiff1d(np.arange(len(symbols) - 1), last)  # no pair within a document is frequent any more
    assert np.unique(np.stack((symbols[inside], symbols[inside + 1])), axis=1, return_counts=True)[1].max() < 2 * token_output.LEAST_COUNT
    with pytest.raises(ValueError):
        token_output.repair(np.array([token_output.FIRST_RULE], np.uint32), np.array([0]))
    places = np.concatenate(([0], last + 1))
    row = {"doc_places": places.astype("<u4").tobytes(), "symbols": symbols.tobytes(), "rules": rules.tobytes()}
    for k, d in enumerate(docs):
        assert np.array_equal(token_output.document(row, k), d)
    lengths = token_output.rule_lengths(rules)
    assert all(len(token_output.expand(np.array([token_output.FIRST_RULE + i], np.uint32), rules)) == n for i, n in enumerate(lengths))


def test_repair_goes_on_until_no_pair_is_frequent():
    passage = np.arange(60, dtype=np.uint32)
    ids = np.concatenate([np.append(passage, 100 + i).astype(np.uint32) for i in range(20)])
    symbols, _, rules = token_output.repair(ids, np.array([len(ids) - 1]))
    assert np.array_equal(token_output.expand(symbols, rules), ids) and len(symbols) <= 60  # a passage ends as a few symbols
    assert token_output.rule_lengths(rules).max() >= 30
    run = np.zeros(1000, np.uint32)
    symbols, _, rules = token_output.repair(run, np.array([999]))
    assert np.array_equal(token_output.expand(symbols, rules), run) and len(symbols) < 20 and len(rules) < 12


def test_super_minhash_estimates_similarity_and_keeps_equal_sets_equal():
    rng = np.random.default_rng(2)
    for n in (1, 7, 40, 600, 5000):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.concatenate((x[: int(len(x) * 0.8)], np.unique(rng.integers(0, 1 << 63, n - int(len(x) * 0.8)).astype(np.uint64))))
        both = len(np.intersect1d(x, y))
        true = both / (len(np.union1d(x, y)) or 1)
        sig = minhash.super_minhash([x, np.sort(y), x.copy()], 240)
        assert np.array_equal(sig[0], sig[2])
        assert abs((sig[0] == sig[1]).mean() - true) < 0.13
        alone = minhash.super_minhash([np.sort(y)], 240)
        assert np.array_equal(alone[0], sig[1])  # early stopping of others changes nothing


def test_shingles():
    sets = minhash.shingle_sets([b"a b c d e f", b"A  b\tc d E\nf", b"a b", b"", b" \n", b"a b c d e a b c d e"])
    assert np.array_equal(sets[0], sets[1]) and len(sets[0]) == 2
    assert [len(s) for s in sets[2:]] == [1, 0, 0, 5]


def test_packing_fits_and_comes_near_the_bound():
    rng = random.Random(5)
    for sizes in ([], [1024] * 3, [600, 424, 600, 424], [rng.randint(1, 1024) for _ in range(3000)], [rng.randint(300, 520) for _ in range(500)], [513] * 7, [1] * 5000):
        counts = {}
        for s in sizes:
            counts[s] = counts.get(s, 0) + 1
        patterns = packing.pack_histogram(counts)
        used = {}
        for items, many in patterns:
            assert sum(a * n for a, n in items) <= 1024
            for a, n in items:
                used[a] = used.get(a, 0) + n * many
        assert used == counts
        bins = sum(m for _, m in patterns)
        low = max(-(-sum(sizes) // 1024), sum(s > 512 for s in sizes))
        assert bins <= max(low * 1.12 + 1, low)
    with pytest.raises(ValueError):
        packing.pack_histogram({1025: 1})


def _fewest(sizes, capacity):
    """The least number of bins, by trying all."""
    if not sizes:
        return 0
    first, rest = sizes[0], sizes[1:]
    best = len(sizes)
    for mask in range(1 << len(rest)):
        if first + sum(x for i, x in enumerate(rest) if mask >> i & 1) <= capacity:
            best = min(best, 1 + _fewest([x for i, x in enumerate(rest) if not mask >> i & 1], capacity))
    return best


def test_dominance_keeps_the_least_number_of_sequences():
    rng, threes = random.Random(11), 0
    for _ in range(400):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 7))]
        counts = {k: sizes.count(k) for k in sizes}
        fixed = packing._reduce(counts, 20)
        threes += any(sum(n for _, n in items) == 3 for items, _ in fixed)
        left = [k for k, n in counts.items() for _ in range(n)]
        assert sum(m for _, m in fixed) + _fewest(left, 20) == _fewest(sizes, 20)
    assert threes > 10


def test_chat_round_trip_and_layouts():
    turns = [("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "a\\b <\\| <| \\n"), ("odd\nrole<|\\", ""), ("assistant", "")]
    written, spans = chat.render(turns)
    assert chat.parse(written) == turns
    assert [chat.unescape(written[a:b]) for a, b in spans] == [turns[1][1], ""]
    for record, want in (
        ({"messages": [{"role": "user", "content": "x"}]}, [("user", "x")]),
        ({"conversations": [{"from": "human", "value": "x"}, {"from": "gpt", "value": "y"}]}, [("user", "x"), ("assistant", "y")]),
        ({"instruction": "do", "input": "this", "output": "done"}, [("user", "do\n\nthis"), ("assistant", "done")]),
        ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
        ({"messages": []}, []),
        ({"id": 7, "messages": [{"role": "user", "content": "x", "name": "n"}, {"role": "assistant", "content": "y", "tool_calls": [{"id": 1}]}]}, [("user", "x"), ("assistant", "y")]),
        ({"id": 7, "prompt": "p", "response": "r", "score": 0.5}, [("user", "p"), ("assistant", "r")]),
        ({"system": "s", "instruction": "do", "output": "done"}, [("system", "s"), ("user", "do"), ("assistant", "done")]),
        ({"prompt": "p", "response": None}, [("user", "p"), ("assistant", "")]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "x"}]}, "loose"]}, [("user", '[{"text": "x", "type": "text"}]'), ("", "loose")]),
        ({"question": "q", "answer": {"a": 1}}, [("user", "q"), ("assistant", '{"a": 1}')]),
    ):
        assert chat.canonical(record, chat.mapping(chat.known_paths(record))) == want
    assert chat.mapping(chat.known_paths({"unknown": 1})) is None and chat.mapping(chat.known_paths({"messages": [{"role": "user"}]})) is None
    same = [{"prompt": "p", "response": "r"}, {"response": "r", "id": 3, "prompt": "p"}]
    assert len({chat.fingerprint(chat.known_paths(r)) for r in same}) == 1


def test_bitmaps():
    lines = [b"x"] * 20
    text = b"\n".join(b"%d" % i for i in range(20))
    kept, n = kept_lines(text, _pack([0, 9, 17]))
    assert n == 20 and kept == [b"%d" % i for i in range(20) if i not in (0, 9, 17)]
    assert kept_lines(b"", None) == ([b""], 1) and len(lines) == 20


def test_forward_equals_sum_over_all_paths():
    rng = np.random.default_rng(0)
    model = hmm.Model.initial(np.full(6, 1 / 6), 2)
    for length in (1, 2, 5):
        s = rng.integers(0, 6, length)
        total = 0.0
        for path in np.ndindex(*(2,) * length):
            p = model.start[path[0]] * model.emit[path[0], s[0]]
            for t in range(1, length):
                p *= model.move[path[t - 1], path[t]] * model.emit[path[t], s[t]]
            total += p
        assert np.isclose(hmm.forward(model, [s])[0], np.log(total))


def test_stretches_of_long_texts_change_nothing():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 6, n) for n in (1, 2, 700, 31, 64, 5)]
    model = hmm.Model.initial(np.full(6, 1 / 6), 3)
    whole = hmm.forward(model, docs, counts=True)
    for most in (1, 7, 64, 100):
        for x, y in zip(whole, hmm.forward(model, docs, counts=True, most=most)):
            assert np.allclose(x, y)


def test_baum_welch_never_lowers_the_likelihood():
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 5, rng.integers(1, 60)) + (0 if i % 2 else 5) for i in range(40)]
    shares = np.full(10, 0.1)
    model, last = hmm.Model.initial(shares, 3), -np.inf
    for _ in range(6):
        ll, start, move, emit = hmm.forward(model, docs, counts=True)
        assert ll.sum() >= last - 1e-9
        last = ll.sum()
        assert np.isclose(emit.sum(), sum(map(len, docs))) and np.isclose(start.sum(), len(docs))
        model = hmm.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), (emit + 1e-12) / (emit + 1e-12).sum(axis=1, keepdims=True))


def test_quantiser_bounds_hold():
    rng = np.random.default_rng(6)
    base = rng.normal(size=(300, 16))
    near = base[:100] + rng.normal(size=(100, 16)) * 0.03
    v = np.vstack((base, near))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    model, radius = Quantiser(v[:200], 8), float(np.sqrt(2 - 2 * 0.98))
    own, codes, error = model.encode(unit)
    who, where = model.probes(unit, radius)
    probed = set(zip(who.tolist(), where.tolist()))
    cos = unit @ unit.T
    for i, j in zip(*np.nonzero(cos >= 0.98)):
        assert (i, own[j]) in probed
        d = np.sqrt(sum(t[0, codes[j, s]] for s, t in enumerate(model.tables(unit[i : i + 1], own[j]))))
        assert d <= radius + error[j] + 1e-5


def test_additive_search_is_exact():
    rng = np.random.default_rng(7)
    v, ids = rng.normal(size=(1500, 24)), np.arange(1500)
    model = AdditiveCode(v[:500], books=30, words=32)
    codes, left = model.encode(v)
    assert np.allclose(np.linalg.norm(v - sum(b[codes[:, m]] for m, b in enumerate(model.books)), axis=1), left)
    assert left.mean() <= AdditiveCode(v[:500], books=30, words=32).encode(v, beam=1)[1].mean()
    q = np.arange(0, 1500, 50)
    q_ids, _, found, score, reranked = search_block(model, q, v[q], ids, v, codes, left, 5)
    want = {}
    for i in q:
        s = v @ v[i]
        s[i] = -np.inf
        want[i] = np.lexsort((ids, -s))[:5].tolist()
        assert found[q_ids == i].tolist() == want[i]
    assert reranked < 0.2 * len(q) * len(v)
    fifth = score[4::5]
    again = search_block(model, q, v[q], ids, v, codes, left, 5, floor=fifth)
    assert again[2].tolist() == found.tolist() and again[4] <= reranked
    few = search_block(model, q, v[q], ids[:3], v[:3], codes[:3], left[:3], 5)
    assert len(few[2]) == 3 * len(q) - 1  # id 0 is a query itself


def test_quality_separates_and_has_a_prior():
    good, bad = [b"plain words in a row number %d here" % i for i in range(60)], [b"%%%%%% junk ### *** %d &&& !!!" % i for i in range(60)]
    model = quality.LatentVote(quality.terms(good + bad), np.array([1.0] * 60 + [0.0] * 60), 8, 5)
    assert model.score([b"some other plain words", b"*** %%% ### junk &&&"]).round().tolist() == [1, 0]
    assert model.score([b"", b" \n"]).tolist() == [0.5, 0.5]
    assert quality.LatentVote(np.zeros((0, 4)), np.zeros(0)).score([b"x"]).tolist() == [0.5]


def test_quality_terms_count_whole_texts_alone(monkeypatch):
    texts = [b"ab ab cd ab", b"", b"x", bytes(range(1, 200)) * 40]
    whole = quality.terms(texts)
    for i, t in enumerate(texts):  # neither neighbours nor stretches change a text's pairs
        assert np.array_equal(quality.terms([t])[0], whole[i])
    pairs = {}
    for a, b in zip(texts[0], texts[0][1:] + b"\0"):
        pairs[quality._SLOT[a << 8 | b]] = pairs.get(quality._SLOT[a << 8 | b], 0) + 1
    assert {i: round(v**2 * len(texts[0])) for i, v in enumerate(whole[0][: quality.PAIRS].tolist()) if v} == pairs
    assert np.allclose(whole[0][quality.PAIRS :] ** 2 * 4, [2, 1, 1, *[0] * 13])  # ab after 1 and after 2 words
    monkeypatch.setattr(quality, "_STRETCH", 64)
    assert np.array_equal(quality.terms(texts)[:, : quality.PAIRS], whole[:, : quality.PAIRS])


def test_quality_votes_are_those_of_a_plain_search():
    rng = np.random.default_rng(9)
    texts = [bytes(rng.integers(97, 100 + i % 20, rng.integers(20, 200)).astype(np.uint8)) for i in range(150)]
    labels = rng.integers(0, 2, 100).astype(float)
    model = quality.LatentVote(quality.terms(texts[:100]), labels)
    scores = model.score(texts[100:], block=7)
    for text, score in zip(texts[100:], scores):
        cosine = [float(np.dot(model.latent([text])[0], p)) for p in model.points]
        near = sorted(range(100), key=lambda i: -cosine[i])[: quality.NEIGHBOURS]
        weights = [max(0.0, cosine[i]) for i in near]
        assert abs(score - sum(w * labels[i] for w, i in zip(weights, near)) / sum(weights)) < 1e-5
