"""Kernels of the text operators against plain Python."""

import math
import os
import random
import subprocess
import sys
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from cellgrid.llm import byte_bpe, class_lm, language_id, near_dedup, packing, quality_classifier, quality_rules, suffix_dedup
from cellgrid.llm.common import HashIndex, SubstringHash, chunks, text_view

ODD = "ab  \n\t\r\x0b\x1c\x1f\x85\xa0 　'sdéÉΣ日語①²Ⅷ٣ñ́🙂!?.,-_\x00​K"


def odd_text(rng, n):
    return "".join(rng.choice(ODD) for _ in range(rng.randint(0, n)))


def test_byte_bpe_equals_the_library():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.ranks_of(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})
    coder = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN)
    rng = random.Random(1)
    texts = [odd_text(rng, 40) for _ in range(600)] + ["a" * 5000, "ab" * 900, " " * 3000, "é" * 700, "word two  three\n\nfour 12345's"]
    ids, counts = coder.encode(texts)
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at:at + n].tolist() == library.encode_ordinary(text), text
        assert byte_bpe.decode_ids(ranks, ids[at:at + n]).tobytes() == text.encode()
        at += n


def test_word_encoder_equals_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    coder = packing.WordEncoder(path)
    library = Tokenizer.from_file(path)
    rng = random.Random(2)
    special = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "endoftext|>"]
    texts = [odd_text(rng, 40) for _ in range(600)] + ["Straße, ÉCOLE. don't x.. <|endoftext|>", "", "hello <|startoftext|> world"]
    for _ in range(300):  # their strings stand for the special tokens, alone, inside words and beside blanks of any kind
        texts.append("".join(rng.choice([*special, "word", "É", ".", " ", "\n", "\t", "\x1c", "\x85", "\u00a0", "\u3000"]) for _ in range(rng.randrange(1, 12))))
    ids, counts = coder.encode(texts)
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at:at + n].tolist() == library.encode(text, add_special_tokens=False).ids, text
        at += n


def test_word_encoder_keeps_the_words_that_come_again(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    coder = packing.WordEncoder(path := public_tokenizers.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(path)
    fresh, encode = [], coder._encode_words
    monkeypatch.setattr(coder, "_encode_words", lambda words: fresh.extend(words) or encode(words))
    for n in range(12):
        texts = ["Common Words, come again.\n", "", f"once{'abcdefghijkl'[n]} " + " ".join(f"é{a}{'abcdefghijkl'[n]}" for a in "qrstuv")]
        ids, counts = coder.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert fresh.count("Common") == fresh.count("again.") == 1 and len(coder._words) <= 20 + 8


@pytest.mark.parametrize("seed", range(12))
def test_packing_plan_is_valid_and_tight(seed):
    rng = random.Random(seed)
    capacity = rng.choice([20, 100, 2048])
    sizes = Counter(min(capacity, int(rng.lognormvariate(math.log(capacity / 4), 0.8)) + 1) for _ in range(rng.choice([5, 300, 4000])))
    used = Counter()
    patterns = packing.plan(dict(sizes), capacity)
    for items, bins in patterns:
        assert bins > 0 and sum(a * b for a, b in items) <= capacity
        for size, each in items:
            used[size] += each * bins
    assert used == sizes
    # best-fit decreasing alone is within 11/9 of the optimum plus one; the volume is a lower bound
    bins, volume = sum(n for _, n in patterns), sum(a * b for a, b in sizes.items())
    big = sum(n for s, n in sizes.items() if 2 * s > capacity)
    assert bins <= 11 / 9 * max(math.ceil(volume / capacity), big) + 4


def best_bins(sizes, capacity):
    """The fewest bins, by trying all placements."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for room in set(bins):
            if room >= sizes[i]:
                rest = list(bins)
                rest.remove(room)
                place(i + 1, [*rest, room - sizes[i]])
        place(i + 1, [*bins, capacity - sizes[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_dominance_reduction_loses_no_bin(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randint(1, 20) for _ in range(8)), reverse=True)
    counts = np.bincount(sizes, minlength=21)
    fixed = packing.dominance_reduction(counts, 20)
    rest = [s for s in range(20, 0, -1) for _ in range(counts[s])]
    assert sum(n for _, n in fixed) + best_bins(rest, 20) == best_bins(sizes, 20)


def test_quality_measures_by_hand():
    texts = ["a b c a b c", "", "x\n\nx\n \nx y", "  ## !!\n", "one two three four one two three"]
    got = quality_rules.measure_texts(*text_view(pa.array(texts)))
    assert got["n_words"].tolist() == [6, 0, 4, 2, 7]
    assert got["word_chars"].tolist() == [6, 0, 4, 4, 26]
    assert got["n_symbols"].tolist() == [0, 0, 0, 2, 0]
    assert got["n_dup_lines"].tolist() == [0, 0, 1, 0, 0]
    assert got["n_repeat_words"].tolist() == [6, 0, 0, 0, 6]
    assert got["n_lines"].tolist() == [1, 1, 5, 2, 1]


def test_rule_bits_are_stable():
    assert list(quality_rules.RULES)[:2] == ["too_few_words", "repeated_words"]
    assert quality_rules.mask_of(quality_rules.POLICIES["base"]) == 3


def windows(texts, span=suffix_dedup.SPAN):
    seen = Counter(t[i:i + span] for t in texts for i in range(len(t) - span + 1))
    return [[i for i in range(len(t) - span + 1) if seen[t[i:i + span]] > 1] for t in texts]


@pytest.mark.parametrize("inner", suffix_dedup.LEVELS)
def test_keyed_suffix_sorts_find_all_repeats(inner):
    rng = random.Random(inner)
    for _ in range(4):
        parts = [bytes(rng.choice(b"abcdefgh ") for _ in range(rng.randint(150, 500))) for _ in range(4)]
        texts = [b"".join(rng.choice([*parts, bytes(rng.choice(b"xyz") for _ in range(30)), b"a" * 450, b"ab" * 200])
                          for _ in range(rng.randint(0, 6))) for _ in range(20)]
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        groups, hit = {}, [set() for _ in texts]
        for r, s, m, key, _, loop in zip(*suffix_dedup.units(np.frombuffer(b"".join(texts), np.uint8), offs, inner), strict=True):
            groups.setdefault(key, []).append((r, s, m, loop))
        for group in groups.values():
            if len(group) == 1 and not group[0][3]:
                continue
            part = [texts[r][s:s + m + suffix_dedup.SPAN - 1] for r, s, m, _ in group]
            found = suffix_dedup.repeated_starts(np.frombuffer(b"".join(part), np.uint8),
                                                 np.concatenate([[0], np.cumsum([len(p) for p in part])]), np.ones(len(part)))
            for (r, s, _, _), ranges in zip(group, found, strict=True):
                for a, b in ranges:
                    hit[r] |= set(range(s + a, s + b))
        assert [sorted(h) for h in hit] == windows(texts)


def test_suffix_order_is_sorted():
    rng = random.Random(3)
    for _ in range(40):
        letters = rng.choice([b"a", b"ab", b"abcd", bytes(range(256))])
        text = bytes(rng.choice(letters) for _ in range(rng.randint(1, 300))) * rng.choice([1, 2])
        wanted = np.array([rng.random() < rng.choice([0.2, 1]) for _ in text])
        order = suffix_dedup.suffix_order(np.frombuffer(text, np.uint8), wanted, 208)
        assert sorted(order) == np.flatnonzero(wanted).tolist()
        heads = [text[i:i + 200].ljust(208, b"\0") for i in order]
        assert heads == sorted(heads)


def slow_probability_jaccard(a, b):
    total = 0.0
    for d in set(a) & set(b):
        total += 1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in set(a) | set(b))
    return total


def test_probability_jaccard_and_its_estimate():
    rng = random.Random(4)
    for _ in range(20):
        a = {rng.randint(0, 30): rng.randint(1, 5) for _ in range(20)}
        b = dict(a) | {rng.randint(0, 60): rng.randint(1, 5) for _ in range(rng.randint(0, 12))}
        exact = slow_probability_jaccard(a, b)
        sets = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)], float)) for x in (a, b)]
        assert near_dedup.probability_jaccard(*sets) == pytest.approx(exact)
        row = np.repeat([0, 1], [len(a), len(b)])
        ids, weight = np.concatenate([s[0] for s in sets]) + np.uint64(7919), np.concatenate([s[1] for s in sets])
        sig = near_dedup.signatures(row, ids, weight, 2, 4000)
        assert (sig[0] == sig[1]).mean() == pytest.approx(exact, abs=0.05)


def slow_cost(counts, context, byte):
    for order in range(len(context), -1, -1):
        seen = counts.get(context[len(context) - order:], {})
        if byte in seen:
            return -math.log2(seen[byte] / (sum(seen.values()) + len(seen))) + slow_cost.paid
        if seen:
            slow_cost.paid -= math.log2(len(seen) / (sum(seen.values()) + len(seen)))
    return 8.0 + slow_cost.paid


def test_ppm_code_length_equals_a_plain_coder():
    train = ["hello there, hello world", "the theme then", "ö"]
    counts = {}
    for text in train:
        data = b"\0\0\0" + text.encode()
        for i in range(3, len(data)):
            for order in range(4):
                at = counts.setdefault(data[i - order:i], Counter())
                at[data[i]] += 1
    view = text_view(pa.array(train))
    keys, n = np.unique(language_id.grams(*view).astype(np.int64), return_counts=True)
    model = language_id.Model(["x"], [(keys, n)])
    tests = ["hello then", "zq the", "", "Ö world", "th"]
    got = model.code_lengths(*text_view(pa.array(tests)))[:, 0]
    for text, bits in zip(tests, got.tolist(), strict=True):
        data, want = b"\0\0\0" + text.encode(), 0.0
        for i in range(3, len(data)):
            slow_cost.paid = 0.0
            want += slow_cost(counts, data[i - 3:i], data[i])
        assert bits == pytest.approx(want, rel=1e-4), text


def test_exchange_gain_is_the_change_of_information():
    rng = np.random.default_rng(5)
    types = 1 + class_lm.SHAPES + 40
    pairs = rng.integers(0, 6, (types, types)).astype(float)
    first = 1 + class_lm.SHAPES
    classes = np.concatenate([np.arange(first), first + rng.integers(0, class_lm.CLASSES, 40)])

    def matrix(c):
        m = np.zeros((class_lm.ALL_CLASSES,) * 2)
        np.add.at(m, (c[:, None].repeat(types, 1), c[None, :].repeat(types, 0)), pairs)
        return m

    for word in (first, first + 7, types - 1):
        left, right = np.zeros(class_lm.ALL_CLASSES), np.zeros(class_lm.ALL_CLASSES)
        np.add.at(left, classes, pairs[:, word])
        np.add.at(right, classes, pairs[word])
        values = []
        for c in range(first, class_lm.ALL_CLASSES):
            moved = classes.copy()
            moved[word] = c
            values.append(class_lm.information(matrix(moved)))
        got = class_lm.best_class(matrix(classes), int(classes[word]), left, right, pairs[word, word])
        assert values[got - first] == pytest.approx(max(values))


def test_exchange_by_met_classes_decides_as_whole_matrices_do():
    rng = np.random.default_rng(6)
    types, first = 1 + class_lm.SHAPES + 300, 1 + class_lm.SHAPES
    pairs = rng.integers(1, 40, (types, types)) * (rng.random((types, types)) < 0.03)
    classes = np.concatenate([np.arange(first), first + rng.integers(0, class_lm.CLASSES - 2, types - first)])  # two classes are empty: ties
    left, right = np.zeros((types, class_lm.ALL_CLASSES)), np.zeros((types, class_lm.ALL_CLASSES))
    matrix = np.zeros((class_lm.ALL_CLASSES,) * 2)
    np.add.at(left.T, classes, pairs)
    np.add.at(right.T, classes, pairs.T)
    np.add.at(matrix, classes, right)
    of = np.arange(first, types)
    args = matrix, classes[of], left[of], right[of], np.diag(pairs)[of]
    assert class_lm.best_classes(*args).tolist() == class_lm._dense_classes(*args).tolist()


@pytest.mark.parametrize("types, often, blocks, parts", [(40, 0, 1, 1), (400, 25, 5, 3), (1 << 29, 30, 7, 4)])
def test_links_keep_every_count(types, often, blocks, parts):
    """Also where so many types leave few bits for a count."""
    rng = np.random.default_rng(7)
    links = class_lm.Links(types, often, blocks, parts)
    tokens = np.where(rng.random(5000) < 0.7, rng.integers(0, 4, 5000), rng.integers(0, 40, 5000)).astype(np.int32)
    want = Counter(zip([0, *tokens[:-1].tolist()], tokens.tolist(), strict=True))
    by_part = {}
    for batch in links.of_tokens(tokens):
        by_part.setdefault(batch.column("part")[0].as_py(), []).append(batch)
    got, beside = Counter(), Counter()
    for batches in by_part.values():
        for batch in links.lists(iter(batches)):
            row = batch.to_pylist()[0]
            words = np.frombuffer(row["words"], np.int32)
            assert row["kind"] == (0 if words[0] <= class_lm.SHAPES else 2 if words[0] < often else 1)
            for name, counts in (("left", got), ("right", beside)):
                lengths, others, n = class_lm._unpacked(pa.scalar(row[name]), len(words))
                for w, o, k in zip(np.repeat(words, lengths).tolist(), others.tolist(), n.tolist(), strict=True):
                    counts[(o, w) if name == "left" else (w, o)] += k
    assert got == {p: n for p, n in want.items() if p[1] > class_lm.SHAPES or p[0] <= class_lm.SHAPES}
    assert beside == {p: n for p, n in want.items() if p[0] > class_lm.SHAPES}


def test_often_words_are_cut_by_their_counts():
    """Blocks of all often words together grow with the tokens, not with words times types."""
    counts = 1_000_000 // np.arange(1, 4001)
    rows = []
    for times in (1, 5):
        c = counts * times
        often, blocks = class_lm.blocks_of(c, int((c > class_lm.BLOCK // 2).sum()), 20 * times)
        links = class_lm.Links(20 * times * class_lm.BLOCK, often, blocks, 64)
        first = 1 + class_lm.SHAPES
        word = np.repeat(np.arange(often), 300)
        other = np.random.default_rng(8).integers(0, 2 * links.types, len(word))
        sent = list(links.sent(word * 2 * links.types + other, np.ones(len(word), np.int64)))
        got = Counter()
        for batch in sent:
            codes, n = links.summed([np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("links")])
            got.update(set((codes // (2 * links.types)).tolist()))
            assert n.sum() >= len(codes)
        assert all(got[w] <= blocks[w] for w in got) and all(got[w] == 1 for w in range(first)) and max(got.values()) > 1
        assert blocks[first:].sum() <= 2 * 2 * c.sum() / class_lm.BLOCK
        rows.append(sum(got.values()))
    assert rows[1] < 8 * rows[0]
    assert class_lm.blocks_of(counts[:10], 20, 3)[1][-10:].tolist() == [3] * 10  # words that the list lacks
    assert class_lm.blocks_of(counts, 20, 1) == (0, 1)


def test_merged_parts_of_words_are_their_sums():
    sides = np.arange(4 * (2 * class_lm.ALL_CLASSES + 1.0)).reshape(4, -1)
    words, total = class_lm._merged(iter([(np.array([9, 20]), sides[:2]), (np.array([20, 7]), sides[2:])]))
    assert words.tolist() == [7, 9, 20] and (total == np.array([sides[3], sides[0], sides[1] + sides[2]])).all()
    assert class_lm._merged(iter([]))[1].shape == (0, 2 * class_lm.ALL_CLASSES + 1)


def test_decisions_start_no_other_threads():
    """BLAS threads spin between small products and take a core each."""
    code = """
import time
import numpy as np
from cellgrid.llm import class_lm
rng = np.random.default_rng(9)
n, size = 4000, class_lm.ALL_CLASSES
left, right = (rng.integers(0, 4, (n, size)) * (rng.random((n, size)) < 0.5) for _ in range(2))
args = rng.integers(1000, 9000, (size, size)), rng.integers(1 + class_lm.SHAPES, size, n), left, right, np.zeros(n)
whole, own = time.process_time(), time.thread_time()
class_lm.best_classes(*args)
print((time.process_time() - whole) / (time.thread_time() - own))
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120,
                         env={**os.environ, "OMP_NUM_THREADS": "2", "OPENBLAS_NUM_THREADS": "2", "PYTHONPATH": root})
    assert float(got.stdout) < 1.2


def test_em_finds_which_labeller_is_better():
    rng = random.Random(6)
    patterns = Counter()
    for _ in range(4000):
        truth = rng.random() < 0.3
        votes = [truth if rng.random() < p else not truth for p in (0.95, 0.7, 0.8)]
        patterns["".join(str(int(v)) for v in votes) + (str(int(truth)) if rng.random() < 0.1 else "2")] += 1
    chances, prior, posterior = quality_classifier.estimate(dict(patterns))
    assert prior == pytest.approx(0.3, abs=0.05)
    good = [chances[j, 1, 1] / (chances[j, 1, 0] + chances[j, 1, 1]) for j in range(3)]
    assert good == pytest.approx([0.95, 0.7, 0.8], abs=0.06)
    assert posterior["1112"] > 0.9 > 0.1 > posterior["0002"]
    assert quality_classifier.estimate({})[2] == {}


def test_hashes_and_chunks():
    data = np.frombuffer(b"abcabcXabc", np.uint8)
    h = SubstringHash(data).of(np.array([0, 3, 7, 1]), np.array([3, 6, 10, 4]))
    assert h[0] == h[1] == h[2] != h[3]
    keys = np.random.default_rng(1).integers(-2**62, 2**62, 5000)
    index = HashIndex(keys)
    assert index.find(keys).tolist() == list(range(5000)) and (index.find(keys + 1) < 0).sum() >= 4999
    assert HashIndex(keys[:0]).find(keys[:3]).tolist() == [-1] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(["aa", None, "b" * 50, "", "c"])], ["t"])
    assert [b.num_rows for b in chunks(iter([batch, batch.slice(0, 0)]), "t", 10)] == [2, 1, 2]


def test_fit_ends_where_the_slope_vanishes():
    rng = np.random.default_rng(3)
    n = 400
    rates = rng.random((n, len(quality_classifier.RATES)))
    row, bucket = np.repeat(np.arange(n), 5), rng.integers(0, 300, 5 * n)
    target = np.where(rng.random(n) < 0.2 + 0.6 * (bucket[::5] % 2), 0.95, 0.02)
    scorer = quality_classifier.fit(rates, row, bucket, target)
    weight = (1 - target) / (1 - target.mean()) + target / target.mean()
    slip = weight / weight.sum() * (scorer(rates, row, bucket) - target)
    words = np.bincount(bucket, slip[row], minlength=len(scorer.words)) + 1e-5 * scorer.words
    assert max(abs(slip.sum()), np.abs(rates.T @ slip + 1e-5 * scorer.rates).max(), np.abs(words).max()) < 1e-5
