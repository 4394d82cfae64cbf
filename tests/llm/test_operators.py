"""Every operator against a brute-force version, over tables with all the awkward rows."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import fixtures
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinsight.llm import best_fit, chat_format, decontaminate, hashing, jaccard_join, lm_score, quality_rules, substring_dedup, token_counts, url_filter, warc

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return SPACED.findall(text or "")


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def empty(docs):
    return docs.limit(0)


def test_word_hashes():
    rng = random.Random(2)
    texts = [fixtures.prose(rng, rng.randrange(0, 50)).encode() for _ in range(50)] + [b"", b" \n", b"x" * (3 << 20), b"a b " * (1 << 19)]
    known = {}
    for t, h in zip(texts, hashing.word_hashes(texts), strict=True):
        assert len(h) == len(t.split())
        for w, x in zip(t.split(), h, strict=True):
            assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known)


def test_windows_and_minima():
    h = hashing.mixed(np.arange(40, dtype=np.uint64) % np.uint64(7))
    for size in (1, 3, 5, 10, 13, 40):
        got = hashing.windows(h, size)
        seen = defaultdict(set)
        for i, x in enumerate(got):
            seen[tuple(h[i : i + size])].add(x)
        assert len(got) == 41 - size and all(len(s) == 1 for s in seen.values()) and len({x for s in seen.values() for x in s}) == len(seen)
        assert list(hashing.sliding_min(h, size)) == [min(h[i : i + size]) for i in range(41 - size)]
    assert len(hashing.windows(h, 41)) == 0 and len(hashing.sliding_min(h, 41)) == 0


# ---- 1


def brute_overlaps(docs, items):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    windows = defaultdict(set)
    for k, t in items:
        w = fold(t)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add("" if k is None else str(k))
    out = []
    for k, t in docs:
        w, hit, found = fold(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                got = windows.get(tuple(w[i : i + n]))
                if got:
                    hit |= set(range(i, i + n))
                    found |= got
        out.append((k, len(w), len(hit), tuple(sorted(found))))
    return out


def test_words_of_decontamination(spark):
    """The characters that a word may have are those of the contract's negated class, over every ASCII character and some beyond."""
    texts = ["".join(f"a{chr(c)}" for c in range(128)), "caf\u00e9 \u6f22\u5b57-\U0001f600x \x80\u2028\ufffe\U0010ffff.Z9", "", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", decontaminate._words(F.col("t")).alias("w")).collect()
    contract = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    assert {r.i: r.w for r in got} == {i: contract.findall(t or "") for i, t in enumerate(texts)}


def test_decontamination(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 7)  # several passes
    texts = rows_of(docs)
    long = [t for _, t in texts if t and len(words(t)) > 60]
    items = [(i, " ".join(words(t)[5 : 5 + n]).upper()) for i, (t, n) in enumerate(zip(long[:8], (13, 20, 5, 30, 1, 14, 13, 2), strict=True))]
    items += [(None, items[0][1]), (90, None), (91, ""), (92, items[1][1]), (92, items[1][1])]
    bench = spark.createDataFrame([(*x, 0) for x in items], "item_id bigint, text string, df int")
    got = decontaminate.find_overlaps(docs, bench).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, tuple(r["items"])) for r in got) == sorted((str(a), b, c, d) for a, b, c, d in brute_overlaps(texts, items))
    none = decontaminate.find_overlaps(docs, bench.limit(0)).collect()
    assert len(none) == len(texts) and not any(r.n_hit for r in none)
    assert decontaminate.find_overlaps(empty(docs), bench).count() == 0


# ---- 2


def test_lm_scores(docs, monkeypatch):
    monkeypatch.setattr(lm_score, "PART_BYTES", 300)  # several parts
    texts = rows_of(docs)
    got = lm_score.score_texts(docs).collect()
    assert len(got) == len(texts)
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2
    counts = Counter(w for k, t in texts if not held(k) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(k), held(k), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for k, t in texts)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm_score.score_texts(empty(docs)).count() == 0


def test_repeats_by_brute_force():
    rng = random.Random(3)
    ids, doc = np.array([rng.randrange(5) for _ in range(60)], dtype="<u4"), np.sort(np.array([rng.randrange(4) for _ in range(60)]))
    same = lambda i: [j for j in range(60) if ids[j] == ids[i] and doc[j] == doc[i]]
    before, all_ = lm_score.repeats(ids, doc)
    assert before.tolist() == [sum(j < i for j in same(i)) for i in range(60)] and all_.tolist() == [len(same(i)) for i in range(60)]


def test_spelling_is_a_distribution():
    """The probabilities of a byte's 256 values after any context sum to one."""
    rng = np.random.default_rng(1)
    n = lm_score.ORDERS << lm_score.SPELL_BITS
    speller = lm_score.Speller(rng.integers(0, 9, n), rng.integers(0, 9, n))
    ends = speller.log10([b"ab"])[0]
    # of "ab" + end against "ab" + one more byte + end: sum over that byte of P(byte | ab) is P(all) - P(end | ab)
    slots, bits, _ = lm_score.spelling([b"ab"])
    x, gate = speller.inputs(slots)
    p = lm_score._squash((speller.weights[gate].T * x).sum(axis=0))
    assert abs(ends - np.log10(np.where(bits == 1, p, 1 - p)).sum()) < 1e-9
    total = 0.0
    for byte in range(256):
        slots, bits, word = lm_score.spelling([bytes([97, 98, byte])])
        x, gate = speller.inputs(slots)
        p = lm_score._squash((speller.weights[gate].T * x).sum(axis=0))
        one = np.log(np.where(bits == 1, p, 1 - p))[16:24].sum()
        total += math.exp(one)
    assert abs(total - 1) < 1e-9


def test_a_held_out_text_teaches_nothing(spark, docs):
    held = next(k for k in range(5000, 6000) if lm_score.held_out(k))
    extra = spark.createDataFrame([(held, "zqzq " * 500)], "doc_id bigint, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    before = {(r.doc_id, r.n_tokens): round(r.score, 9) for r in lm_score.score_texts(docs).collect()}
    after = {(r.doc_id, r.n_tokens): round(r.score, 9) for r in lm_score.score_texts(both).collect() if r.doc_id != held}
    assert before == after


def test_packed_numbers_and_words_come_back():
    for x in ([], [0], [1, 1 << 40, 255, 256, 3]):
        assert lm_score.unpack(lm_score.pack(np.array(x, np.int64))).tolist() == x
    for w in ([], [b"a"], [b"a", b"\xff\x00"]):
        assert lm_score.unpack_words(lm_score.pack_words(w)) == w


def test_long_words_are_learned_whole():
    batch = pa.RecordBatch.from_arrays([pa.array([lm_score.pack_words(w) for w in ([b"a" * 100, b"b" * (1 << 17)], [], [b"c"])], pa.binary())], ["words"])
    learned = sum(sum(b.column("zero").to_pylist()) + sum(b.column("one").to_pylist()) for b in lm_score._spell_counts(iter([batch])))
    assert learned == 8 * lm_score.ORDERS * (101 + (1 << 17) + 1 + 2)


class Model:
    """A vocabulary with counts in a kind's texts and in all, and tables of random outcomes."""

    def __init__(self, seed):
        rng = random.Random(seed)
        self.near = {b"w%d" % i: rng.choice([0, 1, 1, 2, 3, 9, 40]) for i in range(60)}
        self.every = {w: c + rng.choice([0, 1, 5]) or 1 for w, c in self.near.items()}
        self.mass = np.zeros(lm_score.SYMBOLS, np.int64)
        for w, c in self.near.items():
            self.mass[int(lm_score.word_class(np.array([c]))[0]) if c else lm_score.ELSEWHERE] += c or self.every[w]
        self.tree = lm_score.Tree({8: self.mass}, 5, 7)
        n = np.random.default_rng(seed)
        self.stretched = lm_score.stretch_tables(n.integers(0, 30, lm_score.SLOTS), n.integers(0, 30, lm_score.SLOTS))

    def block(self, texts):
        tokens = [b"", *dict.fromkeys(w for t in texts for w in t)]
        ids = np.array([i for t in texts for i in [*map(tokens.index, t), 0]], dtype=np.int64)
        counts = np.array([[c.get(t, 0) for t in tokens] for c in (self.near, self.every)])
        return lm_score.Block(ids, np.array([len(t) + 1 for t in texts]), counts, self.tree, self.mass), len(tokens)

    def scores(self, texts):
        """log10 of each token's probability, but for its spelling; the text's end comes last."""
        block, n = self.block(texts)
        found = lm_score.token_scores(block, self.stretched, np.zeros(n))
        return np.split(found, np.cumsum(block.sizes)[:-1])

    def brute(self, text):
        """The same, token by token."""
        t, S = self.tree, lm_score.SYMBOLS
        weights, refined = np.tile(np.array(lm_score.WEIGHTS, np.float32), (lm_score.GATES, 1)), lm_score._squash((np.arange(lm_score.BINS) + 0.5 - lm_score.BINS / 2) * 0.5)
        seen, follows, symbols, run, waiting, out = Counter(), {}, [], 0, [], []

        def symbol_of(w):
            if w == b"":
                return lm_score.END
            if self.near.get(w):
                return int(lm_score.word_class(np.array([self.near[w]]))[0])
            return lm_score.ELSEWHERE if self.every.get(w) else lm_score.LACKED

        def coded(node, bit, parts, gate):
            nonlocal weights, refined
            x = np.array([self.stretched[o + node + S * v] for o, v in zip(lm_score._OFFSETS, parts, strict=True)], np.float64)
            at = float(x @ weights[gate])
            p = 1 / (1 + math.exp(-at))
            cell = int(min(max(at * 2 + lm_score.BINS / 2, 0), lm_score.BINS - 1))
            q = (3 * p + refined[cell]) / 4
            waiting.append((gate, x, bit, p, cell))
            if len(waiting) == lm_score.SEGMENT:
                new, sums, tried = weights.copy(), np.zeros(lm_score.BINS), np.zeros(lm_score.BINS)
                for g, y, b, guess, c in waiting:
                    new[g] += lm_score.RATE * (b - guess) * y
                    sums[c] += b - refined[c]
                    tried[c] += 1
                weights, refined = new, refined + sums / (tried + 50)
                waiting.clear()
            return math.log10(q if bit else 1 - q)

        words = [*text, b""]
        for i, w in enumerate(words):
            s, pair = symbol_of(w), (words[i - 2], words[i - 1]) if i >= 2 else None
            guess = follows.get(pair) or None
            said = symbol_of(guess) if guess else lm_score.NO_SYMBOL
            last, last2 = (symbols[-1] if i else 0), (symbols[-2] if i > 1 else 0)
            far, level = int(min(math.log2(i + 1) * 2, 31)), int(min((sum(symbols) + 64) / (i + 8) * 3, 63))

            def parts(says, node_symbol=None):
                return last, last * S + last2, far, says * 8 + run, level if node_symbol is None else node_symbol

            gate = lambda says: 0 if says == 2 else 1 + min(run, 6)
            log = 0.0
            for k in range(t.length[s]):
                says = int(t.says[said, t.node[s, k]])
                log += coded(t.node[s, k], t.bit[s, k], parts(says), gate(says))
            own = {x: n for x, n in seen.items() if symbol_of(x) == lm_score.LACKED}
            if s == lm_score.LACKED and own:
                says = 1 if said == lm_score.LACKED else 2
                log += coded(lm_score.HAD, int(w in own), parts(says), gate(says))
            if s != lm_score.END and not (s == lm_score.LACKED and w not in own):
                share = lambda x: own[x] if s == lm_score.LACKED else self.near.get(x) or self.every[x]
                whole = sum(own.values()) if s == lm_score.LACKED else self.mass[s]
                if said == s:
                    whole -= share(guess)
                    if whole > 0:
                        log += coded(lm_score.CANDIDATE, int(w == guess), parts(1, s), gate(1))
                if w != guess or said != s:
                    log += math.log10(share(w) / whole)
            run = min(run + 1, 7) if guess == w and guess else 0
            out.append(log)
            seen[w] += 1
            symbols.append(s)
            if pair:
                follows[pair] = w
        return out


@pytest.mark.parametrize("seed", [1, 2])
def test_lm_scores_by_brute_force(seed):
    model, rng = Model(seed), random.Random(seed)
    words = [*model.near, b"own1", b"own2", b"own3"]
    phrase = [rng.choice(words) for _ in range(30)]
    texts = [[rng.choice(words) for _ in range(n)] for n in (0, 1, 2, 300)] + [phrase * 12, [b"own1"] * 50, phrase[:3] * 9]
    for text, found in zip(texts, model.scores(texts), strict=True):
        assert np.allclose(found, model.brute(text), atol=1e-4)


def test_the_next_token_is_a_distribution():
    """After any text, the probabilities of the end, of every word and of a new word sum to one."""
    model, rng = Model(3), random.Random(8)
    phrase = [rng.choice([*model.near, b"own1", b"own2"]) for _ in range(10)]
    for before in ([], [b"w3"], [b"own1"], [rng.choice([*model.near, b"own1", b"own2"]) for _ in range(80)], phrase * 6 + phrase[:4]):
        own = {w for w in before if w not in model.near}
        follow = sum(10 ** model.scores([[*before, w]])[0][len(before)] for w in [*model.near, *own, b"new"])
        assert abs(follow + 10 ** model.scores([before])[0][-1] - 1) < 1e-6


def test_context_predicts_the_next_word():
    """Words in an order that recurs cost much less than the same words in any order."""
    model = Model(4)
    cycle = sorted(model.near)[::2]
    mixed_up = cycle * 19
    random.Random(5).shuffle(mixed_up)
    assert model.scores([cycle * 20])[0].sum() > 0.6 * model.scores([cycle + mixed_up])[0].sum()


def test_kinds_part_texts_by_their_letters():
    texts = [b"", b"zz", b"the other", b"Quux quiz"]
    shares = lm_score.letters(texts)
    assert np.allclose(shares.sum(axis=1), [0, 1, 1, 1]) and abs(shares[3][16] - 2 / 8) < 1e-9
    cuts = {1: (25, 0.05), 2: (4, 0.1), 3: (25, 0.5)}
    assert lm_score.kinds_of(shares, cuts).tolist() == [4, 7, 5, 6]
    assert lm_score.kinds_of(shares[:0], cuts).tolist() == []


def test_held_out_texts_score_above_the_base(spark):
    """Texts of two made-up languages: what their kind has is known better than by all counts."""
    rng = random.Random(3)
    made = lambda letters: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 6))) for _ in range(300)]
    lists = made("abcdefg"), made("nopqrst")
    rows = [(k, " ".join(rng.choice(lists[k % 2]) for _ in range(150))) for k in range(200)]
    got = lm_score.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).where("held_out").collect()
    assert sum(r.score for r in got) > 0.95 * sum(r.base_score for r in got)


class Numbered(Model):
    """The same with words numbered within their symbols, and tables of their bits."""

    def __init__(self, seed, taught=()):
        super().__init__(seed)
        self.symbol = {w: int(lm_score.known_class(np.array([c]))[0]) for w, c in self.near.items()}
        self.whole = np.bincount(list(self.symbol.values()), minlength=lm_score.SYMBOLS)
        self.number = {w: list(self.symbol.values())[:i].count(s) for i, (w, s) in enumerate(self.symbol.items())}
        self.table = np.zeros((lm_score.NUMBER_SLOTS, 2), np.int32)
        for text in taught:
            block, numbers, _ = self.parts([text])
            numbers.learn(self.table, np.ones(len(block.ids), bool))
        n = np.random.default_rng(seed)
        slots = lm_score.ORDERS << lm_score.SPELL_BITS
        self.speller = lm_score.Speller(n.integers(0, 9, slots), n.integers(0, 9, slots))

    def parts(self, texts):
        tokens = [b"", *dict.fromkeys(w for t in texts for w in t)]
        ids = np.array([i for t in texts for i in [*map(tokens.index, t), 0]], dtype=np.int64)
        counts = np.array([[c.get(t, 0) for t in tokens] for c in (self.near, self.every)])
        block = lm_score.Block(ids, np.array([len(t) + 1 for t in texts]), counts, self.tree, self.mass, numbered=True)
        number = np.array([self.number.get(t, 0) for t in tokens])
        return block, lm_score.Numbers(block, 8, number, self.whole), dict(enumerate(tokens))

    def scores(self, texts, spelled=True):
        block, numbers, words = self.parts(texts)
        below = [numbers.bits(self.table.astype(np.float32))] + [lm_score.spelled_bits(block, words, self.speller)] * spelled
        found = lm_score.token_scores(block, self.stretched, below=below, weights=lm_score.first_weights(self.speller))
        return np.split(found, np.cumsum(block.sizes)[:-1])


def test_numbered_words_are_a_distribution():
    """After any text, the probabilities of the end, of every word and of a new word sum to one, whatever the tables hold."""
    rng = random.Random(8)
    plain = Model(3)
    phrase = [rng.choice([*plain.near, b"own1", b"own2", b"own3"]) for _ in range(12)]
    for model in (Numbered(3), Numbered(3, [phrase * 9, [*plain.near] * 3])):
        for before in ([], [b"w3"], [b"own1"], [rng.choice([*model.near, b"own1", b"own2"]) for _ in range(80)], phrase * 6 + phrase[:4]):
            own = {w for w in before if w not in model.near}
            follow = sum(10 ** model.scores([[*before, w]], spelled=False)[0][len(before)] for w in [*model.near, *own, b"new"])
            assert abs(follow + 10 ** model.scores([before], spelled=False)[0][-1] - 1) < 1e-4


def test_numbers_by_brute_force():
    model, rng = Numbered(5), random.Random(5)
    texts = [[rng.choice([*model.near, b"own1", b"own2", b"own3", b"own4"]) for _ in range(n)] for n in (0, 1, 60, 200)]
    _, numbers, _ = model.parts(texts)
    bits, shares, lengths = [], [], []
    for text in texts:
        own = []
        for w in [*text, b""]:
            if w in model.near:
                value, size = model.number[w], int(model.whole[model.symbol[w]])
            else:
                value, size = (own.index(w), len(own)) if w in own else (0, 1)
                own += [w] * (w != b"" and w not in own)
            found = []
            for left in reversed(range((size - 1).bit_length())):
                under = [x for x in range(size) if x >> (left + 1) == value >> (left + 1)]
                ones = sum(x >> left & 1 for x in under)
                if ones:
                    found.append((value >> left & 1, ones / len(under)))
            lengths.append(len(found))
            bits += [b for b, _ in found]
            shares += [p for _, p in found]
    assert numbers.bit.tolist() == bits and numbers.lengths.tolist() == lengths and np.allclose(numbers.share, shares)


def test_words_of_a_symbol_are_told_apart_by_context():
    """Equal counts: only what came before can tell which word of a symbol comes next."""
    words = [w for w, c in Model(4).near.items() if c == 1]
    pairs = dict(zip(words[::2], words[1::2], strict=False))
    text = lambda follows: [w for a, b in pairs.items() for w in (a, follows[b])]
    as_taught, turned = {b: b for b in pairs.values()}, dict(zip(pairs.values(), [*pairs.values()][::-1], strict=True))
    model = Numbered(4, [text(as_taught)] * 20)
    a, b = (model.scores([text(x)])[0].sum() for x in (as_taught, turned))
    assert len(pairs) > 3 and a > 0.7 * b


def test_weights_of_spelling_follow_the_text():
    """A new word's spelling costs what the text's own weights say, not what they were before it."""
    model = Numbered(6)
    alone, late = model.scores([[b"unheardof"], [b"new%03d" % k for k in range(300)] + [b"unheardof"]])
    block, _, words = model.parts([[b"unheardof"]])
    fixed = lm_score.spelled_bits(block, words, model.speller)
    assert int(fixed[0][0]) == 80 and abs(alone[0] - late[300]) > 1e-3


def test_long_texts_advance_together(monkeypatch):
    """Before, parts of a block took its texts as they came, so that each had a few long ones; and texts that teach nothing were numbered for the tables."""
    model, rng = Numbered(7), random.Random(7)
    texts = [[rng.choice([*model.near, b"own1", b"own2"]) for _ in range(n)] for n in (3, 200, 0, 90, 201, 1, 150, 90)]
    tokens = [b"", *dict.fromkeys(w for t in texts for w in t)]
    counts = np.array([[c.get(t, 0) for t in tokens] for c in (model.near, model.every)])
    sizes, ids = np.array([len(t) + 1 for t in texts]), np.array([i for t in texts for i in [*map(tokens.index, t), 0]])
    number = np.array([model.number.get(t, 0) for t in tokens])
    words = lm_score.Vocabulary(model.tree, [8], 7, {0: model.whole[None]})
    scored = lambda sizes, ids: lm_score.score_block(8, sizes, ids, counts, number, dict(enumerate(tokens)), words, model.stretched, model.table.astype(np.float32), model.speller, 99, 9)
    alone = np.array([scored(x[:1], y)[3][0] for x, y in ((sizes[k:], ids[sizes[:k].sum() : sizes[: k + 1].sum()]) for k in range(len(texts)))])
    made, block = [], lm_score.Block
    monkeypatch.setattr(lm_score, "Block", lambda ids, sizes, *a, **b: made.append(sizes.tolist()) or block(ids, sizes, *a, **b))
    monkeypatch.setattr(lm_score._texts_at_a_time, "__defaults__", (250,))
    n, known, base, score = scored(sizes, ids)
    assert len(made) > 2 and sum(made, []) == sorted(sizes.tolist(), reverse=True)
    assert np.allclose(score, alone, atol=1e-4) and n.tolist() == sizes.tolist()
    made.clear()
    keys = [next(k for k in itertools.count(100 * i) if lm_score.held_out(k) == (i in (1, 4))) for i in range(len(texts))]
    row = {"sizes": pa.array([sizes.tolist()]), "ids": pa.array([lm_score.pack(ids)]), "text_kind": pa.array([8]), "doc_ids": pa.array([keys]), "held": pa.array([None], pa.list_(pa.struct([("at", pa.binary())])))}
    list(lm_score._outcomes(words)(iter([pa.RecordBatch.from_pydict(row)])))
    assert sum(made, []) == [x for i, x in enumerate(sizes.tolist()) if i not in (1, 4)]


def test_packed_numbers_take_as_few_bytes_as_they_need():
    for most, width in ((0, 1), (127, 1), (128, 2), (1 << 15, 4), (1 << 31, 8)):
        x = np.array([0, 5, -most, most])
        raw = lm_score.pack(x)
        assert lm_score.unpack(raw).tolist() == x.tolist() and len(lm_score._plain(raw[1:])) == 4 * width


def test_numbers_do_not_depend_on_the_parts(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(k, " ".join("w%d" % rng.randrange(900) for _ in range(60))) for k in range(120)]
    found = []
    for size in (200, 1 << 20):
        monkeypatch.setattr(lm_score, "PART_BYTES", size)
        found.append(sorted((r.doc_id, round(r.score, 6)) for r in lm_score.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).collect()))
    assert found[0] == found[1]


# ---- 3


def greedy(pieces, word):
    known, n, i = set(pieces), 0, 0
    while i < len(word):
        k = next((k for k in range(len(word) - i, 0, -1) if word[i : i + k] in known), 0)
        if not k:
            return -1
        i, n = i + k, n + 1
    return n


def test_longest_match_automaton():
    rng = random.Random(1)
    for _ in range(400):
        pieces = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 7))]
        machine = token_counts.LongestMatch(pieces)
        for _ in range(10):
            w = "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))
            assert machine.count(w) == greedy(pieces, w)


def test_token_counts(docs):
    path = best_fit.vocabulary_path()
    pieces, table = token_counts.load_pieces(path), token_counts.byte_characters()
    known = set(pieces)
    longest = max(map(len, known))

    def one(w):
        text, n, i = "".join(table[b] for b in w) + token_counts.WORD_END, 0, 0
        while i < len(text):
            k = next(k for k in range(min(longest, len(text) - i), 0, -1) if text[i : i + k] in known)
            i, n = i + k, n + 1
        return n

    memo = {}
    got = sorted((str(r.doc_id), r.n_words, r.n_tokens, r.n_unknown) for r in token_counts.count_tokens(docs, path).collect())
    want = []
    for k, t in rows_of(docs):
        w = (t or "").encode().lower().split()
        want.append((str(k), len(w), sum(memo.setdefault(x, 0) or memo.__setitem__(x, one(x)) or memo[x] for x in w), 0))
    assert got == sorted(want)
    assert token_counts.count_tokens(empty(docs), path).count() == 0


# ---- 4


def brute_classes(texts):
    sets = []
    for _, t in texts:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    n = len(texts)
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links, different = [0] * n, [set() for _ in range(n)]
    for i in range(n):
        for j in range(n):
            if i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                if sets[i] != sets[j]:
                    different[i].add(sets[j])
                a, b = sorted((root(i), root(j)))
                up[b] = a
    least = defaultdict(list)
    for i, (k, _) in enumerate(texts):
        least[root(i)].append(k)
    name = {r: min([k for k in ks if k is not None], default=None) for r, ks in least.items()}
    return sorted((str(k), str(name[root(i)]), links[i], len(different[i])) for i, (k, _) in enumerate(texts))


@pytest.mark.parametrize("tile", [300, 3])
def test_jaccard_join(docs, monkeypatch, tile):
    monkeypatch.setattr(jaccard_join, "TILE", tile)  # small tiles: components are put together again
    got = jaccard_join.join_similar(docs).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links, r.n_text_links) for r in got) == brute_classes(rows_of(docs))


def test_tiles_meet_under_shuffle_joins(spark, docs, monkeypatch):
    """No side is broadcast, and groups are larger than a tile: rows of many parts are joined with those of few."""
    monkeypatch.setattr(jaccard_join, "TILE", 3)
    own = spark.newSession()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    own.conf.set("spark.sql.shuffle.partitions", "16")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = jaccard_join.join_similar(own.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links, r.n_text_links) for r in got) == brute_classes(rows)


@pytest.mark.parametrize("alike", [0.5, 2])
def test_large_buckets_are_split(spark, monkeypatch, alike):
    monkeypatch.setattr(jaccard_join, "BRUTE", 4)
    monkeypatch.setattr(jaccard_join, "ALIKE", alike)
    rng = random.Random(6)
    base = fixtures.prose(rng, 300).split()
    rows = []
    for k in range(60):
        w = list(base)
        w[rng.randrange(300)] = f"new{k}"
        rows.append((k, " ".join(w)))
    got = jaccard_join.join_similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.class_id for r in got} == {0}
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links, r.n_text_links) for r in got) == brute_classes(rows)


def test_runs_reach_the_recall():
    assert jaccard_join.runs(0.999) > jaccard_join.runs(0.9) >= 1


def test_recall_holds_where_buckets_are_split(spark, monkeypatch):
    """Pairs of signatures equal in 0.8 of the coordinates on average, with every bucket split to the last depth."""
    monkeypatch.setattr(jaccard_join, "BRUTE", 1)
    monkeypatch.setattr(jaccard_join, "ALIKE", 2)
    rng, n = np.random.default_rng(4), 2000
    one, other = (rng.integers(0, 1 << 32, (n, jaccard_join.COORDINATES), dtype=np.uint32) for _ in range(2))
    other = np.where(rng.random(one.shape) < jaccard_join.SIMILARITY, one, other)
    rows = [(2 * i + k, bytearray(x[i].astype("<u4").tobytes())) for i in range(n) for k, x in enumerate((one, other))]
    edges = jaccard_join.candidate_edges(spark.createDataFrame(rows, "node bigint, signature binary"))
    met = {tuple(sorted(r)) for r in edges.collect()}
    assert sum((2 * i, 2 * i + 1) in met for i in range(n)) >= 0.997 * n


def test_jaccard_join_of_nothing(docs):
    assert jaccard_join.join_similar(empty(docs)).count() == 0


# ---- 5


def test_globs_by_brute_force():
    rng = random.Random(7)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "?"]) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    texts = ["".join(rng.choice("ab/") for _ in range(rng.randint(0, 7))).encode() for _ in range(200)]
    part = {"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}
    got = url_filter.compile_globs(globs).matches(texts)
    for j, g in enumerate(globs):
        pattern = "".join(part.get(x, re.escape(x)) for x in re.findall(r"\*\*|.", g))
        assert got[:, j].tolist() == [re.fullmatch(pattern, t.decode()) is not None for t in texts], g


def test_url_rules(spark):
    cases = [
        ("http://EXAMPLE.com/en/1?x", "example.com", "/en/1", "example.com/en/", "block"),
        ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://a.www.example.com/en/x#y", "a.www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("http://example.com/fr/", "example.com", "/fr/", "com/", "allow"),
        ("http://badexample.com/en/", "badexample.com", "/en/", "com/", "allow"),
        ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
        ("http://x.net/es", "x.net", "/es", None, "allow"),
        ("http://x.com", "x.com", "", None, "allow"),
        ("http://x.org/a.com/en/", "x.org", "/a.com/en/", None, "allow"),
        ("http://x.com?/en/", "x.com", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("://", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://É.net/fr/é", "É.net", "/fr/é", "net/fr/", "block"),
        ("http://x.com/" + "a" * 5000, "x.com", "/" + "a" * 5000, "com/", "allow"),
    ]
    df = spark.createDataFrame([(c[0], "z", "q") for c in cases] * 2, "url string, host string, rule string")
    got = url_filter.judge(df).select("url", "verdicts.host", "verdicts.path", "verdicts.rule", "verdicts.verdict").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, cases * 2))
    assert url_filter.judge(df.limit(0)).count() == 0


# ---- 6


def test_packing(docs):
    from tokenizers import Tokenizer

    texts = rows_of(docs)
    tokenizer = Tokenizer.from_file(best_fit.vocabulary_path())
    pieces = best_fit.pack(docs, best_fit.vocabulary_path(), length=64, bins=4).collect()
    ids = sorted((str(k), tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [0])) for k, t in texts)
    assert sum(r.length for r in pieces) == sum(len(x) for _, x in ids)
    bins = defaultdict(list)
    for r in pieces:
        assert len(r.ids) == 4 * r.length and r.start == 64 * r.piece and 0 < r.length <= 64
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    once = [k for k, n in Counter(k for k, _ in texts).items() if n == 1]
    for k in once:
        own = b"".join(bytes(r.ids) for r in sorted((r for r in pieces if r.doc_id == k), key=lambda r: r.piece))
        assert (str(k), tuple(np.frombuffer(own, "<u4").tolist())) in ids
    assert best_fit.pack(empty(docs), best_fit.vocabulary_path()).count() == 0


def test_small_partitions_share_a_packer(spark, docs, tmp_path):
    path = f"file://{tmp_path}/docs"
    docs.repartition(20).write.parquet(path)
    split = spark.read.parquet(path)
    pieces = best_fit.pack(split, best_fit.vocabulary_path(), length=64)
    assert pieces.count() == best_fit.pack(docs, best_fit.vocabulary_path(), length=64).count()
    assert len({r[0] >> 33 for r in pieces.select("sequence_id").collect()}) == 1
    size = sum(os.path.getsize(f"{tmp_path}/docs/{f}") for f in os.listdir(f"{tmp_path}/docs") if f.endswith(".parquet"))
    several = best_fit.pack(split, best_fit.vocabulary_path(), length=64, packer_bytes=size // 3)
    assert 1 < several.selectExpr("shiftright(sequence_id, 33) as p").distinct().count() <= 4


def test_packer_keeps_few_bins_open():
    rng = random.Random(9)
    packer, free = best_fit.Packer(0, 100, 5), {}
    for _ in range(2000):
        size = rng.randint(1, 100)
        tight = min((f for f in (packer.by_free or {}) if packer.by_free[f] and f >= size), default=None)
        sequence, offset = packer.place(size)
        assert offset == (100 - tight if tight is not None else 0)
        free[sequence] = 100 - offset - size
        assert free[sequence] >= 0 and packer.open <= 5


# ---- 7


def test_chats(spark):
    odd = ["", None, "plain", "<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\|im_end|>", "a\nb", "<|im_start|>", "<|", "|>", "<" * 5 + "|" * 5, "é" * 4000]
    rows = [(k, t, role, text, "x") for k in range(3) for t, text in enumerate(odd) for role in ("user", "assistant", None, "a%0Ab\nc", "<|im_start|>")]
    rows += [(None, None, "user", "hi", "x"), (7, 1, "user", "twice", "x"), (7, 1, "user", "twice", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat_format.format_chats(df).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        assert [(t.role, t.text) for t in got[conv].turns] == want
    assert got[7].formatted == "<|im_start|>user\ntwice<|im_end|>\n" * 2
    assert chat_format.format_chats(df.limit(0)).count() == 0


# ---- 8


def test_quality_counts(docs, monkeypatch):
    texts = rows_of(docs)

    def brute(t):
        w = words(t)
        windows = Counter(zip(w, w[1:], w[2:]))
        repeated = {i + j for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeated)

    want = sorted((str(k), *brute(t)) for k, t in texts)
    for pack in (20, 4):  # with few bits for starts the whole-hash way is taken
        monkeypatch.setattr(quality_rules, "PACK", pack)
        got = quality_rules.judge_quality(docs, keep=["doc_id"]).collect()
        assert sorted((str(r.doc_id), r.m.n_words, r.m.word_chars, r.m.n_symbols, r.m.n_dup_lines, r.m.n_repeat_words) for r in got) == want
        assert all(r.base_failed == (r.m.n_words < 50 or 100 * r.m.n_repeat_words > 50 * r.m.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality_rules.judge_quality(empty(docs)).count() == 0


def test_divergence(spark):
    p, q = [3.0, 1.0, 0.0], [1.0, 1.0, 2.0]
    a, b = np.array(p) / 4, np.array(q) / 4
    kl = lambda x, y: sum(u * math.log2(u / v) for u, v in zip(x, y, strict=True) if u > 0)
    want = math.sqrt((kl(a, (a + b) / 2) + kl(b, (a + b) / 2)) / 2)
    df = spark.createDataFrame([(p, q, [0.0, 0.0, 0.0])], "p array<double>, q array<double>, z array<double>")
    r = df.select(quality_rules.js_distance(F.col("p"), F.col("q")), quality_rules.js_distance(F.col("p"), F.col("p")), quality_rules.js_distance(F.col("p"), F.col("z"))).first()
    assert abs(r[0] - want) < 1e-12 and r[1] < 1e-7 and r[2] == 0


def test_texts_beyond_the_packing(spark, monkeypatch):
    """Such a text is sorted once, not once for each of its windows."""
    monkeypatch.setattr(quality_rules, "PACK", 6)
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(60)}" for _ in range(20_000))
    got = quality_rules.judge_quality(spark.createDataFrame([(1, text, "en")], "doc_id bigint, text string, lang string")).first()
    w = text.split()
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {p for i, g in enumerate(zip(w, w[1:], w[2:])) if seen[g] > 1 for p in (i, i + 1, i + 2)}
    assert got.m.n_repeat_words == len(covered) and got.m.n_words == 20_000


# ---- 9


def test_warc(spark):
    from kinsight.llm.common import scratch

    big, rows = "é<p>" * 500, []
    rows += [(k, f"http://x/{k}", big, "x") for k in (5, 9, 7)] + [(9, "http://x/9", big, "x"), (None, None, big, "x")]
    rows += [(20, "u\r\nX: 1%0A", "small", "x"), (21, "u", "small", "x"), (22, None, None, "x"), (23, "u", "", "x"), (24, "u", "é" * 100_000, "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string").repartition(3)
    path = scratch(spark, "warc")
    warc.write_archives(df, path)
    got = sorted((str(r.page_id), str(r.url), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, path).collect())
    want = []
    for k, u, h, _ in rows:
        body = (h or "").encode()
        again = h == big and k != 9
        want.append((str(k), str(u), len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", 9 if again else None))
    assert got == sorted(want, key=lambda x: x[:5])
    none = scratch(spark, "warc")
    warc.write_archives(df.limit(0), none)
    assert warc.read_archives(spark, none).count() == 0


def test_damaged_archives():
    import struct

    import zstandard

    raw = warc.record("response", 1, "u", b"body", None)
    good = zstandard.ZstdCompressor().compress(raw)
    assert [b for _, b in warc.records(good + warc.EMPTY_FRAME + good)] == [b"body"] * 2
    for bad in (good[:-3], b"junkjunk" + good, good + b"\1", struct.pack("<II", warc.DICTIONARY, 99), zstandard.ZstdCompressor().compress(raw[:-2]), zstandard.ZstdCompressor().compress(b"WARC/1.1\r\n\r\n\r\n\r\n")):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.records(bad))


# ---- 10


def brute_removed(texts):
    owners = defaultdict(set)
    for k, t in texts:
        w = words(t)
        for i in range(len(w) - 49):
            if k is not None:
                owners[tuple(w[i : i + 50])].add(k)
    out = []
    for k, t in texts:
        w, gone = words(t), set()
        for i in range(len(w) - 49):
            if k is not None and min(owners[tuple(w[i : i + 50])]) < k:
                gone |= set(range(i, i + 50))
        out.append((str(k), len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("shard,chunk", [(200_000, 16 << 20), (10, 2000)])
def test_substring_dedup(docs, monkeypatch, shard, chunk):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", chunk)
    profile, changed = substring_dedup.find_repeats(docs)
    gone = {(r.doc_id, r.text_hash): r for r in changed.collect()}
    got = []
    for r in profile.collect():
        c = gone.get((r.doc_id, r.text_hash))
        got.append((str(r.doc_id), r.n_words, c.n_removed if c else 0, hashlib.sha256(c.kept.encode()).hexdigest() if c else r.plain_sha256))
    want = brute_removed(rows_of(docs))
    assert sorted(got) == want and sum(x[2] for x in want) > 0
    cut = {str(r.doc_id): r.text for r in substring_dedup.remove_repeats(docs).collect()}
    assert cut["1000"] is None and len(cut) == len({x[0] for x in want})


def test_windows_are_told_apart_by_both_hashes():
    rng = np.random.default_rng(3)
    keys, checks = rng.integers(0, 3, 500), rng.integers(0, 50, 500).astype(np.int32)
    at = substring_dedup._distinct_pairs(keys, checks)
    assert sorted(zip(keys[at].tolist(), checks[at].tolist(), strict=True)) == sorted(set(zip(keys.tolist(), checks.tolist(), strict=True)))
    assert len(substring_dedup._distinct_pairs(keys[:0], checks[:0])) == 0


def test_substring_dedup_of_nothing(docs):
    assert substring_dedup.remove_repeats(empty(docs)).count() == 0
