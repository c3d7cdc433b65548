"""Every corpus operator against a brute-force version, and its defined results for odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import bpe, chat, components, jaccard, maxent, mixing, quality, sharding, suffixes, topk, toxicity
from marlstone.llm.queries import vocab_path


def words(t):
    return (t or "").encode().lower().split()


# --- 1 ---------------------------------------------------------------------------------------------------------------


def test_lm_counts_and_gain(corpus, nothing):
    df, rows = corpus
    got = {(r["doc_id"], r["n_tokens"]): r for r in maxent.score_documents(df).collect()}
    train = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2]
    c = Counter(w for r in train for w in [*words(r[1]), b""])
    n, v = sum(c.values()), len(c)
    for r in rows:
        w = [*words(r[1]), b""]
        x = got[r[0], len(w)]
        assert x["train_tokens"] == n and x["n_known"] == sum(k in c for k in w)
        assert x["base_score"] == pytest.approx(sum(math.log10((c[k] + 1) / (n + v + 1)) for k in w))
        assert x["held_out"] == (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2) and x["score"] < 0
    assert maxent.score_documents(nothing).count() == 0
    held = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2]
    none = maxent.score_documents(df.filter(maxent.held_out())).collect()  # nothing to learn from
    assert len(none) == len(held) and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and math.isfinite(r["score"]) for r in none)


def lm_vocabulary(n=9000):
    return maxent.Vocabulary([b"", *[f"w{i}".encode() for i in range(n)]], np.arange(n + 1, 0, -1), 50000, 9500, np.full(maxent.RARE, 7.0))


def wild_model(v, scale=1.0):
    m = maxent._start(v)
    rng = np.random.default_rng(1)
    for w in m.weights:
        w[:] = rng.normal(size=w.shape) * scale
    return m


def test_lm_chances_sum_to_one():
    v = lm_vocabulary()
    m = wild_model(v)
    words = [w.decode() for w in v.words[1:]] + ["zq", "zx"]
    t = maxent.tokens_of(v, ["w5 w7 " + w for w in words])
    third = np.cumsum(t.sizes) - 2
    s = m.score(t)
    hot = t.ids[third] < maxent.HOT
    total = np.exp(s[third][hot & (t.ids[third] >= 0)]).sum()
    end = m.score(maxent.tokens_of(v, ["w5 w7"]))[-1]  # the end in the same context is a hot word too
    rare = {}
    for x, g, k in zip(s[third], t.group[third], t.inner[third]):
        if g == maxent.GROUPS:
            rare[int(k)] = math.exp(x)
    # of the rare classes, some have no word here: their chance by the level's own softmax
    probe = maxent.Tokens(*(np.full(maxent.RARE, x) for x in (t.before[third[0]], t.before2[third[0]], maxent.GROUPS)), np.arange(maxent.RARE), np.zeros(maxent.RARE, int), np.zeros(maxent.RARE, bool), np.full(maxent.RARE, -1), None, np.ones(maxent.RARE))
    chance = np.exp(m.score(probe))
    assert all(rare[k] == pytest.approx(chance[k], rel=1e-5) for k in rare)
    places = maxent.HOT - 1  # w0 to w8190, and the end
    assert hot.sum() - 2 == places and total + math.exp(end) + chance.sum() == pytest.approx(1, rel=1e-4)


def test_lm_score_by_a_plain_model(spark):
    """The chance of each token by loops, from the weights."""
    v = lm_vocabulary()
    m = wild_model(v, 0.3)
    texts = ["w1 w2 W3 nowhere w8999 w1", "", "w5 " * 40, "zz top " * 20000]
    place = {w: i for i, w in enumerate(v.words)}
    one, two, mask = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, (1 << 64) - 1

    def row(context, salt, bits):
        x = (context + salt) * one & mask
        x ^= x >> 32
        return (x * two & mask) >> (64 - bits)

    def softmax(k, within, b, s, at):
        own = 0 if k == 0 else within + 1
        logit = m.biases[k].astype(float) if k == 0 else m.biases[k][within].astype(float)
        for i, x in enumerate((b, s, b * 65537 + s)):
            logit = logit + m.weights[k][row(x * 1024 + own, 8 * k + i, maxent.BITS[k])]
        return logit[at] - math.log(np.exp(logit).sum())

    import pyarrow as pa

    got = next(maxent._score(iter([pa.RecordBatch.from_arrays([pa.array(range(3)), pa.array(range(3)), pa.array(texts[:3])], names=["row", "id", "text"])]), v, m)).to_pydict()
    for i, t in enumerate(texts[:3]):
        b = s = maxent.HOT + maxent.RARE
        want = 0.0
        for w in [*t.lower().encode().split(), b""]:
            k = place.get(w, -1)
            if 0 <= k < maxent.HOT:
                g, c = k // maxent.PER_CLASS // maxent.PER_GROUP, k // maxent.PER_CLASS % maxent.PER_GROUP
                want += softmax(0, 0, b, s, g) + softmax(1, g, b, s, c) + softmax(2, k // maxent.PER_CLASS, b, s, k % maxent.PER_CLASS)
                b, s = k, b
            else:
                r = maxent.rare_class(w)
                want += softmax(0, 0, b, s, maxent.GROUPS) + softmax(1, maxent.GROUPS, b, s, r)
                want += (math.log(v.counts[k] + 1) if k >= 0 else 0.0) - math.log(v.rare_mass[r])
                b, s = maxent.HOT + r, b
        assert got["score"][i] == pytest.approx(want / math.log(10), rel=1e-4)
    assert np.isfinite(m.score(maxent.tokens_of(v, texts))).all()


def test_lm_rare_mass(spark):
    t = spark.createDataFrame([(f"w{i}".encode(), 10000 - i) for i in range(maxent.HOT + 108)], "word binary, c long")
    v = maxent._vocabulary(t)
    rest = [(w, c) for w, c in ((f"w{i}".encode(), 10000 - i) for i in range(maxent.HOT, maxent.HOT + 108))]
    want = np.ones(maxent.RARE)
    for w, c in rest:
        want[maxent.rare_class(w)] += c + 1
    assert v.rare_mass == pytest.approx(want) and len(v.words) == maxent.HOT + 108
    assert set(v.words[: maxent.HOT]) == {f"w{i}".encode() for i in range(maxent.HOT)} and v.words[maxent.HOT :] == [w for w, _ in rest]
    assert [w[::-1] for w in v.words[: maxent.HOT]] == sorted(w[::-1] for w in v.words[: maxent.HOT])
    assert all(v.counts[i] == 10000 - int(w[1:]) for i, w in enumerate(v.words))


def test_lm_words_are_those_of_split():
    import pyarrow as pa

    texts = ["", " a  B\tc\n", "É\x0bÀé\x0c\rz\x1cy\x85\xa0q", "x" * 9000, "\n \t", "A", "Ab ab aB"]
    for a in (pa.array(texts), pa.array(["zz", *texts, "yy"]).slice(1, len(texts))):
        got, sizes = maxent.words_of(a)
        want = [t.encode().lower().split() for t in texts]
        assert got.to_pylist() == [w for ws in want for w in ws] and sizes.tolist() == list(map(len, want))
        assert maxent.rare_classes(got).tolist() == [maxent.rare_class(w) for ws in want for w in ws]
        assert maxent.rare_classes(got.slice(2, 3)).tolist() == [maxent.rare_class(w) for w in got.to_pylist()[2:5]]


def test_lm_run_sums():
    rng = np.random.default_rng(4)
    grad = rng.normal(size=(500, 7)).astype(np.float32)
    for lengths in ([1], [3, 1, 1], [2000, 1, 16, 17, 300, 5], rng.integers(1, 60, 200)):
        order = rng.integers(0, 500, int(np.sum(lengths)))
        start = np.cumsum(lengths) - lengths
        want = np.stack([grad[order[a : a + n]].astype(float).sum(0) for a, n in zip(start, lengths)])
        assert maxent.run_sums(grad, order, start) == pytest.approx(want, abs=1e-4)


def test_lm_learns_what_only_the_two_words_together_say():
    v = lm_vocabulary()
    rng = random.Random(2)
    texts = []
    for _ in range(4000):
        a, b = rng.choice(["w1", "w2"]), rng.choice(["w1", "w2"])
        texts.append(f"{a} {b} {'w1000' if a == b else 'w6000'}")  # neither word alone says which
    t = maxent.tokens_of(v, texts)
    trainer = maxent.Trainer(maxent._start(v))
    for _ in range(150):
        trainer.step(*t.part(0, len(t.ids)))
    assert np.exp(trainer.m.score(t)[2::4]).mean() > 0.9


# --- 2 ---------------------------------------------------------------------------------------------------------------


def test_mixing_keeps_all_within_the_limit(corpus, nothing):
    df, rows = corpus
    out = mixing.mixture(df, flatten=0.5, max_passes=2.0).collect()
    assert Counter((r["doc_id"], r["source"], r["n_tokens"]) for r in out if r["mix_pass"] == 0) == Counter((r[0], r[3], len(words(r[1]))) for r in rows)
    assert max(r["mix_passes"] for r in out) <= 2 + 1e-9 and max(r["mix_pass"] for r in out) <= 2
    tokens, took, passes = Counter(), Counter(), {}
    for r in rows:
        tokens[r[3]] += len(words(r[1]))
    for r in out:
        took[r["source"]] += r["n_tokens"]
        passes[r["source"]] = r["mix_passes"]
    for s in tokens:
        assert took[s] >= math.floor(passes[s] * tokens[s]) - 1  # the budget, and less than one row beyond it
    assert mixing.mixture(nothing).count() == 0
    with pytest.raises(ValueError):
        mixing.mixture(df.withColumn("n_tokens", F.lit(1)), keep=["doc_id", "n_tokens"])


def test_mixing_meets_entropy_and_budget(spark):
    rows = [(i, "a " * 10, "big" if i < 800 else f"s{i % 4}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixture(df, flatten=0.5, max_passes=None, budget=5000).collect()
    w = {r["source"]: r["mix_weight"] for r in out}
    p = np.array([0.8, 0.05, 0.05, 0.05, 0.05])
    h = lambda q: -(np.array(q) * np.log(q)).sum()
    assert h(list(w.values())) == pytest.approx(h(p) + 0.5 * (math.log(5) - h(p)), abs=1e-6)
    assert sum(r["n_tokens"] for r in out) == pytest.approx(5000, abs=5 * 10)


# --- 3 ---------------------------------------------------------------------------------------------------------------


def brute_classes(rows, n, percent):
    sets = [frozenset() if not (w := words(t)) else frozenset([tuple(w)] if len(w) < n else [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return Counter((d, len(sets[i]), (min(least[find(i)], default=None) if sets[i] else d)) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("n,percent,tile", [(3, 90, 1024), (1, 50, 2)])
def test_jaccard_is_exact(corpus, nothing, monkeypatch, n, percent, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    df, rows = corpus
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(df, n, percent).collect())
    assert got == brute_classes([r[:2] for r in rows], n, percent)
    assert jaccard.jaccard_classes(nothing, n, percent).count() == 0


def chained(rng, count=150):
    """Texts that share frequent passages in chains, near copies of some at all degrees, unlike sizes, null ids."""
    passages = [prose_words(rng, 12) for _ in range(12)]
    rows = []
    for i in range(count):
        w = passages[i % 12] + passages[(i + 1) % 12] + prose_words(rng, rng.randint(2, 30))
        rows.append((i, " ".join(w)))
        if i % 3 == 0:
            for k in range(rng.randint(1, 4)):
                v = list(w)
                for _ in range(k):
                    v[rng.randrange(len(v))] = f"x{rng.randrange(9)}"
                rows.append((1000 + len(rows) if rng.random() < 0.8 else None, " ".join(v + w[: rng.randint(0, 8)])))
    return rows


def prose_words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


@pytest.mark.parametrize("n,percent,tile", [(5, 80, 4), (2, 55, 1024)])
def test_jaccard_where_frequent_keys_chain_all_texts(spark, monkeypatch, n, percent, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "FEW", 4)
    monkeypatch.setattr(jaccard, "LOCAL", 3)  # keys of three sets of a batch go to all tasks
    rows = chained(random.Random(n))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(df, n, percent).collect())
    assert got == brute_classes(rows, n, percent)


def test_jaccard_is_exact_with_few_pairs_of_leaders(spark, monkeypatch):
    """A class meets NEAREST leaders at most, a round that connects little is the last, and tiles find the other links."""
    monkeypatch.setattr(jaccard, "FEW", 4)
    monkeypatch.setattr(jaccard, "LOCAL", 3)
    monkeypatch.setattr(jaccard, "NEAREST", 1)
    monkeypatch.setattr(jaccard, "WORTH", 0)
    asked, real = [], jaccard._Join.possible
    monkeypatch.setattr(jaccard._Join, "possible", lambda self, pairs, texts: asked.append([r["b"] for r in pairs.collect()]) or real(self, pairs, texts))
    rows = chained(random.Random(8))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(df, 5, 80).collect())
    assert got == brute_classes(rows, 5, 80)
    assert len(asked) == 2 and asked[0] and max(Counter(asked[0]).values()) == 1


def test_jaccard_dense_group_asks_the_nearest_first(spark, monkeypatch):
    """Of near copies that leaders leave apart, pairs grow with the classes, not with their square, and no link is lost."""
    monkeypatch.setattr(jaccard, "NEAREST", 1)
    monkeypatch.setattr(jaccard, "STARS", 1)
    asked, real = [], jaccard._Join.verify
    monkeypatch.setattr(jaccard._Join, "verify", lambda self, pairs, texts: asked.append(pairs.count()) or real(self, pairs, texts))
    made, compared = [], jaccard._Join.compared
    monkeypatch.setattr(jaccard._Join, "compared", lambda self, tiles, texts, first: made.append((first, (rows := compared(self, tiles, texts, first)).count())) or rows)
    rng = random.Random(4)
    base, rows = prose_words(rng, 150), []
    for i in range(240):
        w = list(base)
        for k in rng.sample(range(len(w)), 3):
            w[k] = f"x{i}y{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(df, 5, 80).collect())
    assert got == brute_classes(rows, 5, 80)
    assert sum(asked) <= 4 * len(rows), (asked, made)
    assert made[0][0] and made[0][1] and not made[-1][0], made


@pytest.mark.parametrize("cross", [False, True])
def test_jaccard_nearest_partners_of_a_tile(cross):
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**63, 100, dtype=np.uint64))
    sets = [np.unique(np.concatenate((base[: 100 - k % 7], rng.integers(0, 2**63, k % 5, dtype=np.uint64)))) for k in range(60)]
    n = np.array([len(x) for x in sets])
    root, block, prior = (np.array([f(k) for k in range(60)]) for f in (lambda k: 0 if k < 30 else k - k % 3, lambda k: k % 2, lambda k: k % 4 == 0))
    sigs = [jaccard.parity(x, 2048) for x in sets]
    want = defaultdict(dict)
    for i in range(60):
        for j in range(60):
            apart = int(np.bitwise_count(sigs[i] ^ sigs[j]).sum())
            if root[i] != root[j] and not (prior[i] and prior[j]) and not (cross and block[i] == block[j]) and jaccard.near_size(n[i], n[j], 90) and jaccard.may_link(n[i], n[j], apart, 90):
                want[i][j] = jaccard.most_alike(n[i], n[j], apart)
    pairs = list(jaccard.tile_pairs(n, root, sigs, 90, block if cross else None, prior))
    assert {(i, int(j)) for i, js, _ in pairs for j in js} | {(int(j), i) for i, js, _ in pairs for j in js} == {(i, j) for i in want for j in want[i]}
    got = {i: (m, a, o, met) for i, m, a, o, met in zip(*(x.tolist() for x in jaccard.nearest(iter(pairs), root)))}
    assert set(got) == {i for i in want if root[i]}
    for i, (mate, alike, others, met) in got.items():
        assert want[i][mate] == alike == max(want[i].values()) and others == len(want[i])
        assert met == (0 if any(root[j] == 0 for j in want[i]) else root[i])


def test_jaccard_keys_with_the_same_classes_are_one_tile(spark):
    sets = {1: [10, 20], 2: [10, 20], 3: [10, 30], 4: [10, 20, 30], 5: [40, 50], 6: [20, 20, 20, 30], 7: [10, 10, 20, 30], 8: [30, 10, 20]}
    tiles = spark.createDataFrame([(k, c, 9) for k, cs in sets.items() for c in cs], "key long, cls long, n long")
    links = spark.createDataFrame([(40, 50)], "a long, b long")
    got = defaultdict(list)
    for r in jaccard._Join.open_tiles(None, tiles, links).collect():
        got[r["key"]].append((r["cls"], r["size"], r["root"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted((c, len(sets[k]), c) for c in sets[k]) for k in (1, 3, 4, 6, 7)}


def test_jaccard_names_that_collide(corpus, monkeypatch):
    df, rows = corpus
    real = jaccard.class_of
    monkeypatch.setattr(jaccard, "class_of", lambda h, salt=0: (real(h, salt)[0] % 7 + 1 if salt == 0 and len(h) else real(h, salt)[0], real(h, salt)[1]))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(df, 3, 90).collect())
    assert got == brute_classes([r[:2] for r in rows], 3, 90)


def test_jaccard_ids_are_integers(spark):
    with pytest.raises(TypeError):
        jaccard.jaccard_classes(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(2)
    for percent in (50, 60, 80, 90):
        for k in range(300):
            s = int(rng.integers(2, 120))
            a = np.unique(rng.integers(0, 2**63, s, dtype=np.uint64) * np.uint64(2))
            drop = int(rng.integers(0, len(a) * (100 - percent) // 100 + 1))
            more = int(rng.integers(0, len(a) * (100 - percent) // 100 + 1)) if k % 2 else 0  # every other pair: one set within the other
            b = np.unique(np.concatenate((rng.permutation(a)[: len(a) - drop], rng.integers(0, 2**63, more, dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            if both and 100 * both >= percent * (len(a) + len(b) - both) and len(a) + len(b) > 2 * both:
                assert set(jaccard.candidate_keys(a, percent)) & set(jaccard.candidate_keys(b, percent))
                for bits in (64, 256):
                    apart = int(np.bitwise_count(jaccard.parity(a, bits) ^ jaccard.parity(b, bits)).sum())
                    assert apart <= len(a) + len(b) - 2 * both and jaccard.may_link(len(a), len(b), apart, percent) and jaccard.near_size(len(a), len(b), percent)


def test_one_row_of_each_component(spark, nothing):
    a, b = (" ".join(prose_words(random.Random(k), 30)) for k in (1, 2))
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (1, a, "y"), (None, a, "x"), (None, b + " more", "z"), (3, "", "e"), (3, "", "e"), (4, None, "e"), (None, None, "e"), (7, "alone", "q"), (None, "nobody", "q"), (None, "nobody", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(3)
    got = Counter((r["doc_id"], r["text"]) for r in jaccard.one_of_each(df).collect())
    assert got == Counter([(1, a), (2, b), (3, ""), (3, ""), (4, None), (None, None), (7, "alone"), (None, "nobody")])
    assert jaccard.one_of_each(nothing).count() == 0 and jaccard.one_of_each(nothing).columns == nothing.columns


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {(r["node"], r["root"]) for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {(x, find(x)) for e in edges if e[0] != e[1] for x in e}


# --- 4 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("length,seed", [(50, 16), (8, 3), (12, 12)])
def test_repeats_are_exact(corpus, nothing, length, seed):
    df, rows = corpus
    got = Counter((r["doc_id"], r["n_words"], r["n_cut_words"], r["cut_text"]) for r in suffixes.cut_repeats(df, length, seed).collect())
    seen, want = set(), {}
    for d, t in sorted({r[:2] for r in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        w = words(t)
        cut = set()
        for k in range(len(w) - length + 1):
            g = tuple(w[k : k + length])
            if g in seen:
                cut |= set(range(k, k + length))
            seen.add(g)
        want[d, t] = cut
    out = Counter()
    for r in rows:
        cut = want[r[:2]]
        w = words(r[1])
        spans = suffixes.joined([(k, k + 1) for k in sorted(cut)])
        out[r[0], len(w), len(cut), None if r[1] is None else suffixes.cut_words(r[1], spans)] += 1
    assert got == out
    assert suffixes.cut_repeats(nothing).count() == 0


def test_cut_words():
    assert suffixes.cut_words(" a b\nc  d ", [(1, 3)]) == " a d "
    assert suffixes.cut_words("a b", [(0, 2)]) == ""


@pytest.mark.parametrize("ident", [5, None])
@pytest.mark.parametrize("parts", [1, 3])
def test_repeated_rows_keep_the_first_of_a_shared_passage(spark, ident, parts):
    shared = " ".join(f"p{i}" for i in range(50))
    rows = [(ident, f"one {shared} two"), (ident, f"one {shared} two"), (9 if ident else None, f"{shared} three")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = Counter((r["doc_id"], r["text"], r["n_cut_words"]) for r in suffixes.cut_repeats(df).collect())
    assert sum(n for (_, _, cut), n in got.items() if cut == 50) in ((1,) if ident else (1, 2))
    assert any(cut == 0 and shared in t for _, t, cut in got)
    if ident:
        assert got == Counter({(5, rows[0][1], 0): 2, (9, rows[2][1], 50): 1})


def test_suffixes_are_compared_word_by_word(spark, monkeypatch):
    """Seeds that collide by a poor hash don't make texts equal; passages that nest and overlap are found whole."""
    real = suffixes.windows
    monkeypatch.setattr(suffixes, "windows", lambda h, n: real(h, n) % np.uint64(5))
    rng = random.Random(3)
    p = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(60):
        a, b = sorted((rng.randrange(40), rng.randrange(41)))
        rows.append((rng.randrange(40) if i % 9 else None, " ".join([f"u{i}", *p[a:b], f"v{rng.randrange(3)}", *p[: rng.randrange(12)]])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = Counter((r["doc_id"], r["text"], r["n_cut_words"]) for r in suffixes.cut_repeats(df, 8, 3).collect())
    seen, want = set(), Counter()
    texts = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    ties = Counter(r[0] for r in texts)
    for d, t in texts:
        w, cut = words(t), set()
        for k in range(len(w) - 7):
            g = tuple(w[k : k + 8])
            cut |= set(range(k, k + 8)) if g in seen else set()
            seen.add(g)
        if ties[d] == 1:
            want[d, t] = len(cut)
    for (d, t), n in want.items():  # where one id has several texts, their order is by hash
        if all(ties[x] == 1 for x, _ in texts if x is not None and d is not None and x <= d):
            assert got[d, t, n] == rows.count((d, t))
    assert got == Counter((r["doc_id"], r["text"], r["n_cut_words"]) for r in suffixes.cut_repeats(df.coalesce(1), 8, 3).collect())


def test_later_windows():
    rng = np.random.default_rng(6)
    words = rng.integers(1, 3, (200, 9)).astype(np.uint64)
    most, least, rank = rng.integers(0, 5, 200), np.zeros(200, int), rng.permutation(200)
    for offset, rows, later in suffixes.later_windows(words, most, least, rank, 4):
        run = {i: tuple(words[i, 4 - offset : 9 - offset]) for i in rows}
        assert set(rows) == {i for i in range(200) if most[i] >= offset}
        assert [bool(x) for x in later] == [any(run[j] == run[i] and rank[j] < rank[i] for j in rows) for i in rows]


# --- 5 ---------------------------------------------------------------------------------------------------------------


def brute_counts(t):
    w = [x for x in (t or "").encode().split()]
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    cover = {j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover)


def test_quality_counts(corpus, nothing):
    df, rows = corpus
    got = Counter(tuple(r) for r in quality.weak_quality(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = Counter()
    for r in rows:
        c = brute_counts(r[1])
        want[(r[0], *c, c[0] < 10 or 100 * c[4] > 20 * c[0])] += 1
    assert got == want
    assert quality.weak_quality(nothing).count() == 0


def test_repeat_words_without_hashes():
    rng = np.random.default_rng(3)
    for hi in (3, 50, 10**6):
        ids = rng.integers(0, hi, 400)
        ids[200:220] = ids[10:30]
        t = " ".join(map(str, ids))
        assert quality.repeat_words(ids) == brute_counts(t)[4]


def plain_estimate(patterns):
    """The label model again, by loops: {pattern: times} -> {pattern: posterior}."""
    rules = range(len(next(iter(patterns))))
    post = {p: (p.count(1) + 1) / (p.count(1) + p.count(-1) + 2) for p in patterns}
    for _ in range(400):
        share = (sum(n * post[p] for p, n in patterns.items()) + 4) / (sum(patterns.values()) + 5)
        acc = {}
        for r in rules:
            for good, (right, wrong) in ((1, (8.0, 2.0)), (0, (2.0, 2.0))):
                for p, n in patterns.items():
                    w = n * (post[p] if good else 1 - post[p])
                    if p[r] == (1 if good else -1):
                        right += w
                    elif p[r]:
                        wrong += w
                acc[good, r] = right / (right + wrong)
        for p in patterns:
            odds = [share, 1 - share]
            for r in rules:
                if p[r]:
                    odds[0] *= acc[1, r] if p[r] == 1 else 1 - acc[1, r]
                    odds[1] *= acc[0, r] if p[r] == -1 else 1 - acc[0, r]
            post[p] = odds[0] / sum(odds)
    return post


def test_an_accurate_rule_outvotes_a_noisy_one():
    rng = random.Random(8)
    patterns = Counter()
    for _ in range(6000):
        good = rng.random() < 0.7
        patterns[tuple((1 if good else -1) * (1 if rng.random() < right else -1) if rng.random() < 0.9 else 0 for right in (0.97, 0.95, 0.93, 0.55, 0.55))] += 1
    votes, times = np.array(list(patterns)), np.array(list(patterns.values()), float)
    share, accuracy, post = quality.estimate(votes, times)
    assert share == pytest.approx(0.7, abs=0.05) and accuracy[:, 0].min() > 0.9 and accuracy[:, 3:].max() < 0.7
    by = dict(zip(patterns, post))
    assert by[1, 1, 1, -1, -1] > 0.9 and by[-1, -1, -1, 1, 1] < 0.1  # the noisy are outvoted
    assert by[1, 0, 0, -1, -1] > 0.5 if (1, 0, 0, -1, -1) in by else True  # even two of them by one
    want = plain_estimate(patterns)
    for p, x in by.items():
        assert x == pytest.approx(want[p], abs=1e-4)


def test_quality_verdicts_are_those_of_the_label_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = quality.weak_quality(docs).collect()
    votes = lambda r: tuple(r[f"vote_{k}"] for k in quality.RULES)
    want = plain_estimate(Counter(map(votes, out)))
    all_pass = 0
    for r in out:
        assert r["posterior"] == pytest.approx(want[votes(r)], abs=1e-4)
        assert r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)
        all_pass += r["kept"] != (not r["base_failed"] and -1 not in votes(r))
    assert all_pass > 0  # the verdict isn't that all must pass
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(labels[r["doc_id"]], r["kept"], -1 not in votes(r) and not r["base_failed"]) for r in out if labels.get(r["doc_id"]) is not None]
    assert sum(x == k for x, k, _ in held) > sum(x == p for x, _, p in held) and not any(k for x, k, _ in held if x == 0)


def test_quality_of_null_and_odd_texts(spark):
    rows = [(None, None), (1, None), (2, ""), (3, "word " * 9), (3, "word " * 9)]
    out = quality.weak_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 5 and all(r["base_failed"] and not r["kept"] and 0 <= r["posterior"] <= 1 for r in out)


# --- 6 ---------------------------------------------------------------------------------------------------------------


def test_bpe_is_the_library(spark, corpus, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocab_path())
    t.no_truncation()
    t.no_padding()
    df, rows = corpus
    odd = ["<|endoftext|>a<|startoftext|> <|x", "ΣΑΣ Σ İI ﬁ é", "we'LL don't 'sx's", "12½ ²³ ١٢", "漢字 かな 한국어 \U0001f600‍", "a\x1cb\x1dc", "z" * 300 + "!?" * 80, " x\u0085y", "thing. thing, (thing)"]
    extra = spark.createDataFrame([(1000 + i, x) for i, x in enumerate(odd)], "doc_id long, text string")
    got = Counter(tuple(r) for r in bpe.bpe_digests(df.select("doc_id", "text").unionByName(extra), vocab_path()).collect())
    want = Counter()
    for d, x in [*[r[:2] for r in rows], *[(1000 + i, x) for i, x in enumerate(odd)]]:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want
    assert bpe.bpe_digests(nothing, vocab_path()).count() == 0
    back = bpe.bpe_decode(bpe.bpe_encode(extra, vocab_path()), vocab_path()).filter("doc_id = 1008").first()
    assert back["decoded"] == "thing</w> .</w> thing</w> ,</w> (</w> thing</w> )</w>"
    with pytest.raises(ValueError):
        bpe.bpe_encode(df.withColumn("ids", F.lit(1)), vocab_path())


def test_one_tree_and_many_agree():
    v = bpe.Vocabulary(open(vocab_path(), "rb").read())
    rng = random.Random(4)
    ws = ["".join(rng.choice("aeinrstlo") for _ in range(rng.randint(1, 16))).encode() for _ in range(400)]
    ids, at = bpe.merge_many(v, ws, 16)
    for k, w in enumerate(ws):
        assert np.frombuffer(ids[at[k] : at[k + 1]], "<u4").tolist() == bpe.SegmentTree(v, v.symbols(w)).merge_all()


# --- 7 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shard_rows", [20, 10_000])
def test_top_k_is_exact(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(topk, "LEAST_ROWS", 20)
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(150)] + [(200 + i, [0.5] * 6) for i in range(60)]
    rows += [(300, None), (301, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (302, [math.nan] * 6), (303, [math.inf] * 6), (304, [1.0, 2.0]), (None, [1.0] * 6), (50, [9.0] * 6), (50, [9.0] * 6), (350, [3e8] * 6), (400, []), (450, [1e305, 0.0, 1e305, 0.0, 1e305, 1e305]), (500, [-1.7e308] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter(tuple(r) for r in topk.exact_top_k(df, F.pmod("vec_id", F.lit(50)) == 0, 5, shard_rows=shard_rows).collect())
    ok = [(i, [math.floor(Fraction(256) * Fraction(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = Counter()
    for a, (i, v) in enumerate(ok):
        if i % 50 == 0:
            best = sorted((-min(max(sum(x * y for x, y in zip(v, w)), -(2**63)), 2**63 - 1), j) for b, (j, w) in enumerate(ok) if b != a and len(w) == len(v))[:5]
            want.update((i, k + 1, j, -s) for k, (s, j) in enumerate(best))
    assert got == want
    assert topk.exact_top_k(df.limit(0), F.lit(True)).count() == 0


# --- 8 ---------------------------------------------------------------------------------------------------------------


def test_shards_are_even_and_keep_groups(corpus, nothing):
    df, rows = corpus
    out = sharding.balanced_shards(df, 8).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    n = Counter(r["shard"] for r in out)
    assert max(n.values()) - min(n.values()) <= 1 and set(n) <= set(range(8)) and len(n) == 8
    for s in n:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n[s]))
    where = defaultdict(set)
    for r in out:
        if r["group_rows"] > 1:
            where[r["size"], r["text_crc32"]].add(r["shard"])
    assert sum(len(v) > 1 for v in where.values()) <= 1
    assert {r["law"] for r in out} == {"rows"} and {r["grown_shard"] for r in out} == {None}
    assert sharding.balanced_shards(nothing).count() == 0


def test_a_group_larger_than_a_shard(spark):
    df = spark.createDataFrame([(i, "same" if i < 60 else f"t{i}") for i in range(100)], "doc_id long, text string")
    n = Counter(r["shard"] for r in sharding.balanced_shards(df, 4).collect())
    assert sorted(n.values()) == [25] * 4


def test_a_hot_group_fills_shards_one_after_the_other(spark):
    rows = [(i, "hot" if i < 160 else f"g{i // 4}" if i < 320 else f"t{i}") for i in range(480)]
    out = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    n = Counter(r["shard"] for r in out)
    assert sorted(n.values()) == [60] * 8
    texts = dict(rows)
    at = defaultdict(Counter)
    for r in out:
        at[texts[r["doc_id"]]][r["shard"]] += 1
    assert sum(sorted(at["hot"].values())[-4:]) >= 150, at["hot"]  # three shards would do, but that small groups hold their places
    assert sum(len(v) > 1 for k, v in at.items() if k[0] == "g") <= 4


# --- 9 ---------------------------------------------------------------------------------------------------------------


def test_preferences(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "ok"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"),
            (2, 0, "user", "q"), (3, 0, "user", "q"), (3, 1, "assistant", "a"), (4, 0, None, None), (5, 0, None, None), (6, 0, "user", "alone"), (None, 0, "user", "x"),
            (8, 1, "assistant", "b"), (8, 1, "assistant", "b"), (9, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pair_id", F.lit("clash"))
    out = {r["pair_id"]: r for r in chat.preference_pairs(df, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0).collect()}
    assert set(out) == {0, 1, 2, 4}
    a = out[0]
    assert a["n_prompt_turns"] == 1 and a["prompt"] == "<|user|>\nhi<|end|>\n" and a["rejected"] == "<|assistant|>\nno<|end|>\n"
    assert [a["chosen"][s["start"] : s["end"]] for s in a["chosen_spans"]] == ["yes<|end|>"]
    assert out[1]["chosen"] == "" and out[1]["n_prompt_turns"] == 1 and out[1]["rejected"] != ""
    assert out[2]["chosen"] == out[2]["rejected"] == "" and out[2]["n_prompt_turns"] == 1
    assert out[4]["n_prompt_turns"] == 1 and out[4]["rejected"] == "" and len(out[4]["chosen_spans"]) == 1
    assert chat.preference_pairs(df.limit(0), F.col("conv_id"), F.lit(True)).count() == 0


# --- 10 --------------------------------------------------------------------------------------------------------------


def distance(a, b):
    """Edits with swaps of neighbours."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_is_the_edit_distance():
    terms = {t: 1.0 for t in ("idiot", "moron", "scum", "disgustingly", "worthless")}
    auto = toxicity.LexiconAutomaton(terms, {"lowei": 1.0}, set(terms))
    rng = random.Random(6)
    for _ in range(3000):
        w = list(rng.choice(list(terms)))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w))
            rng.choice([lambda: w.insert(k, rng.choice("aeixz")), lambda: w.pop(k) if len(w) > 1 else None, lambda: w.__setitem__(k, rng.choice("aeixz")), lambda: w.__setitem__(slice(k, k + 2), w[k : k + 2][::-1])])()
        w = "".join(w)
        near = [t for t in terms if distance(w, t) <= toxicity.edits_allowed(t)]
        hit = auto.find(w)
        assert (hit is not None) == bool(near), w
        if hit:
            assert hit[1] == min(distance(w, t) for t in near)
    assert auto.find("loweischaft") == ("lowei*", 0)


def test_toxicity_learns_and_scores(spark, nothing, corpus):
    rng = random.Random(9)
    from conftest import prose

    rows = []
    for i in range(600):
        w = prose(rng, 40).split()
        if i % 5 == 0:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(["skunkface", "blockhead"])
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    docs = spark.createDataFrame([(*r[:2], 1) for r in rows] + [(9000, "", 1), (None, None, 1), (9001, "you skunkfcae blockhaed blockheed", 1), (9001, "calm words here", 1)], "doc_id long, text string, held_out int")
    labels = spark.createDataFrame([(r[0], r[2], "z") for r in rows] + [(None, 1, "z"), (9000, None, "z")], "doc_id long, toxic int, score string")
    out = toxicity.toxicity(docs, labels).collect()
    truth = {r[0]: r[2] for r in rows}
    assert len(out) == 604 and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["predicted"] == truth[r["doc_id"]] for r in out if r["doc_id"] in truth)
    assert sorted(r["predicted"] for r in out if r["doc_id"] == 9001) == [0, 1]
    assert {r["doc_id"]: r["held_out"] for r in out if r["doc_id"] in truth} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in truth}
    m = toxicity.toxicity_model(docs, labels)
    assert m.score("you blockhead") > m.score('he said "blockhead" again')
    assert toxicity.toxicity(corpus[0], labels.limit(0)).filter("predicted = 1").count() == 0
    assert toxicity.toxicity(docs.select("doc_id", "text").limit(0), labels).count() == 0


def toxic_rows():
    from conftest import prose

    rng = random.Random(19)
    bad = ["skunkface", "blockhead", "grubworm", "vilehearted", "vilehanded", "vilemouthed"]
    rows = []
    for i in range(240):
        w = prose(rng, 30).split()
        if i % 3 == 0:
            for k in rng.sample(range(30), 4):
                w[k] = rng.choice(bad)
        if i % 20 == 1:
            w[5:8] = ["he", "said", rng.choice(bad)]
        if i % 20 == 2:
            w[5] = f'"{rng.choice(bad)}"'
        if i % 20 == 4:
            w[3] = "blokchead"
        if i % 7 == 0:
            w[9] = "blockheat"  # with the misspelling above, two natural words beside a term
        if i % 11 == 0:
            w[12:15] = ["grubworn", "grubwort", "grabworm"]  # three: the term is matched as it is only
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    return rows + [(900, rows[0][1], 1), (901, rows[0][1], 1)]


def plain_toxicity(rows):
    """The whole model and its scores by loops over texts and edit distances."""
    bare, px = toxicity.bare, toxicity.PREFIXES
    seen = {(t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    size = {x: sum(len(t) for t, y in seen if y == x) for x in (0, 1)}
    share = size[1] / sum(size.values())
    settings, texts = defaultdict(set), Counter()
    for t, x in seen:
        w = [bare(k) for k in t.lower().split()]
        for i, k in enumerate(w):
            if len(k) >= 3:
                settings[k].add((x, w[i - 1] if i else "", w[i + 1] if i + 1 < len(w) else ""))
        if x:
            own = {k for k in w if len(k) >= 3}
            texts.update(own | {k[:p] + "*" for k in own for p in px if len(k) > p})
    count = {k: [sum(s[0] == x for s in v) for x in (1, 0)] for k, v in settings.items()}
    most = defaultdict(int)
    for k in list(count):
        for p in px:
            if len(k) > p:
                c = count.setdefault(k[:p] + "*", [0, 0])
                c[0] += count[k][0]
                c[1] += count[k][1]
                most[k[:p] + "*"] = max(most[k[:p] + "*"], count[k][0])
    weight = {}
    for k, (a, c) in count.items():
        if a and a >= 9 * c and texts[k] >= toxicity.MIN_TEXTS:
            if 2 * (a * math.log(a / ((a + c) * share)) + (c * math.log(c / ((a + c) * (1 - share + 1e-9))) if c else 0)) >= 20:
                weight[k] = min(8.0, math.log((a + 0.5) / (c + 0.5) * (1 - share + 1e-9) / share))
    terms = {k: w for k, w in weight.items() if k[-1] != "*"}
    openings = {k[:-1]: w for k, w in weight.items() if k[-1] == "*" and count[k][0] >= 2 * most[k]}
    fuzzy = {t for t in terms if toxicity.edits_allowed(t)}

    def nearest(w):
        if any(w.startswith(o) for o in openings):
            return None
        if w in terms:
            return None
        near = sorted((distance(w, t), t) for t in fuzzy if abs(len(t) - len(w)) <= 2 and distance(w, t) <= toxicity.edits_allowed(t))
        return near[0][1] if near else None

    natural = {k for k, v in settings.items() if any(s[0] == 0 for s in v)}
    while True:
        around = defaultdict(set)
        for w in natural:
            if (t := nearest(w)) is not None:
                around[t].add(w)
        gone = {t for t, ws in around.items() if len(ws) > toxicity.MAX_AROUND}
        if not gone:
            break
        fuzzy -= gone
    exceptions = set().union(*around.values()) if around else set()

    def feature(text):
        w = text.lower().split()
        total = 0.0
        for i, token in enumerate(w):
            k = bare(token)
            start = [o for o in openings if k.startswith(o)]
            if start:
                x = openings[min(start, key=len)]
            elif k in terms:
                x = terms[k]
            elif k and k not in exceptions and (t := nearest(k)) is not None:
                x = terms[t] * toxicity.MISSPELT
            else:
                continue
            total += x * (toxicity.QUOTED if toxicity.quoted(w, i) else 1.0)
        return math.log1p(total)

    data = sorted((x, feature(t)) for t, x in seen)
    coef = toxicity._fit_logistic(np.array([[f] for _, f in data]), np.array([float(x) for x, _ in data]))
    return terms, openings, fuzzy, exceptions, lambda t: 1 / (1 + math.exp(-coef[0] - coef[1] * feature(t)))


def test_toxicity_whatever_the_layout_and_by_brute_force(spark):
    rows = toxic_rows()
    extra = [(2000, "he said you blockhaed and skunkfaec"), (2001, "grubwom " * 3000 + "calm"), (2002, "x" * 20000), (2003, "blockheat vilething")]
    docs = spark.createDataFrame([r[:2] for r in rows] + extra, "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    models = [toxicity.toxicity_model(docs.repartition(k) if k > 1 else docs.coalesce(1), labels) for k in (1, 37)]
    assert models[0] == models[1]
    m = models[0]
    terms, openings, fuzzy, exceptions, score = plain_toxicity(rows)
    assert m.terms == pytest.approx(terms) and m.prefixes == pytest.approx(openings) and m.fuzzy == fuzzy and m.exceptions == exceptions
    assert "vile" in openings and "grubworm" in terms and "grubworm" not in fuzzy and "blockheat" in exceptions and "blockhead" in fuzzy
    out = toxicity.toxicity(docs.repartition(5), labels).collect()
    texts = dict([r[:2] for r in rows] + extra)
    for r in out:
        assert r["score"] == pytest.approx(score(texts[r["doc_id"]]), abs=1e-6) and r["predicted"] == int(r["score"] >= 0.7)
    assert toxicity.toxicity(docs, labels, threshold=out[0]["score"]).filter(F.col("doc_id") == out[0]["doc_id"]).first()["predicted"] == 1  # a tie counts
