"""Operators for training text: brute-force versions on small tables, hard rows, and empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framewright.llm import bytewords, chosen_path, context_tree, decontamination, mixing, quality_classifier, quality_rules, sharding, substring_dedup, toxicity, url_filter

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPLIT.findall(text or "")


def made_up(seed, n, vocabulary=300, size=(1, 120)):
    """Texts with copies, near copies and shared passages."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, vocabulary)}"
    passage = [word() for _ in range(30)]
    out = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(*size))]
        if i and rng.random() < 0.4:
            w = list(rng.choice(out))
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
        if rng.random() < 0.2:
            at = rng.randint(0, len(w))
            w[at:at] = passage
        out.append(w)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def collected(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# words


def test_words_and_hashes():
    texts = ["a b  c", None, "", " \t", "É\u00a0x\u2028y z", "ab" * 3000, "a\nb"]
    h, first = bytewords.words(pa.array(texts))
    assert np.diff(first).tolist() == [len(words(t)) for t in texts]
    seen = collections.defaultdict(set)
    for t, lo, hi in zip(texts, first[:-1], first[1:], strict=True):
        for w, x in zip(words(t), h[lo:hi].tolist(), strict=True):
            seen[w].add(x)
    assert all(len(x) == 1 for x in seen.values()) and len(set.union(*seen.values())) == len(seen)
    many = [f"{i}" for i in range(50_000)]
    h, _ = bytewords.words(pa.array([" ".join(many[:25_000]), " ".join(many[25_000:])]))
    assert len(set(h.tolist())) == len(many)
    low, _ = bytewords.words(pa.array(["ABC-dÉ"]), bytewords.ALNUM, lower=True)
    assert low.tolist() == bytewords.words(pa.array(["abc dÉ"]), bytewords.ALNUM)[0].tolist()


# 1


def brute_dedup(rows, width):
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            first[k] = min(first.get(k, math.inf), math.inf if i is None else i)
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < (math.inf if i is None else i):
                gone.update(range(p, p + width))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 2000, "block_cells": 512}])
def test_substring_dedup(docs, options):
    rows = made_up(1, 120)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(docs(rows), **options).collect()]
    assert sorted(got) == sorted(brute_dedup(rows, 13))


def test_a_window_in_every_document_is_one_entry_a_chunk(spark, docs, monkeypatch):
    """Rows that the exact pass groups: no more for a chunk than it has different windows, however often they occur."""
    common = " ".join(f"c{k}" for k in range(13))
    rows = [(i, f"a{i} {common} b{i} {common} {common}") for i in range(400)] + [(None, common)] * 50
    asked = []
    kind = type(docs(rows))
    plain = kind.groupBy

    def spied(df, *keys):  # what is grouped by block are the messages of the sketch, then those of the exact pass
        if keys == ("block",):
            asked.append(df)
        return plain(df, *keys)

    monkeypatch.setattr(kind, "groupBy", spied)
    out = substring_dedup.substring_dedup(docs(rows), chunk_bytes=4000)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect()]
    sent = asked[1].select("chunk", (F.octet_length("k1") / 8).alias("n")).collect()
    chunks = len({r.chunk for r in sent})
    assert chunks > 10 and sum(r.n for r in sent) <= chunks * 60  # 400 documents have 1,200 occurrences of one window alone
    assert sorted(got, key=repr) == sorted(brute_dedup(rows, 13), key=repr)


def test_chunks_of_null_ids_are_even(spark, docs):
    rows = docs([(None, "same text of all")] * 3000)
    sizes = [r["count"] for r in substring_dedup.chunked(rows, 3000 * 16, chunk_bytes=1600).groupBy("chunk").count().collect()]
    assert len(sizes) == 30 and max(sizes) < 200


def test_substring_dedup_hard(hard, empty):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    got = substring_dedup.substring_dedup(hard).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=key) == sorted(brute_dedup(rows, 13), key=key)
    for r in got:
        assert sum(x["last"] - x["first"] + 1 for x in r.removed) == r.n_removed
    assert substring_dedup.substring_dedup(empty).count() == 0


# 2, 4


def labelled(spark, seed, n=400):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [f"w{int(rng.paretovariate(0.5)) % 3000}" for _ in range(rng.randint(10, 200))]
        toxic, junk = rng.random() < 0.25, rng.random() < 0.3
        for _ in range(2 + len(w) // 40 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(("idiot,", "Moron", "clown"))
        if junk:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, ". ".join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9)) + "."))
        if rng.random() < 0.7:
            labels.append((i, int(not junk), int(toxic)))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n if i is not None else 0


@pytest.mark.parametrize(("score", "label", "at"), [(toxicity.score_toxicity, "toxic", 0.5), (quality_classifier.score_quality, "quality", 0.3)])
def test_classifiers(spark, docs, hard, empty, score, label, at):
    rows, labels = labelled(spark, 5)
    got = collected(score(docs(rows), labels))
    truth = {r.doc_id: r[label] for r in labels.collect()}
    held = [i for i in truth if fold(i, 5) == 0]
    assert {r.doc_id: r.held_out for r in got.values()} == {i: fold(i, 5) == 0 for i, _ in rows}
    assert sum((got[i].score >= at) == truth[i] for i in held) / len(held) > 0.9
    # held-out labels aren't learned from
    turned = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col(label)).otherwise(F.col(label)))
    again = collected(score(docs(rows), turned))
    assert all(abs(again[i].score - got[i].score) < 1e-9 for i, _ in rows)
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 1), (0, None, None), (1, 7, 7), (99999, 1, 1), (3, 1, 1), (3, 0, 0)], labels.schema))
    out = score(hard, odd).collect()
    assert len(out) == hard.count() and all(0 <= r.score <= 1 for r in out)
    assert score(empty, labels).count() == 0
    assert score(docs(rows[:5]), labels.where("false")).count() == 5


def test_prior_is_estimated(spark, docs):
    rows, labels = labelled(spark, 8, 900)
    x = quality_classifier.features(docs(rows)).join(labels.where("quality = 1 and doc_id % 2 = 0").select("doc_id", F.lit(True).alias("t")), "doc_id", "left")
    x = x.select("x", F.coalesce("t", F.lit(False)).alias("trusted"))
    width = quality_classifier.measures(pa.array([""])).shape[1] + 1
    prior = quality_classifier.class_prior(x, quality_classifier._newton(x, width, None))
    assert 0.4 < prior < 0.75  # of the unlabelled: about 0.58 are good


def test_risk_is_minimised(spark):
    """Against plain gradient descent on the same risk, and where the risk of negatives would fall below zero."""
    rng = np.random.default_rng(4)
    good = rng.random(400) < 0.4
    x = np.where(good[:, None], rng.normal(0.7, 0.5, (400, 3)), rng.normal(0, 0.5, (400, 3)))
    trusted = good & (rng.random(400) < 0.5)
    df = spark.createDataFrame([([float(v) for v in r], bool(t)) for r, t in zip(x, trusted, strict=True)], "x array<float>, trusted boolean")
    ones = np.concatenate([np.ones((400, 1)), x.astype(np.float32)], axis=1)
    p, u, ridge = ones[trusted], ones[~trusted], quality_classifier.RIDGE * np.array([0, 1, 1, 1])
    soft = lambda z: np.logaddexp(0, z)

    def parts(w, prior):
        return prior * soft(-p @ w).mean(), soft(u @ w).mean() - prior * soft(p @ w).mean(), ridge @ (w * w) / 2

    prior = 0.25
    w = np.zeros(4)
    for _ in range(20_000):
        w -= 0.3 * (u.T @ (1 / (1 + np.exp(-u @ w))) / len(u) - prior * p.mean(axis=0) + ridge * w)
    got = quality_classifier._newton(df, 4, prior)
    assert parts(w, prior)[1] > 0 and sum(parts(got, prior)) <= sum(parts(w, prior)) + 1e-5 and np.allclose(got, w, atol=0.05)
    bound = quality_classifier._newton(df, 4, 0.9)  # far above the true share: the unbiased risk has a negative part
    assert parts(bound, 0.9)[1] >= -1e-9


def test_kneser_ney_adds_up():
    rng = random.Random(2)
    text = lambda c: " ".join(rng.choice(("a", "b", "c", "d", f"t{rng.randint(0, 9)}" if c else f"o{rng.randint(0, 9)}")) for _ in range(50))
    vocabulary = ["a", "b", "c", "d", *[f"{k}{i}" for k in "to" for i in range(10)]]
    word = lambda t: bytewords.words(pa.array([t]), bytewords.ALNUM)[0]
    model = toxicity.Model([(i % 2, word(text(i % 2))) for i in range(30)], 1.0, 0.3)
    h = word(" ".join(vocabulary))
    base = model.shared.get(h)[0].sum() + model.unseen * (len(vocabulary) + 1)
    own = (model.unigram.get(h).sum(axis=1) + model.spilled) / model.types
    assert abs(base - 1) < 1e-4 and np.allclose(own, 1, atol=1e-4)
    assert model.ratios(word("x t1"), np.array([0, 2]))[1] > 1 and model.ratios(word("x o1"), np.array([0, 2]))[1] < -0.5


def direct_kneser_ney(docs, discount, rate):
    """log-ratio of each word of a text by dictionaries: counts of different (class, word, word, word) outside repeated windows of four words."""
    windows, fresh = set(), []
    every = [(d, i) for d, (_, w) in enumerate(docs) for i in range(len(w))]
    again = set()
    for d, (_, w) in enumerate(docs):
        for i in range(len(w) - 3):
            k = tuple(w[i : i + 4])
            if k in windows:
                again.update((d, i + j) for j in range(4))
            windows.add(k)
    fresh = [p for p in every if p not in again]
    triples = {(docs[d][0], *(docs[d][1][j] if j >= 0 else None for j in (i - 2, i - 1, i))) for d, i in fresh}
    pairs = collections.Counter((c, b, w) for c, a, b, w in triples)  # None before the first word, so triples of a text's head are told apart
    context, follow, types = collections.Counter(), collections.Counter(), collections.Counter()
    for (c, b, w), n in pairs.items():
        context[c, b] += n
        follow[c, b] += min(n, discount)
        types[c, w] += 1
    total = [max(1, sum(n for (c, _), n in types.items() if c == k)) for k in (0, 1)]
    vocabulary = {w for _, w in types}
    rest = toxicity.SHARED_DISCOUNT * len(vocabulary) / max(1, sum(types.values()))
    spilled = [max(1, sum(min(n, discount) for (c, _), n in types.items() if c == k)) for k in (0, 1)]

    def p(c, b, w):
        shared = (1 - rest) * sum(r * types[k, w] / total[k] for k, r in ((0, 1 - rate), (1, rate))) + rest / (len(vocabulary) + 1)
        own = (max(0, types[c, w] - discount) + spilled[c] * shared) / total[c]
        return (max(0, pairs[c, b, w] - discount) + follow[c, b] * own) / context[c, b] if context[c, b] else own

    return lambda w: [max(-toxicity.MOST_RATIO, min(toxicity.MOST_RATIO, math.log(p(1, b, x)) - math.log(p(0, b, x)))) for b, x in zip([None, *w], w, strict=False)]


@pytest.mark.parametrize("discount", [1.0, 4.0])
def test_kneser_ney_by_dictionaries(discount):
    rng = random.Random(7)
    texts = [(i % 2, [f"{'t' if i % 2 and rng.random() < 0.3 else 'w'}{int(rng.paretovariate(1)) % 12}" for _ in range(rng.randint(1, 40))]) for i in range(40)]
    texts += [texts[3], texts[4]]
    hashed = lambda w: bytewords.words(pa.array([" ".join(w)]), bytewords.ALNUM)[0]
    model = toxicity.Model([(c, hashed(w)) for c, w in texts], discount, 0.3)
    direct = direct_kneser_ney(texts, discount, 0.3)
    for w in [*(w for _, w in texts[:12]), ["t1", "new", "w1", "t2"], ["new"]]:
        assert np.allclose(model.ratios(hashed(w), np.array([0, len(w)])), direct(w), rtol=1e-4, atol=1e-4)


def test_toxicity_sample_with_an_oversize_document(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    use = lambda i: (i % 2, fold(i, 5) == 4)
    order = [r.doc_id for r in labels.orderBy(F.xxhash64(F.lit(7), "doc_id")).collect() if fold(r.doc_id, 5) > 0]
    first = {use(i): i for i in reversed(order)}  # one document over all words comes first in each class and use
    rows = docs([(i, " ".join([f"w{i}"] * (5000 if i in first.values() else 3))) for i in range(200)])
    got = toxicity._sample(rows, labels, "toxic", 1000, 2000)
    assert collections.Counter((y, held) for y, held, _ in got) == collections.Counter(map(use, order))
    assert {(y, held, len(h)) for y, held, h in got if len(h) > 3} == {(y, held, 100 if held else 200) for y, held in first}
    assert toxicity.fit(rows, labels, sample_docs=1000, sample_words=2000)[1][1:].any()  # not one score for all


# 3


def direct_ctw(train, depth):
    """Context-tree weighting by its recursion, over dictionaries."""
    count = collections.defaultdict(lambda: [0, 0])

    def steps(stream):
        lead = b"\n" * depth + stream
        for i in range(len(stream)):
            node = 1
            for k in range(7, -1, -1):
                bit = stream[i] >> k & 1
                yield lead[i : i + depth], node, bit
                node = node << 1 | bit

    for s in train:
        for c, node, bit in steps(s):
            for d in range(depth + 1):
                count[c[depth - d :], node][bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    below = collections.defaultdict(float)
    pw = {}
    for c, node in sorted(count, key=lambda k: -len(k[0])):
        a = kt(*count[c, node])
        pw[c, node] = a if len(c) == depth else np.logaddexp(a, below[c, node]) - math.log(2)
        if c:
            below[c[1:], node] += pw[c, node]

    def score(stream):
        total = 0.0
        for c, node, bit in steps(stream):
            p = 0.5
            for d in range(depth, -1, -1):
                k = c[depth - d :], node
                if k in count:
                    n = count[k]
                    stop = 1.0 if d == depth else math.exp(kt(*n) - math.log(2) - pw[k])
                    p = stop * (n[bit] + 0.5) / (sum(n) + 1) + (1 - stop) * p
            total += math.log10(p)
        return total

    return score


def stream(text):
    low = (text or "").encode().translate(context_tree._LOWER)
    return b" ".join(low.split()) + b"\n"


def check_scores(df, rows):
    got = df.collect()
    train = [t for i, t in rows if fold(i, 10)]
    token = lambda t: [*stream(t)[:-1].split(), None]
    c = collections.Counter(x for t in train for x in token(t))
    n, v = sum(c.values()), len(c)
    score = direct_ctw([stream(t) for t in train], context_tree.DEPTH)
    want = sorted((i is None, i or 0, len(token(t)), sum(c[x] > 0 for x in token(t)), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in token(t)), score(stream(t))) for i, t in rows)
    have = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert len(want) == len(have)
    for a, b in zip(want, have, strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-4, abs_tol=1e-6)
    assert all(r.held_out == (fold(r.doc_id, 10) == 0) for r in got)
    lengths = collections.Counter(len(stream(t)) for _, t in rows)
    assert collections.Counter(round(-r.score * math.log2(10) / r.bits_per_byte) for r in got) == lengths


def test_context_tree(docs, empty):
    rows = made_up(4, 40, 30, (1, 25)) + [(100, None), (101, ""), (102, "É Ü ü"), (None, "a null id"), (7, "repeated id")]
    check_scores(context_tree.score_texts(docs(rows)), rows)
    check_scores(context_tree.score_texts(docs(rows), chunk_bytes=300), rows)
    only_held = [(i, t) for i, t in rows if fold(i, 10) == 0]
    check_scores(context_tree.score_texts(docs(only_held)), only_held)
    assert context_tree.score_texts(empty).count() == 0


def test_context_tree_hard(hard, monkeypatch):
    assert context_tree.score_texts(hard).count() == hard.count()
    some = hard.where("doc_id is null or doc_id not in (5, 6)")  # without the long text
    rows = [(r.doc_id, r.text) for r in some.collect()]
    check_scores(context_tree.score_texts(some), rows)
    monkeypatch.setattr(context_tree, "PART_BYTES", 4)  # several parts for each group
    check_scores(context_tree.score_texts(some), rows)


# 5


def check_shards(out, n, total):
    rows = out.collect()
    assert len(rows) == total
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and all(0 <= s < n for s in by)
    sizes = [len(by.get(s, [])) for s in range(n)]
    assert max(sizes) - min(sizes) <= 1
    return rows


def test_sharding(spark, docs, hard, empty):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"))
    a = check_shards(sharding.shard_rows(df, 16), 16, 5000)
    b = check_shards(sharding.shard_rows(df.repartition(3, F.rand(1)), 16), 16, 5000)
    place = lambda rows: {(r.doc_id, r.shard, r.slot) for r in rows}
    assert place(a) == place(b) and place(a) != place(check_shards(sharding.shard_rows(df, 16, seed=6), 16, 5000))
    # ids in order of shard and slot show no order left: the rank correlation is within four standard deviations
    order = np.array([r.doc_id for r in sorted(a, key=lambda r: (r.shard, r.slot))])
    assert abs(np.corrcoef(order, np.arange(5000))[0, 1]) < 4 / math.sqrt(5000)
    table = np.zeros((10, 16))
    for r in a:
        table[r.doc_id * 10 // 5000, r.shard] += 1
    assert ((table - 31.25) ** 2 / 31.25).sum() < 220  # 135 degrees of freedom
    assert {(r.size, r.text_crc32) for r in a} == {(3, zlib.crc32(f"t{i}".encode())) for i in range(7)}
    check_shards(sharding.shard_rows(hard, 4), 4, hard.count())
    assert sharding.shard_rows(empty).count() == 0
    assert sharding.query(spark, "/root/testdata/sf0.001").columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_copies_scatter(spark, docs):
    rows = [(i, f"text {i}") for i in range(1500)] * 3 + [(None, "hot")] * 2000
    df = docs(rows).repartition(5)
    got = check_shards(sharding.shard_rows(df, 16), 16, len(rows))
    assert collections.Counter((r.doc_id, r.size) for r in got) == collections.Counter((i, len(t) + 1) for i, t in rows)
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    pairs = sum(a == b is not None for a, b in zip(order, order[1:], strict=False))
    hot = sum(a is None and b is None for a, b in zip(order, order[1:], strict=False))
    n = len(rows)
    assert pairs <= 10  # about 1.4 by chance
    assert abs(hot - 2000 * 1999 / n) < 6 * math.sqrt(2000 * 1999 / n)
    shards = np.bincount([r.shard for r in got if r.doc_id is None], minlength=16)
    assert ((shards - 125) ** 2 / 125).sum() < 45  # 15 degrees of freedom
    again = sharding.shard_rows(docs(rows).repartition(3), 16).collect()
    place = lambda x: collections.Counter((r.doc_id, r.shard, r.slot) for r in x)
    assert place(again) == place(got)


def test_matrix_against_shuffles():
    """Counts of a matrix are as frequent as in shuffles of all rows."""
    rng, sources, targets = random.Random(3), [4, 3, 2], [5, 4]
    labels = [i for i, n in enumerate(sources) for _ in range(n)]
    drawn, shuffled, n = collections.Counter(), collections.Counter(), 20_000
    for _ in range(n):
        drawn[tuple(r[0] for r in sharding.communication_matrix(rng, sources, targets))] += 1
        rng.shuffle(labels)
        shuffled[tuple(labels[: targets[0]].count(i) for i in range(3))] += 1
    for k in drawn.keys() | shuffled.keys():
        p = math.prod(math.comb(m, x) for m, x in zip(sources, k, strict=True)) / math.comb(9, 5)
        assert abs(drawn[k] / n - p) < 5 * math.sqrt(p / n) and abs(shuffled[k] / n - p) < 5 * math.sqrt(p / n)


def test_hypergeometric_draws():
    rng = random.Random(1)
    got = collections.Counter(sharding.hypergeometric(rng, 12, 18, 10) for _ in range(20_000))
    for k in range(11):
        p = math.comb(12, k) * math.comb(18, 10 - k) / math.comb(30, 10)
        assert abs(got[k] / 20_000 - p) < 4.5 * math.sqrt(p / 20_000) + 1e-4
    big = [sharding.hypergeometric(rng, 10**12, 10**13, 10**9) for _ in range(50)]  # a few thousand steps each
    assert abs(np.mean(big) - 10**9 / 11) < 5 * math.sqrt(10**9 * 10 / 121 / 50)
    m = sharding.communication_matrix(rng, [5, 0, 11], [4, 4, 8])
    assert [sum(r) for r in m] == [5, 0, 11] and [sum(c) for c in zip(*m, strict=True)] == [4, 4, 8]
    assert sharding.hypergeometric(rng, 0, 5, 3) == 0 and sharding.hypergeometric(rng, 5, 0, 3) == 3


# 6


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    host, best = low(host), None
    for h, p, verdict in url_filter.HOST_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = h + p, verdict
    hit = url is not None and any(re.search(p, low(url)) for p in url_filter.PATTERNS)
    return host, path, best and best[0], best[1] if best else "block" if hit else "allow"


URLS = ["http://a.net/x", "http://A.NET/x?y#z", "http://net", "http://net/", "https://sub.example.net/en/1", "http://example.net/fr/", "http://example.com/de/2?q", "http://x.example.com/dex", "http://evilnet/", "ftp://b.org/fr/x", "http://m.casino-win.example.com/en/", "http://mycasino-win.example.com/", "no scheme", "", None, "http://h#frag", "a://b://c/d", "HTTP://X.COM/WP-LOGIN.PHP", "http://x.com/a.torrent", "http://é.com/ü?affid=1", "http://x.com/\nline", "http://a\x00b.net/x", "http://c.net\x00/en/?x", "x\x00://\x00net/", "://", "a:///p?q"]


def test_urls(spark, empty):
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, verdict string")
    got = [(r.row.url, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()]
    assert sorted(got, key=repr) == sorted(((u, *brute_url(u)) for u in URLS * 2), key=repr)
    assert url_filter.filter_urls(df.where("false")).count() == 0


def test_literal_tokens_are_in_every_match():
    cases = {r"a|b": [], r"/ads/": ["ads"], r"/ads+/": [], r"/ad?s/": [], r"/ads{2}/x/": ["x"], r"[/.]x1[._]": ["x1"], r"[/.]x1[-_]": [], r"[^/]x1/": [], r"/x1[a-z]": [], r"\.x1\W": [], r"\bx1\b": ["x1"], r"(?i)/x1/": ["x1"], r"(?x)/ x1 /": [],
             r"\Q/x1/\E": [], r"/(x1/)": [], r"/a(b|[)])/c/": ["c"], r"/A1/": [], r"/x1.y2/": [], r"^x1$": ["x1"], r"\d/x1/": ["x1"], r"\x41/x1/": [], "": [], r"/x1": [], r"/[a]x1/": [], r"/[][]x1/": [], r"é/x1/": ["x1"]}
    assert {p: url_filter.literal_tokens(p) for p in cases} == cases


def test_a_thousand_rules(spark):
    rng = random.Random(2)
    rules = [rf"/track{i}[/.]" if i % 3 else rf"[?&]k{i}=[0-9]+$" for i in range(1000)] + [r"free[0-9]+win", r"(ad|pop)s?/z", r"x{3,}$"]
    urls = [f"http://h{i}.com/track{rng.randrange(1100)}/?k{rng.randrange(1100)}={rng.choice(('9', 'x', '77'))}" + rng.choice(("", "free8win", "xxx")) for i in range(300)]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    want = {u: x for u in urls if (x := [i for i, p in enumerate(rules) if re.search(p, u)])}
    assert {r.url: r.rules for r in url_filter.matching_rules(df, rules).collect()} == want


def test_patterns_by_their_rarest_token(spark):
    assert url_filter.literal_tokens(r"[/.]casino-win\.") == ["casino", "win"]
    assert url_filter.literal_tokens(r"\bads[0-9]+/") == [] and url_filter.literal_tokens(r"/(a|b)/") == [] and url_filter.literal_tokens(r"x-y?-z/") == ["z"]
    assert url_filter.literal_tokens(r"/wp-login\.php$") == ["wp", "login", "php"]
    rules = (r"/ads/", r"popup[0-9]+", r"/track-(me|you)/", r"[?&]id=9$")
    urls = ["http://x/ads/1", "http://x/badads/1", "http://x/popup77/", "http://x/Track-You/", "http://x/?id=9", "http://x/?id=99", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    for size in (0, 1 << 20):
        got = {r.url: r.rules for r in url_filter.matching_rules(df, rules, broadcast_bytes=size).collect()}
        assert got == {u: x for u in urls if u and (x := [i for i, p in enumerate(rules) if re.search(p, u.lower())])}


# 7


def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing the excess again and again."""
    keys = sorted(sizes)
    w = {k: weights[i % len(weights)] for i, k in enumerate(keys)}
    target, full, total = {}, set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[k] for k in full)
        share = sum(w[k] for k in keys if k not in full)
        target = {k: most * sizes[k] if k in full else rest * w[k] / share for k in keys}
        more = {k for k in keys if k not in full and target[k] > most * sizes[k]}
        if not more:
            return target
        full |= more


@pytest.mark.parametrize("seed", range(3))
def test_mixing(docs, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("x" * rng.randint(0, 60)), rng.choice(("a", "b", "c", "d", "é", "Z"))) for i in range(400)]
    rows += [(1000 + i, "y " * 900, "hot") for i in range(20)] + [(2000, "z z z", "tiny"), (2001, None, "none"), (2002, "q q", None)]
    df = docs(rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes["=" + s if s is not None else "~"] += len(words(t))
    want = filled(sizes)
    taken = collections.Counter()
    source = {r[0]: "=" + r[2] if r[2] is not None else "~" for r in rows}
    for r in got:
        k = source[r.doc_id]
        assert r.source_size == sizes[k] and math.isclose(r.target, want[k], rel_tol=1e-9, abs_tol=1e-9) and 0 <= r.taken <= 3 * r["size"]
        taken[k] += r.taken
    for k in sizes:
        assert taken[k] <= 3 * sizes[k] and abs(taken[k] - want[k]) <= 0.02 * want[k] + 4 * mixing.LEAST_BLOCK
    assert [tuple(r)[1:6] for r in sorted(mixing.mix(df.repartition(5)).collect(), key=lambda r: r.doc_id)] == [tuple(r)[1:6] for r in sorted(got, key=lambda r: r.doc_id)]
    # the blocks of the schedule hold just these words, each slot one block
    pieces = mixing.mixed_blocks(df).collect()
    by_doc, by_slot = collections.Counter(), collections.Counter()
    for p in pieces:
        by_doc[p.doc_id] += p.n_words
        by_slot[p.slot] += p.n_words
    assert {r.doc_id: r.taken for r in got if r.taken} == dict(by_doc) and max(by_slot.values()) <= mixing.LEAST_BLOCK
    # any stretch of the schedule is near the weights
    half = collections.Counter()
    for p in pieces:
        if p.slot < max(by_slot) / 2:
            half[source[p.doc_id]] += p.n_words
    for k in ("=hot", "=a"):
        assert abs(half[k] / sum(half.values()) - want[k] / sum(want.values())) < 0.03
    out = mixing.mixed_documents(df).collect()
    assert sum(len(words(r.text)) for r in out) == sum(taken.values()) and all(r.n_chars == len(r.text) for r in out)


def test_mixing_small_sources_of_a_large_corpus(docs, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 1 << 8)  # as if the corpus were 4,096 times as large
    rows = [(i, "y " * 2000, "large") for i in range(200)] + [(1000 + i, "z " * 100, f"s{i:02}") for i in range(40)]
    got = mixing.mix(docs(rows)).collect()
    small = {r.doc_id: r for r in got if r.doc_id >= 1000}
    assert all(abs(r.taken - r.target) <= 4 * mixing.LEAST_BLOCK for r in small.values()) and len(small) == 40


def test_mixing_slots_are_ranked_for_blocks_only(spark):
    shares = spark.createDataFrame([("=a", 48.0, 64), ("=b", 16.0, 64)], "key string, target double, total long")
    slots = mixing.schedule(spark, shares, 64, 16)
    assert slots.columns == ["slot", "key"] and collections.Counter(r.key for r in slots.collect()) == {"=a": 3, "=b": 1}


def test_mixing_keeps_line_breaks_of_a_cut_document(docs):
    text = {i: " \n" + "".join(f"w{k}" + ("\n\n" if k % 3 == 0 else " \t") for k in range(50 + i)) for i in range(12)}
    out = mixing.mixed_documents(docs([(i, t, f"s{i % 3}") for i, t in text.items()])).collect()
    cut = [r for r in out if r.text != text[r.doc_id]]
    assert cut and all(text[r.doc_id].lstrip().startswith(r.text) and "\n\n" in r.text and r.text == r.text.rstrip() for r in cut)


def brute_mix(rows):
    """Taken words of (id, source, size) with unique ids: slots one after another take the next block of their source's stream."""
    streams, sizes = collections.defaultdict(list), collections.Counter()
    for i, source, n in rows:
        key = "~" if source is None else "=" + source
        sizes[key] += n
        streams[key].append((hashlib.md5(f"mix{i}".encode()).hexdigest(), i, n))
    target, total = filled(sizes), sum(sizes.values())
    words_of = {k: [i for _, i, n in sorted(v) for _ in range(n)] * 3 for k, v in streams.items()}
    edges, at, taken = [], 0.0, collections.Counter()
    for k in sorted(k for k in target if target[k] > 0):
        at += target[k]
        edges.append((at / total, k))
    done = collections.Counter()
    for slot in range(-(-total // 16)):
        x = slot % (1 << 31) * mixing.GOLDEN % (1 << 31) / 2**31
        k = next((k for hi, k in edges if x < hi), edges[-1][1])
        taken.update(words_of[k][done[k] * 16 : done[k] * 16 + 16])
        done[k] += 1
    return {i: taken[i] for i, _, _ in rows}


def test_mixing_takes_its_blocks_one_by_one(docs):
    rng = random.Random(12)
    rows = [(i, rng.choice(("a", "b", "c", "d", None)), rng.choice((0, 1, 5, 40, 90))) for i in range(150)] + [(900, "b", 3000)]
    got = {r.doc_id: r.taken for r in mixing.mix(docs([(i, "w " * n, s) for i, s, n in rows]), carry=False).collect()}
    assert got == brute_mix(rows)


def test_mixing_of_copies(spark, docs):
    """Null and repeated ids: each copy has a place of its own, far from the others."""
    rows = [(None, "y " * 7, "a")] * 600 + [(5, "z " * 3, "a")] * 300 + [(i + 10, "x " * 5, "b") for i in range(900)]
    got = mixing.mix(docs(rows).repartition(4), carry=False).collect()
    assert len(got) == len(rows) and sum(r.taken for r in got) == pytest.approx(sum(len(words(t)) for _, t, _ in rows), abs=64)
    pieces = mixing.mixed_blocks(docs(rows)).collect()
    hot = np.array([p.slot for p in pieces if p.doc_id is None])
    assert abs(hot.mean() / max(p.slot for p in pieces) - 0.5) < 0.05 and len(set(hot.tolist())) > 100


def test_mixing_hard(hard, empty):
    got = mixing.mix(hard).collect()
    assert len(got) == hard.count() and all(0 <= r.taken <= 3 * r["size"] for r in got)
    assert sorted((r.row.doc_id, r.row.text) == (r.doc_id, r.row.text) and r["size"] == len(words(r.row.text)) for r in got) == [True] * len(got)
    assert sorted((repr(tuple(r.row)[:2]) for r in got)) == sorted(repr(tuple(r)[:2]) for r in hard.collect())
    assert mixing.mixed_documents(hard).columns == hard.columns
    assert mixing.mix(empty).count() == 0 and mixing.mixed_blocks(empty).count() == 0


# 8


def brute_measures(text):
    t = text or ""
    w, lines = words(t), [x for x in t.split("\n") if words(x)]
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    twice = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(twice) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice), failed


def test_quality_measures(docs, hard, empty):
    rng = random.Random(9)
    texts = []
    for _ in range(60):
        lines = [" ".join(rng.choice(("a", "b", "c#", "dé", "e|")) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 6))]
        texts.append("\n".join(lines + lines[: rng.randint(0, 3)]))
    rows = list(enumerate(texts)) + [(i + 100, r.text) for i, r in enumerate(hard.collect())]
    got = {r.row.doc_id: r for r in quality_rules.quality_rules(docs(rows)).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_measures(t), t
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(hard).count() == hard.count() and quality_rules.quality_rules(empty).count() == 0


def test_lines(docs):
    good = ["The first line says what there is to say, and it goes on to its end.", "Another sentence follows, with other words of much the same kind.", "At last somebody closes the account by naming all those who took part."]
    text = "\n".join([good[0], "Home | News | Sport | About", good[1], "Menu", "BUY!! NOW!! OR!! NEVER!!", "Copyright (c) them. All rights reserved.", "", "Short. One.", good[2]])
    r = collected(quality_rules.clean(docs([(1, text), (2, "Menu\nHome\nLogin\n" * 10 + good[0])])))
    assert r[1].text == "\n".join([good[0], good[1], "", "Short. One.", good[2]])
    assert r[1].n_chars == len(r[1].text) and 2 not in r


# 9


def brute_links(rows, width=5, similarity=0.8):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[p : p + width]) for p in range(max(1, len(w) - width + 1))} if w else set()
    links = collections.defaultdict(set)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    label = {}
    for i in sorted(sets):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = i
                todo += links[x]
    return sorted((i, label[i], len(links[i])) for i in sets)


@pytest.mark.parametrize("limit", [2, 500])
def test_near_duplicates(docs, limit):
    rows = made_up(11, 150) + [(1000, ""), (1001, None), (1002, "a b c"), (1003, "a b c"), (1004, "a b")]
    got = sorted(tuple(r) for r in chosen_path.near_duplicates(docs(rows), limit=limit).collect())
    assert got == brute_links(rows)


def test_near_duplicates_with_null_and_repeated_ids(docs):
    rng = random.Random(4)
    a, b, c = (" ".join(f"{k}{rng.randint(0, 99)}" for _ in range(60)) for k in "abc")
    rows = [(None, a), (None, a), (7, a + " end"), (7, a), (7, a), (8, b), (8, c), (9, c), (None, None), (None, ""), (None, b + " end"), (None, "other")]
    kept = chosen_path.drop_near_duplicates(docs(rows)).collect()
    by = collections.Counter(next((k for k, t in (("a", a), ("b", b), ("c", c)) if (r.text or "").startswith(t)), r.text) for r in kept)
    assert by == {"a": 1, "b": 1, "c": 1, "other": 1, "": 1, None: 1} and sorted(r.doc_id for r in kept if r.doc_id is not None) == [7, 8, 8]


def brute_rows(rows, width=5):
    """(id, class, links) of every row, ids null, repeated or not; and (id, text) of the rows that stay."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[p : p + width]) for p in range(max(1, len(w) - width + 1))} if w else set())
    links = [[b for b, y in enumerate(sets) if a != b and x and 5 * len(x & y) >= 4 * len(x | y)] for a, x in enumerate(sets)]
    seen, out, stay = set(), [], []
    for a in range(len(rows)):
        if a in seen:
            continue
        todo, group = [a], []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                group.append(x)
                todo += links[x]
        ids = [rows[x][0] for x in group if rows[x][0] is not None]
        least = min(ids, default=None)
        out += [(rows[x][0], least, len(links[x])) for x in group]
        stay.append((least, {rows[x][1] for x in group if rows[x][0] == least}))
    return sorted(out, key=repr), stay


@pytest.mark.parametrize("limit", [2, 500])
def test_near_duplicates_by_rows(docs, limit):
    rng = random.Random(8)
    rows = [(None if rng.random() < 0.2 else rng.randrange(25), t) for _, t in made_up(12, 70, size=(1, 60))]
    rows += rows[:20] + [(None, rows[3][1])] * 5 + [(4, ""), (4, ""), (None, None)]
    want, stay = brute_rows(rows)
    got = sorted((tuple(r) for r in chosen_path.near_duplicates(docs(rows), limit=limit).collect()), key=repr)
    assert got == want
    kept = [(r.doc_id, r.text) for r in chosen_path.drop_near_duplicates(docs(rows), limit=limit).collect()]
    assert len(kept) == len(stay)
    for i, t in kept:
        at = next(k for k, (j, texts) in enumerate(stay) if i == j and t in texts)
        stay.pop(at)


def test_one_id_with_two_texts_keeps_its_links(docs):
    rng = random.Random(6)
    a, b = (" ".join(f"{k}{rng.randint(0, 99)}" for _ in range(60)) for k in "ab")
    got = sorted(tuple(r) for r in chosen_path.near_duplicates(docs([(1, a), (1, b), (2, b + " z"), (3, a + " q")])).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_three_equal_rows_leave_one(docs):
    kept = chosen_path.drop_near_duplicates(docs([(1, "one text here"), (1, "one text here"), (2, "one text here")])).collect()
    assert [(r.doc_id, r.text) for r in kept] == [(1, "one text here")]


def test_rows_of_a_dense_group_have_short_lists(spark):
    rows = [(i, [7] * chosen_path.SAMPLES) for i in range(400)]
    reps = spark.createDataFrame(rows, "rep long, tokens array<int>")
    found = chosen_path.buckets(reps, 3, limit=10)
    lists = found.groupBy("rep").agg(F.count_distinct("group").alias("groups"), F.count_distinct("bucket").alias("buckets")).collect()
    assert all(r.groups == 6 and r.buckets == 6 * 40 for r in lists)


def test_near_duplicates_hard(hard, empty):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    want, stay = brute_rows(rows)
    assert sorted((tuple(r) for r in chosen_path.near_duplicates(hard).collect()), key=repr) == want
    kept = chosen_path.drop_near_duplicates(hard)
    assert kept.columns == hard.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, _ in stay), key=repr)
    assert chosen_path.near_duplicates(empty).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    got = {r.node: r.root for r in chosen_path.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = list(range(500))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert got == {x: find(x) for x in range(500) if find(x) != x}


# 10

ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_hits(text, items, width=10):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w, hit, found = ALNUM.findall(low(text)), set(), set()
    for name, t in items:
        q = ALNUM.findall(low(t))
        n = min(width, len(q))
        for p in range(len(q) - n + 1 if q else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == q[p : p + n]:
                    hit.update(range(i, i + n))
                    found.add(name)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("item_bytes", [8 << 20, 300])
def test_decontamination(spark, docs, item_bytes):
    rows = made_up(13, 60, 40) + [(500, None), (501, "..."), (502, "Short ITEM! here"), (503, "É-x short item")]
    rng = random.Random(5)
    items = [(str(i), t if len(t := rng.choice(rows[:60])[1]) < 90 else " ".join(t.split()[3:18])) for i in range(12)] + [("s", "short item"), ("n", None), ("e", "--"), ("7", "zz yy")]
    df = spark.createDataFrame(items, "item_id string, text string")
    got = {r.row.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontamination.find_matches(docs(rows), df, item_bytes=item_bytes).collect()}
    assert got == {i: brute_hits(t, items) for i, t in rows}
    clean = decontamination.decontaminate(docs(rows), df, item_bytes=item_bytes)
    assert {r.doc_id for r in clean.collect()} == {i for i, x in got.items() if not x[1]}


def test_longest_matches(spark, docs):
    passage = " ".join(f"q{i}" for i in range(25))
    text = f"before it {passage} after it q3 q4 q5 q6 q7 q8 q9 q10 q11 q12 end"
    out = decontamination.find_matches(docs([(1, text)]), spark.createDataFrame([(5, f"x {passage} y")], "item_id long, text string")).first()
    assert sorted(tuple(m) for m in out.matches) == [("5", 1, 2, 25), ("5", 4, 29, 10)] and out.n_hit == 35


def test_decontamination_hard(spark, hard, empty):
    items = spark.createDataFrame([(None, "one two three four five six seven eight nine ten"), (2, None)], "item_id long, text string")
    out = decontamination.find_matches(hard, items).collect()
    assert len(out) == hard.count() and {r.row.doc_id for r in out if r.n_hit} == {0, 1, None, 7, 11} and out[0].row.chunk == 1
    assert decontamination.find_matches(empty, items).count() == 0
    assert decontamination.decontaminate(hard, items.where("false")).count() == hard.count()


def brute_matches(w, q, width=10):
    """(item word, document word, length) of all longest matches."""
    out = []
    for a in range(len(q)):
        for b in range(len(w)):
            if a and b and q[a - 1] == w[b - 1]:
                continue
            n = 0
            while a + n < len(q) and b + n < len(w) and q[a + n] == w[b + n]:
                n += 1
            if n >= width or n == len(q) > 0:
                out.append((a, b, n))
    return sorted(out)


def test_all_longest_matches(spark, docs):
    rng = random.Random(9)
    draw = lambda n, k: [f"x{rng.randint(0, k)}" for _ in range(n)]
    texts = [draw(200, 1), draw(150, 0), draw(300, 2) + ["x0"] * 40, draw(100, 1) * 3, ["x0", "x1"] * 80]
    items = [draw(60, 1), ["x0"] * 30, ["x0", "x1"] * 20, ["x1", "x0"], draw(40, 2), ["x0"] * 9]
    df = spark.createDataFrame([(str(i), " ".join(q)) for i, q in enumerate(items)], "item_id string, text string")
    out = decontamination.find_matches(docs([(i, " ".join(w)) for i, w in enumerate(texts)]), df).collect()
    for r in out:
        got = collections.defaultdict(list)
        for m in r.matches:
            got[m.item_id].append((m.item_word, m.doc_word, m.n_words))
        assert {k: sorted(v) for k, v in got.items()} == {str(i): x for i, q in enumerate(items) if (x := brute_matches(texts[r.row.doc_id], q))}


def test_one_word_over_and_over_makes_few_pairs():
    column = pa.array(["again " * 20_000])
    raw, offsets = bytewords.text_buffers(column)
    items = decontamination.Items([("i", "again " * 500)], 10)
    n, row, *_, size = decontamination._matches(items, column, 10, 0, 1, raw, offsets)
    # a match for each diagonal, of all 9.8 million pairs of windows and places
    assert n.tolist() == [20_000] and len(row) == 20_000 - 9 + 500 - 9 - 1 and size.max() == 500


def test_suffix_array():
    rng = np.random.default_rng(3)
    seq = rng.integers(1, 4, 500)
    order = decontamination.suffix_array(seq, 8)
    cut = [tuple(seq[i : i + 8]) for i in order]
    assert sorted(order.tolist()) == list(range(500)) and cut == sorted(cut)


# pipeline and queries


def test_pipeline(spark, sf, empty, hard):
    out = corpus_pipeline.run(spark, sf)
    names = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert out.columns == [*names, "shard", "slot"]
    check_shards(out, 16, out.count())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, sf).count() == 0 and stage(spark, hard, sf).columns == hard.columns
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf).count() == 0


def test_stages_by_brute_force(spark, sf, docs):
    rows = made_up(17, 80, 200, (15, 60))
    df = docs([(i, "\n".join(" ".join(t.split()[k : k + 12]) + "." for k in range(0, len(t.split()), 12)), f"s{i % 3}") for i, t in rows])
    texts = [(r.doc_id, r.text) for r in df.collect()]
    clean = {r.doc_id for r in corpus_pipeline.clean(spark, df, sf).collect()}
    assert clean == {i for i, t in texts if not brute_measures(t)[-1]}
    kept = {r.doc_id for r in corpus_pipeline.deduplicate(spark, df, sf).collect()}
    assert kept == {c for _, c, _ in brute_links(texts)}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {r.doc_id for r in corpus_pipeline.decontaminate(spark, df, sf).collect()} == {i for i, t in texts if not brute_hits(t, items)[1]}
    taken = {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    got = collections.Counter()
    for r in corpus_pipeline.mix(spark, df, sf).collect():
        got[r.doc_id] += len(words(r.text))
    assert dict(got) == {i: n for i, n in taken.items() if n}


def test_digest_of_kept_words(spark, sf):
    out = substring_dedup.query(spark, sf).limit(5).collect()
    whole = collected(substring_dedup.substring_dedup(spark.read.parquet(f"{sf}/documents.parquet")))
    assert all(r.kept_sha256 == hashlib.sha256(whole[r.doc_id].kept_text.encode()).hexdigest() for r in out)
