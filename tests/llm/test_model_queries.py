"""The queries of the two classifiers and their stages against versions that follow the definitions step by step."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from brindle.llm import quality_classifier, toxicity
from brindle.llm.packing import default_vocabulary

PLAIN = "the a nice day for all of us and this is what we have seen in town on our way home with friends from work".split()
BAD = ["idiot", "1d10t", "idi*t", "stupid", "$tup1d", "moron!", "m0r0n", "looooser", "loser"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents and labels, with nulls, repeated rows, long texts and keys that no label has."""
    rnd = random.Random(5)
    docs, labels = [], []
    for i in range(240):
        words = [rnd.choice(PLAIN) for _ in range(rnd.randrange(5, 90))]
        bad = i % 3 == 0
        for _ in range(rnd.randrange(1, 4) if bad else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
        if i % 30 == 0:
            words.append("you i d i o t there 42 (10)")
        text = " ".join(words) if i % 4 else "#$ | " * rnd.randrange(3, 30) + " ".join(words).upper() + "!!\n" * rnd.randrange(4)
        docs.append((i, text, "x"))
        if i % 11:
            labels.append((i, int(i % 4 != 0), int(bad)))
    docs += [(500, None, None), (501, "", "x"), (None, "stupid " * 2000, "x"), docs[7], docs[7], (502, docs[3][1], "x")]
    labels += [(500, 0, 0), (502, 1, 1), (777, 1, 1), (None, 0, 1)]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, score string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, docs, labels


def remainder(key, n):
    return None if key is None else zlib.crc32(str(key).encode()) % n


# --- toxicity


def symbol(c):
    return ord(c.lower()) - 96 if re.match("[a-zA-Z]", c) else 28 if re.match("[0-9]", c) else 27 if ord(c) > 127 else 0


def character_costs(texts):
    """Costs by context, longest first: each shorter model counts as five occurrences."""
    runs = Counter()
    for text in texts:
        codes = [0, 0, 0, *map(symbol, text), 0]
        runs.update(tuple(codes[i : i + 4]) for i in range(len(codes) - 3))
    models = [Counter() for _ in range(5)]  # by length of the run's end
    totals = [Counter() for _ in range(5)]
    for run, n in runs.items():
        for k in range(1, 5):
            models[k][run[4 - k :]] += n
            totals[k][run[4 - k : 3]] += n

    def p(run):
        return (models[len(run)][run] + 5 * p(run[1:])) / (totals[len(run)][run[:-1]] + 5) if run else 1 / 29

    return lambda run: -math.log(p(run))


def restored(word, arcs, cost):
    """The cheapest of all paths."""
    def price(path):
        codes, total = [0, 0, 0], 0.0
        for c, own in [*path, (" ", 0.0)]:
            total += own
            if c:
                codes.append(symbol(c))
                total += cost(tuple(codes[-4:]))
        return total

    return "".join(c for c, _ in min(itertools.product(*arcs), key=price)).split()


def brute_toxicity(docs, labels):
    texts = [text or "" for _, text, *_ in docs]
    cost = character_costs(texts)
    channel = toxicity.Channel(np.ones(29**4))  # for the arcs, which do not depend on counts
    known = {}

    def meant(word):
        if word not in known:
            if word.isalpha() and not re.search(r"(.)\1\1", word):
                known[word] = [word]
            elif number := re.match(r"^\W*(\d+)\W*$", word):
                known[word] = [number[1]]
            else:
                known[word] = restored(word, channel.arcs(word), cost)
        return known[word]

    def features(text):
        text = text.lower()
        words = {x for w in text.split() for x in meant(w)}
        for run in re.findall(r"(?<!\S)\S(?:[ \t]+\S){2,}(?!\S)", text):
            words |= set(restored(run, channel.arcs(" ".join(run.split()), True), cost))
        return words | {w[:n] + "*" for w in words for n in (4, 5, 6) if len(w) >= n}

    label = {i: y for i, _, y in labels if i is not None and remainder(i, 3) != 1}
    train = sorted({(text or "", label[i]) for i, text, *_ in docs if i in label})
    x, y = [features(t) for t, _ in train], np.array([v for _, v in train])
    pos, neg = y.sum(), (1 - y).sum()
    used = []
    for f in sorted(set().union(*x)):
        a, b = sum(f in s and v == 1 for s, v in zip(x, y, strict=True)), sum(f in s and v == 0 for s, v in zip(x, y, strict=True))
        if a >= 2 and a / pos > 2 * b / neg and a * math.log((a + 0.1) / pos / ((b + 1) / neg)) >= 8:
            used.append(f)
    m = np.array([[f in s for f in used] for s in x], float)
    share = np.where(y == 1, 0.5 / pos, 0.5 / neg)
    w, b, mw, mb = np.zeros(len(used)), 0.0, np.zeros(len(used)), 0.0
    for _ in range(400):
        ahead = w + 0.9 * mw
        g = share * (1 / (1 + np.exp(-(m @ ahead + b + 0.9 * mb))) - y)
        mw, mb = 0.9 * mw - 2 * (m.T @ g + 3e-4 * ahead), 0.9 * mb - 2 * g.sum()
        w, b = w + mw, b + mb
    scores = [1 / (1 + math.exp(-(b + sum(v for f, v in zip(used, w, strict=True) if f in features(t))))) for t in texts]
    return [(d[0], remainder(d[0], 3) == 1, s, int(s >= 0.7)) for d, s in zip(docs, scores, strict=True)]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2] for r in got], [r[2] for r in want], atol=1e-5)
    assert [r[3] for r in got] == [r[3] for r in want] and 0 < sum(r[3] for r in got) < len(got)


def test_op8_by_definition(spark, tables):
    at, docs, labels = tables
    got = toxicity.op8_toxicity(spark, at).select("doc_id", "held_out", "score", "predicted").collect()
    same(got, brute_toxicity(docs, [(i, q, t) for i, q, t in labels]))


def test_toxicity_stage_by_definition(spark, tables):
    import corpus_pipeline as pipeline

    at, docs, labels = tables
    out = pipeline.toxicity(spark, spark.read.parquet(f"{at}/documents.parquet"), at)
    want = [d for d, r in zip(docs, brute_toxicity(docs, labels), strict=True) if not r[3]]
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(out.collect()) == order(want) and len(want) < len(docs)


# --- quality


def numbers(text):
    """The features of a text, one after the other."""
    data = (text or "").encode()
    words, lines = data.split(), [x for x in data.split(b"\n") if x.split()]
    n, size = len(words), len(data)
    share = lambda a, b: a / b if b else 0.0
    of = lambda signs: sum(data.count(s.encode()) for s in signs)
    triples = [tuple(words[i : i + 3]) for i in range(n - 2)]
    signs = ["#*$%&", "|<>", "!?", ".,;:", "0123456789", "@/_=+\\{}[]()"]
    return [
        math.log(1 + n), math.log(1 + size), *[math.sqrt(share(of(s), size)) for s in signs], math.sqrt(share(of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), size)),
        share(len(set(words)), n), 1 - share(len(set(triples)), len(triples)), 1 - share(len(set(lines)), len(lines)), share(sum(map(len, words)), n) / 10,
        share(sum(w.decode()[-1] in "!#*$%&|" for w in words), n), share(sum(len(w) < 3 for w in words), n), math.log(1 + share(n, len(lines))), n < 20, n < 50, math.sqrt(share(of(".,;:"), n)), n == 0,
    ]


def brute_quality(docs, labels):
    label = {i: q for i, q, _ in labels if i is not None}
    x = np.array([numbers(t) for _, t, *_ in docs], float)
    train = [k for k, d in enumerate(docs) if d[0] in label and remainder(d[0], 5) != 0]
    y = np.array([label[docs[k][0]] for k in train])
    mean, scale = x[train].mean(axis=0), x[train].std(axis=0)
    scale[scale < 1e-9] = 1
    z = (x - mean) / scale
    good, bad = z[train][y == 1], z[train][y == 0]
    pairs = (good[:, None] - bad[None]).reshape(-1, z.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(pairs @ w))
        gradient = -(p @ pairs) / len(pairs) + 1e-3 * w
        hessian = (pairs.T * (p * (1 - p))) @ pairs / len(pairs) + 1e-3 * np.eye(len(w))
        w = w - np.linalg.solve(hessian, gradient)
    ordered = np.sort(z[train] @ w)
    middle = (ordered[len(bad) - 1] + ordered[len(bad)]) / 2
    raw = z @ w - middle + math.log(0.3 / 0.7)
    score = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
    return [(d[0], remainder(d[0], 5) == 0, float(s), int(s >= 0.3)) for d, s in zip(docs, score, strict=True)]


def test_op1_by_definition(spark, tables):
    at, docs, labels = tables
    same(quality_classifier.op1_quality_classifier(spark, at).select("doc_id", "held_out", "score", "predicted").collect(), brute_quality(docs, labels))


# --- packing


def test_packing_stage_by_definition(spark, tables):
    """Pieces by the library's ids, as few sequences as best-fit decreasing, no gaps and no overlaps."""
    import struct

    import corpus_pipeline as pipeline
    from tokenizers import Tokenizer

    at, docs, _ = tables
    docs = [*docs, (900, "plain words " * 3000, "x")]
    encoder = Tokenizer.from_file(str(default_vocabulary()))
    want = []
    for i, text, *_ in docs:
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want.append((i, piece, start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    rows = pipeline.packing(spark, spark.createDataFrame(docs, "doc_id long, text string, score string"), at).collect()
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(r)[:5] for r in rows) == order(want)
    used = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 2048
    room = []
    for size in sorted((r[3] for r in want), reverse=True):
        fits = [x for x in room if x >= size]
        if fits:
            room.remove(min(fits))
        room.append((min(fits) if fits else 2048) - size)
    assert len(used) <= len(room)
