"""Quality scores and languages of the registered queries, worked out again with plain loops."""

import math
import zlib

import numpy as np

from tidemark.llm import language, quality, queries

SF = "/root/testdata/sf0.001"


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def statistics(text):
    words = (text or "").split()
    if not words:
        return [0.0] * 18
    raw = text.encode()
    count = lambda kinds: sum(b in kinds for b in raw)
    upper, lower, wide, digits = count(range(65, 91)), count(range(97, 123)), count(range(128, 256)), count(range(48, 58))
    letters, lines, different, n = upper + lower + wide, text.split("\n"), set(words), len(words)
    return [
        math.log1p(n), sum(len(w) for w in words) / n, upper / max(letters, 1), digits / len(raw), count(b"*$%&#@^~<>{}[]=+\\_/`") / len(raw), count(b"|") / n, count(b".;:") / n, count(b",") / n, count(b"!?") / n,
        len(different) / n**0.8, sum(words[i] == words[i - 1] for i in range(1, n)) / n, 1 - len(set(lines)) / len(lines), sum(len(w) > 20 for w in words) / n, letters / len(raw), math.log1p(max(map(len, words))),
        wide / len(raw), math.log1p(n / len(lines)), sum(not w.isalpha() for w in different) / len(different),
    ]


def monotone(x, good, n):
    """The non-decreasing fit by its formula: the greatest over starts of the least over ends of the mean between."""
    k = len(x)
    level = [max(min(sum(good[a : b + 1]) / sum(n[a : b + 1]) for b in range(i, k)) for a in range(i + 1)) for i in range(k)]
    knots, i = [], 0
    while i < k:
        j = i
        while j + 1 < k and abs(level[j + 1] - level[i]) < 1e-12:
            j += 1
        w = sum(n[i : j + 1])
        knots.append((sum(a * b for a, b in zip(x[i : j + 1], n[i : j + 1], strict=True)) / w, (sum(good[i : j + 1]) + 0.5) / (w + 1)))
        i = j + 1
    best, out = 0.0, []
    for a, p in knots:
        best = max(best, p)
        out.append((a, best))
    return out


def test_quality(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["doc_id"] in docs}
    stats = {d: np.array(statistics(t)) for d, t in docs.items()}
    learn = [d for d in labels if fold(d, 5) in (1, 2, 3)]
    rows = np.array([stats[d] for d in learn])
    mean, scale = rows.mean(axis=0), np.maximum(rows.std(axis=0), 1e-6)
    rng = np.random.default_rng(7)
    directions, phases = rng.normal(0, 1 / math.sqrt(18), (18, 128)), rng.uniform(0, 2 * math.pi, 128)

    def features(s):
        z = np.clip((s - mean) / scale, -6, 6)
        return np.array([math.cos(z @ directions[:, j] + phases[j]) * math.sqrt(2 / 128) for j in range(128)] + [1.0])

    x, y = np.array([features(stats[d]) for d in learn]), np.array([labels[d] for d in learn], float)
    # Ridge regression as least squares on rows with the penalty added as rows.
    penalty = math.sqrt(1e-4 * len(learn)) * np.eye(129)
    weights = np.linalg.lstsq(np.vstack([x, penalty]), np.concatenate([y, np.zeros(129)]), rcond=None)[0]
    ridge = {d: float(features(s) @ weights) for d, s in stats.items()}
    bins = {}
    for d in labels:
        if fold(d, 5) == 4:
            k = int(min(max((ridge[d] + 0.5) * 512, 0), 1023))
            g, n = bins.get(k, (0, 0))
            bins[k] = (g + labels[d], n + 1)
    order = sorted(bins)
    knots = monotone([(k + 0.5) / 512 - 0.5 for k in order], [bins[k][0] for k in order], [bins[k][1] for k in order])
    found = {r["doc_id"]: r for r in queries.op6_quality(spark, SF).collect()}
    assert found.keys() == docs.keys()
    for d, r in found.items():
        want = float(np.interp(ridge[d], *zip(*knots, strict=True)))
        assert abs(r["score"] - want) < 1e-5 and r["held_out"] == (fold(d, 5) == 0) and (r["predicted"] == int(want >= 0.3) or abs(want - 0.3) < 1e-5)


def grams(text):
    """Hashed 1- to 3-grams with their counts; None without a letter."""
    chars = []
    for c in (text or "").lower():
        if c.isalpha():
            chars.append(ord(c))
        elif not chars or chars[-1] != 32:
            chars.append(32)
    if not any(c != 32 for c in chars):
        return None
    # A run of other characters at an end is one space, beside the one that is always put there.
    chars = [32, *chars, 32]
    out = {}
    mask, shift = (1 << 32) - 1, 17
    for i, c in enumerate(chars):
        h = c * 0x9E3779B1 & mask
        keys = [h >> shift]
        if i + 1 < len(chars):
            h = (h ^ chars[i + 1]) * 0x85EBCA6B & mask
            keys.append(h >> shift)
            if i + 2 < len(chars):
                keys.append(((h ^ chars[i + 2]) * 0xC2B2AE35 & mask) >> shift)
        for k in keys:
            out[k] = out.get(k, 0) + 1
    return out


def shares(z):
    e = [math.exp(v - max(z)) for v in z]
    return [v / sum(e) for v in e]


def test_language(spark):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    known = [(d, g, lang) for d, t, lang in docs if lang is not None and fold(d, 4) != 2 and (g := grams(t)) is not None]
    languages = sorted({lang for d, _, lang in docs if lang is not None and fold(d, 4) != 2})
    df = {}
    for _, g, _ in known:
        for k in g:
            df[k] = df.get(k, 0) + 1

    def vector(g):
        x = {k: (1 + math.log(c)) * (math.log((len(known) + 1) / (df.get(k, 0) + 1)) + 1) for k, c in g.items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        return {k: v / size for k, v in x.items()}

    order = sorted(known, key=lambda r: (r[0] * 0x9E3779B97F4A7C15 % (1 << 64), languages.index(r[2])))
    kept, train = order[::5], [r for i, r in enumerate(order) if i % 5]
    z, n, m = {}, {}, len(languages)

    def weight(k):
        zs, ns = z.get(k, [0.0] * m), n.get(k, [0.0] * m)
        return [0.0 if abs(a) <= 0.02 else -(a - math.copysign(0.02, a)) / ((1 + math.sqrt(b)) / 0.3 + 0.01) for a, b in zip(zs, ns, strict=True)]

    def logits(x, w):
        return [sum(v * w[k][j] for k, v in x.items()) for j in range(m)]

    vectors = [(vector(g) | {-1: 1.0}, languages.index(lang)) for _, g, lang in train]
    for _ in range(3):
        for x, y in vectors:
            w = {k: weight(k) for k in x}
            p = shares(logits(x, w))
            p[y] -= 1
            for k, v in x.items():
                zs, ns = z.setdefault(k, [0.0] * m), n.setdefault(k, [0.0] * m)
                for j in range(m):
                    g = v * p[j]
                    zs[j] += g - (math.sqrt(ns[j] + g * g) - math.sqrt(ns[j])) / 0.3 * w[k][j]
                    ns[j] += g * g

    def of(g):
        x = vector(g) | {-1: 1.0}
        return logits(x, {k: weight(k) for k in x})

    held = [(of(g), languages.index(lang)) for _, g, lang in kept]
    grid = [float(t) for t in np.geomspace(0.02, 5, 60)]
    loss = [sum(-math.log(max(shares([v / t for v in zs])[y], 1e-12)) for zs, y in held) for t in grid]
    temperature = grid[loss.index(min(loss))]
    found = {r["doc_id"]: r for r in queries.op10_language(spark, SF).collect()}
    assert len(found) == len(docs) and language.DIMENSIONS == 1 << 15
    for d, text, _ in docs:
        g = grams(text)
        want = ("und", 0.0) if g is None else max(zip(languages, shares([v / temperature for v in of(g)]), strict=True), key=lambda r: r[1])
        assert found[d]["lang_pred"] == want[0] and abs(found[d]["score"] - want[1]) < 1e-3, (d, found[d], want)
    assert quality.STATISTICS[0] == "log_words"
