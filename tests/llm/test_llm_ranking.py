"""Importance resampling, SimHash and lexical search against brute force, with odd rows and long texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from strandlake.llm import importance, lexical_search, simhash

RNG = random.Random(11)
SCHEMA = "doc_id bigint, text string, q bigint, fp string, rank string, part int, `row` string, `a b` string"
VOCABULARY = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(1, 6))) for _ in range(150)] + ["Ünïcode", "日本語", "x9", "Q", "z" * 70, "Y" * 64]


def prose(n, vocabulary=VOCABULARY):
    return [RNG.choice(vocabulary) for _ in range(n)]


def corpus():
    """Prose of all lengths, copies, texts that differ in a word, null and empty texts, repeated rows and ids, a null id, a long text."""
    base = prose(120)
    out = [(1000 - 3 * i, RNG.choice([" ", ", ", "\n", "-"]).join(prose(RNG.choice([1, 2, 3, 5, 19, 20, 21, 60, 200])))) for i in range(120)]
    for i in range(60):
        ws = list(base)
        for _ in range(RNG.randint(0, 2)):
            ws[RNG.randrange(120)] = RNG.choice(VOCABULARY)
        out.append((2000 + i, " ".join(ws)))
    out += [(1, None), (2, ""), (3, " \n.,-"), (4, "One TWO three"), (4, "one two Three"), (5, out[3][1]), (out[3][0], out[3][1]), (None, " ".join(base)), (-7, " ".join(base)), (6, "a" * 3000 + " b")]
    out.append((7, " ".join(prose(30_000))))
    return out


@pytest.fixture(scope="module")
def docs():
    return corpus()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "x", 1, "x", "x") for i, t in rows], SCHEMA).repartition(3)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- importance resampling


def features(text, n=2):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return len(ws), [" ".join(ws[i : i + k]) for k in range(1, n + 1) for i in range(len(ws) - k + 1)]


def plain_resample(docs, target, percent, least, buckets, seed):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    each = [(i, *features(t)) for i, t in docs]
    s, t = Counter(of(f) for _, _, fs in each for f in fs), Counter(of(f) for _, x in target for f in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, n, fs in each:
        gain = [math.floor(1000 * math.log((t[of(f)] + 1) * (S + buckets) / ((s[of(f)] + 1) * (T + buckets)))) for f in fs]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, n, len(fs), weight, score, None])
    pool = sorted((r for r in out if r[1] >= least and r[4] is not None), key=lambda r: (-r[4], r[0]))
    for k, r in enumerate(pool[: len(pool) * percent // 100]):
        r[5] = k + 1
    return out


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


@pytest.mark.parametrize("percent,least,buckets,seed", [(25, 20, 10_000, 7), (60, 1, 13, 3)])
def test_importance(spark, docs, percent, least, buckets, seed):
    target = [(k, " ".join(prose(30))) for k in range(12)] + [(99, None), (98, "")]
    out = importance.resample(frame(spark, docs), frame(spark, target), percent, least, buckets, seed)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    want = plain_resample(docs, target, percent, least, buckets, seed)
    got = [tuple(r) for r in out.collect()]
    # ranks of rows of one id that repeat may be exchanged, also with being drawn or not
    assert sorted((tuple(r[:5]) for r in got), key=key) == sorted((tuple(r[:5]) for r in want), key=key)
    drawn = lambda rows: sorted((r[5], r[0], r[4]) for r in rows if r[5] is not None)
    assert drawn(got) == drawn(want)
    kept = importance.drawn_rows(frame(spark, docs), frame(spark, target), percent, least, buckets, seed)
    assert kept.columns == ["doc_id", "text", "q", "fp", "rank", "part", "row", "a b"]
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in want if r[5] is not None}


def test_importance_in_pieces(spark, monkeypatch):
    """Pieces of long texts give the features of the whole."""
    texts = ["".join(RNG.choice(["ab ", "Cd", " ", "é", ".", "x" * 80, "日"]) for _ in range(RNG.randint(0, 300))) for _ in range(60)] + [None, ""]
    for step in (1, 7, 64, 1 << 22):
        monkeypatch.setattr(importance, "STEP", step)
        import pyarrow as pa

        for col in (pa.array(texts), pa.array(["skip", *texts])[1:]):
            found = [[] for _ in texts]
            for a, _, row, of, _ in importance.bucketed(col, 1 << 32):
                for r, x in zip(row.tolist(), of.tolist()):
                    found[a + r].append(x)
            assert [sorted(x) for x in found] == [sorted(zlib.crc32(f.encode()) for f in features(t)[1]) for t in texts]


def test_importance_empty(spark):
    none = frame(spark, []).limit(0)
    some = frame(spark, [(1, "a b " * 20)])
    assert importance.resample(none, some).count() == 0 and importance.drawn_rows(none, some).count() == 0
    assert [r["weight"] for r in importance.resample(some, none).collect()] == plain_resample([(1, "a b " * 20)], [], 25, 20, 10_000, 7)[0][3:4]


# --- near duplicates by SimHash


def plain_fingerprint(text, n=3, seed=42):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered(text)) if w]
    grams = [" ".join(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))] if ws else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, distance):
    """Least fingerprint in reach by links."""
    todo, label = sorted(set(fps)), {}
    for start in todo:
        if start in label:
            continue
        label[start], queue = start, [start]
        while queue:
            x = queue.pop()
            for y in todo:
                if y not in label and (x ^ y).bit_count() <= distance:
                    label[y] = start
                    queue.append(y)
    return label


@pytest.mark.parametrize("distance", [2, 3])
def test_simhash(spark, docs, distance):
    df = frame(spark, docs)
    fps = [(i, plain_fingerprint(t)) for i, t in docs]
    label = plain_components([f for _, f in fps], distance)
    least = defaultdict(list)
    for i, f in fps:
        if i is not None:
            least[label[f]].append(i)
    want = [(i, f"{f:016x}", min(least[label[f]])) for i, f in fps]
    got = simhash.near_duplicates(df, distance)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert len(set(f for _, f in fps)) > len(set(label.values())) > 20
    if distance == 2:
        rest = simhash.one_of_each(df, distance)
        assert rest.columns == df.columns and sorted(r["doc_id"] for r in rest.collect()) == sorted(i for i, _, c in want if i == c)


@pytest.mark.parametrize("small,distance", [(3, 2), (256, 3)])
def test_links_of_crowded_halves(spark, small, distance):
    """Fingerprints of few different halves, so that groups are split two and three times; no pair within reach is lost."""
    few = [RNG.getrandbits(32) for _ in range(3)]
    near = lambda x, k: x ^ sum(1 << b for b in RNG.sample(range(32), k))
    values = {near(RNG.choice(few), RNG.randint(0, 2)) << 32 | near(RNG.choice(few), RNG.randint(0, 2)) for _ in range(400)}
    values |= {few[0] << 32 | x for x in range(300)} | {0, (1 << 64) - 1, 1 << 63, 3}
    rows = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in rows]
    fps = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    got = {frozenset((r["a"], r["b"])) for r in simhash.links(fps, distance, small).collect()}
    x = np.array(rows, np.uint64)
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= distance)
    assert got == {frozenset((signed[a], signed[b])) for a, b in zip(i.tolist(), j.tolist()) if a < b}


def test_simhash_empty(spark):
    assert simhash.near_duplicates(frame(spark, []).limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp bigint"), 4)


# --- ranked lexical search


def plain_search(docs, items, k, b=90, s=8):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))
    each = [(i, Counter(terms(t))) for i, t in docs]
    each = [(i, c, sum(c.values())) for i, c in each if c]
    N, L, df = len(each), sum(n for *_, n in each), Counter(t for _, c, _ in each for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, ts in asked.items():
        found = []
        for i, c, n in each:
            m = 100 - b + b * n * N // L
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + s * m)) for t in ts if c[t])
            if score > 0 and i is not None:
                found.append((-score, i))
        out += [(item, r + 1, i, -x) for r, (x, i) in enumerate(sorted(found)[:k])]
    return out


@pytest.mark.parametrize("block,pairs", [(256, 200_000), (4, 60)])
def test_search(spark, docs, monkeypatch, block, pairs):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", block)
    items = [(k, " ".join(prose(RNG.choice([1, 3, 12, 40])))) for k in range(25)] + [(3, "Q more terms"), (50, None), (51, "..."), (52, "nowhere-tobefound"), (None, "x9 abc"), (53, docs[7][1]), (53, docs[7][1])]
    got = lexical_search.search(frame(spark, docs), frame(spark, items).withColumnRenamed("doc_id", "item_id"), 10, pairs=pairs)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_search(docs, items, 10), key=key)


def test_bounds_hold_and_prune(spark, docs):
    """No score is above its block's bound, and the line spares blocks."""
    rows = sorted(docs[:120], key=lambda r: len(r[1])) * 2
    vocabulary = {t.encode(): k for k, t in enumerate(sorted({w for _, t in rows for w in map(bytes.decode, lexical_search.terms_of(t))}))}
    forward = lexical_search.forward_pass(spark.createDataFrame(rows, "id bigint, text string").coalesce(1), vocabulary).collect()
    assert sum(r["n_docs"] for r in forward) == len(rows)
    n_docs, n_terms = sum(r["n_docs"] for r in forward), sum(r["n_terms"] for r in forward)
    blocks = lexical_search.maxima_pass(spark.createDataFrame(forward, lexical_search.BLOCKS), lexical_search.Scoring(), n_docs, n_terms).collect()
    rng = np.random.default_rng(3)
    q = lexical_search.Queries(np.sort(rng.choice(len(vocabulary), 12, False)), rng.integers(0, 5000, 12), np.array([0, 5, 12]), len(vocabulary))
    for b in blocks:
        counts = np.array(b["counts"])
        bound = q.bounds(np.array(b["at"]), np.array(b["most"]))
        for k in (0, 1):
            s = q.scores(k, np.array(b["terms"]), np.array(b["impact"]), np.cumsum(counts) - counts, np.zeros(len(vocabulary), np.int64))
            assert s.max() <= bound[k]


def test_search_empty(spark, docs):
    none = frame(spark, []).limit(0)
    assert lexical_search.search(none, frame(spark, docs[:3]).withColumnRenamed("doc_id", "item_id")).count() == 0
    out = lexical_search.search(frame(spark, docs), none.withColumnRenamed("doc_id", "item_id"))
    assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical_search.search(frame(spark, [(1, None)]), frame(spark, docs[:3]).withColumnRenamed("doc_id", "item_id")).count() == 0


def test_impact_beyond_64_bits():
    s = lexical_search.Scoring()
    tf, size = np.array([1, 50]), np.array([10, 10**9])
    got = s.impact(tf, size, 10**11, 10**14)
    assert got.tolist() == [10**9 * t // (1000 * t + 8 * (10 + 90 * n * 10**11 // 10**14)) for t, n in zip([1, 50], [10, 10**9])]
