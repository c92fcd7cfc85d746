"""Mixing, near duplicates and substring dedup against brute force, and the pipeline's stages."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import Row
from pyspark.sql import functions as F

from strandlake.llm import components, jaccard_join, mixing, substring_dedup
from strandlake.llm.queries import BPE_RANKS

RNG = random.Random(5)
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


def corpus():
    """Copies, near copies, a passage that many share, empty and short texts, repeated ids, a null id and a null text."""
    passage, base, out = prose(60), prose(300), []
    for i in range(60):
        kind = i % 6
        if kind == 0:
            ws = prose(RNG.randint(1, 120))
        elif kind == 1:
            ws = prose(30) + passage + prose(RNG.randint(0, 40))
        elif kind == 2:
            ws = list(base)
            for _ in range(RNG.randint(0, 9)):
                ws[RNG.randrange(300)] = RNG.choice(VOCABULARY)
        elif kind == 3:
            ws = base[:290] + prose(RNG.randint(0, 12))
        elif kind == 4:
            ws = prose(RNG.choice([1, 2, 3, 9, 10, 49, 50, 51]))
        else:
            ws = list(passage)
        out.append((1000 - 7 * i, " ".join(ws)))
    out += [(5, None), (6, ""), (7, " \n\t"), (8, "One two"), (9, "one TWO"), (10, "One  two"), (11, "a b"), (11, " ".join(base)), (out[2][0], out[2][1]), (None, " ".join(passage)), (None, "null one here"), (3, "ONE")]
    return out


@pytest.fixture(scope="module")
def docs():
    return corpus()


def frame(spark, docs):
    return spark.createDataFrame([Row(doc_id=i, text=t, lang="x", source=f"s{k % 3}" if k % 5 else None, n_chars=1, c1="clash", rep="clash", keys="clash") for k, (i, t) in enumerate(docs)])


def gram_sets(docs, n):
    out = []
    for i, t in docs:
        ws = [w.lower() for w in (t or "").encode().split()]
        out.append({tuple(ws[p : p + n]) for p in range(len(ws) - n + 1)} if len(ws) >= n else {tuple(ws)} if ws else set())
    return out


def brute_components(docs, n, percent):
    sets, big = gram_sets(docs, n), 1 << 62
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                up[find(a)] = find(b)
    least = defaultdict(lambda: big)
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(least[find(k)], big if i is None else i)
    return sorted((i is None, i or 0, len(sets[k]), -1 if least[find(k)] == big else least[find(k)]) for k, (i, _) in enumerate(docs))


@pytest.mark.parametrize("n,percent,family", [(3, 90, 20_000), (5, 80, 20_000), (3, 90, 1)])
def test_components_are_those_of_all_pairs(spark, docs, n, percent, family, monkeypatch):
    if family == 1:  # groups instead of families, and blocks of a few sets
        monkeypatch.setattr(jaccard_join, "BLOCK", 3)
        monkeypatch.setattr(jaccard_join, "FEW", 2)
    got = jaccard_join.near_duplicates(frame(spark, docs), n, percent, family=family).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == brute_components(docs, n, percent)


@pytest.mark.parametrize("n,percent", [(5, 80), (3, 90)])
def test_one_row_of_each_component_stays(spark, docs, n, percent):
    df = frame(spark, docs)
    out = jaccard_join.one_of_each_group(df, n, percent)
    assert out.columns == df.columns
    sets = gram_sets(docs, n)
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                up[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(docs)):
        groups[find(k)].append(k)
    want = Counter(min(((docs[k][0] is None, docs[k][0] or 0) for k in members)) for members in groups.values())
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == want
    # a second time nothing more goes
    again = spark.createDataFrame(out.collect(), df.schema)
    assert jaccard_join.one_of_each_group(again, n, percent).count() == sum(want.values())
    assert jaccard_join.one_of_each_group(df.limit(0), n, percent).count() == 0


def rows_of_joins(spark, on):
    """Output rows of all joins so far whose keys are columns named `on` on both sides and that have no further condition."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, out = spark._jsparkSession.sharedState().statusStore(), {}
    runs = store.executionsList()
    for i in range(runs.size()):
        k = runs.apply(i).executionId()
        nodes, values = store.planGraph(k).allNodes(), store.executionMetrics(k)
        for j in range(nodes.size()):
            node = nodes.apply(j)
            if re.match(rf"\w+Join(\(skew=true\))? \[{on}#\d+L?\], \[{on}#\d+L?\], Inner(, Build\w+, false)?$", node.desc()):
                for m in (node.metrics().apply(x) for x in range(node.metrics().size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        out[k, m.accumulatorId()] = int(values.apply(m.accumulatorId()).replace(",", ""))
    return sum(out.values())


def test_a_set_is_joined_by_its_unit_once(spark):
    # one family of texts that share fragments and are not linked
    rng = random.Random(9)
    base, texts = rng.choices(VOCABULARY, k=300), []
    for _ in range(40):
        ws = list(base)
        for at in rng.sample(range(300), 12):
            ws[at] = rng.choice(VOCABULARY)
        texts.append(" ".join(ws))
    before = rows_of_joins(spark, "unit")
    jaccard_join.near_duplicates(frame(spark, list(enumerate(texts))), 5, 80).collect()
    assert 0 < rows_of_joins(spark, "unit") - before <= len(texts)


def test_sets_with_little_in_common_share_no_key():
    import numpy as np

    rng = np.random.default_rng(8)
    cut = jaccard_join.Cutting(80)
    sets = [np.unique(rng.integers(0, 2**64 - 1, 150, dtype=np.uint64)) for _ in range(4000)]
    assert np.unique(np.concatenate([cut.keys(s) for s in sets]), return_counts=True)[1].max() <= 3
    # nor is a link lost of sets that differ in one element of every fragment but those that are empty in both
    odd, cut = 0, jaccard_join.Cutting(60)
    for _ in range(2000):
        a = np.unique(rng.integers(0, 2**64 - 1, int(rng.integers(4, 60)), dtype=np.uint64))
        n = cut.fragments[cut.scheme(len(a))]
        part = (a >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
        gone, more = [], []
        for f in np.unique(part).tolist():
            if rng.random() < 0.5:
                gone.append(int(rng.choice(np.flatnonzero(part == f))))
            else:
                more.append((f << 64) // n + int(rng.integers(1, 2**40)))
        b = np.unique(np.concatenate([np.delete(a, gone), np.array(more, np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 60 * (len(a) + len(b) - common):
            shared = np.intersect1d(cut.keys(a), cut.keys(b))
            assert len(shared)
            odd += bool((shared & np.uint64(1)).all())
    assert odd > 50


def test_keys_meet_whenever_sets_are_linked():
    import numpy as np

    rng = np.random.default_rng(6)
    for percent in (90, 80):
        cut = jaccard_join.Cutting(percent)
        for _ in range(400):
            n = int(rng.integers(5, 120))
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            d = (100 - percent) * 2 * n // (100 + percent)
            b = np.unique(np.concatenate([a[int(rng.integers(0, d + 1)) :], rng.integers(0, 2**63, int(rng.integers(0, d + 1)), dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if len(a) != len(b) or (a != b).any():
                if 100 * common >= percent * (len(a) + len(b) - common):
                    assert len(np.intersect1d(cut.keys(a), cut.keys(b)))


def test_connected_components(spark):
    pairs = [(i, i + 1) for i in range(10, 60) if i % 17] + [(5, 59), (100, 101), (101, 102), (100, 102), (7, 7)]
    got = {r.node: r.label for r in components.components(spark, spark.createDataFrame(pairs, "a long, b long")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    assert got == {x: find(x) for x in list(up) if find(x) != x}


def brute_dedup(docs, window):
    big = 1 << 62
    first = {}
    for i, t in docs:
        ws = (t or "").encode().split()
        for p in range(len(ws) - window + 1):
            k = tuple(ws[p : p + window])
            first[k] = min(first.get(k, big), big if i is None else i)
    out = []
    for i, t in docs:
        ws = (t or "").encode().split()
        covered = [False] * len(ws)
        for p in range(len(ws) - window + 1):
            if first[tuple(ws[p : p + window])] < (big if i is None else i):
                covered[p : p + window] = [True] * window
        kept = [w for w, c in zip(ws, covered) if not c]
        out.append((i is None, i or 0, len(ws), len(ws) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), b" ".join(kept).decode()))
    return out


def test_removed_words_are_those_of_all_windows(spark, docs):
    got = substring_dedup.removed_words(frame(spark, docs)).collect()
    want = brute_dedup(docs, 50)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(w[:5] for w in want)
    assert any(0 < w[3] < w[2] for w in want)


def test_texts_without_repeats(spark, docs):
    df = frame(spark, docs)
    out = substring_dedup.without_repeats(df)
    assert out.columns == df.columns
    want = Counter((i, t if not w[3] else w[5]) for (i, t), w in zip(docs, brute_dedup(docs, 50)) if not w[2] or w[3] < w[2])
    assert Counter((r.doc_id, r.text) for r in out.collect()) == want


def brute_targets(sizes, most=3):
    """Targets by source from the words of each."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        new = {s for s in names if s not in capped and left * weight[s] / w > most * sizes[s]} if w else set()
        if not new:
            return {s: float(most * sizes[s]) if s in capped else left * weight[s] / w for s in names}
        capped |= new


@pytest.mark.parametrize("block", [1, 16, 256])
def test_mix_meets_its_targets(spark, docs, block):
    df = frame(spark, docs)
    rows = df.select("doc_id", "text", "source").collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len((r.text or "").encode().split())
    out = mixing.mix(df, block=block).collect()
    assert len(out) == len(rows)
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source_size, round(r.target, 6)] += r.taken
    assert sorted(taken) == sorted({(sizes[s], round(want[s], 6)) for s in want})
    for (_, t), n in taken.items():
        assert abs(n - t) < 1


def test_mix_is_the_same_again_and_takes_odd_sources(spark):
    rows = [(i, " ".join(["w"] * (i % 7)), s) for i, s in enumerate(["é", "z", None, "a", "tiny"] * 8)] + [(100, "w " * 500, "big"), (101, None, "none"), (None, "x y", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = (sorted(map(str, mixing.mix(df, block=4).collect())) for _ in range(2))
    assert a == b and len(a) == len(rows)
    out = mixing.mixed_rows(df, block=4)
    assert out.columns == df.columns and out.filter("text IS NULL").count() == 0
    assert mixing.mix(df.limit(0)).count() == 0


def test_rows_come_as_often_as_they_are_taken(spark):
    rows = [(1, "a b c d", "p"), (1, "e f g h", "q"), *((k, "w " * 40, "q") for k in range(2, 30)), (50, "x y z", None), (50, "x y z", None), (None, "u v", "q"), (None, "v u", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("row", F.lit("clash"))
    taken = defaultdict(int)
    for r in mixing.mix(df, block=4).collect():
        taken[r.doc_id, r.source, r["size"]] += r.taken
    got = defaultdict(int)
    for r in mixing.mixed_rows(df, block=4).collect():
        got[r.doc_id, r.source, len(r.text.split())] += 1
    assert {k: n for k, n in got.items()} == {k: int(t / k[2] + 0.5) for k, t in taken.items() if t / k[2] >= 0.5}
    assert got[1, "p", 4] == 3  # a small source stops at three times its words
    assert mixing.mixed_rows(df.limit(0)).count() == 0


def test_low_discrepancy_of_the_schedule(spark):
    """Any stretch of slots holds each source in proportion, to a few slots."""
    sources = spark.createDataFrame([(0, 500.0), (1, 300.0), (2, 200.0)], "sid int, target double")
    plan = sorted((r.slot, r.sid, r["rank"]) for r in mixing.schedule(spark, sources, 1000.0, 1).collect())
    assert [p[0] for p in plan] == list(range(1000))
    seen = Counter()
    for _, sid, rank in plan:
        assert rank == seen[sid]
        seen[sid] += 1
    for lo in range(0, 900, 50):
        for n in (50, 100):
            part = Counter(p[1] for p in plan[lo : lo + n])
            assert all(abs(part[s] - n * w) <= 4 for s, w in ((0, 0.5), (1, 0.3), (2, 0.2)))


def test_taken_words_of_every_document(spark):
    """taken by document against streams laid out in Python: each source's documents in the order of their keys, its goal going
    round its blocks from the first."""
    rows = [(i, " ".join(["w"] * (i * 7 % 23)), "abc"[i % 3] if i % 5 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = mixing.sizes(df, "doc_id", "text", "source").collect()
    sizes = defaultdict(int)
    for r in sized:
        sizes[r.source] += r["size"]
    goals = {s: round(t) for s, t in brute_targets(sizes).items()}
    n_buckets = max(1, len(rows) // mixing.BUCKET)
    want = {}
    for s in sizes:
        own = sorted((r for r in sized if r.source == s and r["size"]), key=lambda r: (((r.key >> 8) % n_buckets), r.key, r.doc_id, r["size"]))
        at = 0
        for r in own:
            whole, rest = divmod(goals[s], sizes[s])
            want[r.doc_id] = whole * r["size"] + max(0, min(at + r["size"], rest) - at)
            at += r["size"]
    got = {r.doc_id: r.taken for r in mixing.mix(df, block=1).collect() if r["size"]}
    assert got == want


def test_empty_tables(spark, docs):
    none = frame(spark, docs).limit(0)
    assert jaccard_join.near_duplicates(none).count() == 0
    assert substring_dedup.removed_words(none).count() == 0


def library_of(name):
    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_stages_on_empty_tables_and_odd_rows(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, row string"
    odd = [(1, None, None, None, None, "x"), (2, "", "en", "a", 0, "x"), (2, "", "en", "a", 0, "x"), (None, "same words here " * 30, "en", None, 1, "x"), (3, "same words here " * 30, None, "b", 1, "x"), (4, "w " * 60_000, "en", "b", 1, "x"), (4, "w " * 60_000, "en", "b", 1, "x")]
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if k == len(corpus_pipeline.STAGES) - 1:
                assert out.count() == docs.count()
                break
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
        assert rows == [] or {r.doc_id for r in docs.collect()} == {3, 4}


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "source mix", "byte-level BPE"]
    sf = "/root/testdata/sf0.001"
    raw = spark.read.parquet(f"{sf}/documents.parquet")
    docs, before = raw, None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        docs = stage(spark, docs, sf)
        assert docs.columns == raw.columns
        docs = spark.createDataFrame(docs.collect(), raw.schema)
        assert before is None or docs.count() <= before
        before = docs.count()
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, sf)
    assert mixed.columns == raw.columns
    taken = {r.doc_id: int(r.taken / r["size"] + 0.5) for r in mixing.mix(docs).collect() if r["size"]}
    assert Counter(r.doc_id for r in mixed.collect()) == {k: n for k, n in taken.items() if n}
    tokens = corpus_pipeline.STAGES[4][1](spark, mixed, sf).collect()
    texts = dict(kept)
    enc = library_of(BPE_RANKS)
    assert len(tokens) == mixed.count() and all(r.n_tokens == len(r.ids) and r.ids == enc.encode_ordinary(texts[r.doc_id]) for r in tokens)
    assert all(w[3] == 0 for w in brute_dedup(kept, 50))  # nothing repeats any more
    assert len({c[3] for c in brute_components(kept, 5, 80)}) == len(kept)
