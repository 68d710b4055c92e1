"""Operators on documents against brute force, on rows with every odd case."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from adagium.llm import byte_bpe, decontaminate, maxent_lm, near_dup, ordinal_quality, quality_rules, substring_dedup
from tests.llm.cases import edge_docs, frame

WORD = re.compile("[^\x20\x09-\x0d]+")


def split(t):
    return WORD.findall(t or "")


@pytest.fixture(scope="module")
def rows():
    return edge_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


def counted(values):
    return Counter(map(tuple, values))


# ---- quality rules ---------------------------------------------------------------------------


def slow_stats(t):
    w = split(t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    cover = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if split(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(cover)


def test_quality_statistics(docs, rows):
    got = quality_rules.judge(docs.select("doc_id", "text", "lang", "source")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = []
    for d, t, *_ in rows:
        s = slow_stats(t)
        want.append((d, *s, s[0] < 10 or 100 * s[4] > 20 * s[0]))
    assert counted(r[:7] for r in got) == counted(want)
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_quality_fences_follow_the_group(spark):
    text = "these are plain words of an ordinary line that everyone would keep number {}"
    rows = [(i, text.format(i), "en", "s") for i in range(100)] + [(100, text.format("###### ") * 1 + "###### " * 40 + " ".join(f"u{i}" for i in range(30)), "en", "s")]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(frame(spark, rows)).collect()}
    assert all(got[i] for i in range(100)) and not got[100]


def test_quality_limits_are_the_groups_own(spark):
    """19 symbols per 100 words: rejected among texts without any, kept among texts that all have some."""
    words = lambda i, n: " ".join(f"word{i}x{k}" + "#" * (k < n) for k in range(100))
    rows = [(i, words(i, 0), "en", "plain") for i in range(100)] + [(100, words(100, 19), "en", "plain")] + [(200 + i, words(i, i % 30), "en", "code") for i in range(100)] + [(300, words(300, 19), "en", "code")]
    got = {r["doc_id"]: r for r in quality_rules.judge(frame(spark, rows)).collect()}
    assert not got[100]["kept"] and all(got[i]["kept"] for i in [*range(100), *range(200, 300), 300])
    assert got[100]["limit_symbol_share"] < 1900 < got[300]["limit_symbol_share"]


def test_sketches_merge(spark, docs):
    stats = quality_rules.document_stats(docs)
    whole = {tuple(r)[:4]: r["n"] for r in quality_rules.quantile_sketches(stats).collect()}
    parts = Counter()
    for half in (stats.filter("doc_id % 2 = 0 or doc_id is null"), stats.filter("doc_id % 2 = 1")):
        for r in quality_rules.quantile_sketches(half).collect():
            parts[tuple(r)[:4]] += r["n"]
    assert whole == dict(parts)


# ---- substring dedup -------------------------------------------------------------------------


def slow_dedup(rows, window):
    big = 1 << 62
    texts = [(big if d is None else d, split(t)) for d, t, *_ in rows]
    first = {}
    for d, w in texts:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for (d, w), row in zip(texts, rows):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d, i):
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((row[0], len(w), len(gone), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
    return out


def test_substring_dedup(docs, rows):
    got = substring_dedup.dedup(docs, window=20, start=10, chunk_chars=20_000).select("doc_id", "__n_words", "__n_removed", "__kept_sha256").collect()
    want = slow_dedup(rows, 20)
    assert counted(got) == counted(want)
    assert sum(r["__n_removed"] for r in got) > 200


def test_substring_dedup_rewrites_and_keeps_columns(docs, rows):
    got = substring_dedup.dedup(docs, window=20, start=5)
    assert set(docs.columns) <= set(got.columns) and {(r["__id"], r["__text"], r["chunk"]) for r in got.collect()} == {("x", 1, "c")}
    by = {r["doc_id"]: r for r in got.filter("doc_id in (106, 107)").collect()}
    assert by[106]["text"] == dict((r[0], r[1]) for r in rows)[106] and by[107]["text"] == "another start"


def test_windows_of_words_that_look_alike(spark):
    """19 equal words before two different words: nothing repeats for 20 words."""
    got = substring_dedup.dedup(frame(spark, [r for r in edge_docs() if r[0] in (114, 115, 116, 117)]))
    assert {r["doc_id"]: r["__n_removed"] for r in got.collect()} == {114: 0, 115: 0, 116: 0, 117: 0}


def test_levels_until_nothing_repeats(docs):
    lengths = substring_dedup.repeat_lengths(docs.filter("doc_id in (106, 107)"), start=10)
    assert lengths == [(10, 51), (20, 41), (40, 21)]


# ---- near duplicates -------------------------------------------------------------------------


def slow_similarity(a, b):
    p = [0] * (len(b) + 1)
    for x in a:
        c = [0]
        for j, y in enumerate(b):
            c.append(p[j] + 1 if x == y else max(c[-1], p[j + 1]))
        p = c
    return p[-1] / (len(a) + len(b) - p[-1])


def test_alignment_equals_full_dynamic_programme():
    rng = np.random.default_rng(5)
    for _ in range(400):
        a = list(rng.integers(0, rng.choice([3, 60]), rng.integers(1, 40)))
        b = list(a)
        for _ in range(rng.integers(0, 5)):
            k = int(rng.integers(0, len(b) + 1))
            if rng.random() < 0.5 and len(b) > 1:
                b.pop(min(k, len(b) - 1))
            else:
                b.insert(k, 99)
        s = slow_similarity(a, b)
        got = near_dup.aligned(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64))
        assert got == pytest.approx(s) if s >= 0.8 else got < 0.8


def slow_classes(rows):
    sh = {}
    for d, t, *_ in rows:
        w = split(t)
        if d is not None and w:
            k = min(5, len(w))
            sh[d] = [hash(tuple(w[i : i + k])) for i in range(len(w) - k + 1)]
    up = {d: d for d, *_ in rows if d is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sh)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sh[a], sh[b]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(set(x) & set(y)) >= 0.5 * len(set(x)) and slow_similarity(x, y) >= 0.8:
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {d: find(d) for d in up}


def test_near_duplicate_classes(spark, docs, rows):
    got = near_dup.classes(docs).collect()
    assert len(got) == len(rows)
    want = slow_classes(rows)
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == want
    assert all(r["class_id"] is None for r in got if r["doc_id"] is None)
    assert want[105] == want[104] == 103 and want[109] == 108 and want[101] == 101


@pytest.mark.parametrize("small", [48, 0])
def test_near_duplicate_group_without_common_leader(spark, small):
    """A chain: neighbours are alike, the ends aren't, and nobody is like all others."""
    rng = np.random.default_rng(8)
    base = [f"t{i}" for i in range(300)]
    rows = []
    for k in range(12):
        rows.append((k, " ".join(base), "en", "a"))
        for i in rng.integers(0, 300, 4):
            base[int(i)] = f"n{k}_{i}"
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(frame(spark, rows), small_bucket=small, block_words=900).collect()}
    assert got == slow_classes(rows)


def test_keep_first(docs, rows):
    kept = near_dup.keep_first(docs)
    assert kept.columns == docs.columns and {r["__h"] for r in kept.collect()} == {2}
    ids = [r["doc_id"] for r in kept.collect()]
    assert 103 in ids and 104 not in ids and 105 not in ids and 100 in ids and ids.count(None) == 2
    want = slow_classes(rows)
    assert sorted(i for i in ids if i is not None) == sorted(d for d, c in want.items() if d == c)


def test_keep_first_loses_no_text(spark):
    """Rows share doc_ids and words; (7, b) and (9, c) are unique, (5, e) is unique though (5, d) belongs to 2."""
    rng = np.random.default_rng(3)
    a, b, c, d, e = (" ".join(f"v{x}" for x in rng.integers(0, 900, 80)) for _ in range(5))
    near = d.replace(d.split()[40], "other")
    rows = [(3, a), (7, a), (7, b), (9, c), (9, c), (5, d), (5, e), (2, near), (None, a), (11, ""), (12, None)]
    got = near_dup.keep_first(frame(spark, [(*r, "en", "s") for r in rows])).select("doc_id", "text").collect()
    want = [(3, a), (7, b), (9, c), (5, e), (2, near), (None, a), (11, ""), (12, None)]
    assert counted(got) == counted(want)
    classes = near_dup.classes(frame(spark, [(*r, "en", "s") for r in rows])).select("doc_id", "class_id").collect()
    assert counted(classes) == counted([(3, 3), (7, 3), (7, 7), (9, 9), (9, 9), (5, 2), (5, 5), (2, 2), (None, None), (11, 11), (12, 12)])


# ---- benchmark leaks -------------------------------------------------------------------------


def test_leaks(spark):
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(25)) + "\n" + " ".join(word() for _ in range(8))) for i in range(40)] + [(40, None), (41, ""), (None, "null item text here for nobody"), (7, None)]
    text = {i: t for i, t in items if t}
    filler = lambda n: " ".join(word() for _ in range(n))
    docs = [(1, filler(100) + " " + text[3].replace("\n", " ").upper() + "! " + filler(50)), (2, filler(200)), (3, None), (4, ""), (5, text[5].split("\n")[0]), (6, filler(3000) + " " + text[6] + " " + filler(3000)), (6, text[6]), (None, text[9])]
    d = spark.createDataFrame([(*x, "c", "n") for x in docs], "doc_id long, text string, item_id string, bm25 string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, b).collect()), key=str)
    assert got == sorted([(1, 3), (6, 6), (6, 6), (None, 9)], key=str)
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0 and decontaminate.contaminated(d.limit(0), b).count() == 0
    small = sorted(((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, b, shard_items=7).collect()), key=str)
    assert small == got


def test_leaks_do_not_depend_on_shards(spark):
    """Noisy copies: scores and leaks are the same in one shard and in many."""
    import random

    rng = random.Random(9)
    items = [(i, " ".join(f"v{rng.randrange(250)}" for _ in range(rng.randrange(8, 70))) + "\n" + " ".join(f"v{rng.randrange(250)}" for _ in range(6))) for i in range(60)]
    noisy = lambda t: " ".join(w if rng.random() < 0.93 else f"n{rng.randrange(99)}" for w in t.split())
    docs = [(k, " ".join(f"v{rng.randrange(250)}" for _ in range(60)) + " " + noisy(items[k % 60][1]) + " tail", "en", "s") for k in range(120)]
    d, b = frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    got = [sorted((r["doc_id"], r["item_id"], round(r["bm25"], 6)) for r in decontaminate.contaminated(d, b, **p).collect()) for p in ({}, {"shard_items": 7}, {"shard_chars": 900})]
    assert got[0] == got[1] == got[2] and len(got[0]) > 40
    clean = decontaminate.clean(d, b, shard_items=7)
    assert clean.columns == d.columns and {r["doc_id"] for r in clean.collect()} == set(range(120)) - {x[0] for x in got[0]}


def test_wand_retrieves_what_exhaustive_scoring_does():
    import random

    rng = random.Random(6)
    items = [(i, " ".join(f"v{rng.randrange(300)}" for _ in range(rng.randrange(5, 80)))) for i in range(70)]
    index = decontaminate.Index(items)
    texts = [" ".join(f"v{rng.randrange(400)}" for _ in range(rng.randrange(1, 300))) for _ in range(40)] + [items[5][1], items[9][1] + " tail"]
    ids = index.ids(texts)
    got = index.retrieve(ids)
    size = index.n_blocks * decontaminate.BLOCK
    dense = np.zeros((index.n_terms, size))
    for key, row in zip(index.row_key, index.rows.T):
        b, t = divmod(int(key), index.n_terms)
        dense[t, b * decontaminate.BLOCK : (b + 1) * decontaminate.BLOCK] = row
    for d, found in zip(ids, got):
        want = {}
        for h in range(-(-len(d) // decontaminate.HALF)):
            p = d[h * decontaminate.HALF : (h + 2) * decontaminate.HALF]
            score = dense[np.unique(p[p >= 0])].sum(axis=0)[: len(index.need)]
            for u in np.flatnonzero(score >= index.need - 1e-9):
                want[int(index.unit_item[u])] = max(want.get(int(index.unit_item[u]), 0), score[u])
        assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)


# ---- ordinal quality -------------------------------------------------------------------------


def test_ordinal_quality(spark):
    """Held-out accuracy: a quarter of the labels is kept from training."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = ordinal_quality.grades(labels.filter("doc_id % 4 = 0"))
    scored = ordinal_quality.classify(d, labels.filter("doc_id % 4 <> 0")).join(held, "doc_id").select("grade", "__quality.kept", "__quality.expected_grade").collect()
    kept, mean = defaultdict(list), defaultdict(list)
    for r in scored:
        kept[r["grade"]].append(r["kept"])
        mean[r["grade"]].append(r["expected_grade"])
    assert np.mean(kept[2]) > 0.97 and np.mean(kept[1]) < 0.2 and np.mean(kept[0]) < 0.3
    assert np.mean(mean[2]) > max(np.mean(mean[1]), np.mean(mean[0]))


def slow_features(t):
    """Slots of one text: its words, lower-cased, and their first four and five letters; then bucketed shares."""
    import xxhash

    slot = lambda k: xxhash.xxh32_intdigest(k.encode()) & ((1 << ordinal_quality.BITS) - 1)
    words, out = split(t), set()
    for w in words:
        core = w.lower().strip(ordinal_quality._STRIP)
        out |= {slot(core or w), *[slot(f"\0{core[:k]}") for k in (4, 5) if len(core) > k]}
    n, chars, symbols, dup, rep = slow_stats(t)
    lines, upper, d = sum(bool(split(x)) for x in (t or "").split("\n")), sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in t or ""), max(n, 1)
    share = (0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8)
    values = ((symbols / d, share), (upper / max(chars, 1), share), (dup / max(lines, 1), share), (rep / d, share), (len(set(words)) / d, (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)), (n, (1, 3, 10, 30, 100, 1000, 5000)), (chars / d, (2, 3, 4, 5, 6, 8, 12)), ((t or "").count("!!") / d, share), ((t or "").count("|") / d, share))
    return sorted(out) + [(1 << ordinal_quality.BITS) + 8 * i + sum(v >= c for c in cuts) for i, (v, cuts) in enumerate(values)]


def test_ordinal_features_and_scores_by_hand(spark, docs, rows):
    texts = [r[1] for r in rows]
    doc, slot = ordinal_quality.features(texts)
    for i, t in enumerate(texts):
        assert sorted(slot[doc == i].tolist()) == sorted(slow_features(t))
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    grade = {i: 0 if i % 5 == 0 else 1 + i % 2 for i in range(60)}
    w, cuts = ordinal_quality.fit([(np.array(slow_features(t), dtype=np.int32), grade[d]) for d, t, *_ in sorted((r for r in rows if r[0] in grade), key=lambda r: r[0])])
    got = {r["doc_id"]: r["__quality"] for r in ordinal_quality.classify(docs.filter("doc_id < 60 or doc_id > 109"), labels).collect()}
    for d, t, *_ in rows:
        if d is not None and (d < 60 or d > 109):
            z = sum(float(w[k]) for k in slow_features(t))
            p0, p1 = (1 / (1 + math.exp(-(c - z))) for c in cuts)
            assert got[d]["tail_probability"] == pytest.approx(1 - p1, abs=1e-6) and got[d]["expected_grade"] == pytest.approx((p1 - p0) + 2 * (1 - p1), abs=1e-6)


def test_ordinal_gradient():
    """One step from equal weights moves each weight against the slope of the loss, by finite differences."""
    f = [(np.array([i % 3, 3 + i % 2], dtype=np.int32), (i * 7) % 3) for i in range(60)]
    w, cuts = ordinal_quality.fit(f, epochs=1)
    more, _ = ordinal_quality.fit(f, epochs=8)

    def loss(w, cuts):
        z = np.array([w[x].sum() for x, _ in f], dtype=float)
        p = ordinal_quality.grade_probabilities(z, cuts)
        return -np.log(p[np.arange(len(f)), [g for _, g in f]]).mean()

    assert loss(more, cuts) <= loss(w, cuts) <= loss(np.zeros_like(w), cuts) + 1e-6


def test_ordinal_quality_odd_rows(spark, docs, rows):
    labels = spark.createDataFrame([(i, i % 2, None if i == 4 else 0, "t") for i in range(40)] + [(5, 0, 1, "t"), (None, 1, 0, "t"), (9999, 1, 0, "t")], "doc_id long, quality int, toxic int, text string")
    out = ordinal_quality.classify(docs, labels)
    assert set(docs.columns) < set(out.columns) and out.count() == len(rows)
    none = ordinal_quality.classify(docs, labels.limit(0)).select("__quality.kept").collect()
    assert all(r["kept"] for r in none)
    assert ordinal_quality.classify(docs.limit(0), labels).count() == 0


def test_thresholds_are_ordered():
    f = [(np.array([i % 7, 7 + i % 3], dtype=np.int32), i % 3) for i in range(90)]
    _, cuts = ordinal_quality.fit(f)
    assert cuts[0] < cuts[1]
    p = ordinal_quality.grade_probabilities(np.linspace(-5, 5, 11), cuts)
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()


# ---- language model --------------------------------------------------------------------------


def lm_tokens(t):
    return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)})) + [None]


def test_language_model_base_scores(docs, rows):
    got = maxent_lm.score(docs, chunk_chars=30_000).collect()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    c = Counter(w for d, t, *_ in rows if not held(d) for w in lm_tokens(t))
    n, v = sum(c.values()), len(c)
    want = []
    for d, t, *_ in rows:
        w = lm_tokens(t)
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want.append((str(d), held(d), len(w), sum(c[x] > 0 for x in w), n, round(base, 4)))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == sorted(want)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def trained(d, steps):
    """The model of docs, and the pieces that a brute-force version needs."""
    from pyspark.sql import functions as F

    rows = d.select("doc_id", "text")
    words = rows.select("text").mapInPandas(maxent_lm._words(4), maxent_lm.CELLS).groupBy("bucket").applyInPandas(maxent_lm._summed, maxent_lm.CELLS)
    model = maxent_lm.untrained(words, rows.agg(F.sum(F.length("text"))).first()[0] or 0)
    return model, maxent_lm.train(rows, model, steps)


def slow_paths(model, text, seen=True):
    """Every softmax of a text, one at a time: (rows of the tables, scores of the children, child)."""
    h, e, first = maxent_lm.tokens_of([text])
    ids = model.ids(h)
    ctx = [i if i >= 0 else model.frequent + int(x >> np.uint64(40)) % model.others for i, x in zip(ids.tolist(), h)]
    start = model.frequent + model.others
    one = lambda a, b, salt: int(model.hashed(np.array([a]), np.array([b]), salt)[0])
    for k, i in enumerate(ids.tolist()):
        leaf = i if i >= 0 else model.frequent + (int(e[k]) if seen else maxent_lm.RARE)
        b1, b2 = (ctx[k - j] if k >= j else start for j in (1, 2))
        for at in range(model.offsets[leaf], model.offsets[leaf + 1]):
            node, child = int(model.nodes[at]), int(model.children[at])
            rows = [(0, b1), (1, one(b1, b2, 1)), (2, b2)] if at == model.offsets[leaf] else [(3, one(b1, node, 2)), (4, one(b2, node, 3))]
            x = model.shares[node].astype(float) + sum(model.weights[t][r].astype(float) for t, r in rows)
            yield k, rows, np.exp(x - x.max()) / np.exp(x - x.max()).sum(), child


def test_language_model_gradient_step(spark, rows):
    """One step over all documents against observed and expected counts, summed one softmax at a time."""
    texts = [(r[0], r[1], "en", "s") for r in rows[:25]]
    before, after = trained(frame(spark, texts), (0.5,))
    seen, expected = ([np.zeros(w.shape) for w in before.weights] for _ in range(2))
    for _, t, *_ in texts:
        for _, at, p, child in slow_paths(before, t):
            for k, r in at:
                seen[k][r, child] += 1
                expected[k][r] += p
    for k, w in enumerate(after.weights):
        hit = seen[k].any(axis=1)
        want = np.where(hit[:, None], 0.5 * np.log((seen[k] + 3) / (expected[k] + 3)), 0)
        assert np.abs(w - want).max() < 2e-3


def test_language_model_is_a_distribution_and_learns(spark):
    rng = np.random.default_rng(2)
    left, right = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    d = frame(spark, [(i, " ".join(rng.choice(left if i % 2 else right, 40)), "en", "s") for i in range(400)])
    out = maxent_lm.score(d).filter("held_out").toPandas()
    assert out["score"].sum() > 0.95 * out["base_score"].sum()
    _, model = trained(d, (0.5, 0.4))
    # After one history the probabilities of all 61 known tokens and the unseen slot add up to 1.
    total = 0.0
    for x in [*left, *right, None, "new"]:
        h, e, first = maxent_lm.tokens_of(["a1 a2" + (f" {x}" if x else "")])
        lp = model.log_probabilities(h, e, first, np.arange(len(h)) != 2 if x == "new" else np.ones(len(h), bool))
        total += math.exp(lp[2])
    assert total == pytest.approx(1, abs=1e-5)


def test_language_model_score_of_one_text(spark):
    """A text's score by hand: tree of softmaxes, unigram share, pair and triple counts."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, 50) % 400), "en", "s") for i in range(200)]
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 1]
    learn = [r for r in rows if r not in held]
    d = frame(spark, rows)
    got = {r["doc_id"]: r["score"] for r in maxent_lm.score(d).collect()}
    chars = sum(len(r[1]) for r in rows)
    words = frame(spark, learn).select("text").mapInPandas(maxent_lm._words(4), maxent_lm.CELLS).groupBy("bucket").applyInPandas(maxent_lm._summed, maxent_lm.CELLS)
    model = maxent_lm.train(frame(spark, learn).select("doc_id", "text"), maxent_lm.untrained(words, chars))
    c1, c2, c3 = Counter(), Counter(), Counter()
    for r in learn:
        w = [None, *lm_tokens(r[1])]
        c1.update(w[1:])
        c2.update(zip(w, w[1:]))
        c3.update(zip(w, w[1:], w[2:]))
    for d_, text, *_ in held[:4]:
        w = [None, *lm_tokens(text)]
        lp, total = Counter(), 0.0
        h, e, _ = maxent_lm.tokens_of([text])
        ids = model.ids(h)
        for k, word in enumerate(w[1:]):
            seen = c1[word] > 0
            for at, _, p, child in slow_paths(model, text, seen):
                if at == k:
                    lp[k] += math.log(p[child])
            p = math.exp(lp[k])
            if ids[k] < 0:
                leaf = model.frequent + (int(e[k]) if seen else maxent_lm.RARE)
                p *= (c1[word] + 0.5) / model.mass[leaf]
            for count, history, (a, b) in ((c2[w[k], word], c1[w[k]], maxent_lm.BACKOFF[0]), (c3[w[k - 1], w[k], word] if k else 0, c2[w[k - 1], w[k]] if k else 0, maxent_lm.BACKOFF[1])):
                if history:
                    p = (count + a * history**b * p) / (history + a * history**b)
            total += math.log10(p)
        assert got[d_] == pytest.approx(total, abs=1e-3)


def test_language_model_depends_on_the_table_alone(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, many = ({r["doc_id"]: r["score"] for r in maxent_lm.score(d.repartition(k)).collect()} for k in (1, 8))
    assert one == many


def test_language_model_keeps_every_pair(spark):
    """Far more words than the frequent ones: each u<i> is always followed by its v<i>."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"u{k} v{k}" for k in rng.integers(0, 3000, 60)), "en", "s") for i in range(500)]
    out = maxent_lm.score(frame(spark, rows)).filter("held_out").agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first()
    assert (out["sum(score)"] - out["sum(base_score)"]) / out["sum(n_tokens)"] > 1.0
    # Backed-off probabilities after one history add up to 1, and stay as they are after none.
    p, count = np.array([0.5, 0.25, 0.25]), np.array([3, 0, 1])
    assert maxent_lm.backed_off(p, count, np.full(3, 4), 4.0, 0.75).sum() == pytest.approx(1)
    assert (maxent_lm.backed_off(p, count * 0, np.zeros(3), 4.0, 0.75) == p).all()


def test_language_model_empty_table(docs):
    assert maxent_lm.score(docs.limit(0)).count() == 0


# ---- byte-level BPE --------------------------------------------------------------------------


def tokenizer():
    import base64

    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs, rows):
    path, enc = tokenizer()
    odd = "I'm we've'll  don't   \n\n 12ab\u00a0x <|endoftext|> \r\n\t "
    more = docs.sparkSession.createDataFrame([(500, odd), (501, odd)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    got = byte_bpe.encode(both, path, chunk_chars=20_000)
    want = []
    for d, t in [*[(r[0], r[1]) for r in rows], (500, odd), (501, odd)]:
        raw = np.array(enc.encode_ordinary(t or ""), dtype="<u4").tobytes()
        want.append((d, len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert counted(got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == counted(want)
    text = {r["doc_id"]: r["text"] for r in byte_bpe.decode(got, path).collect()}
    assert text[500] == odd and text[100] == ""
    assert byte_bpe.encode(docs.limit(0), path).count() == 0
    shuffled = byte_bpe.encode(both.repartition(5), path, chunk_chars=20_000)
    assert counted(shuffled.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == counted(want)


@pytest.mark.parametrize("op", [lambda d: quality_rules.judge(d), lambda d: substring_dedup.dedup(d), lambda d: near_dup.classes(d), lambda d: near_dup.keep_first(d)])
def test_empty_tables(docs, op):
    assert op(docs.limit(0)).count() == 0
