"""Operators over whole corpora against brute force, exact enumeration or held-out accuracy."""

import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import llm.tables as tables
from llm.test_texts import check_packing, counted, library  # noqa: F401
from pairloom.llm import language_id, markov_lm, multi_index, ngram_join, queries

FOLDER = "/root/testdata/sf0.001"


# ------------------------------------------------------------------------------------ op1


def shingles(text, n=4):
    words = tables.lower(text).encode().split()
    if len(words) < n:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def grouped(rows, words=4, percent=85):
    """For rows (doc_id, text): set size and component of each, by comparing all distinct sets."""
    sets = [shingles(t, words) for _, t in rows]
    kinds = sorted({s for s in sets if s}, key=len)
    root = {s: s for s in kinds}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for a, b in itertools.combinations(kinds, 2):
        if len(a) * 100 >= percent * len(b):
            common = len(a & b)
            if 100 * common >= percent * (len(a) + len(b) - common):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for (doc_id, _), s in zip(rows, sets):
        if s and doc_id is not None:
            least[find(s)].append(doc_id)
    return [(d, len(s), min(least[find(s)], default=None) if s else d) for (d, _), s in zip(rows, sets)]


def corpus():
    """Awkward rows, real texts, groups of near copies of many sizes and passages that many documents share."""
    rng = np.random.default_rng(2)
    rows = [(r[0], r[1]) for r in tables.awkward()]
    rows += [(d + 1000, t) for d, t in tables.some(FOLDER, "documents", "doc_id, text")]
    word = lambda n: [f"x{rng.integers(1 << 40):x}" for _ in range(n)]
    passage, next_id = word(60), 5000
    for size, edits in ((2, 1), (3, 4), (12, 2), (90, 3), (60, 5)):
        text = word(300)
        for _ in range(size):
            copy = list(text)
            for at in rng.integers(0, len(copy), edits):
                copy[at] = word(1)[0]
            rows.append((next_id, " ".join(copy)))
            next_id += 1
    for _ in range(60):
        own = word(int(rng.integers(5, 60)))
        rows.append((next_id, " ".join([*own, *passage])))
        next_id += 1
    return rows


def test_ngram_join(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = grouped(rows)
    found = ngram_join.components(docs).collect()
    assert tables.bag(found) == tables.bag(expected)
    assert max(Counter(c for _, _, c in expected).values()) > 60
    assert ngram_join.components(tables.empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (3, " \n")], "doc_id long, text string")
    assert tables.bag(ngram_join.components(blank).collect()) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_ngram_join_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK_CHARS", 50_000)
    monkeypatch.setattr(ngram_join, "SLICE_TOKENS", 5_000)
    rows = corpus()
    found = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert tables.bag(found) == tables.bag(grouped(rows))


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(8)
    checked = 0
    for _ in range(4000):
        n = int(rng.integers(6, 120))
        x = rng.choice(1 << 50, n, replace=False).astype(np.uint64)
        gone = int(rng.integers(0, int(0.17 * n) + 1))
        new = int(rng.integers(0, int(0.17 * n) + 1))
        y = np.concatenate([x[gone:], rng.choice(1 << 50, new, replace=False).astype(np.uint64)])
        common = n - gone
        if 100 * common < 85 * (n + len(y) - common) or common == n == len(y):
            continue
        checked += 1
        # Any token may be frequent; one that a single set holds may also be unshared.
        kinds = {}
        weights = rng.dirichlet([0.5, 0.5, 0.5])
        for t in {*x.tolist(), *y.tolist()}:
            kinds[t] = int(rng.choice([0, 5, 90], p=weights))
        for t in set(x.tolist()) & set(y.tolist()):
            kinds[t] = kinds[t] or int(rng.choice([5, 90]))
        keys = []
        for s in (x, y):
            classes = np.array([kinds[t] for t in s.tolist()], np.uint8)
            held, own = s[classes > 0], classes[classes > 0]
            order = np.lexsort((held, own))
            keys.append(set(ngram_join.signatures(len(s), held[order], own[order], 20).tolist()))
        assert keys[0] & keys[1]
    assert checked > 1000


# ------------------------------------------------------------------------------------ op4


def test_language_id(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.op4_language_id(spark, folder).collect()}
    truth = dict(tables.some(folder, "documents", "doc_id, lang"))
    assert len(rows) == len(truth)
    out = [d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2]
    assert {d for d, r in rows.items() if r["held_out"]} == set(out)
    assert sum(rows[d]["lang_pred"] == truth[d] for d in out) >= 0.95 * len(out)
    assert sum(r["rejected"] for r in rows.values()) <= 0.02 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_language_id_of_awkward_rows(spark):
    docs = tables.documents(spark)
    model = language_id.fit(docs, F.lit(True))
    found = language_id.identify(docs, model).collect()
    assert len(found) == docs.count()
    for row, (doc_id, text, *_) in zip(sorted(found, key=lambda r: repr(r[0])), sorted(tables.awkward(), key=lambda r: repr(r[0]))):
        assert row["doc_id"] == doc_id
    no_letters = {d for d, t, *_ in tables.awkward() if d is not None and d != 5 and not any(c.isalpha() for c in t or "")}
    assert {r["doc_id"] for r in found if r["lang_pred"] == "und" and r["doc_id"] is not None} == no_letters
    assert all(r["score"] == 0 and r["rejected"] for r in found if r["lang_pred"] == "und")
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r["rejected"] for r in found)
    nothing = language_id.fit(docs, F.lit(False))
    assert nothing is None and {r[1] for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(tables.empty(spark), model).count() == 0


def test_nothing_learnt_rejects_only_texts_without_letters(spark):
    docs = tables.documents(spark).withColumn("lang", F.lit(None).cast("string"))
    model = language_id.fit(docs, F.lit(True))
    kept = dict(corpus_pipeline.STAGES)["language_id"](spark, docs, FOLDER)
    assert model is None
    expected = [(*r[:2], None, *r[3:]) for r in tables.awkward() if any(c.isalpha() for c in r[1] or "")]
    assert tables.bag(kept.collect()) == tables.bag(expected)


def test_sample_is_bounded_by_whole_documents(spark):
    rows = [(0.4, 4, "x" * 10), (0.1, 1, "a" * 50), (0.2, 2, None), (0.3, 3, "b" * 40)]
    drawn = spark.createDataFrame(rows, "mark double, doc_id long, text string")
    for most, ids in ((100, [1, 2, 3, 4]), (99, [1, 2, 3]), (50, [1, 2]), (10, [1])):
        found = language_id._within(drawn, most)
        assert [r["doc_id"] for r in found] == ids and all((r["mark"], r["doc_id"], r["text"]) in rows for r in found)


def test_calibration_bounds_rejection():
    rng = np.random.default_rng(0)
    letters = {"aa": "abcde", "bb": "vwxyz"}
    texts, labels = [], []
    for k in range(1500):
        label = ["aa", "bb"][k % 2]
        texts.append(" ".join("".join(rng.choice(list(letters[label]), 5)) for _ in range(int(rng.integers(1, 12)))))
        labels.append(label)
    model = language_id.train(texts, labels)
    names, scores, rejected = language_id.predict(model, texts + ["12 34", "", None])
    assert names[-3:] == ["und"] * 3 and rejected[-3:].all()
    assert np.mean([a == b for a, b in zip(names, labels)]) > 0.99
    assert rejected[:-3].mean() <= 0.02


# ------------------------------------------------------------------------------------ op7


def neighbours(rows, top=20):
    out = []
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for k, (q, v) in enumerate(good):
        if q % 20 == 0:
            near = sorted((-float((v * w).sum()), i) for j, (i, w) in enumerate(good) if j != k)[:top]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(near, 1)]
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, block string")


def rounded(rows):
    return tables.bag((r[0], r[1], r[2], round(r[3], 9)) for r in rows)


def test_multi_index_is_exact_when_all_cells_are_visited(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(700)]
    rows += [(i, [1.0, 2.0, 3.0, 0.0, 0.0, 1.0]) for i in range(700, 800)]  # equal vectors, many ties
    rows += [(800, None), (820, []), (840, [0.0] * 6), (860, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (880, [math.nan] * 6),
             (900, [math.inf] + [1.0] * 5), (None, [1.0] * 6), (60, [2.0, 0.0, 0.0, 0.0, 1.0, 0.0])]
    found = multi_index.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, centroids=4, recall=1.0, block=64)
    assert rounded(found.collect()) == rounded(neighbours(rows))
    few = rows[:5]
    found = multi_index.nearest(vectors(spark, few), F.col("vec_id") % 20 == 0)
    assert rounded(found.collect()) == rounded(neighbours(few))
    twice = [rows[0], rows[0], rows[1], rows[2]]
    found = multi_index.nearest(vectors(spark, twice), F.col("vec_id") % 20 == 0)
    assert rounded(found.collect()) == rounded(neighbours(twice))
    for nothing in ([], rows[800:804]):
        assert multi_index.nearest(vectors(spark, nothing), F.col("vec_id") % 20 == 0).count() == 0


def test_multi_index_recall(spark):
    folder = "/root/testdata/sf0.1"
    rows = tables.some(folder, "embeddings", "vec_id, embedding")
    truth = defaultdict(set)
    for q, _, i, _ in neighbours(rows):
        truth[q].add(i)
    found = defaultdict(set)
    for r in queries.op7_multi_index(spark, folder).collect():
        found[r["query_id"]].add(r["vec_id"])
    assert all(len(found[q]) == len(truth[q]) for q in truth)
    assert np.mean([len(found[q] & truth[q]) / len(truth[q]) for q in truth]) >= 0.9


def test_multi_index_recall_of_distinct_queries_beside_a_hot_vector(spark):
    rng = np.random.default_rng(9)
    points = rng.standard_normal((6000, 64)) + 0.5
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    points = np.concatenate([points, np.full((3000, 64), -0.125)])  # a third of the rows, and far from all others
    rows = [(i, v) for i, v in enumerate(points.astype(np.float32).tolist())]
    found = defaultdict(set)
    for r in multi_index.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect():
        found[r["query_id"]].add(r["vec_id"])
    points, shares = np.array([v for _, v in rows]), []
    for q in range(0, 6000, 20):
        scores = points @ points[q]
        scores[q] = -np.inf
        shares.append(len(found[q] & set(np.argsort(-scores)[:20].tolist())) / 20)
    assert np.mean(shares) >= 0.94


def test_cells_are_visited_by_falling_sum():
    rng = np.random.default_rng(1)
    index = multi_index.fit(rng.standard_normal((500, 8)), 5, centroids=7)
    query = rng.standard_normal(8)
    sums = (index.books[0] @ query[:4])[:, None] + (index.books[1] @ query[4:])[None]
    order = list(index.visit(query))
    assert sorted(order) == list(range(49))
    assert np.all(np.diff(sums.ravel()[order]) <= 1e-12)


# ------------------------------------------------------------------------------------ op9


def test_markov_scores(spark):
    rows = [(r[0], r[1]) for r in tables.awkward()] + tables.some(FOLDER, "documents", "doc_id + 100, text")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = markov_lm.score_documents(docs, rounds=2).collect()
    tokens = [[*tables.lower(t).encode().split(), None] for _, t in rows]
    held = [None if d is None else zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    count = Counter(w for words, out in zip(tokens, held) if out is False for w in words)
    total, kinds = sum(count.values()), len(count)
    expected = []
    for (doc_id, _), words, out in zip(rows, tokens, held):
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in words)
        expected.append((doc_id, out, len(words), sum(count[w] > 0 for w in words), total, round(base, 6)))
    assert tables.bag((*tuple(r)[:5], round(r["base_score"], 6)) for r in found) == tables.bag(expected)
    assert all(r["score"] < 0 for r in found)
    assert markov_lm.score_documents(tables.empty(spark)).count() == 0


def test_markov_score_is_the_log_probability(spark):
    """The column ``score`` against a plain sum over places, with the model that the query trains."""
    rows = [(r[0], r[1]) for r in tables.awkward() if len(r[1] or "") < 6000] + tables.some(FOLDER, "documents", "doc_id + 100, text", "length(text) < 3000")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    written = markov_lm.write_through(markov_lm.blocks(docs))
    places = markov_lm.write_through(markov_lm.counted(written))
    trained = markov_lm.train(written, places, 2)
    known = written.filter("word IS NOT NULL").select("block", "place", "word", "class").join(places, ["block", "place"]).collect()
    c, kind = {r["word"]: r["c"] for r in known}, {r["word"]: r["class"] for r in known}
    types = Counter(kind[w] for w, n in c.items() if n)
    tokens = Counter()
    for w, n in c.items():
        tokens[kind[w]] += n
    model, expected = trained.model, []
    for doc_id, text in rows:
        state, score = None, 0.0
        for w in [*tables.words(tables.lower(text)), " "]:
            state = (model.first if state is None else state @ model.chain) * model.emit[kind[w]]
            score += math.log10(state.sum()) + math.log10((c[w] + 0.5) / (tokens[kind[w]] + 0.5 * (types[kind[w]] + 1)))
            state = state / state.sum()
        expected.append((doc_id, round(score, 6)))
    assert tables.bag((r["doc_id"], round(r["score"], 6)) for r in markov_lm.score(written, places, trained).collect()) == tables.bag(expected)


def test_markov_beats_word_counts_on_held_out_texts(spark):
    rows = [r for r in queries.op9_markov_lm(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert len(rows) > 100 and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_forward_and_expected_counts_by_enumeration():
    rng = np.random.default_rng(6)
    k, classes = markov_lm.STATES, markov_lm.CLASSES + 1
    normal = lambda x: x / x.sum(axis=-1, keepdims=True)
    model = markov_lm.Model(normal(rng.random(k)), normal(rng.random(k)), normal(rng.random((k, k))), rng.random((classes, k)) / classes)
    lengths, seen = np.array([1, 4, 3]), rng.integers(0, 5, 8)
    total = np.zeros((classes + k + 1, k))
    for n, start, score in zip(lengths, (0, 1, 5), markov_lm.likelihoods(model, lengths, seen)):
        word = seen[start : start + n]
        paths = list(itertools.product(range(k), repeat=n))
        weights = np.array([
            model.first[p[0]] * np.prod([model.emit[w, s] for w, s in zip(word, p)]) * np.prod([model.chain[a, b] for a, b in zip(p, p[1:])])
            for p in paths
        ])
        assert math.log10(weights.sum()) == pytest.approx(score)
        for p, weight in zip(paths, weights / weights.sum()):
            total[classes + k, p[0]] += weight
            for w, s in zip(word, p):
                total[w, s] += weight
            for a, b in zip(p, p[1:]):
                total[classes + a, b] += weight
    assert markov_lm.expected(model, lengths, seen) == pytest.approx(total)


def test_expected_counts_of_long_texts():
    rng = np.random.default_rng(16)
    k, classes = markov_lm.STATES, markov_lm.CLASSES + 1
    normal = lambda x: x / x.sum(axis=-1, keepdims=True)
    model = markov_lm.Model(normal(rng.random(k)), normal(rng.random(k)), normal(rng.random((k, k))), rng.random((classes, k)) / classes)
    lengths = np.array([65, 3, 300, 64])
    seen = rng.integers(0, 5, lengths.sum())
    total = np.zeros((classes + k + 1, k))
    for start, n in zip(np.cumsum(lengths) - lengths, lengths):
        e = model.emit[seen[start : start + n]]
        alpha, beta = [normal(model.first * e[0])], [np.ones(k)]
        for t in range(1, n):
            alpha.append(normal((alpha[-1] @ model.chain) * e[t]))
            beta.append(normal(model.chain @ (e[n - t] * beta[-1])))
        beta.reverse()
        gamma = normal(np.array(alpha) * np.array(beta))
        np.add.at(total, seen[start : start + n], gamma)
        total[-1] += gamma[0]
        for t in range(n - 1):
            pair = alpha[t][:, None] * model.chain * (e[t + 1] * beta[t + 1])
            total[classes : classes + k] += pair / pair.sum()
    found = markov_lm.expected(model, lengths, seen)
    assert found == pytest.approx(total)
    assert found[classes : classes + k].sum() == pytest.approx((lengths - 1).sum())
    assert markov_lm.expected(model, lengths, seen, np.float32) == pytest.approx(total, rel=1e-3, abs=1e-3)


def test_word_classes_make_a_distribution():
    tokens = np.zeros(markov_lm.CLASSES + 1)
    tokens[[1, 5, markov_lm.CLASSES]] = 7, 3, 4
    for model in (markov_lm.Model.start(tokens), markov_lm.Model.of(np.ones((len(tokens) + markov_lm.STATES + 1, markov_lm.STATES)), tokens)):
        assert model.emit.sum(axis=0) == pytest.approx(1) and model.chain.sum(axis=1) == pytest.approx(1)


# ------------------------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, library):  # noqa: F811
    folder = FOLDER
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "language_id", "ngram_jaccard", "best_fit_packing"]
    rows = [tuple(r) for r in docs.collect()]
    good = stages["quality_rules"](spark, docs, folder)
    assert good.columns == docs.columns
    # The labels here are too few to certify any cutoff.
    assert tables.bag(good.collect()) == tables.bag(r for r in rows if not counted(r[1])[-1])
    known = stages["language_id"](spark, good, folder)
    assert known.columns == docs.columns and known.count() >= 0.97 * good.count()
    single = stages["ngram_jaccard"](spark, known, folder)
    left = [tuple(r) for r in known.collect()]
    keep = {c for _, _, c in grouped([(r[0], r[1]) for r in left])}
    assert single.columns == docs.columns
    assert tables.bag(single.collect()) == tables.bag(r for r in left if r[0] in keep)
    packed = stages["best_fit_packing"](spark, single, folder).collect()
    check_packing(packed, [(r[0], r[1]) for r in left if r[0] in keep], library, 2048)
    assert tables.bag(r[:5] for r in corpus_pipeline.run(spark, folder).collect()) == tables.bag(tuple(r)[:5] for r in packed)


def test_pipeline_on_awkward_and_empty_tables(spark):
    for docs in (tables.documents(spark), tables.empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, docs, FOLDER)
            result.count()
            assert name == "best_fit_packing" or result.columns == docs.columns


def test_one_document_of_each_group_stays(spark):
    docs = tables.documents(spark)
    kept = ngram_join.keep_one(docs).collect()
    texts = [(r["doc_id"], r["text"]) for r in kept]
    worded = [t for t in texts if t[0] is not None and tables.words(t[1])]
    assert len(worded) == len(set(worded))
    ids = [d for d, _ in worded]
    # Another text under the id of a group stays beside it.
    assert 6 not in ids and 7 not in ids and ids.count(5) == 2 and (5, "another text") in worded
    assert [d for d, _ in texts].count(None) == sum(r[0] is None for r in tables.awkward())
    assert {d for d, t, *_ in tables.awkward() if d is not None and not tables.words(t)} <= {d for d, _ in texts}


def test_a_copy_under_the_id_of_another_group_takes_nothing_along(spark):
    one, two = (" ".join(f"{letter}{i}" for i in range(60)) for letter in "ab")
    rows = [(1, one), (2, two), (2, one), (3, two), (3, two)]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert tables.bag(kept) == tables.bag([(1, one), (2, two)])


def test_pipeline_joins_near_copies_of_five_words(spark):
    # Two of 100 words differ: 4-word windows share 89 of 105 (0.848), 5-word windows 86 of 106 (0.811).
    text = [f"w{i}" for i in range(100)]
    copy = [f"x{i}" if i in (30, 60) else w for i, w in enumerate(text)]
    rows = [(i + 10_000, t) for i, t in enumerate([" ".join(text), " ".join(copy)])] + [r for r in corpus() if r[0] is not None and r[0] != 5]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len({c for _, _, c in grouped(rows[:2])}) == 2
    keep = {c for _, _, c in grouped(rows, 5, 80)}
    found = dict(corpus_pipeline.STAGES)["ngram_jaccard"](spark, docs, FOLDER).collect()
    assert tables.bag(found) == tables.bag(r for r in rows if r[0] in keep)
    assert 10_000 in keep and 10_001 not in keep
