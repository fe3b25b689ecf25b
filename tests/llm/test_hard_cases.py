"""Cases that once went wrong, brute force for the operators that SQL can't express, and the stated SQL."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ticktrail.llm import catalog, common, components, language, line_dedup, mixing, ngram_join, packing, quality_cnn, topk, toxicity, url_filter

SF = "/root/testdata/sf0.001"
LINE = "A shared line that is certainly longer than forty characters."
NAMES = ("epoch", "__row", "__id", "__hashes", "__b", "at", "row", "size", "text_hash", "hash", "parts", "node", "id", "src", "block", "hashes", "new", "score")


def with_names(df):
    """df with columns named like those that operators use inside."""
    for i, c in enumerate(NAMES):
        df = df.withColumn(c, F.lit(f"own{i}"))
    return df


# stated SQL ---------------------------------------------------------------------------------------------
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_against_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF), con.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    as_rows = lambda rows, names: Counter(tuple(map(str, (dict(zip(names, r))[c] for c in cols))) for r in rows)
    assert as_rows([tuple(r) for r in got.collect()], got.columns) == as_rows(want.fetchall(), want.columns)


# extra columns, empty tables ----------------------------------------------------------------------------
def test_stages_keep_columns_of_any_name(spark):
    docs = with_names(spark.read.parquet(f"{SF}/documents.parquet").limit(60)).unionByName(
        with_names(spark.createDataFrame([(None, None, None, None, None), (None, "", "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    )
    docs = common.written(docs, "clash")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_out = common.written(stage(spark, docs, SF), name)
        assert docs_out.columns == docs.columns, name
        bad = " OR ".join(f"`{c}` <> 'own{i}' OR `{c}` IS NULL" for i, c in enumerate(NAMES))
        assert docs_out.count() and not docs_out.where(bad).count(), name
        docs = docs_out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, SF), name)
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_scratch_removes_intermediates(spark):
    import os

    with common.scratch(spark):
        a = common.written(spark.range(3), "gone")
        b = common.kept(common.written(spark.range(4), "stays"))
    at = lambda df: df.inputFiles()
    assert b.count() == 4 and at(b)
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert not any(x.startswith("gone-") for x in os.listdir(folder)) and a.columns == ["id"]


# 1 ------------------------------------------------------------------------------------------------------
def test_mix_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sized = common.written(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", mixing.size_of(F.col("text")).alias("size")), "sizes")
    m = mixing.mix(sized)
    placed, slots = m.placed.collect(), mixing.slots_of(spark, m.plan).collect()
    # Every source's documents tile its stream of words, gapless.
    for src in {r.src for r in placed}:
        at = 0
        for r in sorted((r for r in placed if r.src == src and r.size), key=lambda r: r.start):
            assert r.start == at
            at += r.size
        assert at == m.plan.sizes[src]
    want, block = Counter(), m.plan.params.block
    for s in slots:
        for r in placed:
            if r.src == s.src:
                want[r.doc_id] += max(0, min(r.start + r.size, (s.block + 1) * block) - max(r.start, s.block * block))
    got = {r.doc_id: r.taken for r in mixing.op1_mixing(spark, SF).collect()}
    assert got == {r.doc_id: want[r.doc_id] for r in placed}
    seen = Counter((s.src, s.block) for s in slots)
    assert max(seen.values()) <= 3


def test_mix_of_repeated_rows(spark):
    rows = [(1, "a b c d", "x")] * 40 + [(None, f"w{i} w w", None) for i in range(40)]
    out = mixing.mix_documents(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), SF).collect()
    assert out and {r.source for r in out} <= {"x", None}


# 2 ------------------------------------------------------------------------------------------------------
def brute_counts(rows, p):
    """Every document's number of links, by an inverted index over all shingles."""
    sets = {}
    for i, text in rows:
        s = ngram_join.shingles((text or "").encode(), p.words)
        if len(s):
            sets.setdefault(s.tobytes(), (s, []))[1].append(i)
    sets = list(sets.values())
    size, ids = np.array([len(s) for s, _ in sets]), [x for _, x in sets]
    flat, own = np.concatenate([s for s, _ in sets]), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    keys, first = np.unique(flat[order], return_index=True)
    own, bounds, out = own[order], np.append(first, len(flat)), {}
    for k, (s, own_ids) in enumerate(sets):
        at = np.searchsorted(keys, s)
        inter = np.bincount(np.concatenate([own[bounds[a] : bounds[a + 1]] for a in at]), minlength=len(sets))
        near = np.flatnonzero(inter * (1 + p.threshold) >= p.threshold * (size + len(s)) - 1e-9)
        for i in own_ids:
            out[i] = sum(len(ids[j]) for j in near) - 1
    return out


def test_recall_over_ten_thousand_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    want = brute_counts([(r.doc_id, r.text) for r in docs.collect()], ngram_join.JoinParams())
    got = {r.id: r.n_links for r in ngram_join.join_ngrams(docs).collect()}
    assert sum(got.values()) >= 0.999 * sum(want.values()) and all(got[i] <= n for i, n in want.items())


def test_prefix_is_shortened_until_the_measured_recall(spark):
    p = ngram_join.JoinParams()
    none = {d: p.chance(p.threshold, d) for d in range(1, 9)}  # no link in the sample: the formula decides
    assert ngram_join.final_depth(none, p) == max(d for d in none if none[d] >= p.recall)
    assert ngram_join.final_depth({d: 1.0 for d in range(1, 9)}, p) == p.longest and ngram_join.final_depth({d: 0.0 for d in range(1, 9)}, p) == 1
    a = np.arange(24).reshape(3, 8)
    b = a.copy()
    b[:, 5] = 99
    b[1, 2] = 99
    assert ngram_join.shared_depth(a, b) == 5 and ngram_join.shared_depth(a, a) == 8 and ngram_join.shared_depth(a, a + 1) == 0
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[:300] + [f"x{k}"] * (4 * k))) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sample = ngram_join.sample_of(docs, p)
    signs = common.written(ngram_join.signed(docs, "doc_id", p, sample), "signs")
    recall = ngram_join.measured_recall(signs, p)
    # By hand: for each document, the share of its exact links that meet in some tree, and one pair by the formula.
    forest, sets = ngram_join.Forest(p), [ngram_join.shingles(t.encode(), 5) for _, t in rows]
    paths = [forest.paths(s) for s in sets]
    near = lambda a, b: len(np.intersect1d(a, b)) >= p.threshold * len(np.union1d(a, b))
    for d in range(1, 9):
        shares = []
        for i in range(12):
            links = [j for j in range(12) if j != i and near(sets[i], sets[j])]
            if links:
                shares.append(np.mean([ngram_join.shared_depth(paths[i], paths[j]) >= d for j in links]))
        assert recall[d] == pytest.approx((sum(shares) + p.chance(p.threshold, d)) / (len(shares) + 1))


def test_join_of_repeated_and_missing_ids(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(None, " ".join(base + [f"a{k}"])) for k in range(30)] + [(7, f"other text number {k} with words of its own {k * k}") for k in range(30)] + [(7, "same words here every single time")] * 20
    got = ngram_join.join_ngrams(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.id, r.n_links) for r in got) == Counter({(None, 29): 30, (7, 0): 30, (7, 19): 20})


def test_components_alone(spark):
    edges = [(i, i + 1) for i in range(1, 300)] + [(500, 500), (None, 3), (4, None), (700, 701), (701, 700), (900, 800), (800, 850)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 301)} | {700: 700, 701: 700, 800: 800, 850: 800, 900: 800}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


# 3 ------------------------------------------------------------------------------------------------------
def test_ids_and_padding_over_a_thousand_documents(spark):
    d = "/root/testdata/sf0.01"
    p = packing.PackParams()
    slow = packing.encoder(packing.PackParams(ranks=None))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    import zlib

    rows = packing.op3_packing(spark, d).collect()
    for r in rows:
        ids = np.array([*slow(texts[r.doc_id]), 0], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    total, used = sum(r.length for r in rows), len({r.sequence_id for r in rows})
    assert used <= 1.02 * math.ceil(total / 1024)


# 4, 5 ---------------------------------------------------------------------------------------------------
def test_training_takes_one_row_an_id(spark):
    rows = [(1, f"vile words {k}") for k in range(3000)] + [(i, f"plain text number {i} of many") for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chosen = common.hash_sample(docs, 30, 1)
    assert chosen.count() == 30 and chosen.distinct().count() == 30 and common.hash_sample(docs, 1000, 1).count() == 59
    assert common.one_row_an_id(docs, docs.select("doc_id").distinct()).count() == 59
    labels = spark.createDataFrame([(i, i % 2, int(i == 1)) for i in range(1, 60)], "doc_id long, quality int, toxic int")
    p = toxicity.ToxicityParams(max_unlabelled=20)
    a, b = toxicity.train(docs, labels, p), toxicity.train(docs.repartition(7), labels, p)
    assert (a.weights == b.weights).all() and a.bias == b.bias
    c, d = quality_cnn.train(docs, labels, quality_cnn.CnnParams(epochs=2)), quality_cnn.train(docs.repartition(5), labels, quality_cnn.CnnParams(epochs=2))
    assert c.score(b"any text") == d.score(b"any text")


def test_risk_gradient_by_differences():
    """One step of fit_nnpu from zero weights moves along the gradient of the stated risk."""
    pos, unl, prior = [np.array([1, 2]), np.array([1, 3])], [np.array([2, 4]), np.array([4, 5]), np.array([3])], 0.3
    loss = lambda z: np.logaddexp(0, -z)

    def risk(w):
        zp, zu = [w[f].sum() for f in pos], [w[f].sum() for f in unl]
        return prior * np.mean([loss(z) for z in zp]) + max(0.0, np.mean([loss(-z) for z in zu]) - prior * np.mean([loss(-z) for z in zp]))

    step = 1e-6
    grad = np.array([(risk(np.eye(8)[k] * step) - risk(-np.eye(8)[k] * step)) / (2 * step) for k in range(8)])
    many = toxicity.fit_nnpu(pos * 40, unl * 40, prior, toxicity.ToxicityParams(epochs=1, batch=120, rate=1e-4, l2=0.0))
    moved = many.weights[:8].astype(float)
    assert (np.sign(moved) == -np.sign(np.where(np.abs(grad) < 1e-9, 0, grad))).all()


# 6 ------------------------------------------------------------------------------------------------------
def test_repeated_and_missing_ids_count_as_sql_has_it(spark):
    twice = [(1, LINE), (1, LINE), (1, LINE + "\nmore"), (2, LINE), (2, LINE)]  # two documents only
    keep = line_dedup.dedup_lines(spark.createDataFrame(twice, "doc_id long, text string")).collect()
    assert sum(r.text.count(LINE) for r in keep) == 5
    rows = [(i, f"{LINE}\nown {i}") for i in range(5)] + [(None, f"{LINE}\nnone {k}") for k in range(50)] + [(4, f"{LINE}\nagain")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all((LINE in r.text) == (r.doc_id == 4) for r in got)


# 7 ------------------------------------------------------------------------------------------------------
def test_ngrams_of_a_text_that_lower_case_lengthens():
    p = language.LanguageParams()
    text = "İ" * 70_000
    low = text.lower()
    n = sum(len(f) for _, f in language.ngrams([text], p))
    assert len(low) == 140_000 and n == sum(len(low) - k for k in range(3))
    small = language.LanguageParams(piece=7)
    texts = ["Ein langer Text ohne Ende", "", "x", "İstanbul ve İzmir", "ab"]
    for t, whole in enumerate(texts):
        a = np.sort(np.concatenate([f for _, f in language.ngrams([whole], p)] or [np.empty(0)]))
        b = np.sort(np.concatenate([f[own == t] for own, f in language.ngrams(texts, small)]))
        assert len(a) == len(b) and (a == b).all()


def test_naive_bayes_by_hand(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("the house is red", "en"), ("das haus ist rot", "de"), ("a dog", None)] * 4)]
    p = language.LanguageParams()
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), p, folds=1 << 30, held_out=-1)
    count = {x: Counter() for x in ("de", "en")}
    for _, t, lang in rows:
        if lang:
            for _, f in language.ngrams([t], p):
                count[lang].update(f.tolist())
    for text in ("the red dog", "die rote katze", "xyz", "the die"):
        grams = [g for _, f in language.ngrams([text], p) for g in f.tolist()]
        z = {x: math.log(0.5) + sum(math.log((c[g] + p.alpha) / (sum(c.values()) + p.alpha * 2**p.bits)) for g in grams) for x, c in count.items()}
        best = max(sorted(z), key=z.get)
        (lang,), (score,) = model.predict([text])
        want = 1 / sum(math.exp((v - z[best]) * min(len(grams), 50) / len(grams)) for v in z.values())
        assert lang == best and score == pytest.approx(want, rel=1e-4)


# 9 ------------------------------------------------------------------------------------------------------
def test_topk_of_large_components_is_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(0, 1, 3) * 10.0 ** float(rng.integers(-1, 6))]) for i in range(120)]
    rows += [(200, [9000.0, 1.0, -3.0]), (201, [-9000.0, 8192.5, 0.1]), (300, [1e300, 1.0, 0.0]), (301, [-1e300, 0.0, 0.0]), (302, [1.7e308, -1e-9, 0.0])]
    whole = {i: [math.floor(v * 1024) if abs(v) < 1e290 else int(math.copysign(1, v)) * min(int(abs(v)) * 1024, 1 << 1000) for v in vec] for i, vec in rows}
    low, high = -(1 << 63), (1 << 63) - 1
    want = Counter()
    for i in whole:
        if i % 100 == 0:
            s = sorted((-min(max(sum(a * b for a, b in zip(whole[i], whole[j])), low), high), j) for j in whole if j != i)[:10]
            want.update((i, r + 1, j, -n) for r, (n, j) in enumerate(s))
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, topk.TopKParams(block_values=240, query_block=2, lanes=3, group_blocks=2)).collect()
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want


# 10 -----------------------------------------------------------------------------------------------------
def test_urls_with_line_feeds_against_the_sql(spark):
    urls = ["http://x.net/b.html\n", "http://x.net/b", "http://x.net/b.html", "http://x.net/b/\n", "http://x.net/b/\n", "http://www.x.net/b/", "http://y.org/\r", "http://y.org", "http://z.net\n/a.html\n\n", None]
    con = duckdb.connect()
    import pandas as pd

    pages = pd.DataFrame({"page_id": range(len(urls)), "url": urls})
    con.register("pages", pages)
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judge(df, url_filter.crowded_urls(df))
    want = con.sql(url_filter.OP10_SQL)
    names = sorted(got.columns)
    pick = lambda cols, rows: Counter(tuple(dict(zip(cols, r))[c] for c in names) for r in rows)
    assert pick(got.columns, [tuple(r) for r in got.collect()]) == pick(want.columns, want.fetchall())
    none = df.where("false")
    assert url_filter.judge(none, url_filter.crowded_urls(none)).collect() == []
