"""The registered queries against plain versions over whole tables, and held-out accuracy."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, covertree, langid, licenses, minhash, packing, pii, quality, queries, toxicity

from .test_llm import PATH, SF, ALPHABETS, PLANTED, brute_groups, brute_quality, plain_spans, sentence

WIDE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


# whole tables


def test_op2_base_and_spans(spark, texts):
    net = pii.train(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    for r in queries.op2_pii(spark, SF).collect():
        t = texts[r.doc_id] or ""
        base = plain_spans(t)
        line = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        _, whole = pii.Finder(net, batch=7).spans([t])  # one text at a time, in other batches
        assert r.spans == pii.joined(whole[0])
        added = [x for x in whole[0] if x not in base]
        assert all(pii.plausible(k, t[s:e]) for s, k, e in added) and set(base) <= set(whole[0])
        assert not any(s < y and x < e for s, _, e in added for x, _, y in base)


def test_op5_pieces(spark, texts, tok):
    out = queries.op5_best_fit_packing(spark, SF).collect()
    mine, bins = {}, {}
    for r in out:
        mine.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert mine.keys() == texts.keys()
    for i, t in texts.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(mine[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and 0 < r.length <= 1024 and (k == 0 or r.length == 1024)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:], strict=False)) and sum(x[1] for x in b) <= 1024
    total = sum(r.length for r in out)
    assert len(bins) <= 1.01 * total / 1024 + 1


def test_op7_ids(spark, texts, tok):
    for r in queries.op7_bpe(spark, SF).collect():
        ids = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op1_finds_planted_lines(spark, texts):
    got = {r.doc_id: r for r in queries.op1_license_scan(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        families = {f for line, f in PLANTED.items() if line in (t or "").split("\n")}
        assert families <= set(got[i].licences.split(","))
        assert families or got[i].licences in ("", "unknown")
    assert sum(r.licences == "unknown" for r in got.values()) <= 2


def test_op6_held_out_accuracy(spark):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{WIDE}/documents.parquet").select("doc_id", "text", "lang").collect()}
    rows = queries.op6_language_id(spark, WIDE).collect()
    assert len(rows) == len(truth)
    for r in rows:
        t = truth[r.doc_id].text
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not t or not any(c.isalpha() for c in t))
    held = [r.lang_pred == truth[r.doc_id].lang for r in rows if r.held_out and truth[r.doc_id].lang and r.lang_pred != "und"]
    assert len(held) > 100 and np.mean(held) > 0.97


def test_op8_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{WIDE}/labels.parquet").collect()}
    rows = queries.op8_toxicity(spark, WIDE).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    y = np.array([t for _, t in held])
    assert y.sum() >= 3 and np.mean([(s >= 0.7) == t for s, t in held]) > 0.93
    pos, neg = ([s for s, t in held if t == k] for k in (1, 0))
    assert np.mean([p > n for p in pos for n in neg]) > 0.85  # some labels are wrong


def test_op9_recall_of_links(spark):
    """Of the pairs at 0.8 or more on full sets, the share that falls into one group."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{WIDE}/documents.parquet").select("doc_id", "text").collect()}
    order = sorted(texts)
    for k in (2, 5):
        _, root = brute_groups([texts[i] for i in order], k, 80)
        want = {i: order[r] for i, r in zip(order, root, strict=True)}
        got = {r.id: r.component_id for r in minhash.near_duplicates(spark.read.parquet(f"{WIDE}/documents.parquet"), k=k).collect()}
        pairs = [(i, r) for i, r in want.items() if i != r]
        assert len(pairs) > 20 and np.mean([got[i] == got[r] for i, r in pairs]) >= 0.99
        assert all(want[i] == want[got[i]] for i in order)  # nothing joined that is not linked


# near duplicates in blocks


def test_large_buckets_in_small_blocks(spark, monkeypatch):
    """Buckets that stay open after the hub rounds are compared in blocks, whatever the block size."""
    rng = random.Random(31)
    vocab = [f"w{i}" for i in range(4000)]
    common_part = [rng.choice(vocab) for _ in range(60)]
    texts = []
    for _ in range(120):  # neighbours at 0.8 or more along a chain of documents, far ones below
        w = list(common_part)
        for _ in range(rng.randint(2, 9)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    _, root = brute_groups(texts, 2, 80)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(minhash, "ROUNDS", 1)
    for block in (5, 1000):
        got = {r.id: r.component_id for r in minhash.near_duplicates(d, k=2, block=block).collect()}
        assert [got[i] for i in range(len(texts))] == root


def test_bounds_follow_the_threshold():
    assert minhash.permutations(80) == 200 and minhash.permutations(60) > 1000 and minhash.permutations(100) == minhash.PER_BAND
    assert minhash.least_share(60) < 0.6 < minhash.least_share(80) < 0.8
    with pytest.raises(ValueError):
        minhash.near_duplicates(None, percent=10)


# whole texts of any form


def test_very_long_runs(tok):
    enc = packing.encoder(open(PATH, encoding="utf-8").read())
    rng = random.Random(32)
    runs = [" " * 2_000_000 + "a", "7" * 1_000_000, "b" * 1_000_000, "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(300_000)), "\n" * 500_000 + "x\t" * 10]
    for t in runs:
        assert np.array_equal(np.frombuffer(enc(t), "<u4"), np.array(tok.encode(t, add_special_tokens=False).ids, "<u4"))
        assert pii.base_spans(t) == []
    spans = "1.2.3.4 " * 60_000 + "9" * 300_000 + " a@b.cd"
    assert len(pii.base_spans(spans)) == 60_001
    assert pii.base_spans("0" * 6000 + "1.2.3.4") == [(0, 1, 6007)]
    net = pii.Network.new()
    digits = "".join(rng.choice("0123456789 ") for _ in range(200_000))
    base, whole = pii.Finder(net).spans([digits])
    assert set(base[0]) <= set(whole[0])
    for t in (runs[1], runs[2], runs[3]):
        assert max(map(len, toxicity.words_of(t))) <= toxicity.LONGEST


def test_pipeline_takes_very_long_texts(spark):
    import corpus_pipeline as cp

    rng = random.Random(33)
    plain = [(i, sentence("en", rng, 60), "en", "s", 0) for i in range(40)]
    odd = [(100, " " * 1_200_000 + sentence("en", rng, 80), "en", "s", 0), (101, sentence("en", rng, 200) + " " + "1" * 200_000 + " " + sentence("en", rng, 20_000), "en", "s", 0), (102, "x" * 300_000, "en", "s", 0), (None, None, None, None, None)]
    d = spark.createDataFrame(plain + odd, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES[3:]:
        out = stage(spark, d, SF)
        assert {r.doc_id for r in out.select("doc_id").collect()} == {i for i, *_ in plain + odd}, name
        d = d if name == "best_fit_packing" else out


def test_quality_of_long_texts(spark):
    rng = random.Random(34)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(30_000)), "x" * 500_000, "\n" * 300_000 + "a b"]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), order=list(quality.RULES)).collect()}
    assert [tuple(got[i][f] for f in quality.FEATURES)[:4] for i in (1, 2)] == [brute_quality(texts[i])[:4] for i in (1, 2)]
    assert got[0].n_words == 30_000 and 0 < got[0].n_repeat_words <= 30_000


# samples and letters


def test_samples_depend_on_rows_alone(spark):
    d = spark.range(5000).select(F.col("id").alias("k"), F.concat(F.lit("t"), F.col("id")).alias("t"))
    a, b = ({r.k for r in common.bounded_sample(x, "k", 300).collect()} for x in (d, d.repartition(13)))
    assert a == b and 300 <= len(a) <= 600
    same = spark.range(5000).select(F.lit(7).alias("k"), F.lit("x").alias("t"))
    assert 300 <= common.bounded_sample(same, "k", 300).count() <= 600
    one_key = spark.range(5000).select(F.lit(7).alias("k"), F.col("id").cast("string").alias("t"))
    assert 300 <= common.bounded_sample(one_key, "k", 300).count() <= 600
    assert common.bounded_sample(d.limit(0), "k", 5).count() == 0


def test_numerals_are_no_letters():
    model = langid.fit(["the cat of the house"] * 3 + ["le chat de la maison"] * 3, ["en"] * 3 + ["fr"] * 3)
    assert model.predict(["½ ² ³ Ⅷ 12", "ª ½", "²a"])["lang"].tolist()[0] == "und"
    assert model.predict(["² le"])["lang"].tolist() != ["und"]


# licences


def test_unlisted_notices_are_unknown():
    rng = random.Random(35)
    model = licenses.fit([sentence(k, rng, 25) for k in ALPHABETS for _ in range(40)])
    unseen = [
        "Licensed under the Eclipse Public License 2.0.",
        "Licensed under the EUPL, Version 1.2.",
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
        "Distributed under the Boost Software License, Version 1.0.",
        "Released under the zlib license.",
        "Licensed under the Artistic License 2.0.",
        "(c) 2020 Acme",
    ]
    for t in unseen:
        body = sentence("en", rng, 60) + "\n" + t + "\n" + sentence("fr", rng, 60)
        assert [f for f, _, _ in model.scan(body)] == ["unknown"], t
    # notices of listed families in words that no template has
    for t, family in {"This project is released under the MIT licence, see LICENSE.": "MIT", "Code licensed under Apache License 2.0": "Apache-2.0", "Licensed under the terms of the Mozilla Public License 2.0": "MPL-2.0"}.items():
        assert [f for f, _, _ in model.scan(t)] in ([family], ["unknown"]), t
    for t in ("He lost his driving licence in 2019.", "The copyright debate was long.", sentence("de", rng, 400)):
        assert model.scan(t) == []


# vectors


def brute_links(x, cosine=0.95):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = u @ u.T >= cosine
    np.fill_diagonal(g, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(g, label[None], len(x)).min(1))
        if (new == label).all():
            return g.sum(1), label
        label = new


@pytest.mark.parametrize("sent", [covertree.SENT, 3000])
def test_levels_route_and_slices(spark, sent):
    """Nodes of several levels, leaves that link as a whole, and trees in slices."""
    rng = np.random.default_rng(36)
    centre = rng.standard_normal((30, 8))
    x = np.concatenate([centre[rng.integers(0, 30, 500)] + rng.standard_normal((500, 8)) * 0.05, centre[:1] + rng.standard_normal((250, 8)) * 0.004, rng.standard_normal((250, 8))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r.id: r for r in covertree.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), unit=80, sample=200, sent=sent).collect()}
    n, label = brute_links(x)
    assert [got[i].n_links for i in range(len(x))] == n.tolist() and [got[i].component_id for i in range(len(x))] == label.tolist()


def test_unstructured_vectors_shuffle_in_proportion(spark):
    """No bound prunes much among random vectors of 64 dimensions; what is shuffled must not grow with
    the number of blocks."""
    rng = np.random.default_rng(38)
    x = rng.standard_normal((2500, 64)).astype(np.float32)
    x[2000:] = x[rng.integers(0, 2000, 500)] + rng.standard_normal((500, 64)).astype(np.float32) * 0.1
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        return sum(sc.statusStore().executorList(False).apply(k).totalShuffleWrite() for k in range(sc.statusStore().executorList(False).size()))

    before = written()
    got = {r.id: r for r in covertree.similar_vectors(d, unit=64, sample=500).collect()}
    assert written() - before < 6 * x.nbytes
    n, label = brute_links(x.astype(float))
    assert n.sum() > 900 and [got[i].n_links for i in range(len(x))] == n.tolist() and [got[i].component_id for i in range(len(x))] == label.tolist()


@pytest.mark.parametrize(("rows", "sent"), [(0.0, covertree.SENT), (0.0, 30_000), (1.2, 60_000), (1e9, covertree.SENT)])
def test_busy_blocks_and_shuffled_ones(spark, rows, sent):
    """Blocks sent to the vectors, all or some, give what shuffled ones give: with copies, tight
    leaves that link as a whole, near pairs and two lengths."""
    rng = np.random.default_rng(39)
    centre = rng.standard_normal((20, 8))
    x = np.concatenate([centre[rng.integers(0, 20, 300)] + rng.standard_normal((300, 8)) * 0.05, *(centre[:1] + k * 0.06 + rng.standard_normal((200, 8)) * 0.004 for k in range(3)), rng.standard_normal((200, 8))])
    x[50:60] = 2 * x[40:50]
    n, label = brute_links(x)
    rows_ = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, [*v.tolist(), 0.0]) for i, v in enumerate(x[:100])]
    m, other = brute_links(x[:100])
    got = {r.id: r for r in covertree.similar_vectors(spark.createDataFrame(rows_, "vec_id long, embedding array<double>"), unit=80, sample=200, sent=sent, rows=rows).collect()}
    assert [got[i].n_links for i in range(len(x))] == n.tolist() and [got[i].component_id for i in range(len(x))] == label.tolist()
    assert [got[5000 + i].n_links for i in range(100)] == m.tolist() and [got[5000 + i].component_id for i in range(100)] == (5000 + other).tolist()


def test_joins_by_hits():
    rng = np.random.default_rng(37)
    for share in (0.001, 0.02, 0.5):
        hit = rng.random((60, 45)) < share
        a, b = covertree.Forest(105), covertree.Forest(105)
        a.join_hits(hit, np.arange(60), np.arange(60, 105))
        for i, j in zip(*np.nonzero(hit), strict=True):
            b.join(int(i), int(j) + 60)
        assert [a.root(k) for k in range(105)] == [b.root(k) for k in range(105)]


def test_vector_cases(spark):
    rows = [(1, [1.0, 0.0], 5), (None, [1.0, 0.0], 5), (2, [2.0, 0.0], 5), (2, [2.0, 0.0], 6), (3, None, 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int").withColumn("u", F.lit("x"))
    got = sorted(((r.id or 0), r.n_links, r.component_id, r.kept) for r in covertree.similar_vectors(d).collect())
    assert got == [(0, 0, None, True), (1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), (3, 0, 3, True)]


def test_large_ids_beside_nulls(spark):
    """Whole numbers beyond 2 ** 53 stay exact where a batch holds nulls too."""
    big = (1 << 62) + 12345
    d = spark.createDataFrame([(big, "a b c d e f"), (None, None), (big + 1, "a b c d e f"), (None, "x")], "doc_id long, text string").coalesce(1)
    assert sorted((r.id or 0, r.component_id or 0) for r in minhash.near_duplicates(d).collect()) == [(0, 0), (0, 0), (big, big), (big + 1, big)]
    assert {r.doc_id for r in packing.pack(d, open(PATH, encoding="utf-8").read()).collect()} == {big, big + 1, None}
    v = spark.createDataFrame([(big, [1.0, 2.0]), (None, None), (big + 1, [1.0, 2.0])], "vec_id long, embedding array<double>").coalesce(1)
    assert sorted((r.id or 0, r.n_links) for r in covertree.similar_vectors(v).collect()) == [(0, 0), (big, 1), (big + 1, 1)]


# columns that clash with an operator's own


def test_clashing_columns(spark):
    d = spark.createDataFrame([(1, "Hello wonderful world of data", 3, "q"), (2, None, 4, "r")], "doc_id long, text string, n int, x string")
    names = ("language", "pii", "toxicity", "licences", "ids", "decoded", "n_words", "keys", "f1", "places", "rep", "t", "id", "k", "y", "length", "none", "part", "kept")
    e = d.select("*", *[F.lit(1).alias(n) for n in names])
    assert minhash.near_duplicates(e).count() == 2
    assert langid.identify(e, langid.train(e.withColumn("lang", F.lit("en")))).count() == 2
    assert quality.judge(e, order=list(quality.RULES)).count() == 2
    assert pii.find(e, pii.Network.new()).count() == 2
    assert packing.pack(e, open(PATH, encoding="utf-8").read()).select("doc_id").distinct().count() == 2


def test_repeated_and_null_ids(spark):
    d = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "e f"), (2, "")], "doc_id long, text string")
    out = packing.pack(d, open(PATH, encoding="utf-8").read()).collect()
    assert sorted((r.doc_id or 0) for r in out) == [0, 1, 1, 2]
    assert len(re.findall("a", "".join(r.text or "" for r in pii.find(d, pii.Network.new()).collect()))) == 2
    from tessera.llm import urlfilter

    p = spark.createDataFrame([(1, "http://a.org/" + "x" * 200_000), (None, "http://example.org/es/1"), (1, "http://a.org/"), (1, "http://a.org/")], "page_id long, url string").withColumn("judged", F.lit(1))
    assert [r.judged.verdict for r in urlfilter.judge(p).collect()].count("block") == 1 and urlfilter.judge(p.limit(0)).count() == 0
