"""The training-data operators: brute force, exact round trips, held-out accuracy, defined cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, common, covertree, langid, licenses, minhash, packing, pii, quality, queries, toxicity, urlfilter

SF = "/root/testdata/sf0.001"
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = ("word " * 40_000).strip()


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words long, component_id string, kept int, row string, id int")


def odd(spark):
    """Nulls, empty and very long texts, repeated rows, clashing names."""
    rows = [(1, None, "en"), (2, "", "en"), (3, LONG, None), (4, "ab cd", "fr"), (4, "ab cd", "fr"), (None, "ab cd", None), (5, "12 !!", "en"), (6, "\n \t\n", None)]
    return docs(spark, [(*r, 7, "x", 1, "y", 3) for r in rows])


# language

ALPHABETS = {"en": ("th ing er and of to ion", 1), "fr": ("eau que les é ou ai ç", 2), "de": ("ch sch ung ä ei ver ß", 3), "es": ("ción ñ os ar ll í", 4)}


def sentence(lang, rng, n=30):
    parts = ALPHABETS[lang][0].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_held_out():
    rng = random.Random(1)
    data = [(sentence(k, rng), k) for k in ALPHABETS for _ in range(60)]
    model = langid.fit(*map(list, zip(*data, strict=True)))
    test = [(sentence(k, rng, rng.randint(2, 40)), k) for k in ALPHABETS for _ in range(50)]
    out = model.predict([t for t, _ in test])
    assert (out["lang"] == [k for _, k in test]).mean() > 0.97 and out["score"].between(0, 1).all()
    long = model.predict([(test[0][0] + " ") * 3000])
    assert long["lang"][0] == test[0][1]
    assert model.predict([None, "", "12 !"])["lang"].tolist() == ["und"] * 3
    assert langid.fit([], []).predict(["abc"])["lang"].tolist() == ["und"]


@pytest.mark.parametrize("k", [1, 2, 4, 6, 9, 30])
def test_codewords_differ(k):
    c = langid.codewords(k)
    assert len({tuple(r) for r in c}) == k


def test_language_odd_rows(spark):
    d = odd(spark)
    got = langid.identify(d, langid.train(d)).collect()
    assert len(got) == 8 and [r.language.lang for r in got if r.text in (None, "", "12 !!", "\n \t\n")] == ["und"] * 4
    assert langid.identify(d.limit(0), langid.train(d.limit(0))).count() == 0


# quality


def brute_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit |= set(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_features(spark):
    rng = random.Random(2)
    texts = [None, "", "a b c d e", "a b c d e a b c d e", "x\n\nx\n \ny", "é ß 😀 a|b <c>", *("".join(rng.choice(["a ", "b ", "c\n", "d\t", "# "]) for _ in range(rng.randint(1, 80))) for _ in range(40))]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.judge(d).collect()}
    for i, t in enumerate(texts):
        b = brute_quality(t)
        assert tuple(got[i][f] for f in quality.FEATURES) == b
        assert got[i].base_failed == (b[0] < 10 or 100 * b[4] > 20 * b[0]) and not (got[i].base_failed and got[i].kept)


def test_quality_order_never_changes_a_verdict(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    a = quality.judge(d, order=list(quality.RULES)).select("doc_id", "kept")
    b = quality.judge(d, order=list(quality.RULES)[::-1]).select("doc_id", "kept")
    assert a.exceptAll(b).isEmpty()
    plan = quality.plan_cascade(d)
    assert {r.name for r, _, _ in plan} == {r.name for r in quality.RULES} and all(0 <= s <= 1 for _, _, s in plan)


def test_quality_odd_rows(spark):
    out = quality.judge(odd(spark))
    assert out.count() == 8 and out.where("kept").where("text is null or text = ''").isEmpty() and "component_id" in out.columns
    assert quality.judge(odd(spark).limit(0)).count() == 0


# near duplicates


def brute_groups(texts, k, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_brute(spark, k):
    rng = random.Random(k)
    vocab = [f"w{i}" for i in range(300)]
    texts = [None, "", " ", "One", "one", "one two", "ONE two", "É", "é"]
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    n, root = brute_groups(texts, k, 80)
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.id: r for r in minhash.near_duplicates(d, k=k).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == n
    assert [got[i].component_id for i in range(len(texts))] == root
    assert all(r.kept == (r.component_id == r.id) for r in got.values())


def test_near_duplicates_odd_rows(spark):
    out = minhash.near_duplicates(odd(spark), k=2).collect()
    assert len(out) == 8 and [r for r in out if r.id is None][0].component_id is None
    assert all(r.component_id == r.id for r in out if r.id in (1, 2, 3, 4, 5))
    assert minhash.near_duplicates(odd(spark).limit(0)).count() == 0


def test_min_max_estimates_similarity():
    rng = np.random.default_rng(0)
    a, b = minhash._perms(2000)
    x = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    u, v = np.sort(x[:800]), np.sort(x[100:])
    p, q = np.stack(minhash.min_max(u, a, b)), np.stack(minhash.min_max(v, a, b))
    assert (p == q).mean() == pytest.approx(700 / 900, abs=0.03)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    root = list(range(60))
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in common.components(common.Scratch(spark), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, i) == root[i] for i in range(60))


# tokens


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    tok, enc, pack = Tokenizer.from_file(PATH), bpe.Encoder(bpe.load(PATH)), packing.encoder(open(PATH, encoding="utf-8").read())
    rng = random.Random(4)
    texts = ["", " a", "a  b", "  ", " \n", "don't  we'll ", "x<|endoftext|> y", "日本語 テスト é² ½ 😀", "a" * 5000, "\t\tif x:\n    y = 1\n"]
    texts += ["".join(rng.choice("abz  \n\t.'09é日\u00a0") for _ in range(rng.randint(1, 90))) for _ in range(800)]
    for t in texts:
        want = tok.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == want and np.frombuffer(pack(t), "<u4").tolist() == want
        assert enc.decode(enc.encode(t)) == tok.decode(want, skip_special_tokens=False) == t


def test_bpe_rows(spark):
    out = bpe.encode_decode(odd(spark), PATH)
    assert all(r.decoded == (r.text or "") for r in out.collect()) and out.limit(0).count() == 0
    d = bpe.encode_decode(odd(spark), PATH, digests=True).where("doc_id = 2").first()
    assert (d.n_tokens, d.ids_sha256) == (0, hashlib.sha256(b"").hexdigest())


def test_fullest_is_the_best_sum():
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(rng.randint(1, 7))}
        room = rng.randint(1, 90)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * j for s in sums for j in range(c + 1)}
        got = packing.fullest(counts, room)
        assert sum(n * m for n, m in got.items()) == max(s for s in sums if s <= room) and all(m <= counts[n] for n, m in got.items())


def test_packing_is_exact(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("ab" for _ in range(rng.randint(0, 900)))) for i in range(150)] + [(500, LONG), (501, None), (502, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = packing.pack(d, open(PATH, encoding="utf-8").read(), with_ids=True).collect()
    texts, enc = dict(rows), bpe.Encoder(bpe.load(PATH))
    for i, t in texts.items():
        mine = sorted((r for r in out if r.doc_id == i), key=lambda r: r.piece)
        ids = np.frombuffer(enc.encode(t), "<u4").tolist() + [2]
        assert [x for r in mine for x in r.ids] == ids and [r.start for r in mine] == list(np.cumsum([0, *(r.length for r in mine)])[:-1])
        assert all(r.length == 1024 for r in mine[1:])
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:], strict=False)) and sum(x[1] for x in b) <= 1024
    room: list[int] = []  # no more than first fit of falling lengths takes
    for n in sorted((r.length for r in out), reverse=True):
        at = next((i for i, x in enumerate(room) if x >= n), None)
        if at is None:
            room.append(1024 - n)
        else:
            room[at] -= n
    assert len(bins) <= len(room)
    assert packing.pack(d.limit(0), open(PATH, encoding="utf-8").read()).count() == 0


# vectors


@pytest.mark.parametrize("seed", range(4))
def test_links_brute(spark, seed):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((6, 5))
    x = np.concatenate([base[rng.integers(0, 6, 300)] + rng.standard_normal((300, 5)) * rng.choice([0.05, 0.3, 1.0], 300)[:, None], np.repeat(base[:1], 40, 0), 3 * base[:2]])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 5), (902, [float("nan")] * 5), (903, [1.0, None]), (904, []), (905, [1.0, 2.0])]
    got = {r.id: r for r in covertree.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), unit=64).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = u @ u.T >= 0.95
    np.fill_diagonal(g, False)
    assert [got[i].n_links for i in range(len(x))] == g.sum(1).tolist()
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min([label[i], *label[g[i]]]) for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    assert [got[i].component_id for i in range(len(x))] == label.tolist()
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(900, 906))


def test_an_id_with_different_vectors_is_refused(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (3, [0.0, 1.0])]
    assert covertree.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == 6
    with pytest.raises(ValueError, match="different vectors: 2"):
        covertree.similar_vectors(spark.createDataFrame([*rows, (2, [1.0, 1.0])], "vec_id long, embedding array<double>"))


def test_more_than_1000_lengths(spark):
    rows = [(2 * n + k, [1.0] * n) for n in range(1, 1006) for k in range(2)]
    got = covertree.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(rows) and all(r.n_links == 1 and r.component_id == r.id // 2 * 2 for r in got)


def test_no_vectors(spark):
    e = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert covertree.similar_vectors(e).count() == 0


# urls


def test_url_rules_brute(spark):
    rng = random.Random(7)
    rules = [(rng.choice(["allow", "block"]), h, p) for h in ("org", "example.org", "a.example.org", "com") for p in ("/", "/en/", "/en/1", "/EN")]
    urls = [None, "", "no scheme", "http://", "http://EXAMPLE.org", "x://a.example.org/en/12?q#f", "http://example.org?x=/en/", "a://b://c/"]
    urls += [f"http://{rng.choice(['', 'www.', 'a.'])}{rng.choice(['example.org', 'xexample.org', 'org', 'b.com', 'de'])}{rng.choice(['', '/', '/en/', '/en/12', '/EN/x'])}{rng.choice(['', '?a', '#b'])}" for _ in range(200)]
    out = urlfilter.judge(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), rules).orderBy("page_id").collect()
    for u, r in zip(urls, out, strict=True):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split(r"[/?#]", rest)[0]
            path = re.split(r"[?#]", rest[len(host) :])[0]
            host = host.lower()
        fit = [(len(h + p), h + p, v) for v, h, p in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit) if fit else (0, None, "allow" if host else "block")
        j = r.judged
        assert (j.host, j.path, j.rule, j.verdict) == (host, path, best[1], best[2])


def test_colliding_digests_do_not_decide():
    d, p, s = urlfilter.build([("block", "a.b", "/x")])
    t = urlfilter.Table(np.frombuffer(d, np.uint64), np.frombuffer(p, np.int64), np.frombuffer(s.replace(b"/x", b"/y"), np.uint8), [2])
    assert t.judge(["http://a.b/x"], "allow")["verdict"].tolist() == ["allow"]
    assert urlfilter.Table(*(np.empty(0, k) for k in (np.uint64, np.int64, np.uint8)), []).judge(["http://a/b"], "allow")["rule"].tolist() == [None]


# personal data


@pytest.fixture(scope="module")
def net():
    rng = random.Random(8)
    return pii.fit([sentence("en", rng, 60) + f" {rng.randint(1, 10**6)} " + sentence("de", rng, 10) for _ in range(60)], steps=250)


def plain_spans(t):
    out = []
    for k, r in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(r, t):
            d = re.sub(r"[^0-9]", "", m[0])
            if (k == 1 and any(int(p) > 255 for p in m[0].split("."))) or (k == 2 and not (12 <= len(d) <= 19 and pii.luhn(d))) or (k == 3 and not 9 <= len(d) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_brute():
    rng = random.Random(9)
    for _ in range(3000):
        t = "".join(rng.choice(["a", "@", ".", "b.c", "1", "23", "+4", " ", "-", "(", "é", "4242424242424242", "10.0.0.1", "@x.y"]) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == plain_spans(t)
    assert pii.base_spans(None) == []


def test_network_finds_variants(net):
    rng, gen, hits = np.random.default_rng(10), random.Random(11), []
    for _ in range(200):
        k, s = pii._variants(rng)
        left = sentence("fr", gen, 20)
        text = f"{left} {s} {sentence('en', gen, 20)}"
        _, whole = pii.Finder(net).spans([text])
        hits.append(any(a <= len(left) + 3 and b >= len(left) + len(s) - 2 and j == k for a, j, b in whole[0]))
    assert np.mean(hits) > 0.8
    clean = [sentence("en", gen, 80) + f" in 19{i} he had {i} of 1{i}00" for i in range(50)]
    assert not any(pii.Finder(net).spans(clean)[1])


def test_addresses_without_digits_are_found(net):
    gen, hits = random.Random(18), []
    word = lambda: "".join(gen.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(gen.randint(3, 7)))
    for at, dot in [("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", "."), (" (at) ", " (dot) "), ("(at)", ".")] * 12:
        left, s = sentence("fr", gen, 40), f"{word()}.{word()}{at}{word()}{dot}org"
        text = f"{left} {s} {sentence('en', gen, 40)}"
        assert not re.search("[0-9@]", text)
        base, whole = pii.Finder(net).spans([text])
        hits.append(base == [[]] and any(k == 0 and a <= len(left) + 3 and e >= len(left) + len(s) - 2 for a, k, e in whole[0]))
        if hits[-1]:
            assert "<EMAIL>" in pii.redact(text, whole[0])
    assert np.mean(hits) > 0.8


def test_every_plausible_span_passes_the_window_test():
    rng = random.Random(19)
    for _ in range(20_000):
        s = "".join(rng.choice(["a", "@", ".", "(at)", "[at]", "(dot)", "[dot]", " ", "1", "23", "+", "-", "("]) for _ in range(rng.randint(1, 9)))
        assert pii._TRIGGER.search(s) or not any(pii.plausible(k, s) for k in range(4))


def test_spans_across_windows(net):
    gen = random.Random(12)
    for pad in range(100, 180, 7):
        text = (sentence("en", gen, 60)[:pad] + " 4242424242424242 " + sentence("en", gen, 60)) * 2
        base, whole = pii.Finder(net).spans([text])
        assert [s for s in base[0] if s not in whole[0]] == [] and len(base[0]) == 2
        assert pii.redact(text, whole[0]).count("<CARD>") == 2


def test_gradients_match_differences():
    net = pii.Network.new(1, 4)
    rng = np.random.default_rng(0)
    ids, tags = rng.integers(0, pii.VOCAB, (3, 9)), np.zeros((3, 9), int)
    tags[:, 3], tags[:, 4] = 1, 2
    net.trans += rng.normal(size=net.trans.shape).astype(np.float32) * 0.1
    _, grads = net.gradients(ids, tags)
    for p, g in zip(net.params(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = net.gradients(ids, tags)[0]
        p[at] = old - 1e-2
        down = net.gradients(ids, tags)[0]
        p[at] = old
        assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.05, abs=1e-3)


def test_pii_odd_rows(spark, net):
    out = pii.find(odd(spark), net).collect()
    assert len(out) == 8 and all(r.pii.base == "" for r in out) and [r for r in out if r.text is None][0].pii.redacted is None
    assert pii.find(odd(spark).limit(0), pii.train(odd(spark).limit(0))).count() == 0


# toxicity


def test_toxicity_held_out():
    rng = random.Random(13)
    bad = ["vexor", "grimulk", "snarfle"]

    def make(toxic):
        w = sentence("en", rng, rng.randint(20, 200)).split()
        for _ in range(rng.randint(1, 3) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "!", ","]))
        return " ".join(w)

    data = [(make(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    net = toxicity.fit(*map(list, zip(*data, strict=True)), steps=150)
    test = [(make(i % 4 == 0), i % 4 == 0) for i in range(200)]
    s = toxicity.Scorer(net).score([t for t, _ in test])
    assert np.mean((s >= 0.7) == [y for _, y in test]) > 0.95
    far = toxicity.Scorer(net).score([sentence("en", rng, 3000) + " vexor grimulk " + sentence("en", rng, 3000), None, ""])
    assert far[0] >= 0.7 and far[1] == far[2] == net.rate


def test_all_grams_of_a_word_are_read():
    net = toxicity.Network.new(4)
    word = "abcdefghijklmnopqrstuvwxyzäöü"
    lex = toxicity.Lexicon({})
    others = [word[:i] + "Q" + word[i + 1 :] for i in range(len(word))]
    lex.add([word, "a", *others])
    x = net.inputs(*lex.arrays())[:, toxicity.DIM : 2 * toxicity.DIM]
    assert all(np.abs(x[2 + i] - x[0]).max() > 0 for i in range(len(others)))
    for w, row in zip([word, "a", *others], x, strict=True):
        b = f"^{w}$".encode()
        want = np.mean([net.p["ec"][toxicity.zlib.crc32(b[i : i + 3]) % toxicity.SLOTS] for i in range(len(b) - 2)], 0)
        assert row == pytest.approx(want, abs=1e-5)
    at = np.array([3, 1, 0])
    assert net.inputs(*toxicity.taken(lex.arrays(), at)) == pytest.approx(net.inputs(*lex.arrays())[at], abs=1e-6)


def test_runs_without_blanks_are_cut_into_words():
    rng = random.Random(20)
    chinese = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(999))
    letters = "".join(chr(rng.randint(0x430, 0x44F)) for _ in range(999))
    marked = "".join(c + "_" * (i % 5 == 0) for i, c in enumerate(letters))
    for text in (chinese, letters, marked, letters[:32] + chinese[:9] + letters[32:80]):
        words = toxicity.words_of(text)
        assert len(words) > 1 and max(map(len, words)) <= toxicity.LONGEST
        at = 0  # the pieces, in order, leave out no character but marks
        for w in words:
            i = text.find(w, max(at - len(w), 0))
            assert i >= 0 and not text[at:i].strip("_-")
            at = max(at, i + len(w))
        assert not text[at:].strip("_-")
    assert max(map(len, toxicity.words_of("-" * 100))) <= toxicity.LONGEST
    assert toxicity.words_of("Don't stop, a_b (über)!") == ["don't", "stop", "a_b", "über"]


@pytest.mark.parametrize("script", ["chinese", "marks"])
def test_toxicity_without_blanks(script):
    rng = random.Random(21)
    plain = [chr(c) for c in range(0x4E00, 0x4E80)] if script == "chinese" else ["so", "la", "tem", "ori", "ban", "kel", "mu"]
    bad, gap = ("\u9f8d\u9f9c", "") if script == "chinese" else ("vexor", "_")

    def make(toxic, n):
        w = [rng.choice(plain) for _ in range(n)]
        if toxic:
            w.insert(rng.randrange(len(w)), bad)
        return gap.join(w)

    data = [(make(i % 4 == 0, rng.randint(60, 200)), int(i % 4 == 0)) for i in range(400)]
    net = toxicity.fit(*map(list, zip(*data, strict=True)), steps=150)
    test = [(make(i % 2 == 0, 2000), i % 2 == 0) for i in range(60)]
    s = toxicity.Scorer(net).score([t for t, _ in test])
    assert np.mean((s >= 0.7) == [y for _, y in test]) > 0.9


def test_toxicity_gradients():
    net = toxicity.Network.new(2)
    rng = np.random.default_rng(1)
    lex = toxicity.Lexicon({"w1": 1.0})
    lex.add([f"w{i}" for i in range(12)])
    idx, mask, y = rng.integers(0, 12, (4, 6)), np.ones((4, 6), np.float32), np.array([1, 0, 1, 0])
    mask[0, 3:] = 0
    words = lex.arrays()
    loss = lambda: float(np.mean(np.log1p(np.exp(-(2 * y - 1) * net.run(net.gates(net.inputs(*words)), idx, mask)[0]))))
    for k, g in net.gradients(words, idx, mask, y).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = net.p[k][at]
        net.p[k][at] = old + 1e-2
        up = loss()
        net.p[k][at] = old - 1e-2
        down = loss()
        net.p[k][at] = old
        assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.05, abs=1e-3)


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, None), (4, 1), (4, 0), (None, 1)], "doc_id long, toxic int")
    net = toxicity.train(odd(spark), labels)
    assert net.constant and toxicity.score(odd(spark), net).where("toxicity is null").isEmpty()
    assert toxicity.score(odd(spark).limit(0), net).count() == 0


def test_rare_toxic_labels_are_learned(spark):
    rng = random.Random(22)
    rows = [(i, sentence("en", rng, 40) + (" vexor grimulk" if i % 500 == 3 else ""), int(i % 500 == 3)) for i in range(4000)]
    long = [(5000 + i, "word " * 5000, 1) for i in range(300)]  # not fitted, nor may they fill the sample
    d = spark.createDataFrame(rows + long, "doc_id long, text string, toxic int")
    net = toxicity.train(d.select("doc_id", "text"), d.select("doc_id", "toxic"), rows=80)
    assert not net.constant and net.rate == pytest.approx(8 / 4000)
    s = toxicity.Scorer(net).score([sentence("en", rng, 40) + " vexor grimulk", sentence("en", rng, 40)])
    assert s[0] >= 0.7 > s[1]


def test_windows_hold_every_word():
    for n in (1, 47, 48, 49, 80, 81, 500):
        s = toxicity.windows(n)
        assert set(range(n)) <= {i for a in s for i in range(a, a + toxicity.WIDTH)}


# licences


@pytest.fixture(scope="module")
def model():
    rng = random.Random(14)
    return licenses.fit([sentence(k, rng, 25) for k in ALPHABETS for _ in range(40)])


def test_licences_held_out(model):
    rng, hits = random.Random(15), []
    for family, texts in licenses.TEMPLATES.items():
        for t in texts:
            body = sentence("en", rng, 40) + "\n" + t + "\n" + sentence("fr", rng, 40)
            hits.append([f for f, _, _ in model.scan(body)] == [family])
            w = t.split()
            if len(w) > 25:
                del w[7], w[15]
                hits.append(family in [f for f, _, _ in model.scan(" ".join(w))])
    assert np.mean(hits) > 0.85
    assert not any(model.scan(t) for t in (*licenses.OTHERS, None, "", "His license plate was lost. All rights to appeal were denied.", sentence("de", rng, 500)))


PLANTED = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL",
    "All rights reserved.": "proprietary",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
}


def test_notices_without_hints_are_found(model):
    rng = random.Random(16)
    free = "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    cut = free.split()
    wrapped = "\n".join(" ".join(cut[i : i + 9]) for i in range(0, len(cut), 9))
    for line, family in {**PLANTED, free: "Unlicense", wrapped: "Unlicense", "CC-BY-SA 4.0": "CC-BY-SA", "CC-BY 4.0": "CC-BY"}.items():
        for text in (line, sentence("en", rng, 300) + "\n" + line + "\n\n" + sentence("de", rng, 300)):
            assert [f for f, _, _ in model.scan(text)] == [family]
    for plain in ("All the rights of the crew were reserved.", "He is free to copy it by any means.", "The report of the year is in the file."):
        assert model.scan(plain) == []


def test_planted_licences_are_found_by_the_trained_model(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    m = licenses.train(d)
    planted = [(r.text, PLANTED[x]) for r in d.collect() for x in (r.text or "").split("\n") if x in PLANTED]
    assert planted and all(family in [f for f, _, _ in m.scan(t)] for t, family in planted)
    assert all([f for f, _, _ in m.scan(x)] == [family] for x, family in PLANTED.items())


def test_known_grams_are_all_grams(model):
    rng = random.Random(17)
    words = [w for t in licenses.OTHERS for w in t.split()] + ["zzz", "the", "of"]
    for _ in range(200):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) + " the license plate of"
        assert model.features(t) == sorted({model.vocabulary[g] for g in licenses.grams(t) if g in model.vocabulary})


def test_licence_rows(spark, model):
    d = odd(spark).withColumn("text", F.when(F.col("doc_id") == 3, F.concat("text", F.lit("\nReleased under the MIT License."))).otherwise(F.col("text")))
    got = {r.doc_id: [x.family for x in r.licences] for r in licenses.scan(d, model).collect()}
    assert got[3] == ["MIT"] and got[1] == [] and licenses.scan(d.limit(0), model).count() == 0


# queries and pipeline


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_sql(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.SQL[name]).df()
    key = got.columns[0]
    got, want = (x.sort_values(key)[sorted(got.columns)].astype(object).where(x.sort_values(key).notna(), None) for x in (got, want))
    assert got.astype(str).values.tolist() == want.astype(str).values.tolist()


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_other_queries_cover_the_table(spark, name):
    out = queries.QUERIES[name](spark, SF)
    key, table = ("vec_id", "embeddings") if "vec_id" in out.columns else ("doc_id", "documents")
    assert out.select(key).distinct().count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_slices_are_read_whole_or_not_at_all(spark, tmp_path):
    scratch = common.Scratch(spark)
    slices = common.Slices(scratch, spark.range(1000).select("id", F.expr("cast(id % 3 as int)").alias("slice")))
    assert sorted(sum((slices.read(k)["id"].to_pylist() for k in slices.rows), [])) == list(range(1000))
    assert slices.read(3) is None
    slices.rows[1] += 1
    with pytest.raises(OSError):
        slices.read(1)


def test_busy_vectors_do_not_pass_through_the_driver(spark, monkeypatch):
    kind = type(spark.range(1))
    taken, collect = [], kind.collect
    monkeypatch.setattr(kind, "toArrow", lambda self: pytest.fail("a table came to the driver"))
    monkeypatch.setattr(kind, "collect", lambda self: taken.append(collect(self)) or taken[-1])
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 24))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = covertree.similar_vectors(d, unit=200, sample=100, sent=40_000, rows=0.0)
    assert any(rows and "visits" in rows[0] for rows in taken) and not any(rows and "u" in rows[0] for rows in taken)
    assert out.count() == 1500


def test_pipeline_against_plain_version(spark):
    import corpus_pipeline as cp

    src = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars", F.col("n_chars").alias("kept"), F.col("source").alias("id"))
    extra = spark.createDataFrame([(9001, None, "en", "s", 0, 1, "x"), (9002, "", "en", "s", 0, 1, "x"), (None, "12", None, None, None, None, None)], src.schema)
    d = src.union(extra).union(src.where("doc_id = 1")).cache()
    rows = {r.doc_id: r for r in d.collect()}
    a = cp.STAGES[0][1](spark, d, SF)
    assert a.columns == d.columns and {r.doc_id for r in a.collect()} == {i for i, r in rows.items() if r.text and any(c.isalpha() for c in r.text)}
    b = cp.STAGES[1][1](spark, a, SF).cache()
    kept = {r.doc_id for r in quality.judge(a.select("doc_id", "text"), order=list(quality.RULES)).where("kept").collect()}
    assert b.columns == d.columns and {r.doc_id for r in b.collect()} == kept
    c = cp.STAGES[2][1](spark, b, SF).cache()
    order = sorted(kept)
    _, root = brute_groups([rows[i].text for i in order], 5, 80)
    assert c.columns == d.columns and sorted(r.doc_id for r in c.collect()) == [order[k] for k in range(len(order)) if root[k] == k]
    e = cp.STAGES[3][1](spark, c, SF).cache()
    assert e.columns == d.columns
    for r in e.collect():
        assert not plain_spans(r.text) and r.n_chars == len(r.text)
        assert plain_spans(rows[r.doc_id].text) or "<" in r.text or r.text == rows[r.doc_id].text
    f = cp.STAGES[4][1](spark, e, SF)
    assert {r.doc_id for r in f.collect()} == {r.doc_id for r in e.collect()}
    empty = d.limit(0)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
