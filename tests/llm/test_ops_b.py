import hashlib
import re
import zlib

import numpy as np
import pytest
from helpers import DOCS, SF, awkward, collected, rng, words
from pyspark.sql import functions as F
from test_ops_a import brute_components, docs_of, expected, library, oracle, same

import corpus_pipeline
from tessera.llm import common, decontaminate, lm, quality, secrets, warc

# ---- op4


def test_warc_equals_sql(spark):
    same(warc.query(spark, SF), oracle(SF, warc.SQL), "page_id")


def awkward_pages(spark):
    big = "<p>é</p>" * 300
    rows = [(0, "http://A.example/x?Q=1#f", big), (1, None, big), (2, "", None), (3, "http://www.a.example/x", ""), (4, "http://a.example/\r\nX: y", big), (5, "ftp://[bad", "short"), (6, "u", "short"), (7, "http://b.example", "y" * 3_000_000), (8, "http://a.example/x?q=1", big + "!")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("file", "offset", "refers", "page", "sha"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.mark.parametrize("s", [warc.Settings(), warc.Settings(archive=500, run=2, every=1, fan_in=2, captures=2)])
def test_warc_awkward_and_external_merge(spark, s):
    pages = awkward_pages(spark)
    written = warc.write(pages, s)
    back = collected(warc.read(written, payloads=True), "page_id")
    assert [r["record_type"] for r in back] == ["revisit", "revisit", "response", "response", "response", "response", "response", "response", "response"]
    assert [r["refers_to"] for r in back[:2]] == [4, 4]
    for r, p in zip(back, sorted(pages.collect(), key=lambda p: p.page_id), strict=True):
        raw = (p.html or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert r["payload"] == (raw if r["record_type"] == "response" else None)
    index = sorted((r.asDict() for r in warc.merged(written, s).collect()), key=lambda r: (r["range"], r["place"]))
    keys = [(r["urlkey"], r["captured"], r["page_id"]) for r in index]
    assert keys == sorted(keys) and {r["page_id"] for r in index} == set(range(9))
    assert {(r["file"], r["offset"]) for r in index} == {(r["file"], r["offset"]) for r in back}


def test_warc_of_nothing(spark):
    written = warc.write(awkward_pages(spark).where("false"))
    assert warc.read(written).count() == 0 and warc.merged(written).count() == 0


def test_loser_tree():
    r = rng(4)
    for k in (1, 2, 3, 7, 16):
        runs = [sorted((f"{r.randrange(50):03d}", f"{i}") for _ in range(r.randrange(0, 30))) for i in range(k)]
        got = list(warc.LoserTree([iter(x) for x in runs]))
        assert sorted(x for y in runs for x in y) == sorted(got) and [g[0] for g in got] == sorted(g[0] for g in got)
    assert list(warc.LoserTree([])) == []


# ---- op8


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = quality.query(spark, sf).join(labels, "doc_id", "left").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.quality is not None]
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    print("auc", auc, "accuracy", np.mean([r.predicted == r.quality for r in held]))
    assert auc > 0.85


def test_quality_awkward(spark):
    docs, labels = docs_of(spark), spark.read.parquet(f"{SF}/labels.parquet")
    odd = awkward(spark, [None, "", "a", "a", "one two\n" * 30_000], ("predicted", "share_lower", "i", "y"))
    model = quality.train(docs, labels)
    got = collected(quality.score(odd, model))
    assert got[0]["score"] == got[1]["score"] and got[2] | {"doc_id": 3} == got[3] and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(odd.where("false"), model).count() == 0
    bare = quality.train(docs, labels.where("false"))
    assert bare.rules == () and {r["score"] for r in collected(quality.score(odd, bare))} == {0.5}


def test_compiled_rules_equal_numpy(spark):
    r = np.random.default_rng(2)
    x = r.random((1500, len(quality.STATS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.4) | (x[:, 7] > 0.9)).astype(float)
    model = quality.fit(x, y)
    assert model.rules and np.mean((model.numpy_logit(x) > 0) == y) > 0.97 and len(model.rules) < 120
    df = spark.createDataFrame(x[:200].tolist(), list(quality.STATS)).withColumn("i", F.monotonically_increasing_id())
    got = [v.z for v in df.select("i", model.logit().alias("z")).orderBy("i").collect()]
    assert np.allclose(got, model.numpy_logit(x[:200]))


# ---- op10


def test_lm_learns_both_sides(spark):
    r = rng(6)
    cycle = [f"w{k}" for k in range(30)]
    real = [" ".join(cycle[(a + k) % 30] for k in range(60)) for a in (r.randrange(30) for _ in range(400))]
    mixed = [" ".join(r.choice(cycle) for _ in range(60)) for _ in range(5)]
    s = lm.Settings(buckets=1 << 12, classes=32, batch=256, rounds=1)
    train = awkward(spark, real)
    lex = lm.lexicon(train, s)
    net = lm.train(train.coalesce(1), lex, s)
    got = [x["mean_log_prob"] for x in collected(lm.score(awkward(spark, real[:5] + mixed), lex, net, s))]
    assert min(got[:5]) > max(got[5:]) + 0.5


def test_lm_sums_conditionals(spark):
    s = lm.Settings(buckets=1 << 10, classes=8, hidden=4)
    texts = [None, "", "a b c", "a b c", words(rng(1), 700), "A"]
    docs = awkward(spark, texts, ("log_prob", "n_tokens"))
    lex = lm.lexicon(docs, s)
    net = lm.train(docs, lex, s)
    got = collected(lm.score(docs, lex, net, s))
    assert got[0]["n_tokens"] == got[1]["n_tokens"] == 0 and got[0]["log_prob"] == 0 and got[2]["log_prob"] == got[3]["log_prob"]
    for row, t in zip(got, texts, strict=True):
        if t:
            raw = np.frombuffer(t.encode(), np.uint8)
            b, first = lm.tokens(raw, np.array([0, len(raw)]), lm.hasher(), s)
            cls, total = lex.of[b].tolist(), 0.0
            for i, c in enumerate(cls):
                ctx = [[cls[i + o] if 0 <= i + o < len(cls) else s.classes] for o in s.offsets]
                total += lex.log_inner[b[i]] + net.forward(np.array(ctx))[1][0, c]
            assert row["n_tokens"] == len(t.split()) and abs(row["log_prob"] - total) < 1e-3 * max(1, abs(total))
    assert np.allclose(np.bincount(lex.of, np.exp(lex.log_inner)), 1)
    assert lm.score(docs.where("false"), lex, net, s).count() == 0
    none = lm.lexicon(docs.where("false"), s)
    assert lm.train(docs.where("false"), none, s).flat.shape == net.flat.shape


def test_lm_gradient():
    s = lm.Settings(classes=5, hidden=3, sides=1)
    r = np.random.default_rng(0)
    ctx, target = r.integers(0, 6, (2, 40)), r.integers(0, 5, 40)
    net = lm.Net(s)
    def loss(flat):
        return -lm.Net(s, flat).forward(ctx)[1][np.arange(40), target].mean()

    moved = lm.Net(s, net.flat)
    moved.step(ctx, target, 1e-2)
    step = (net.flat - moved.flat) / 1e-2
    for k in range(0, len(net.flat), 7):
        d = np.zeros(len(net.flat), np.float32)
        d[k] = 1e-2
        assert abs((loss(net.flat + d) - loss(net.flat - d)) / 2e-2 - step[k]) < 2e-2


def grown(spark, texts, s):
    docs = awkward(spark, texts)
    lex = lm.lexicon(docs, s)
    return docs, lex, lm.train(docs, lex, s)


def scored(text, lex, net, s):
    raw = np.frombuffer(text.encode(), np.uint8)
    _, cls, ctx, below, _ = lm.read(raw, np.array([0, len(raw)]), lm.hasher(), lex, s)
    return net.log_prob(ctx, cls, below)


def test_lm_tells_all_words_apart(spark):
    s = lm.Settings()
    n = 300_000
    texts = [" ".join(f"v{k}" for k in range(a, a + 1000)) for a in range(0, n, 1000)]
    docs, lex, net = grown(spark, texts, s)
    tree = lex.tree
    assert len(lex.of) == n + 1 and len(set(zip(lex.of.tolist(), tree.node.tolist(), tree.digit.tolist(), strict=True))) == n + 1
    ids, _ = lm.tokens(np.frombuffer(texts[7].encode(), np.uint8), np.array([0, len(texts[7])]), lm.hasher(), s)
    found = tree.find(ids)
    assert len(set(found.tolist())) == 1000 and n not in found
    by_class = {}
    for word, c in zip(texts[7].split(), lex.of[found].tolist(), strict=True):
        by_class.setdefault(c, []).append(word)
    a, b = next(x for x in by_class.values() if len(x) > 1)[:2]
    swapped = texts[7].replace(a + " ", "? ").replace(b + " ", a + " ").replace("? ", b + " ")
    assert swapped != texts[7]
    one, two = (x["log_prob"] for x in collected(lm.score(awkward(spark, [texts[7], swapped]), lex, net, s)))
    assert one != two


def test_lm_context_reaches_the_word(spark):
    """Pairs of words of equal count, so that only their partner tells which of a class comes."""
    r = rng(8)
    texts = [" ".join(f"l{k} r{k}" for k in (r.randrange(100) for _ in range(30))) for _ in range(600)]
    s = lm.Settings(classes=4, batch=64, rounds=2)
    docs, lex, net = grown(spark, texts, s)
    vocabulary = [f"{x}{k}" for x in "lr" for k in range(100)] + ["never"]
    assert abs(sum(np.exp(scored(f"l3 r3 {w} r5 l9", lex, net, s)[2]) for w in vocabulary) - 1) < 1e-4
    blank = lm.Net(s, np.zeros_like(net.flat), lex.levels)
    with_context, without = (sum(scored(t, lex, x, s).sum() for t in texts[:50]) for x in (net, blank))
    assert with_context > without + 50 * 60 * 0.3
    got = collected(lm.score(docs, lex, net, s))
    assert all(abs(x["log_prob"] - scored(t, lex, net, s).sum()) < 1e-3 * abs(x["log_prob"]) for x, t in zip(got[:20], texts, strict=False))


def test_lm_does_not_depend_on_partitions(spark):
    r = rng(12)
    docs = awkward(spark, [words(r, r.randrange(1, 300), 500) for _ in range(300)] + [None, ""])
    s = lm.Settings(batch=128, share=5000)
    found = []
    for n in (1, 8):
        parted = docs.repartition(n)
        lex = lm.lexicon(parted, s)
        found.append([x["log_prob"] for x in collected(lm.score(parted, lex, lm.train(parted, lex, s), s))])
    assert np.allclose(*found, rtol=1e-5) and lex.words > 6 * s.share


def test_lm_query_scores_every_document(spark):
    texts = [x.text for x in docs_of(spark).orderBy("doc_id").collect()]
    got = collected(lm.query(spark, SF))
    assert [x["n_tokens"] for x in got] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert all(x["log_prob"] < 0 if x["n_tokens"] else x["log_prob"] == 0 for x in got)
    docs, s = docs_of(spark), lm.Settings()
    lex = lm.lexicon(docs, s)
    net = lm.train(docs, lex, s)
    assert all(not t or abs(x["log_prob"] - scored(t, lex, net, s).sum()) < 1e-3 * abs(x["log_prob"]) for x, t in zip(got, texts, strict=True))


def test_lm_gradient_below_the_classes():
    s = lm.Settings(classes=3, hidden=3, sides=2)
    r = np.random.default_rng(1)
    keys = np.sort(r.integers(0, 2**63, 400).astype(np.uint64) * np.uint64(2))
    of, tree = lm.planted(keys, r.integers(1, 50, 400), s)
    ids = r.integers(0, 401, 60)
    digits, nodes = tree.paths(np.pad(ids, 2))
    nodes[:, [0, 1, -1, -2]] = -1
    below, cls = lm.Below(digits, nodes, tree.log_count), of[ids].astype(np.int64)
    ctx = lm.contexts(cls, np.array([0, 25, 60]), s)
    start = lm.Net(s, levels=tree.levels)
    start = lm.Net(s, start.flat + r.normal(0, 0.3, len(start.flat)), tree.levels)
    moved = lm.Net(s, start.flat, tree.levels)
    moved.step(ctx, cls, 1e-2, below)
    step = (start.flat - moved.flat) / 1e-2
    for k in range(0, len(start.flat), 5):
        d = np.zeros(len(start.flat), np.float32)
        d[k] = 1e-2
        up, down = (-lm.Net(s, start.flat + x, tree.levels).log_prob(ctx, cls, below).mean() for x in (d, -d))
        assert abs((up - down) / 2e-2 - step[k]) < 5e-3


# ---- pipeline


def test_pipeline_equals_brute_force(spark):
    """Each stage by itself, on what the one before kept."""
    docs = docs_of(spark)
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    kept = common.cut(stages["language_id"](spark, docs, SF))
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.text is not None and any(c.isalpha() for c in r.text)}
    ids = sorted(r.doc_id for r in kept.collect())
    comp = brute_components([rows[i].text for i in ids], 5)
    deduped = common.cut(stages["near_dedup"](spark, kept, SF))
    assert sorted(r.doc_id for r in deduped.collect()) == [i for i, c in zip(ids, comp, strict=True) if c[2]]
    clean = common.cut(stages["decontamination"](spark, deduped, SF))
    bad = oracle(SF, decontaminate.SQL, documents=deduped.toPandas())
    assert sorted(r.doc_id for r in clean.collect()) == sorted(bad[~bad.contaminated].doc_id.tolist())
    masked = stages["secret_scan"](spark, clean, SF)
    assert masked.columns == list(corpus_pipeline.COLUMNS) and masked.schema == clean.schema
    model = secrets.train(clean)
    for r in masked.collect():
        old = rows[r.doc_id]
        base = secrets.base_spans(old.text)
        spans = base + secrets.model_spans(old.text, base, model, secrets.Settings())
        assert r.text == (secrets.masked_text(old.text, spans, "[SECRET]") if spans else old.text)
        assert r.n_chars == (len(r.text) if spans else old.n_chars) and (r.lang, r.source) == (old.lang, old.source)
    t = library()
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    for r in masked.collect():
        o = out.pop(r.doc_id)
        assert (o.n_tokens, o.ids_sha256, o.decoded_sha256) == expected(t, r.text)
    assert not out


def test_pipeline_stages_take_awkward_rows(spark):
    docs = awkward(spark, [None, "", "12", "A text in English with the words of the language.", "A text in English with the words of the language.", "word " * 20_000])
    bare = docs.select(*corpus_pipeline.COLUMNS)
    for given in (docs.unionByName(docs.limit(4)), bare.where("false")):
        now = given
        for _, stage in corpus_pipeline.STAGES:
            now = common.cut(stage(spark, now, SF))
        assert now.count() == now.select("doc_id").distinct().count() <= 2


def test_rows_without_id_are_judged_apart(spark):
    items = common.table(spark, SF, "benchmark")
    dirty = next(r.text for r in items.where("text is not null").orderBy("item_id").collect() if len(r.text.split()) >= 20)
    clean = [f"clean number {k} has its own words and none of any benchmark" for k in range(3)]
    docs = spark.createDataFrame([(None, dirty, "en", "s", 1), (None, clean[0], "en", "s", 1), (5, dirty, "en", "s", 1), (5, clean[1], "en", "s", 1), (6, clean[2], "en", "s", 1)], DOCS)
    stage = dict(corpus_pipeline.STAGES)["decontamination"]
    assert sorted(r.text for r in stage(spark, docs, SF).collect()) == clean
    flags = [(r.doc_id, r.n_words, r.contaminated) for r in decontaminate.decontaminate(docs, items).where("doc_id is null").collect()]
    assert sorted(flags, key=str) == sorted([(None, len(clean[0].split()), False), (None, flags[0][1] if flags[0][2] else flags[1][1], True)], key=str)
    assert stage(spark, docs.where("false"), SF).count() == 0


def test_dedup_keeps_different_texts_under_one_id(spark):
    r = rng(21)
    a, b, c = (words(r, 60, 5000) for _ in range(3))
    rows = [(1, a), (1, b), (1, b), (2, a), (3, c), (3, "short one"), (3, "short one"), (3, "short two"), (None, c), (None, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF).collect()
    want = [(1, a), (1, b), (3, c), (3, "short one"), (3, "short two"), (None, c), (None, c)]
    assert sorted(((x.doc_id, x.text) for x in got), key=str) == sorted(want, key=str)


def test_warc_repeated_and_null_ids(spark):
    """One record for each row; rows that share an id are judged by their own payloads."""
    big, other = "<p>x</p>" * 300, "<p>y</p>" * 300
    rows = [(7, big), (7, other), (9, big), (3, other), (None, big), (9, "small"), (3, other)]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
    got = [(r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(warc.write(pages)).collect()]
    sha = {x: hashlib.sha1(x.encode()).hexdigest() for x in (big, other, "small")}
    want = [(7, sha[big], "revisit", 9), (7, sha[other], "response", None), (9, sha[big], "response", None), (3, sha[other], "revisit", 7), (None, sha[big], "response", None), (9, sha["small"], "response", None), (3, sha[other], "revisit", 7)]
    assert sorted(got, key=str) == sorted(want, key=str)
