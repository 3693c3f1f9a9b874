"""Small fixtures against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecrel.llm import bitslice, chat, common, decontaminate, graph, langid, lm, minhash, pieces, quality, sharding, suffixes

WORDS = "the of and sun moon tree river stone bird house light water road hill cloud rain wind grass field star".split()


def text(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


def docs_of(spark, texts):
    rows = [(i, t, "x", i, 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, node long, n double").repartition(3)


def odd_texts(rng):
    base = text(rng, 150, [f"w{i}" for i in range(400)])
    near = base.split()
    near[10] = "changed"
    return [None, "", "   \n ", "one", base, base, " ".join(near), base.upper(), text(rng, 3000), text(rng, 60), "é" * 500, "a" * 3000, base + " " + text(rng, 40)]


def test_language(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, 30) if i % 2 else text(rng, 30, "der die und nicht ein haus baum licht wasser".split()), "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "123 456", "de"), (102, "", None), (103, text(rng, 90000), None), (1, rows[1][1], "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", common.held_out(5)).withColumn("score", F.lit("clash"))
    found = langid.predict(df, langid.train(df.where(~F.col("held_out")))).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert all(by[i].lang_pred == ("en" if i % 2 else "de") for i in range(60))
    assert [by[i].lang_pred for i in (100, 101, 102, 103)] == ["und", "und", "und", "en"] and by[100].score == 0
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    # A language whose only text is far over a megabyte, in a row without an id, is learnt.
    long = spark.createDataFrame([(None, text(rng, 200_000, "uno due tre casa albero acqua luce".split()), "it")], "doc_id long, text string, lang string")
    more = langid.train(df.select("doc_id", "text", "lang").unionByName(long))
    asked = spark.createDataFrame([(1, "casa luce acqua albero"), (2, "nicht ein haus")], "doc_id long, text string").withColumn("held_out", F.lit(True))
    assert {r.doc_id: r.lang_pred for r in langid.predict(asked, more).collect()} == {1: "it", 2: "de"}
    nothing = langid.train(df.where(F.lit(False)))
    assert {r.lang_pred for r in langid.predict(df, nothing).collect()} == {"und"}
    assert langid.predict(df.where(F.lit(False)), nothing).count() == 0


def test_language_code_lengths():
    """Code lengths against the definition of method C, symbol by symbol."""
    model = langid.fit([("x", b"abracadabra"), ("y", b"banana")])
    for lang, train in (("x", b"abracadabra"), ("y", b"banana")):
        seen = {}
        for k in range(langid.ORDER + 1):
            for i in range(k, len(train)):
                seen.setdefault(train[i - k : i], Counter())[train[i]] += 1

        def cost(context, symbol, seen=seen):
            out = 0.0
            while True:
                c = seen.get(context)
                if c:
                    n, d = sum(c.values()), len(c)
                    if c[symbol]:
                        return out + math.log2((n + d) / c[symbol])
                    out += math.log2((n + d) / d)
                if not context:
                    return out + 8
                context = context[1:]

        word = b"abracabananz"
        grams = langid.grams_of(np.frombuffer(word, np.uint8), np.array([0, len(word)]))
        got = model.lengths(grams)[:, model.langs.index(lang)]
        # Before the text stand zero bytes, which no context holds.
        want = [cost(word[max(0, i - langid.ORDER) : i], s) for i, s in enumerate(word)]
        assert got == pytest.approx(want, abs=1e-4)


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 6)]) for i in range(80)]
    rows += [(200 + i, rows[0][1]) for i in range(30)] + [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, rows[1][1])]
    rows += [(20, [0.9] * 6), (20, [0.9] * 6), (304, [0.5]), (305, [2e6, 1.0, 0.0, 0.0, 0.0, 0.0]), (340, [1e17, -1e17, 3e16, 0.0, 1.0, 1.0]), (341, [1e17, -9e16, 3e16, 0.0, 1.0, 1.0]), (342, [-1e17, 1e17, 0.0, 0.0, 0.0, 0.5])]
    long = lambda x: max(-(2**63), min(2**63 - 1, x))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit("clash"))
    ok = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    got = {}
    for r in bitslice.search(df, df.where("vec_id % 20 = 0"), 20, block_rows=40, block_queries=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in {i for i, _ in ok if i % 20 == 0 and i != 20}:
        own = next(v for i, v in ok if i == q)
        best = sorted(((-sum(a * b for a, b in zip(own, v)), i) for i, v in ok if i != q))[:20]
        assert [(i, s) for _, i, s in sorted(got[q])] == [(i, long(-s)) for s, i in best]
    assert bitslice.search(df.where(F.lit(False)), df.where(F.lit(False)), 20).count() == 0


def classes(texts):
    """Class and number of links of each text."""
    sets = []
    for t in texts:
        w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
        sets.append(Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter())
    name, links = list(range(len(texts))), [0] * len(texts)
    for i in range(len(texts)):
        for j in range(i):
            o = sum((sets[i] & sets[j]).values())
            if sets[i] and o >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - o):
                links[i], links[j] = links[i] + 1, links[j] + 1
                a, b = sorted((name[i], name[j]))
                name = [a if x == b else x for x in name]
    return list(zip(name, links))


def test_near_duplicates(spark):
    rng = random.Random(3)
    texts = odd_texts(rng)
    base = text(rng, 120, [f"v{i}" for i in range(300)]).split()
    for _ in range(90):
        own = list(base)
        for _ in range(rng.randint(1, 4)):
            own[rng.randrange(120)] = f"z{rng.random()}"
        texts.append(" ".join(own))
    df = docs_of(spark, texts)
    for small, cluster in ((64, 4096), (4, 4096), (4, 40)):
        found = {r.doc_id: (r.class_id, r.n_links) for r in minhash.find(df, small=small, cluster=cluster).collect()}
        assert [found[i] for i in range(len(texts))] == classes(texts)
    df = df.withColumn("row_", F.lit(7))
    kept = minhash.dedup(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {c for c, _ in classes(texts)}
    assert minhash.find(df.where(F.lit(False))).count() == 0


def test_signature_is_unbiased():
    rng = np.random.default_rng(4)
    a = {int(k): int(w) for k, w in zip(range(40), rng.integers(1, 9, 40))}
    b = {k: int(w) for k, w in zip(range(10, 60), rng.integers(1, 9, 50))}
    truth = sum(min(a.get(k, 0), b.get(k, 0)) for k in range(60)) / sum(max(a.get(k, 0), b.get(k, 0)) for k in range(60))
    key = common.mix(np.arange(60, dtype=np.uint64) + np.uint64(7))
    parts = [(np.full(len(x), i), key[list(x)], np.array(list(x.values()))) for i, x in enumerate((a, b))]
    s = minhash.signatures(*(np.concatenate(x) for x in zip(*parts)), 2, 4096)
    assert abs((s[0] == s[1]).mean() - truth) < 4 * math.sqrt(truth * (1 - truth) / 4096)


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(30)]
    name = {x: x for e in links for x in e}
    for _ in name:
        for a, b in links:
            name[a] = name[b] = min(name[a], name[b])
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(x, x) == c for x, c in name.items())


def test_leaks(spark):
    rng = random.Random(6)
    items = [text(rng, 25, [f"q{i}" for i in range(500)]) for _ in range(8)] + [None, "", "two words", "Été Échec. Élan école"]
    edited = items[2].split()
    edited[5], edited[15] = "new", "other"
    clean = [text(rng, 200) for _ in range(10)]
    texts = [*clean, None, "", clean[0] + " " + items[0].upper() + ". " + clean[1], "x " + " ".join(edited), " ".join(items[3].split()[:6]), text(rng, 30000) + " " + items[4], items[5] + " " + items[5] + " " + items[6], "ÉTÉ ÉCHEC ÉLAN ÉCOLE"]
    df = docs_of(spark, texts)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("row", F.lit(1))
    for block in (1_000_000, 20):
        got = {(r.doc_id, r.item_id) for r in decontaminate.find(df, bench, block_words=block).collect()}
        assert got == {(12, 0), (13, 2), (15, 4), (16, 5), (16, 6), (17, 11)}
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {*range(12), 14}
    assert decontaminate.find(df, bench.where(F.lit(False))).count() == 0 and decontaminate.find(df.where(F.lit(False)), bench).count() == 0


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(map(max, h))


def test_alignment():
    rng = random.Random(7)
    pairs = [([rng.randrange(4) for _ in range(rng.randint(1, 12))], [rng.randrange(4) for _ in range(rng.randint(1, 9))]) for _ in range(200)]
    best, _ = decontaminate.align([np.array(a, np.uint64) for a, _ in pairs], [np.array(b, np.uint64) for _, b in pairs])
    assert best.tolist() == [smith_waterman(a, b) for a, b in pairs]


def covered(raw, match):
    count = Counter(b[i : i + match] for b in raw for i in range(len(b) - match + 1))
    out = []
    for b in raw:
        spans = suffixes.union([(i, i + match) for i in range(len(b) - match + 1) if count[b[i : i + match]] > 1])
        edges = [0, *(e for s in spans for e in s), len(b)]
        kept = b"".join(b[x:y] for x, y in zip(edges[::2], edges[1::2]))
        out.append((len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_strings(spark):
    rng = random.Random(8)
    shared = [text(rng, 30, [f"s{i}" for i in range(200)]) for _ in range(4)]
    texts = odd_texts(rng)
    for _ in range(60):
        parts = [text(rng, rng.randint(1, 15), [f"u{i}" for i in range(900)])]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            parts += [s[a : a + rng.randint(20, 140)], text(rng, 3, [f"u{i}" for i in range(900)])]
        texts.append(" ".join(parts))
    df = docs_of(spark, texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.report(df, match=48, seed=16).collect()}
    assert [got[i] for i in range(len(texts))] == covered([(t or "").encode() for t in texts], 48)
    # Seeds with more than three surroundings are counted by window; shorter passages are told beside.
    got = {r.doc_id: r for r in suffixes.report(df, match=48, seed=16, passage=(32, 12), crowd=3).collect()}
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in map(got.get, range(len(texts)))] == covered([(t or "").encode() for t in texts], 48)
    assert [got[i].n_repeated for i in range(len(texts))] == [n for _, n, _, _ in covered([(t or "").encode() for t in texts], 32)]
    clash = df.withColumn("row_", F.lit(1)).withColumn("spans", F.lit(2)).withColumn("spans_", F.lit(3))
    cut = suffixes.remove(clash, match=48, seed=16)
    assert cut.columns == clash.columns and cut.count() == len(texts)
    left = {r.doc_id: r.text for r in cut.collect()}
    for i, (n, removed, _, kept) in enumerate(covered([(t or "").encode() for t in texts], 48)):
        if (left[i] or "").isascii():
            assert hashlib.sha256((left[i] or "").encode()).hexdigest() == kept
    assert suffixes.report(df.where(F.lit(False))).count() == 0


def test_merge_of_runs():
    rng = random.Random(9)
    for _ in range(300):
        runs = []
        for _ in range(rng.randint(1, 6)):
            own = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(0, 6)))
            shared, rests = suffixes.front_code(own)
            assert suffixes.decode(shared, rests) == own
            runs.append((own, shared))
        out = list(suffixes.merge_runs(runs))
        strings = [runs[r][0][p] for r, p, _ in out]
        assert strings == sorted(x for own, _ in runs for x in own)
        assert all(out[i][2] == suffixes.shared_length(strings[i - 1], strings[i]) for i in range(1, len(out)))


def test_language_model(spark):
    rng = random.Random(10)
    texts = [text(rng, 40) + "." for _ in range(80)] + [None, "", "Zürich x THE the", text(rng, 20000)] + [f"rare{i} words{i}" for i in range(20)]
    df = docs_of(spark, texts).withColumn("held_out", common.held_out(10))
    counts = common.written(lm.count_tokens(df.where(~F.col("held_out"))), "counts")
    for table in (500_000, 12):  # with the smaller table most words go through the join
        model = lm.train(df.where(~F.col("held_out")), counts, table_words=table, sample_docs=50)
        got = {r.doc_id: r for r in lm.score(df, counts, model).collect()}
        low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        split = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), "\n"] for t in texts]
        c = Counter(w for i, s in enumerate(split) if zlib.crc32(str(i).encode()) % 10 for w in s)
        n, v = sum(c.values()), len(c)
        for i, s in enumerate(split):
            r = got[i]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(s), sum(w in c for w in s), n)
            assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in s), rel=1e-9)
            assert r.score < 0
    # The distribution is normalised: units in a context, and the words of a class.
    total = np.exp(model.log_probs(np.arange(lm.WORDS + lm.CLASSES), np.zeros((lm.WORDS + lm.CLASSES, lm.CONTEXT), np.int64))).sum()
    assert total == pytest.approx(1, abs=1e-4)
    nothing = df.where(F.lit(False))
    assert lm.train_and_score(nothing).count() == 0


def test_network_by_definition():
    """Probabilities and the gradient steps against a form with one row at a time; contexts that fill several chunks, and no rows."""
    draw = np.random.default_rng(5)
    size = lm.WORDS + lm.CLASSES
    noise = draw.random(size) + 0.1
    noise /= noise.sum()
    state = lm.begun(noise, 3)
    parts = lm.taken_apart(state[0])
    model = lm.Model(1, 1, np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int), np.zeros(1 << 16, int), np.ones(lm.CLASSES), **parts)
    units, contexts = draw.integers(0, size, 3000), draw.integers(0, size, (3000, lm.CONTEXT))
    contexts[::3] = contexts[0]
    peaks = []
    exp = np.exp
    lm.np.exp = lambda x, *a, **k: peaks.append(x.size) or exp(x, *a, **k)
    try:
        got = model.log_probs(units, contexts)
    finally:
        lm.np.exp = exp
    hidden = sum(parts["vectors"][contexts[:, j]].astype(float) * parts["mixing"][j] for j in range(lm.CONTEXT))
    logits = hidden @ parts["outputs"].T.astype(float) + parts["bias"]
    want = logits[np.arange(3000), units] - np.log(exp(logits).sum(1))
    assert np.allclose(got, want, atol=1e-4) and max(peaks) <= 512 * size
    assert len(model.log_probs(units[:0], contexts[:0])) == 0
    values, rows = draw.normal(size=(40, lm.SIZE)).astype(np.float32), draw.integers(0, 30, 120)
    plain = np.zeros((30, lm.SIZE))
    for i, r in enumerate(rows):
        plain[r] += values[i % 40]
    assert np.allclose(lm.added(rows, values, 30), plain, atol=1e-5)


def test_rows_without_own_ids(spark):
    """Rows whose ids are null or repeat are judged by their texts, in near-dedup and in decontamination."""
    rng = random.Random(13)
    a, b, c, leak = (text(rng, 40, [f"{k}{i}" for i in range(300)]) for k in "abcd")
    df = spark.createDataFrame([(None, a), (None, b), (None, a), (7, c), (7, leak), (None, leak), (7, None), (None, "")], "doc_id long, text string").repartition(3)
    assert sorted(r.text or "" for r in minhash.dedup(df).collect()) == sorted([a, b, c, leak, "", ""])
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    assert sorted(r.text or "" for r in decontaminate.clean(df, bench).collect()) == sorted([a, b, a, c, "", ""])


def test_language_model_learns_from_every_text(spark):
    """Words that follow each other only in one late, long text of over 64 KB among 1,600 others are learnt in that order."""
    rng = random.Random(12)
    late = " ".join(["left", "right"] * 9000)
    texts = [text(rng, 12) for _ in range(1600)] + [late, "left right " * 30, "right right " * 30]
    df = docs_of(spark, texts).withColumn("held_out", F.col("doc_id") > 1600)
    assert len(late) > 1 << 16
    got = {r.doc_id: r for r in lm.train_and_score(df).collect()}
    assert got[1601].score > got[1602].score + 30
    assert got[1601].score > got[1601].base_score + 20


def test_quality(spark):
    rng = random.Random(11)
    good, bad = [text(rng, 60) + "." for _ in range(120)], [text(rng, 60).upper() + "!!! $$$ ###" for _ in range(40)]
    texts = [*good, *bad, None, "", text(rng, 100000)]
    df = docs_of(spark, texts).withColumn("held_out", common.held_out(5))
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(160)] + [(0, 1), (999, 0), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score(df, quality.train(df.where(~F.col("held_out")), labels.where(~common.held_out(5)))).collect()}
    held = [i for i in range(160) if got[i].held_out]
    assert np.mean([got[i].predicted == int(i < 120) for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values()) and len(got) == len(texts)
    one = quality.train(df, labels.where("quality = 1"))
    assert {r.score for r in quality.score(df, one).collect()} == {1.0}
    assert quality.score(df.where(F.lit(False)), one).count() == 0


def plain_features(b):
    """The features of one text, counted one by one."""
    sets = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".", b",", b"!?", b"#$%&*@^~+=<>", b"|\\/_-", b"\"'`()[]{}:;", b"\n", bytes(range(128, 256))]
    share = [sum(x in own for x in b) / max(1, len(b)) for own in sets]

    def of(found):
        sizes, c = [len(x) for x in found], max(1, len(found))
        times = Counter(x.lower() for x in found)
        return len(found), len(times) / c, max(times.values(), default=0) / c, sum(sizes) / c, float(np.std(sizes)) if sizes else 0.0

    words, kinds, top, mean, spread = of(re.findall(rb"[^\x20\x09-\x0d]+", b))
    lines, line_kinds, line_top, line_mean, _ = of(re.findall(rb"[^\n]+", b))
    marks = share[6] + share[5]
    grown = math.log1p(kinds * words) / max(math.log1p(words), 1e-9)
    return [
        *share, share[0] / max(share[0] + share[1], 1e-9), marks, math.log1p(len(b)), math.log1p(words), math.log1p(lines), kinds, grown, top, mean, min(spread, 50),
        line_kinds, line_top, math.log1p(line_mean), float(not b), float(words < 8),
    ]


def test_quality_against_plain_form(spark):
    """Features one by one, weights at the least loss of the pairs, the cut at its quantile, scores by the formula."""
    rng = random.Random(21)
    marks = ["", ".", ",", "!", " #", "\n", "\n\n", " 12", "Ü", " (x)"]
    texts = ["", " \n ", "Same same SAME", *("".join(text(rng, rng.randint(1, 9)) + rng.choice(marks) for _ in range(rng.randint(1, 12))) for _ in range(150))]
    raw = [t.encode() for t in texts]
    x = np.array([plain_features(b) for b in raw])
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
    assert np.allclose(quality.features(np.frombuffer(b"".join(raw), np.uint8), offsets), x, atol=1e-9)
    label = np.array([int(rng.random() < (0.9 if "." in t else 0.4)) for t in texts])
    share = label.mean()
    model = quality.fit(x, label, share)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.maximum(x.std(0), 1e-6))
    z = np.clip((x - x.mean(0)) / np.maximum(x.std(0), 1e-6), -4, 4)
    z = np.concatenate([z, abs(z)], axis=1)
    draw = np.random.default_rng(7)
    d = z[draw.choice(np.flatnonzero(label == 1), quality.PAIRS)] - z[draw.choice(np.flatnonzero(label == 0), quality.PAIRS)]

    def loss(w):
        return np.logaddexp(0, -(d @ w)).mean() + quality.RIDGE / 2 * (w @ w)

    least = loss(model.weights)
    for _ in range(60):
        step = draw.normal(size=len(model.weights)) * 0.03
        assert loss(model.weights + step) > least
    worth = z @ model.weights
    assert (worth < model.cut).mean() <= 1 - share + 1e-9 <= (worth <= model.cut).mean() + 2e-9
    df = docs_of(spark, texts).withColumn("held_out", F.lit(False))
    got = {r.doc_id: r for r in quality.score(df, model).collect()}
    odds = np.exp(worth - model.cut) * quality.CUT / (1 - quality.CUT)
    assert np.allclose([got[i].score for i in range(len(texts))], odds / (1 + odds), atol=1e-9)


def test_quality_learns_from_every_label(spark):
    """In one block the model is that of all rows in memory; in several every row counts, in the cut as well."""
    rng = random.Random(22)
    texts = [text(rng, rng.randint(1, 30)) + rng.choice(["", ".", "!", " # 12", "\n"]) for _ in range(300)]
    label = [int(rng.random() < (0.9 if "." in t else 0.5)) for t in texts]
    df = docs_of(spark, texts).withColumn("held_out", F.lit(False))
    labels = spark.createDataFrame(list(enumerate(label)), "doc_id long, quality int")
    x = np.array([plain_features(t.encode()) for t in texts])
    share = np.mean(label)
    for block in (8000, 50):
        model = quality.train(df, labels, block)
        assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.maximum(x.std(0), 1e-6)) and model.weights.any()
        worth = model.shape(x) @ model.weights
        assert (worth < model.cut - 1e-9).mean() <= 1 - share + 1e-9 <= (worth <= model.cut + 1e-9).mean() + 2e-9
    # A label of two documents is set against every block of the other.
    seen = []
    batches = [pa.RecordBatch.from_arrays([pa.array([1] * 40, pa.int32()), pa.array([[float(i)]] * 40)], ["label", "x"]) for i in range(5)]
    for own, rows in quality._blocks(iter(batches), 50, [(np.zeros(2, np.int32), np.full((2, 1), -1.0))]):
        assert (own == 0).sum() == 2 and (rows[own == 0] == -1).all()
        seen += rows[own == 1, 0].tolist()
    assert sorted(seen) == sorted([float(i) for i in range(5)] * 40)
    two = quality.train(df, spark.createDataFrame([(i, int(i > 1)) for i in range(300)], "doc_id long, quality int"), 50)
    assert two.weights.any() and (two.shape(x[2:]) @ two.weights).mean() > (two.shape(x[:2]) @ two.weights).mean()
    # Documents beyond 4,000 of a label count in the means.
    many = spark.range(9000).select(F.col("id").alias("doc_id"), F.expr("CASE WHEN id % 2 = 1 THEN 'one two' ELSE 'ONE TWO' END").alias("text"))
    every = quality.train(many, many.select("doc_id", F.expr("int(doc_id % 2)").alias("quality")))
    upper = list(quality._CLASSES).index("upper")
    assert every.mean[upper] == pytest.approx(6 / 7 / 2, abs=1e-9)
    odd = many.withColumn("text", F.when(F.xxhash64("doc_id") > 0, F.concat("text", F.lit(" 777"))).otherwise(F.col("text")))
    digit = list(quality._CLASSES).index("digit")
    want = np.mean([3 / 11 if r.h > 0 else 0 for r in many.select(F.xxhash64("doc_id").alias("h")).collect()])
    assert quality.train(odd, many.select("doc_id", F.expr("int(doc_id % 2)").alias("quality"))).mean[digit] == pytest.approx(want, abs=1e-9)


def test_least_hashes(spark):
    """The sample is that of ranking every row, with repeated and null ids and groups smaller than it."""
    rows = [(None if i % 97 == 0 else i // 2, ["a", "b", "c"][0 if i < 2500 else 1 + (i == 2900)], i) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, kind string, place long").withColumn("h", F.xxhash64("doc_id"))
    every = df.collect()
    for most in (1, 40, 5000):
        want = []
        for kind in "abc":
            own = sorted((r for r in every if r.kind == kind), key=lambda r: (r.h, -1 if r.doc_id is None else r.doc_id, r.place))
            want += [(kind, r.place) for r in own[:most]]
        got = common.least_hashes(df, "kind", most, ["doc_id", "place"])
        assert got.columns == df.columns and sorted((r.kind, r.place) for r in got.collect()) == sorted(want)
    assert common.least_hashes(df.where(F.lit(False)), "kind", 3, ["place"]).count() == 0


def test_shards(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"), target_bytes=200_000)
    assert store.read() is None and store.version() == 0
    rng = random.Random(12)
    rows = [(i, None if i % 50 == 0 else text(rng, 200), i % 7) for i in range(1200)] + [(5, "", 1), (5, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, path string, bytes long")
    for k in range(6):
        store.append(df.where(F.pmod(F.xxhash64("doc_id"), F.lit(6)) == k).repartition(4))
        if k == 2:
            store.compact()
    old = store.version()
    store.append(df.where(F.lit(False)))
    assert store.version() == old
    before = store.manifest().count()
    store.compact()
    assert store.manifest().count() < before and sorted(map(str, store.read().collect())) == sorted(map(str, df.collect()))
    assert sorted(map(str, store.read(old).collect())) == sorted(map(str, df.collect()))
    with pytest.raises(Exception, match="already exist|exists"):
        store.publish(store.manifest(), store.version() - 1)
    with pytest.raises(ValueError):
        store.append(spark.range(3))
    store.vacuum()
    assert store.read().count() == df.count()
    tiers = store._tiered(store.manifest()).where(F.col("tier") < sharding.TIERS).groupBy("tier").count().collect()
    assert all(r["count"] < store.fanout for r in tiers)


def test_loading_shards(spark, tmp_path):
    """Any table is loaded whole and once: many files, one file, or a part of a file."""
    rows = spark.range(400).selectExpr("id AS doc_id", "repeat(concat('x', id), 50) AS text")
    rows.repartition(7).write.parquet(str(tmp_path / "many"))
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    for name, where, n in (("many", "true", 400), ("one", "true", 400), ("many", "doc_id < 10", 10), ("one", "doc_id < 10", 10), ("one", "doc_id < 0", 0)):
        table = spark.read.parquet(str(tmp_path / name))
        store = sharding.ShardStore(spark, str(tmp_path / f"s-{name}-{n}"), target_bytes=20_000)
        sharding.load(store, table if where == "true" else table.where(where), 3)
        found = store.read()
        assert sorted(r.doc_id for r in found.collect()) == list(range(n)) if n else found is None


def test_pieces(spark):
    import sentencepiece

    if not __import__("os").path.exists(pieces.MODEL):
        pytest.skip("no model file")
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(13)
    texts = [*odd_texts(rng), "  two  spaces ", "line\nbreak\t\r\n", "snow ☃ 漢字 \U0001f600", "x" * 50, " ", "▁mark", "Hello world!"]
    df = docs_of(spark, texts)
    for most in (50_000, 5):
        got = {r.doc_id: r for r in pieces.decode(pieces.encode(df, table_words=most)).collect()}
        for i, t in enumerate(texts):
            if t is None:
                assert got[i].ids is None and got[i].decoded is None
            else:
                assert got[i].ids == model.encode(t), t
                assert got[i].decoded == t.replace("▁", " ")
    assert pieces.encode(df.where(F.lit(False))).count() == 0


def test_driver_gets_packed_tables(spark, monkeypatch):
    """Words and grams come to the driver as rows of many each, and hold what the tables hold."""
    from pyspark.sql.classic.dataframe import DataFrame

    if not __import__("os").path.exists(pieces.MODEL):
        pytest.skip("no model file")
    rng = random.Random(17)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(80)) for _ in range(40)]
    df = docs_of(spark, texts).withColumn("lang", F.lit("en"))
    coded = common.written(pieces.lattice(pieces.count_words(df, pieces.load()).select("word"), pieces.load()), "coded")
    want = {r.word: r.ids for r in coded.collect()}
    sizes, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: pytest.fail("a row of the driver for each word or gram"))
    monkeypatch.setattr(DataFrame, "collect", lambda self: sizes.append(len(rows := collect(self))) or rows)
    shared = pieces._shared_words(df, pieces.load(), 50_000).value
    model = langid.train(df)
    assert len(want) > 2500 and len(model.seen[4][0]) > 2500 and max(sizes) < 100
    _, keys, flat, counts = shared
    ends = np.cumsum(counts)
    got = {h: flat[e - n : e].tolist() for h, n, e in zip(keys.tolist(), counts.tolist(), ends.tolist(), strict=True)}
    assert got == dict(zip(pieces.hashed(list(want)).tolist(), want.values(), strict=True))
    assert np.array_equal(keys, np.sort(keys))
    plain = langid.fit([("en", t.encode()) for t in texts])
    assert all(np.array_equal(a, b, equal_nan=True) for x, y in zip(model.seen + model.escape, plain.seen + plain.escape, strict=True) for a, b in zip(x, y, strict=True))


def test_chat(spark):
    assert chat.parse(None) == [] and chat.parse("User: hi there?\nAssistant: hello\nmore") == [("user", "hi there?"), ("assistant", "hello\nmore")]
    assert [r for r, _ in chat.parse("Kim: can you help?\nLee: yes, of course.\nKim: great, how?")] == ["user", "assistant", "user"]
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "why?"), (1, 2, "assistant", "because\n\n- a\n- b"), (1, 2, "assistant", "because\n\n- a\n- b"), (2, 0, "user", None), (2, None, None, "x"), (3, 0, "tool", "y"), (None, 0, "user", "z")]
    rows += [(4, i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("clash"))
    for segment in (256, 2):
        got = chat.recover(df, segment).collect()
        assert len(got) == len(rows)
        long = [r for r in got if r.conv_id == 4]
        assert all(r.recovered and r.role == r.role_pred for r in long)
        assert all(r.rendered == f"<|{r.role}|>\nturn {r.turn}\n<|end|>\n" for r in long)
    assert chat.recover(df.where(F.lit(False))).count() == 0


def test_chat_over_segments(spark):
    """Segments of any size, over any tasks, are decoded as the one transcript; every line is rendered."""
    rng = random.Random(15)
    texts = ["yes", "why?", "- a\n- b", "Answer: x\nmore", "x" * 130 + "\n" + "y" * 140, "question\nQ: again?\nUser: no", ""]
    rows = [(c, i, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(texts)) for c in range(6) for i in range(rng.randint(1, 60))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {}
    for segment, parts in ((1000, 1), (3, 1), (7, 5), (1, 5)):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = sorted(chat.recover(df, segment).collect(), key=lambda r: (r.conv_id, r.segment, r.nth))
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        for c in range(6):
            own = [r for r in got if r.conv_id == c]
            assert sorted({r.turn for r in own}) == [t for k, t, _, _ in rows if k == c]
            found = "".join(re.sub(r"(?m)^<\|(system|user|assistant|end)\|>\n", "", r.rendered) for r in own)
            roles = [(r.turn, r.role_pred) for r in own if r.rendered]
            assert whole.setdefault(c, (found, roles))[0] == found
            if len(roles) == len(whole[c][1]):  # a turn that runs over a border has a part on either side
                assert roles == whole[c][1]
            else:
                assert segment < 1000 and set(whole[c][1]) <= set(roles)
    states = chat.viterbi
    kinds, look = [rng.randrange(5) for _ in range(40)], [rng.randrange(5) for _ in range(40)]
    cuts = [0, 7, 8, 21, 40]
    border = chat.settle([chat.cells(kinds[a:b], look[a:b]) for a, b in zip(cuts, cuts[1:])], 6, None)
    pieced = [s for (a, b), (x, y) in zip(zip(cuts, cuts[1:]), border) for s in states(kinds[a:b], look[a:b], None if x == 6 else x, y)]
    assert pieced == states(kinds, look)


def test_viterbi():
    import itertools

    rng = random.Random(14)
    for _ in range(20):
        kinds, look = [rng.randrange(5) for _ in range(4)], [rng.randrange(5) for _ in range(4)]

        def score(path, kinds=kinds, look=look):
            return chat.START[path[0]] + sum(chat.EMIT_MARKER[s, k] + chat.EMIT_LOOK[s, x] for s, k, x in zip(path, kinds, look)) + sum(chat.MOVE[a, b] for a, b in zip(path, path[1:]))

        assert score(chat.viterbi(kinds, look)) == pytest.approx(max(score(p) for p in itertools.product(range(6), repeat=4)))


def test_driver_gives_free_native_memory_back(spark, tmp_path):
    """Blocks freed below one that is still held stay with the C library until it is told to trim."""
    jvm = spark._jvm
    status = f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup"

    def held():
        return int(re.search(r"\nAnonymous:\s+(\d+)", open(status).read())[1]) / 1024

    common.written(spark.range(10).toDF("doc_id"), "warm")
    before = held()
    blocks = [jvm.java.util.zip.Deflater() for _ in range(1500)]
    filled = held()
    for block in blocks[:-1]:
        block.end()
    common.written(spark.range(10).toDF("doc_id"), "after")
    assert filled - before > 100
    assert held() - before < (filled - before) / 2
    blocks[-1].end()
