"""The corpus pipeline from end to end against a plain form of its stages."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vecrel.llm import pieces, suffixes

from .test_llm_small import WORDS, classes, text

ENGLISH = [a + b for a in WORDS for b in WORDS]
GERMAN = [a + b for a in "haus baum licht wasser stein vogel feld strasse".split() for b in "chen lich ung heit keit schaft".split()]


def without_repeats(raw, match):
    """Each text without the bytes covered by a string of ``match`` bytes that starts anywhere else too."""
    count = Counter(b[i : i + match] for b in raw for i in range(len(b) - match + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - match + 1):
            if count[b[i : i + match]] > 1:
                gone[i : i + match] = b"\1" * match
        out.append(bytes(x for x, g in zip(b, gone) if not g))
    return out


def tables(spark, folder, rows, items):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline(spark, tmp_path):
    import sentencepiece

    if not __import__("os").path.exists(pieces.MODEL):
        pytest.skip("no model file")
    rng = random.Random(31)
    passage = text(rng, 60, ENGLISH)
    items = [(0, text(rng, 30, ENGLISH)), (1, None), (2, "")]
    texts = [text(rng, rng.randint(20, 120), ENGLISH if i % 3 else GERMAN) for i in range(60)]
    for i in (4, 7, 11):
        texts[i] += " " + passage + " " + text(rng, 30, ENGLISH)
    copied = text(rng, 100, ENGLISH)
    near = copied.split()
    near[50] = "otherwise"
    texts += [copied, copied, " ".join(near), text(rng, 40, ENGLISH) + " " + items[0][1], None, "", "123 456", "  ", text(rng, 20000, ENGLISH)]
    rows = [(i, t, None if i >= 60 else "en" if i % 3 else "de", "hot", len(t or ""), "clash") for i, t in enumerate(texts)]
    rows += [(None, text(rng, 30, ENGLISH), "en", None, None, None), (None, text(rng, 30, ENGLISH), None, "s", 1, None)]
    tables(spark, tmp_path, rows, items)
    got = {r.text: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    first = {}
    for r, (name, _) in zip(kept, classes([r[1] for r in kept])):
        first.setdefault(name, r)
    kept = list(first.values())
    left = without_repeats([r[1].encode() for r in kept], suffixes.PASSAGE)
    want = {b.decode(): r for b, r in zip(left, kept) if r[0] != 63}
    assert len(want) == len(kept) - 1 and got.keys() == want.keys()
    assert all(passage not in t for t in got) and all(want[t][0] not in (61, 62) for t in got)
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for t, r in got.items():
        doc_id, whole, lang, source, n_chars, row = want[t]
        assert (r.doc_id, r.lang, r.source, r.row) == (doc_id, lang, source, row) and r.ids == model.encode(t)
        assert r.n_chars == (n_chars if t == whole else len(t))


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [], [])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[:6] == ["doc_id", "text", "lang", "source", "n_chars", "row"]


def test_stages_keep_columns(spark, tmp_path):
    """Without anything to learn from, benchmark or copies, every text with a letter stays as it was."""
    rows = [(i, text(random.Random(i), 30, ENGLISH), None, "s", i, None) for i in range(12)] + [(None, None, None, None, None, None)]
    tables(spark, tmp_path, rows, [])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row"]
    assert sorted(map(tuple, docs.collect())) == sorted(rows[:12]) and docs.where(F.col("text").isNull()).count() == 0
