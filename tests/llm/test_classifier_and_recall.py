"""The classifier's whole result recomputed from its weights, and the near-copy stage's recall on planted pairs."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import ordinal_quality, simhash

DATA = "/root/testdata/sf0.01"


def plain_buckets(text):
    """Buckets of a text's features, written down from their definition."""
    raw = text.encode()
    # what is left of each space-separated piece without its letters and digits
    marks = [m for piece in re.split(rb"[ \t\n\r\x0b\x0c]+", raw) if (m := re.sub(rb"[0-9A-Za-z\x80-\xff]+", b"", piece))]
    words = [w for w in re.split(rb"[^0-9a-z\x80-\xff]+", bytes(b + 32 if 65 <= b <= 90 else b for b in raw)) if w]
    if not words:
        return set()
    names = set(words) | {b"\x03" + w[:4] for w in words if len(w) > 4}
    for mark, n in Counter(marks).items():
        names.add(b"\x01" + mark + b"\x01%d" % max(-8, int(math.log2(n / len(words)))))
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    for name, share in ((b"rep", repeats / len(words)), (b"dist", len(set(words)) / len(words)), (b"len", min(1.0, len(words) / 50))):
        names.add(b"\x02" + name + b"%d" % int(share * 8))
    return {zlib.crc32(n) % ordinal_quality.BUCKETS for n in names}


def test_every_row_of_a_table_has_the_score_of_its_weights(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = ordinal_quality.train(docs, labels)
    weights, (low, high) = model.weights.astype(float), model.thresholds
    assert low < high and (weights != 0).sum() > 10
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    got = ordinal_quality.score(docs, model).collect()
    assert len(got) == len(texts)
    for r in got:
        buckets = plain_buckets(texts[r.doc_id])
        score = sum(weights[b] for b in buckets)
        tails = [1 / (1 + math.exp(t - score)) for t in (low, high)]
        assert r.expected_grade == pytest.approx(sum(tails), abs=1e-5) and r.tail_probability == pytest.approx(tails[1], abs=1e-5)
        assert r.kept == (bool(buckets) and r.tail_probability >= ordinal_quality.LIMIT)
    kept = {r.doc_id for r in ordinal_quality.keep_good(docs, model).collect()}
    assert kept == {r.doc_id for r in got if r.kept}


def test_recall_of_near_copies_just_above_the_limit(spark):
    """Pairs that share 0.80 to 0.85 of their shingles: nearly all of one go, and no unrelated text does."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    rows, pairs = [], 0
    for k in range(300):
        words = [word() for _ in range(rng.randint(120, 260))]
        other = list(words)
        while (share := jaccard(words, other)) > 0.85:
            other[rng.randrange(len(other))] = word()
        if share >= 0.8:
            rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
            pairs += 1
    rows += [(10_000 + k, " ".join(word() for _ in range(100))) for k in range(200)]
    left = {r.doc_id for r in simhash.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum((2 * k in left) != (2 * k + 1 in left) for k in range(300) if (2 * k, 0) and any(r[0] == 2 * k for r in rows))
    assert pairs > 200 and found >= 0.99 * pairs and all(10_000 + k in left for k in range(200))
    assert all(2 * k in left or 2 * k + 1 in left for k in range(300) if any(r[0] == 2 * k for r in rows))
    print("pairs", pairs, "found", found)


def test_fingerprints_find_near_copies(spark):
    """Texts with one fingerprint that share 0.34 of their shingles, at a limit of 0.3: bands of minima meet few of them."""
    rng = random.Random(5)
    some = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(n)]
    rows = []
    for k in range(40):
        common = some(3) * 70 + some(30)
        rows += [(2 * k, " ".join(common + some(28))), (2 * k + 1, " ".join(common + some(28)))]
    assert all(simhash.fingerprint(a) == simhash.fingerprint(b) and 0.3 < jaccard(a.split(), b.split()) < 0.4 for (_, a), (_, b) in zip(rows[::2], rows[1::2]))
    left = {r.doc_id for r in simhash.drop_similar(spark.createDataFrame(rows, "doc_id long, text string"), share=0.3).collect()}
    assert all((2 * k in left) != (2 * k + 1 in left) for k in range(40))


def jaccard(a, b):
    x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_null_and_empty_texts_are_scored(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "some words")], "doc_id long, text string")
    model = ordinal_quality.train(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet").where(F.col("doc_id") < 400))
    got = {r.doc_id: r for r in ordinal_quality.score(docs, model).collect()}
    assert not got[1].kept and not got[2].kept and got[1].tail_probability == got[2].tail_probability
