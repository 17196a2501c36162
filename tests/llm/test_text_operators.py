"""Each operator on documents against plain Python, on nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, license_scan, mixing, ordinal_quality, packing, quality_rules, repeats, simhash
from tidemark.llm.common import cut_lineage
from tidemark.llm.queries import op1_suffix_dedup, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, content string, digest string, row long, fp long, key string, bytes string, spans int, grp string, epochs long, part long, range string, source_size int, target int, taken int, level string, place int"
SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    return [w for w in re.split(f"[{SPACE}]+", text or "") if w]


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", "x", 1, 1, "k", "b", 0, "g", 1, 1, "r", 1, 1, 1, "l", 1) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7)))
    prose = [" ".join(word() for _ in range(rng.randint(60, 160))) for _ in range(12)]
    passage = " ".join(word() for _ in range(110))
    out = [(i, t, rng.choice(["en", "de"]), f"s{i % 4}") for i, t in enumerate(prose)]
    out += [(100 + i, prose[i % 3], "en", "s0") for i in range(9)]  # copies
    out += [(200 + i, prose[i] + " " + passage + "\nunder the MIT License. " + word(), "en", None) for i in range(4)]
    out += [(300, None, None, None), (301, "", "en", "s1"), (302, " \n\t", "en", "s1"), (None, prose[0], "en", "s1"), (None, None, "en", "s1")]
    out += [(303, "cc by-nc " * 400, "en", "s2"), (304, "x", "de", "s9"), (305, "A b\nA b\nA b\n c", "de", "s2"), (306, "#$% <x> & |" * 30, "de", "s2")]
    out += [(307, "long " + " ".join(word() for _ in range(30_000)), "en", "s3"), (1, prose[1], "en", "s1"), (308, "a\x00b  c", "en", "s1")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return make(spark, rows).repartition(5).cache()


def test_exact_dedup(docs, rows):
    got = sorted(map(tuple, exact_dedup.group_copies(docs).collect()), key=str)
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    for i, keep, size, kept, sha in got:
        t = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == sha)
        assert i in groups[t] and size == len(groups[t])
        assert keep == max((x for x in groups[t] if x is not None), default=None)
    assert len(got) == len(rows)
    assert sum(k for *_, k, _ in got) == len(groups)  # one of each, even of rows alike in all
    stay = exact_dedup.drop_copies(docs)
    assert stay.columns == docs.columns and stay.count() == len(groups)


def test_exact_dedup_compares_content(docs):
    # with a single salt and with many the verdicts agree
    one, many = (sorted(map(str, exact_dedup.group_copies(docs, salts=s).collect())) for s in (1, 64))
    assert one == many
    # texts that share what is left of their digest are told apart by content, those that don't stay on the short way
    for digits in (0, 1, 2):
        assert sorted(map(str, exact_dedup.group_copies(docs, digits=digits).collect())) == one
        assert exact_dedup.drop_copies(docs, digits=digits).count() == len({r.text_sha256 for r in exact_dedup.group_copies(docs).collect()})


def plain_fingerprint(text, shingle=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words_of(low)
    parts = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash(docs, rows):
    got = simhash.near_groups(docs).collect()
    expected = [(i, plain_fingerprint(t)) for i, t, *_ in rows]
    assert Counter((r.doc_id, int(r.fingerprint, 16)) for r in got) == Counter(expected)
    fps = sorted({f for _, f in expected})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for i, f in expected:
        if i is not None:
            least[find(f)].append(i)
    for r in got:
        assert r.component_id == min(least[find(int(r.fingerprint, 16))], default=None)
    assert simhash.drop_near_copies(docs).count() == len({find(f) for _, f in expected})


def test_near_copies_that_share_an_id(spark):
    words = ["".join(random.Random(k).choice("abcdefgh") for _ in range(6)) for k in range(400)]
    rows = [(1, " ".join(words[:200])), (1, " ".join(words[200:])), (1, " ".join(words[:200])), (2, " ".join(words[200:]))]
    kept = simhash.drop_near_copies(make(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted(rows[:2])
    named = spark.createDataFrame([("b", "x y z"), ("a", "x y z"), (None, "x y z")], "doc_id string, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_groups(named).collect()} == {"a": "a", "b": "a", None: "a"}


def test_hamming_links_are_complete(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(12)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()}
    assert got == {tuple(sorted((signed(a), signed(b)))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 150: 100, 200: 100}


def plain_spans(texts, length):
    places = defaultdict(list)
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            places[t[p : p + length]].append((i, p))
    marks = [bytearray(len(t)) for t in texts]
    for found in places.values():
        if len(found) > 1:
            for i, p in found:
                marks[i][p : p + length] = b"\1" * length
    return [[m.span() for m in re.finditer(b"\1+", bytes(x))] for x in marks]


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeats(docs, rows, hot):
    got = repeats.remove_repeats(docs, length=120, hot=hot).collect()
    texts = [(t or "").encode() for _, t, *_ in rows]
    expected = Counter()
    for (i, *_), t, spans in zip(rows, texts, plain_spans(texts, 120)):
        kept = b"".join(t[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(t)]))
        expected[i, len(t), tuple(spans), kept] += 1
    assert Counter((r.doc_id, r.n_bytes, tuple((s.start, s.stop) for s in r.spans), bytes(r.kept)) for r in got) == expected


def test_hot_keys_beside_others(spark):
    """Kinds of the keys that stay when others go a level further meet their rows without bytes, wherever the join leaves them."""
    both = bytes(range(32, 127)) * 3
    fields = f"{repeats._REGION}, bytes binary"
    lead = [(k, b"k", k, 0, 0, 86, False, 2, both) for k in range(400)]
    other = [(k, b"k", 1000 + k, 0, 7, 86, False, 2, None) for k in range(400)]
    found = cut_lineage(spark.createDataFrame(lead + other, fields).repartition(8))
    crowded = cut_lineage(spark.createDataFrame([(-1,)], "key long"))
    # a join that is planned by a shuffle and then runs by broadcast, on small tables
    at_size = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in at_size.items():
        spark.conf.set(name, value)
    try:
        left = found.join(crowded, "key", "left_anti")
        got = {tuple(r) for r in repeats._indexed(left, 200, int(spark.conf.get("spark.sql.shuffle.partitions")), True).collect()}
    finally:
        for name in at_size:
            spark.conf.unset(name)
    ends = {d: max(e for x, _, _, e in got if x == d) for d in {x for x, *_ in got}}
    assert ends == {**{k: len(both) for k in range(400)}, **{1000 + k: 7 + len(both) for k in range(400)}}


def test_run_length_index_on_small_alphabets():
    rng = random.Random(1)
    for trial in range(150):
        length = rng.choice([3, 5, 8, 13, 20])
        base = bytes(rng.choice(b"ab" if trial % 2 else b"abcdefgh\x00\xf4") for _ in range(rng.randint(1, 150)))
        texts = [b"".join(base[a : a + rng.randint(0, 60)] for a in (rng.randint(0, len(base)) for _ in range(3))) + b"z" * rng.randint(0, 30) for _ in range(rng.randint(1, 5))]
        assert repeats.repeated_spans(texts, length) == plain_spans(texts, length)


def test_runs_spell_the_transform():
    texts = [b"abracadabra" * 5, b"cadabra" * 9, b""]
    index = repeats.RunLengthIndex(texts)
    # a terminator sorts below all bytes, earlier texts' before later ones'
    rows = sorted((tuple([*(b + 1 for b in t[k:]), i - len(texts)]), t[k - 1] + 1 if k else 0) for i, t in enumerate(texts) for k in range(len(t) + 1))
    lengths = np.diff(np.append(index.run_starts, index.rows))
    assert np.repeat(index.run_symbols, lengths).tolist() == [x for _, x in rows]
    assert len(lengths) < 40 < sum(map(len, texts))
    # copies lengthen runs, but add none
    many = repeats.RunLengthIndex(texts, [3, 1, 2])
    assert (many.run_symbols == index.run_symbols).all() and many.run_counts.sum() == 3 * 56 + 64 + 2 and (index.run_counts == lengths).all()
    assert not hasattr(index, "words") and not hasattr(index, "symbols")


def test_copies_of_texts_count_as_texts():
    rng = random.Random(8)
    for _ in range(60):
        texts = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 6))})
        copies = [rng.choice([1, 1, 2, 5]) for _ in texts]
        whole = plain_spans([t for t, n in zip(texts, copies, strict=True) for _ in range(n)], 9)
        at = np.cumsum([0, *copies[:-1]])
        assert repeats.repeated_spans(texts, 9, copies) == [whole[k] for k in at]


def test_most_bytes_go_by_the_index(spark):
    """Of what is removed only third copies of a region within one task go by digest alone."""
    docs = repeats._keyed(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id", "text")
    met = repeats._meet(repeats._document_regions(docs, 400, 160)).cache()
    size = lambda rows: rows.agg(F.sum(F.col("n") + 399)).first()[0] or 0
    direct, indexed = size(met.where("covered")), size(met.where("not covered and copies = 2"))
    assert indexed > 0 and met.where("not covered and lead and copies = 2").count() > 0
    print("bytes of regions by digest", direct, "through the index", indexed)


def test_ids_that_are_no_numbers(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdef ") for _ in range(900))
    rows = spark.createDataFrame([("x-1", text), ("x-2", text[:500] + "!"), (None, "short")], "doc_id string, text string")
    got = {r.doc_id: (r.n_bytes, len(r.kept)) for r in repeats.remove_repeats(rows).collect()}
    assert got == {"x-1": (900, 400), "x-2": (501, 1), None: (5, 5)}


def test_planted_passages(spark, tmp_path):
    """Planted passages show in n_removed and text, while n_bytes is the whole length of every row; other rows are left alone."""
    rng = random.Random(12)
    words = lambda n: " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(5, 9))) for _ in range(n))
    long, short = words(80), " ".join(w[:4] for w in words(55).split())
    assert len(short.encode()) < 400 < len(long.encode())
    texts = [f"{words(60)} {i} <{x}> {i} {words(60)}" for i, x in enumerate((long, long, long, short, short, words(80), words(80)))]
    docs = spark.createDataFrame([(i, t, "fr", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op1_suffix_dedup(spark, str(tmp_path)).collect()}
    gone = len(f" <{long}> ".encode())
    for i, t in enumerate(texts):
        left = t.replace(f" <{long}> ", "")
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].text) == (len(t.encode()), gone * (i < 3), int(i < 3), left)
        assert got[i].kept_sha256 == hashlib.sha256(left.encode()).hexdigest() and got[i].n_bytes > len(t)


def plain_targets(sizes):
    names = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    cap = {k: 3 * sizes[k] for k in names}
    capped = set()
    while True:
        rest = sum(sizes.values()) - sum(cap[k] for k in capped)
        open_ = [k for k in names if k not in capped]
        t = {k: cap[k] if k in capped else rest * weight[k] / sum(weight[x] for x in open_) for k in names}
        over = {k for k in open_ if t[k] > cap[k] + 1e-9}
        if not over:
            return t
        capped |= over


def test_source_targets(spark):
    rng = random.Random(0)
    for _ in range(4):
        sizes = {(None if i == 3 else f"s{i}"): rng.choice([0, 1, 5, 100, 3000, 50000]) for i in range(rng.randint(1, 9))}
        got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
        assert got == pytest.approx(plain_targets(sizes))


def test_mixing(docs, rows):
    first, again = (sorted(map(str, mixing.mix(docs).collect())) for _ in range(2))
    assert first == again and len(first) == len(rows)
    sizes, taken = Counter(), Counter()
    for _, t, _, s in rows:
        sizes[s] += len(words_of(t))
    targets = plain_targets(sizes)
    by_target = defaultdict(set)
    for r in mixing.mix(docs).collect():
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["epochs"] * r["size"] + r["part"]
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
    for s, t in targets.items():
        by_target[sizes[s], round(t, 6)].add(s)
    for key, sources in by_target.items():
        assert abs(taken[key] - key[1] * len(sources)) <= len(sources)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len(words_of(r.text)) for r in out.collect()) == sum(taken.values())


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    import zlib
    import numpy as np

    reader = Tokenizer.from_file(tokenizer_path())
    pieces = packing.pack(docs, tokenizer_path()).collect()
    tokens = Counter()
    for i, t, *_ in rows:
        tokens[i, tuple([*reader.encode(t or "", add_special_tokens=False).ids, 1])] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for (i, ids), n in tokens.items():
        mine = [p for p in by_doc[i] if p.doc_tokens == len(ids)]
        if n == 1 and sum(k[0] == i for k in tokens) == 1:
            mine.sort(key=lambda p: p.start)
            assert [p.start for p in mine] == [sum(q.length for q in mine[:k]) for k in range(len(mine))]
            assert all(p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes()) for p in mine)
    assert sum(p.length for p in pieces) == sum(len(ids) * n for (_, ids), n in tokens.items())
    for s in by_sequence.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == [sum(q.length for q in s[:k]) for k in range(len(s))]
        fill = sum(p.length for p in s)
        assert fill <= 2048 and (fill & (fill - 1)) == 0  # nothing is padded


def test_packing_prefers_the_smallest_sum_of_squares():
    packer = packing.SumOfSquares(10)
    piece = lambda n: ("d", 0, [0] * n, n)
    for n in (6, 6, 3):
        packer.place(piece(n))
    assert packer.counts[6] == 1 and packer.counts[9] == 1  # 3 joined a 6 rather than standing alone
    assert packer.place(piece(1)) is not None  # and 1 fills the 9 up


def test_tokenizer_pieces_equal_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(2)
    whole = Tokenizer.from_file(tokenizer_path())
    texts = ["".join(rng.choice(" \n\tabé'sll1.,%　日\x85\xa0\x1c") for _ in range(rng.randint(0, 30))) for _ in range(600)]
    texts += ["", " ", "a\n b", "x <|endoftext|> y", "  a", "it's 12 345"]
    # any code point but surrogates, spaces among them
    anything = lambda: rng.choice(" " * 4 + chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])))
    texts += ["".join(anything() for _ in range(rng.randint(1, 40))) for _ in range(8000)]
    texts.append("x" * 300_000 + " y" * 300_000)
    got = packing.tokenizer(tokenizer_path()).ids_of(pa.array(texts))
    assert [g.tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_tokenizer_on_a_whole_table(spark):
    import pyarrow as pa
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    got = packing.tokenizer(tokenizer_path()).ids_of(pa.array(texts))
    assert all(g.tolist() == whole.encode(t, add_special_tokens=False).ids for g, t in zip(got, texts))


def test_tokenizer_memory_is_bounded(monkeypatch):
    """Texts without spaces are pieces as a whole: they are encoded, but not remembered."""
    import pyarrow as pa

    rng = random.Random(5)
    reader = packing.PieceTokenizer(tokenizer_path())
    for _ in range(10):
        texts = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(300)) for _ in range(1000)]
        got = reader.ids_of(pa.array(texts))
        assert got[7].tolist() == reader.whole.encode(texts[7], add_special_tokens=False).ids
    assert not reader.known and not reader.held
    monkeypatch.setattr(packing.PieceTokenizer, "MOST_BYTES", 400_000)
    monkeypatch.setattr(packing.PieceTokenizer, "PART", 100)
    size = lambda d: sum(reader.ENTRY + 4 * len(k) + len(v) for k, v in d.items())
    for _ in range(5):
        texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(20)) for _ in range(100)]
        assert [g.tolist() for g in reader.ids_of(pa.array(texts))] == [reader.whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert 0 < size(reader.known) <= reader.held <= 200_000 and size(reader.old) <= 200_000
    assert reader.old


def test_license_scan(docs, rows):
    got = Counter()
    for r in license_scan.scan(docs).collect():
        got[r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels] += 1
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    expected = Counter()
    for i, t, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(s, label) for phrase, label in license_scan.BASE for s in range(len(w)) if w[s : s + len(phrase.split())] == phrase.split()]
        at = [s for s, _ in places]
        expected[i, len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))] += 1
    assert got == expected


def test_license_spans_survive_edits(spark):
    text = license_scan.PASSAGES[2][0].split()
    edited = " ".join(["lead"] * 5 + text[:8] + ["inserted"] + text[8:15] + text[16:])
    r = license_scan.scan(spark.createDataFrame([(1, edited), (2, "nothing of the kind here")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert r[0].labels == "bsd" and r[0].base_labels == "" and r[0].score >= 0.6 and r[1].labels == ""


def plain_labels(text):
    """Labels of passages by the definition: hits on diagonals, merged, of each span the longest chain."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found, best = set(), 0.0
    for passage, label in license_scan.PASSAGES:
        p = passage.split()
        size = len(p) - 2
        hits = [(i, j) for i in range(len(w) - 2) for j in range(size) if w[i : i + 3] == p[j : j + 3]]
        diagonals = defaultdict(list)
        for i, j in hits:
            diagonals[i - j].append((i, j))
        spans, last = [], None
        for first, d in sorted((min(i for i, _ in x), d) for d, x in diagonals.items()):
            if last is None or abs(d - last[0]) > license_scan.GAP or first - last[1] > size:
                spans.append([])
            spans[-1] += diagonals[d]
            last = d, max(i for i, _ in diagonals[d])
        for span in spans:
            chains = {}
            for i, j in sorted(span):
                chains[i, j] = 1 + max((c for (a, b), c in chains.items() if a < i and b < j), default=0)
            best = max(best, max(chains.values()) / size)
            if max(chains.values()) >= license_scan.ENOUGH * size:
                found.add(label)
    return found, best


def test_license_labels_against_brute_force(spark):
    rng = random.Random(12)
    texts = ["redistribution and use " * 14, "the gnu general public license " * 30, "", None, "all rights reserved " * 3000]
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 4)):
            w = rng.choice(license_scan.PASSAGES)[0].split()
            for _ in range(rng.randint(0, 9)):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 2)] = rng.choice([[], ["odd"], w[:2], [w[k]] * 2])
                w = w or ["x"]
            if rng.random() < 0.3:
                w = [x for _ in range(rng.randint(2, 5)) for x in w[: rng.randint(3, 8)]]
            if rng.random() < 0.2:
                rng.shuffle(w)
            parts += w + ["plain"] * rng.randint(0, 30)
        texts.append(" ".join(parts))
    got = {r.doc_id: r for r in license_scan.scan(make(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    wrong = []
    for i, t in enumerate(texts):
        labels, best = plain_labels(t)
        labels |= set(filter(None, got[i].base_labels.split(",")))
        if ",".join(sorted(labels)) != got[i].labels or (got[i].n_base == 0 and abs(got[i].score - best) > 1e-9):
            wrong.append((i, labels, best, got[i]))
    assert not wrong and got[0].labels == "" and got[0].score < 0.2
    assert sum(bool(r.labels) for r in got.values()) > 40


def test_quality_statistics(docs, rows):
    got = Counter()
    for r in quality_rules.judge(docs).collect():
        got[r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed] += 1
        assert not (r.base_failed and r.kept)
    expected = Counter()
    for i, t, *_ in rows:
        w, t = words_of(t), t or ""
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        many = Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if many[x] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if x.strip(SPACE)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        expected[i, len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered), failed] += 1
    assert got == expected


def test_quality_outliers_go_and_clean_stays(spark):
    rng = random.Random(4)
    clean = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(80, 300))), "en", "a") for i in range(240)]
    junk = [(1000 + i, " ".join(w + "%%%" for w in clean[i][1].split()), "en", "a") for i in range(30)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(make(spark, clean + junk)).collect()}
    assert all(got[i] for i, *_ in clean) and not any(got[i] for i, *_ in junk)
    few = quality_rules.judge(make(spark, clean[:5] + junk[:1])).collect()
    assert all(r.kept for r in few)  # too few to judge


def plain_mcd(x, share, trials=300, seed=0):
    """Smallest regularised determinant by random starts of concentration steps, as FastMCD does; and the distances."""
    rng = np.random.default_rng(seed)
    n, dims = x.shape
    h = math.ceil(share * n)
    factor = quality_rules.consistency(share, dims)

    def estimate(rows):
        cov = factor * np.cov(rows.T, bias=True)
        weight = max(np.trace(cov) / (quality_rules.CONDITION - 1 + np.trace(cov)), 1 / quality_rules.CONDITION)
        return rows.mean(0), (1 - weight) * cov + weight * np.eye(dims)

    best = None
    for trial in range(trials):
        mean, cov = estimate(x if trial == 0 else x[rng.choice(n, dims + 1, replace=False)])
        size = math.inf
        while True:
            d2 = np.einsum("ij,ij->i", x - mean, np.linalg.solve(cov, (x - mean).T).T)
            mean, cov = estimate(x[np.argsort(d2, kind="stable")[:h]])
            now = np.linalg.slogdet(cov)[1]
            if now >= size - 1e-9:
                break
            size = now
        if best is None or size < best[0]:
            best = size, mean, cov
    size, mean, cov = best
    return size, np.einsum("ij,ij->i", x - mean, np.linalg.solve(cov, (x - mean).T).T)


def test_estimates_against_exact_minimum(spark):
    rng = np.random.default_rng(5)
    groups = {}
    for g, (n, bad) in enumerate([(30, 3), (80, 12), (400, 90), (900, 0), (60, 0)]):
        x = rng.normal(0, 1, (n, 5)) @ rng.normal(0, 0.6, (5, 5)) + rng.normal(0, 3, 5)
        x[:bad] = rng.normal(0, 0.2, (bad, 5)) + x.mean(0) + 9 * rng.choice([-1, 1], 5)
        if g == 4:
            x[:, 3:] = 0.0  # two statistics that never differ
        groups[f"g{g}"] = x
    rows = spark.createDataFrame([(g, *map(float, r)) for g, x in groups.items() for r in x], "grp string, x0 double, x1 double, x2 double, x3 double, x4 double")
    units = quality_rules.scales(rows)
    rows = quality_rules.scaled(rows, units)
    estimates = quality_rules.estimates(rows)
    far = {r.grp: r.far for r in quality_rules.limits(quality_rules._with_distance(rows.join(estimates, "grp"))).collect()}
    shares = estimates.collect()
    found = {r.grp: r for r in quality_rules._with_distance(rows.join(estimates, "grp")).groupBy("grp").agg(F.sort_array(F.collect_list("d2")).alias("d2")).collect()}
    scale = {r.grp: r for r in units.collect()}
    for g, x in groups.items():
        median = np.median(x, axis=0)
        spread = 1.4826 * np.median(np.abs(x - median), axis=0)
        spread[spread == 0] = 1.0
        mine = np.array([[scale[g][f"{c}{i}"] for i in range(5)] for c in "av"])
        assert mine[0] == pytest.approx(median, abs=0.5) and mine[1] == pytest.approx(spread, rel=0.15)
        size, d2 = plain_mcd((x - mine[0]) / mine[1], quality_rules.SHARE)
        got = np.array(found[g].d2)
        assert (got > far[g]).sum() == (d2 > far[g]).sum()  # the same rows are far
        if g not in ("g3", "g4"):
            assert (got > far[g]).sum() == [3, 12, 90][int(g[1])]
        # bins keep a few rows more than the exact share, so distances agree but for some percent
        assert np.median(np.abs(got / np.sort(d2) - 1)) < 0.12
        logs = np.log(got)
        width = max(1.4826 * np.median(np.abs(logs - np.median(logs))), 0.336)
        assert math.log(far[g]) == pytest.approx(np.median(logs) + 4.265 * 2 * max(width / 2, 0.336), rel=0.05)
    # what regularises is small beside the variances, but where statistics never differ
    for r in shares:
        for i in range(5):
            if r.grp != "g4":
                assert sum(r[f"l{i}{k}"] ** 2 for k in range(i + 1)) > 10 / quality_rules.CONDITION


def test_steps_leave_no_joins_behind(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([("g", *[rng.gauss(0, 1) for _ in range(5)]) for _ in range(60)], "grp string, x0 double, x1 double, x2 double, x3 double, x4 double")
    found = quality_rules.estimates(rows)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 1


def test_copies_do_not_move_the_estimate(spark):
    """More than half of a group are copies of one text: nothing else is rejected for that."""
    rng = random.Random(6)
    clean = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(80, 300))), "en", "a") for i in range(100)]
    copies = [(1000 + i, clean[0][1], "en", "a") for i in range(300)]
    junk = [(5000, " ".join(w + "%%%" for w in clean[1][1].split()), "en", "a")]
    got = {r.doc_id: r.kept for r in quality_rules.judge(make(spark, clean + copies + junk)).collect()}
    assert sum(not kept for kept in got.values()) == 1 and not got[5000]
    same = quality_rules.judge(make(spark, copies)).collect()
    assert all(r.kept for r in same)


def test_rejections_by_language(spark):
    """The one target leaves labelled good rows alone in every language; bad ones that pass the base rules go."""
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = quality_rules.judge(docs).where("not base_failed").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    found = {(r.lang, r.quality): (r.n, r.gone) for r in rows.groupBy("lang", "quality").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("kept")).alias("gone")).collect()}
    for lang in ("de", "en", "es", "fr"):
        good, bad = found[lang, 1], found[lang, 0]
        assert good[1] <= 0.002 * good[0] + 1 and bad[1] >= 0.9 * bad[0], found
    print(found)


def test_groups_are_widened_until_they_are_enough(spark):
    rows = [(f"l{k % 2}", f"s{k % 3}", False) for k in range(180)] + [("l0", "t", False)] * 20 + [("l0", "u", False)] * 10 + [("l1", "u", False)] * 24 + [("l2", None, False), (None, None, False), ("l1", "v", True)]
    docs = spark.createDataFrame(rows, "by0 string, by1 string, base_failed boolean")
    got = {(r.by0, r.by1): r.grp for r in quality_rules.pooled(docs, ["by0", "by1"]).collect()}
    assert len({got[f"l{k % 2}", f"s{k % 3}"] for k in range(6)}) == 6 and None not in {got[f"l{k % 2}", f"s{k % 3}"] for k in range(6)}
    assert got["l0", "t"] == got["l0", "u"] not in (None, got["l0", "s0"])  # 30 of one language
    assert got["l1", "u"] == got["l2", None] == got[None, None]  # 26 of all
    assert got["l1", "v"] is None  # only rows that failed


def test_chi_square():
    assert quality_rules.chi_square_limit(0.05, 5) == pytest.approx(11.0705, abs=1e-3)
    assert quality_rules.chi_square_limit(0.05, 4) == pytest.approx(9.4877, abs=1e-3)
    assert quality_rules.consistency(0.75, 5) == pytest.approx(1.4121, abs=1e-3)


def test_ordinal_fit_orders_grades():
    import numpy as np

    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 600)
    rows = [np.unique(np.append(rng.integers(100, 400, 8), [g] * 1)) for g in grades]
    model = ordinal_quality.fit(rows, grades, 3)
    assert (np.diff(model.thresholds) > 0).all()
    scores = np.array([model.score(r) for r in rows])
    means = [scores[grades == g].mean() for g in range(3)]
    assert means[0] < means[1] < means[2]
    tails = model.tails(0.3)
    assert tails[0] >= tails[1]


def test_quality_classifier_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = ordinal_quality.train(docs, labels.filter("doc_id % 2 = 0"), sample=2500)
    held = ordinal_quality.score(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    share = lambda rows: sum(r.kept for r in rows) / len(rows)
    assert share([r for r in held if r.quality == 0]) < 0.05
    assert share([r for r in held if r.quality == 1 and r.toxic == 0]) > 0.97
    assert share([r for r in held if r.quality == 1 and r.toxic == 1]) < 0.45


def test_fit_reaches_the_maximum_likelihood():
    # two words and three grades without penalty: the same as a plain search for the likeliest parameters
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (900, 2))
    grades = np.digitize(x @ np.array([1.5, -1.0]) + rng.logistic(size=900), [-0.5, 1.0])
    rows = [np.flatnonzero(r) for r in x]
    model = ordinal_quality.fit(rows, grades, 3, buckets=2, steps=4000, penalty=0.0)
    share = np.bincount(grades) / 900
    weigh = 1 / np.sqrt(share[grades])

    def likelihood(w, t):
        tails = lambda k: 1 / (1 + np.exp(-(x @ w - t[k])))
        p = np.select([grades == 0, grades == 1], [1 - tails(0), tails(0) - tails(1)], tails(1))
        return float((weigh * np.log(p)).sum() / weigh.sum()) - 1e-3 * np.abs(w).sum()

    best = likelihood(model.weights.astype(float), model.thresholds)
    for _ in range(3000):
        w, t = model.weights + rng.normal(0, 0.05, 2), model.thresholds + rng.normal(0, 0.05, 2)
        assert t[0] >= t[1] or likelihood(w, t) < best + 1e-5


def test_repeated_ids_do_not_grow_the_sample(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["good", "fine"] if k % 2 else ["junk", "spam"]) + str(rng.randrange(30)) for _ in range(60)) for k in range(400)]
    docs = make(spark, [(k % 20, t, "en", "s") for k, t in enumerate(texts)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    seen = []
    fit, ordinal_quality.fit = ordinal_quality.fit, lambda rows, *a, **k: seen.append(len(rows)) or fit(rows, *a, **k)
    try:
        assert ordinal_quality.train(docs, labels, sample=50) is not None
    finally:
        ordinal_quality.fit = fit
    assert seen == [50]


def test_classifier_edge_cases(spark, docs):
    labels = spark.createDataFrame([(0, 1, 0), (2, 0, 0), (2, 1, 0), (3, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = ordinal_quality.train(docs, labels)
    got = ordinal_quality.score(docs, model).collect()
    assert len(got) == docs.count() and not any(r.kept for r in got if r.doc_id in (300, 301, 302))
    assert ordinal_quality.train(docs, labels.limit(0)) is None
    kept = ordinal_quality.keep_good(docs, None)
    assert kept.columns == docs.columns


def test_empty_tables(spark):
    empty = make(spark, [])
    outs = [
        exact_dedup.group_copies(empty), exact_dedup.drop_copies(empty), simhash.near_groups(empty), simhash.drop_near_copies(empty), repeats.remove_repeats(empty),
        mixing.mix(empty), mixing.mixed_documents(empty), packing.pack(empty, tokenizer_path()), license_scan.scan(empty), quality_rules.judge(empty), ordinal_quality.score(empty, None),
    ]
    assert all(o.count() == 0 for o in outs)


def test_levels_end_with_the_window():
    assert repeats.LEVELS[-1] == 1.0 and math.isclose(mixing.SHARE, 1.0)


def test_near_copies_by_word_sets(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [[word() for _ in range(300)] for _ in range(8)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base):
        edited = list(w)
        edited[150] = "edited"
        rows.append((100 + i, " ".join(edited)))
    rows += [(300, " ".join(base[0][:100] + [word() for _ in range(200)])), (301, ""), (302, None), (5, rows[5][1])]
    docs = make(spark, [(i, t, "en", "s") for i, t in rows])
    kept = Counter(r.doc_id for r in simhash.drop_near_copies(docs, shingle=None).collect())
    assert all(kept[i] == 1 for i in (*range(8), 300, 301)) and kept[302] == 0
    assert sum(kept[100 + i] for i in range(8)) <= 2  # one word of 300 rarely moves four bits


def settled(rows, kept):
    """No two rows that stay are alike, and each that goes is alike to one that stays."""
    assert len(kept) == len(set(kept))
    sets = [(i, simhash.shingles(t or "")) for i, t in dict(rows).items()]
    stay = [x for x in sets if x[0] in kept]
    assert not any(simhash.alike(a, b) for i, a in stay for j, b in stay if i != j)
    assert all(any(simhash.alike(a, b) for _, b in stay) for i, a in sets if i not in kept)


def test_similar_texts_go_and_no_others(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [[word() for _ in range(200)] for _ in range(6)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base):
        edited = list(w)
        edited[50] = edited[100] = "edited"  # 10 of 196 shingles differ
        rows.append((100 + i, " ".join(edited)))
    rows.append((200, " ".join(base[1][100:] + base[1][:100])))  # the same word set, 0.96 of the shingles
    rows.append((201, " ".join(x for k in range(0, 200, 4) for x in reversed(base[2][k : k + 4]))))  # the same word set, no shingle
    # a chain: each a near copy of the one before, the last not of the first
    chain = [list(base[3]) for _ in range(3)]
    chain[1][:12], chain[2][:24] = [word() for _ in range(12)], [word() for _ in range(24)]
    chain[2][:12] = chain[1][:12]
    rows += [(400 + i, " ".join(w)) for i, w in enumerate(chain)]
    rows += [(300, " ".join(base[0][:100] + [word() for _ in range(100)])), (301, ""), (302, None), (303, " \n"), (5, rows[5][1]), (None, rows[0][1])]
    docs = make(spark, [(i, t, "en", "s") for i, t in rows])
    kept = [r.doc_id for r in simhash.drop_similar(docs).collect()]
    settled(rows, kept)
    assert {201, 300} <= set(kept) and len({0, 100, None} & set(kept)) == len({1, 101, 200} & set(kept)) == 1
    assert simhash.drop_similar(docs.limit(0)).count() == 0


def test_groups_without_one_centre_are_settled_in_order(spark):
    # every two edits of one text are close to 0.8, so stars do not settle them
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(90)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(90), 1 + i % 2):
            w[k] = f"x{i}"
        rows.append((i, " ".join(w)))
    docs = make(spark, [(i, t, "en", "s") for i, t in rows])
    kept = [r.doc_id for r in simhash.drop_similar(docs).collect()]
    settled(rows, kept)
    assert 5 < len(kept) < 60



def test_pipeline_near_stage_verifies(spark):
    import corpus_pipeline

    words = [f"w{k}" for k in range(120)]
    shuffled = [words[k] for k in random.Random(1).sample(range(120), 120)]
    docs = make(spark, [(1, " ".join(words), "en", "s"), (2, " ".join(shuffled), "en", "s")])
    assert corpus_pipeline.near(spark, docs, "").count() == 2


def test_rare_toxic_words_get_weight():
    # 4,000 rows, each toxic word in 8 of them (0.2 %)
    rng = random.Random(3)
    rows, grades = [], []
    for i in range(4000):
        toxic = i < 160
        words = [f"w{rng.randrange(300)}" for _ in range(30)] + [f"vile{i % 20}"] * toxic
        rows.append(ordinal_quality.features(" ".join(words)))
        grades.append(0 if i >= 3600 else 1 if toxic else 2)
        if i >= 3600:
            rows[-1] = ordinal_quality.features(" ".join(["junk", *words[:5]]))
    model = ordinal_quality.fit(rows, np.array(grades), 3, steps=60)
    marked = [model.weights[ordinal_quality.zlib.crc32(b"vile%d" % k) % ordinal_quality.BUCKETS] for k in range(20)]
    assert all(w < 0 for w in marked)
