"""WARC archives, Merkle manifests and vector codes against plain Python, on edge cases as well."""

import gzip
import hashlib
import math
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import manifest, vector_codes, warc


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# -- WARC ------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, payload string, digest string, first string, n1 int, key string"


def pages_table(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z", 1, "k") for i, u, h in rows], PAGES)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(5)
    body = lambda n: "".join(rng.choice("abc <é>\r\n") for _ in range(n))
    copy, short = body(300), body(20)
    rows = [(i, f"http://h{i % 7}.example.com/p/{i % 11}?q={i}#f", body(rng.randint(0, 400))) for i in range(60)]
    rows += [(100 + i, "http://hot.example.com/x", copy) for i in range(25)] + [(90, None, copy), (None, "http://hot.example.com/x", copy)]
    rows += [(200, "no scheme \r\nX: y", short), (201, None, short), (202, "", None), (203, "http://a b/é", ""), (None, None, None)]
    twin = (5000, "http://twin.org/", body(500))
    rows += [twin] * 5 + [(6000, "http://twin.org/", twin[2])]
    rows += [(7000, "http://long.org/" + "x" * 5000, body(200_000) + "WARC/1.1\r\n\r\n"), (7001, "http://long.org/" + "x" * 5001, "y" * 99), (7002, "u", "y" * 100)]
    return rows


def test_warc_round_trip(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 4)
    monkeypatch.setattr(warc, "FILE_BYTES", 4000)
    got = warc.round_trip(pages_table(spark, pages), str(tmp_path / "w")).collect()
    groups = {}
    for i, u, h in pages:
        groups.setdefault((h or "").encode(), []).append(i)
    want = []
    for i, _, h in pages:
        data = (h or "").encode()
        want.append((i, len(data), sha(data)))
    assert sorted(map(str, [(r.page_id, r.payload_bytes, r.payload_digest) for r in got])) == sorted(map(str, want))
    for data, ids in groups.items():
        own = [r for r in got if r.payload_digest == sha(data)]
        first = min((i for i in ids if i is not None), default=None)
        if len(data) < 100:
            assert all(r.record_type == "response" and r.refers_to is None for r in own)
        else:
            assert [r.page_id for r in own if r.record_type == "response"] == [first]
            assert all(r.refers_to == first for r in own if r.record_type == "revisit")


def test_warc_files_are_plain_archives(spark, pages, tmp_path):
    """Any reader of gzip members finds every record, its payload and its revisit."""
    warc.write_archive(pages_table(spark, pages), str(tmp_path / "w"))
    kinds, payloads = [], []
    for path in Path(tmp_path / "w/archive").iterdir():
        data = gzip.decompress(path.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            size = int(fields["Content-Length"])
            assert rest[size : size + 4] == b"\r\n\r\n" and ("WARC-Refers-To" in fields) == (fields["WARC-Type"] == "revisit")
            kinds.append(fields["WARC-Type"])
            payloads += [rest[:size]] if fields["WARC-Type"] == "response" else []
            data = rest[size + 4 :]
    assert len(kinds) == len(pages) and {p for p in payloads} == {(h or "").encode() for _, _, h in pages}


def test_lookup_reads_only_what_is_asked(spark, pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 4)
    folder = str(tmp_path / "w")
    table = pages_table(spark, pages)
    shards = warc.build_index(warc.write_archive(table, folder), folder)
    assert shards == sorted(shards) and all(a[1] <= b[0] for a, b in zip(shards, shards[1:], strict=False))
    asked = spark.createDataFrame([("http://HOT.example.com/x#y",), ("http://twin.org/",), ("http://nowhere.org/",), (None,), ("http://long.org/" + "x" * 5001,)], "url string")
    found = warc.fetch(warc.lookup(asked, folder, shards), folder, with_payload=True).collect()
    want = sum(1 for _, u, _ in pages if u in ("http://hot.example.com/x", "http://twin.org/", None) or u == "http://long.org/" + "x" * 5001)
    assert len(found) == want and all(r.size == len(r.payload) for r in found if r.kind == "response")
    directory = warc._directory(warc._place(folder)[0], f"{folder}/index/{shards[0][2]}")
    assert directory == sorted(directory) and directory[0][0] == shards[0][0]
    assert warc.lookup(asked.limit(0), folder, shards).count() == 0


def test_url_keys(spark):
    urls = ["http://User@www.Example.com:8080/a/B?c#d", "https://example.com", "x/y", None, "", "http://a.b/" + "z" * 3000]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.url_key(F.col("u"))).collect()]
    assert got[:5] == ["com,example,www:8080)/a/B?c", "com,example)", ")x/y", "", ")"] and len(got[5]) == warc.LONGEST


def test_damage_is_seen(spark, tmp_path):
    folder = str(tmp_path / "w")
    captures = warc.write_archive(pages_table(spark, [(1, "http://a.b/", "z" * 500)]), folder)
    [row] = captures.collect()
    path = Path(folder) / "archive" / row.file
    record = gzip.decompress(path.read_bytes()).replace(b"z" * 500, b"z" * 499 + b"y")
    data = gzip.compress(record, mtime=0)
    path.write_bytes(data)
    with pytest.raises(Exception, match="digest"):
        warc.fetch(captures.withColumn("length", F.lit(len(data)).cast("long")), folder).collect()


def test_warc_of_nothing(spark, tmp_path):
    assert warc.round_trip(pages_table(spark, []), str(tmp_path / "w")).count() == 0


# -- manifest --------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, proof string, root int, position string, tampered string, __tree string"


def plain_manifest(rows):
    """Leaf, subroot, root and siblings of each row, by the definition."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, lang, s, n: sha("".join(map(field, (i, s, lang, n, t))))

    def tree(nodes):
        """The root, and the siblings of each of the nodes."""
        paths, at = [[] for _ in nodes], [[j] for j in range(len(nodes))]
        while len(nodes) > 1:
            runs = [list(range(j, min(j + 2, len(nodes)))) for j in range(0, len(nodes), 2)]
            for run in runs:
                for j in run:
                    for member in at[j]:
                        paths[member] += [nodes[o] for o in run if o != j]
            at = [[m for j in run for m in at[j]] for run in runs]
            nodes = [sha("".join(nodes[j] for j in run)) for run in runs]
        return nodes[0], paths

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    inner = {}
    for lang in langs:
        own = sorted(((r[0] is not None, r[0] or 0, leaf(*r)) for r in rows if r[2] == lang))
        inner[lang] = (own, *tree([d for _, _, d in own]))
    root, paths = tree([inner[lang][1] for lang in langs])
    return root, [(i if known else None, d, inner[lang][1], sha("".join(own_path + path))) for lang, path in zip(langs, paths, strict=True) for (known, i, d), own_path in zip(inner[lang][0], inner[lang][2], strict=True)]


@pytest.mark.parametrize("levels", [2, 10])
def test_manifest(spark, levels, monkeypatch):
    for f in (manifest.reduced, manifest.proved):
        monkeypatch.setattr(f, "__defaults__", (levels,))
    rng = random.Random(levels)
    rows = [(i, "t" * rng.randint(0, 9), rng.choice(["en", "en", "en", "de", "é", "", None]), rng.choice(["s", "", None]), rng.choice([1, None, 2**63 - 1])) for i in range(-20, 60)]
    rows += [(None, None, None, None, None), (None, "x", "en", "s", 1), (7, "other", "en", "s", 1)] + [(200, "twin", "en", "s", 4)] * 9
    rows += [(300, "long " * 100_000, "en", "s", 500_000), (301, "alone", "zz", "s", 5)]
    docs = spark.createDataFrame([(*r, "a", "b", 1, "c", "d", "e") for r in rows], DOCS)
    out = manifest.manifest(docs, keep={"tampered": manifest.tampered(docs)})
    out = manifest.folded(out.withColumn("shown", F.coalesce("tampered", "leaf")), "shown").collect()
    root, want = plain_manifest(rows)
    assert sorted(map(str, [(r.doc_id, r.leaf, r.subroot, r.proof_sha256) for r in out])) == sorted(map(str, want)) and {r.root for r in out} == {root}
    hit = lambda r: r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
    assert all((r.tampered is not None) <= hit(r) and (r.folded_root == root) == (r.tampered is None) for r in out)
    assert any(r.tampered for r in out) and any(hit(r) and r.tampered is None for r in out)


def test_manifest_of_little(spark):
    docs = spark.createDataFrame([], DOCS)
    assert manifest.folded(manifest.manifest(docs), "leaf").count() == 0
    [row] = manifest.folded(manifest.manifest(spark.createDataFrame([(1, "x", None, None, 1, "a", "b", 1, "c", "d", "e")], DOCS)), "leaf").collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == sha("") and row.proof == b""


# -- vector codes ----------------------------------------------------------------


def plain_codes(rows):
    kept = [(i, [math.floor(1024 * float(x)) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cuts = [slice(int(c[0]), int(c[-1]) + 1) for c in np.array_split(np.arange(len(kept[0][1])), 4)]
    books = [[v[c] for _, v, _ in kept[:256]] for c in cuts]

    def assign():
        found = []
        for _, v, _ in kept:
            own = [min((sum((a - b) ** 2 for a, b in zip(v[c], e, strict=True)), k) for k, e in enumerate(book)) for c, book in zip(cuts, books, strict=True)]
            found.append(own)
        return found

    for _ in range(4):
        found = assign()
        for p, cut in enumerate(cuts):
            for k in range(len(books[p])):
                if own := [v[cut] for (_, v, _), f in zip(kept, found, strict=True) if f[p][1] == k]:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    errors = [(i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), label) for (i, _, label), f in zip(kept, assign(), strict=True)]
    sums = {}
    for *_, e, label in errors:
        sums[label] = sums.get(label, 0) + e
    seal = sha(",".join(str(x) for b in books for e in b for x in e))
    return [(i, code, e, sums[label], seal) for i, code, e, label in errors]


VECTORS = "vec_id long, embedding array<double>, label int, code string, part int, error string, __v int"


@pytest.mark.parametrize("n,width,scale", [(400, 8, 1.0), (60, 6, 1.0), (300, 8, 1e6)])
def test_codes(spark, n, width, scale):
    rng = random.Random(n)
    rows = [(i, [rng.choice([rng.gauss(0, scale), 0.5 * scale]) for _ in range(width)], rng.choice([1, 1, 2, None])) for i in range(n)]
    rows += [(None, rows[3][1], 2), (5, rows[5][1], 1), (5, rows[6][1], 1)] + [(1000 + i, rows[0][1], 1) for i in range(40)]
    rows += [(-1, None, 1), (-2, [1.0] * (width - 1) + [None], 1), (-3, [1.0] * (width - 1) + [math.nan], 1), (-4, [math.inf] + [1.0] * (width - 1), 1), (-5, [], 1)]
    table = spark.createDataFrame([(*r, "c", 1, "e", 1) for r in rows], VECTORS)
    got = [tuple(r) for r in vector_codes.compress(table).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_codes(rows)))


def test_search_is_exact():
    rng = np.random.default_rng(1)
    for kind in (np.int64, object):
        points, book = rng.integers(-9, 9, (3000, 7)).astype(kind), rng.integers(-9, 9, (50, 7)).astype(kind)
        code, error = vector_codes.nearest(points, book)
        every = ((points[:, None].astype(np.int64) - book[None].astype(np.int64)) ** 2).sum(axis=2)
        assert (code == every.argmin(axis=1)).all() and (error == every.min(axis=1)).all()


def test_codes_of_nothing_and_of_other_lengths(spark):
    table = spark.createDataFrame([], VECTORS)
    assert vector_codes.compress(table).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and vector_codes.compress(table).count() == 0
    rows = [(1, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (2, [1.0], 1), (3, [1e300, 0.0, 0.0, 0.0, 0.0], None)]
    got = {r.vec_id: r for r in vector_codes.compress(spark.createDataFrame([(*r, "c", 1, "e", 1) for r in rows], VECTORS)).collect()}
    assert set(got) == {1, 3} and got[1].code == "00000000" and got[1].error == 0
    books = [np.array([[1, 2], [3, 4]]), np.array([[5], [6]]), np.array([[7], [8]]), np.array([[9], [10]])]
    assert vector_codes.decode("01000100", books) == [3, 4, 5, 8, 9]
