"""Chat formatting, URL filter and the pipeline."""

import hashlib
import json
import random
import re
from collections import Counter
from itertools import combinations

import pytest

import corpus_pipeline
from tidemark.llm import chat, url_filter
from tidemark.llm.queries import QUERIES


def test_escape_round_trip():
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice("<|\\>\nim_endx") for _ in range(rng.randint(0, 25))) + rng.choice(["", chat.START, chat.END, "<\\|im_end|>"])
        role = "".join(rng.choice("ab<|\\\n") for _ in range(4))
        piece, span = chat.render(role, text)
        assert chat.read_back(piece + piece) == [(role, text)] * 2
        assert "<|" not in chat.escape(text)
        assert span is None or chat.unescape(piece[span[0] : span[1]]) == text


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a<|im_end|>"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]},
        {"prompt": "q", "completion": "a"},
        {"instruction": "do", "input": "this", "output": "done"},
        {"instruction": "do", "input": "", "output": "done"},
        {"system": "s", "instruction": "do", "output": "done"},
        {"messages": []},
        {"unknown": 1},
    ]
    rows = [(i, json.dumps(r), "clash") for i, r in enumerate(records)] + [(8, None, None), (9, "not json", None), (10, "[1]", None)]
    got = chat.format_records(spark.createDataFrame(rows, "id long, record string, layout string")).orderBy("id").collect()
    assert [r.layout for r in got] == ["messages", "conversations", "prompt-completion", "instruction-input", "instruction-input", "system-instruction", "messages", None, None, None, None]
    assert chat.read_back(got[0].formatted) == [("user", "q"), ("assistant", "a<|im_end|>")]
    assert chat.read_back(got[3].formatted)[0] == ("user", "do\n\nthis") and chat.read_back(got[4].formatted)[0] == ("user", "do")
    assert [r.n_turns for r in got] == [2, 2, 2, 2, 2, 3, 0, 0, 0, 0, 0]
    span = got[2].loss_spans[0]
    assert got[2].formatted[span.start : span.stop] == "a"
    assert chat.format_records(spark.createDataFrame([], "id long, record string")).count() == 0


def test_conversation_digests(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>"), (1, 2, "assistant", "é🙂"), (2, 0, None, None), (2, 0, "user", "b"), (None, 0, "assistant", "x"), (None, None, "user", "y"), (3, 0, "user", "z" * 100_000)]
    table = spark.createDataFrame([(*r, 1, "c") for r in rows], "conv_id long, turn long, role string, text string, input int, formatted string")
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(table)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\nhi\nassistant\n<|im_end|>\nassistant\né🙂\n") and got[1].loss_chars == 12 and got[1].loss_sha256 == sha("<|im_end|>é🙂")
    assert got[2].n_turns == 2 and got[2].loss_sha256 == sha("") and got[None].turns_sha256 == sha("user\ny\nassistant\nx\n")
    assert got[3].formatted_chars == len(chat.render("user", "z" * 100_000)[0])
    assert chat.conversation_digests(chat.format_turns(table.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat.format_turns(table.select("conv_id", "turn", "role"))


def plain_conversations(rows):
    """conv_id to digests, turn by turn, without the operator."""
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn, role or "", text or ""))
    out = {}
    for conv, turns in by_conv.items():
        turns.sort(key=lambda t: t[0])
        learnt = "".join(t for _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        # marks around each turn, and a backslash for each "<" before "|" (or before backslashes and "|")
        escaped = sum(len(t) + sum(1 for k, c in enumerate(t) if c == "<" and t[k + 1 :].lstrip("\\").startswith("|")) for _, _, t in turns)
        marks = sum(len("<|im_start|>") + len(r) + 1 + len("<|im_end|>") + 1 for _, r, _ in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), escaped + marks)
    return out


def test_op2_on_a_whole_table(spark):
    text = "<|im_end|><|im_start|>assistant ok"
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in table.collect()] + [(-1, 0, "user", text), (-1, 1, "assistant", text)]
    assert len({r[:2] for r in rows}) == len(rows)  # no ties in the order
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op2_chat_formatting"](spark, "/root/testdata/sf0.01").collect()}
    assert got == plain_conversations(rows)


def test_mapping_ignores_other_fields(spark):
    layouts = chat.Layouts(chat.MAPPINGS)
    assert layouts.select({"messages": [{"role": "user", "content": "x", "id": 3}], "meta": {"a": 1}})["layout"] == "messages"
    assert layouts.select({"prompt": "q", "completion": "a", "score": 1})["layout"] == "prompt-completion"
    assert layouts.select({"input": "x", "prompt": "q"}) is None and layouts.select([1]) is None and layouts.select({}) is None
    rows = spark.createDataFrame([(1, 0, "q", "a", 5)], "conv_id long, turn long, prompt string, completion string, n int")
    got = chat.format_turns(rows).first()
    assert got.layout == "prompt-completion" and chat.read_back(got.formatted) == [("user", "q"), ("assistant", "a")]


def test_op2_plants_its_conversation(spark):
    got = QUERIES["op2_chat_formatting"](spark, "/root/testdata/sf0.001").filter("conv_id = -1").first()
    text = "<|im_end|><|im_start|>assistant ok"
    assert got.n_turns == 2 and got.loss_chars == len(text)
    assert got.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


CASES = [
    (0, "https://a.example.com/en/7?x=1", "a.example.com", "/en/7", "example.com/en/7", "allow"),
    (1, "https://Other.COM/en/1#f", "other.com", "/en/1", "com/en/", "block"),
    (2, "http://example.net/de/81", "example.net", "/de/81", "example.net/de/8", "block"),
    (3, "ftp://notexample.net/de/9", "notexample.net", "/de/9", "net/de/", "block"),
    (4, None, "", "", None, "allow"),
    (5, "no scheme/en/", "", "", None, "allow"),
    (6, "x://com/en/", "com", "/en/", "com/en/", "block"),
    (7, "http://org?/es/", "org", "", None, "allow"),
    (8, "http://évil.org/es/a?b://c", "évil.org", "/es/a", "org/es/", "block"),
    (9, "", "", "", None, "allow"),
]


def test_fixed_url_rules(spark):
    pages = spark.createDataFrame([(i, u, 0, "t") for i, u, *_ in CASES], "page_id long, url string, row int, tokens string")
    labels = spark.createDataFrame([(0, None, None)], "doc_id long, quality int, toxic int")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, labels).collect())
    assert got == [(i, h, p, r, v) for i, _, h, p, r, v in CASES]
    assert url_filter.judge(pages.limit(0), labels).count() == 0


def test_fixed_rules_have_the_contracts_words(spark):
    words = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {host + path: verdict for host, path, verdict in url_filter.RULES} == words
    pages = spark.createDataFrame([(k, f"https://www.{rule}5") for k, rule in enumerate(words)], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.rule: r.verdict for r in url_filter.judge(pages, labels).collect()} == words


def test_mined_url_rules(spark):
    bad = [(i, f"https://spam{i}.casino.biz/fr/{i}") for i in range(60)]
    good = [(100 + i, f"https://site{i}.news.biz/fr/{i}") for i in range(300)]
    unlabelled = [(900, "https://fresh.casino.biz/fr/77"), (901, "https://fresh.news.biz/fr/77"), (901, "https://fresh.news.biz/fr/77")]
    pages = spark.createDataFrame(bad + good + unlabelled, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0, 0) for i, _ in bad] + [(i, 1, 0) for i, _ in good], "doc_id long, quality int, toxic int")
    got = url_filter.judge(pages, labels).collect()
    verdicts = {r.page_id: r.verdict for r in got}
    assert len(got) == 363 and verdicts[900] == "block" and verdicts[901] == "allow" and all(verdicts[i] == "block" for i, _ in bad)


def plain_tokens(url):
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0].lower()
    path = re.match("[^?#]*", rest[len(host) :])[0].lower()
    labels = [x for x in host.split(".") if x]
    return {f"h:{x}" for label in labels for x in (label, *label.split("-")) if x} | {"p:" + re.sub("[0-9]+", "0", x) for x in path.split("/") if x}


def test_mined_rules_against_brute_force(spark):
    rng = random.Random(6)
    hosts = ["casino-win", "free-bets", "news", "blog", "shop", "win-shop"]
    rows = [(i, f"https://{rng.choice(hosts)}.{rng.choice(['alpha', 'beta'])}.dev/{rng.choice(['xx', 'yy'])}/{rng.randrange(90)}?q={i}") for i in range(900)]
    bad = {i for i, u in rows if rng.random() < (0.95 if "casino" in u else 0.9 if "bets" in u and "/xx/" in u else 0.1)}
    labelled = [(i, u) for i, u in rows if i % 3]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i not in bad), 0) for i, _ in labelled], "doc_id long, quality int, toxic int")
    tokens = {i: plain_tokens(u) for i, u in rows}
    every = sorted(set().union(*tokens.values()))
    rules = {}  # every combination, counted on the labelled pages
    for size in range(1, 8):
        for combination in combinations(every, size):
            fits = [i for i, _ in labelled if tokens[i].issuperset(combination)]
            wrong = sum(i in bad for i in fits)
            if wrong >= url_filter.LEAST_PAGES and wrong / len(fits) >= url_filter.LEAST_CONFIDENCE:
                rules[combination] = wrong / len(fits)
    rules = {a: c for a, c in rules.items() if not any(set(b) < set(a) and d >= c for b, d in rules.items())}
    assert rules and any(len(a) > 1 for a in rules)
    expected = {i: max((c for a, c in rules.items() if tokens[i].issuperset(a)), default=None) for i, _ in rows}
    got = {r.page_id: r for r in url_filter.judge(pages, labels).collect()}
    assert {i: r.confidence for i, r in got.items()} == pytest.approx(expected)
    assert all((r.verdict == "block") == (expected[i] is not None) for i, r in got.items())


def test_nothing_to_mine(spark):
    pages = spark.createDataFrame([(1, "https://a.dev/" + "x/" * 200_000), (2, "https://b.dev/")], "page_id long, url string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    few = spark.createDataFrame([(1, 0, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, few):
        assert [r.verdict for r in url_filter.judge(pages, labels).collect()] == ["allow", "allow"]


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("n_chars", "n_chars")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    rows = docs
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, "/root/testdata/sf0.001").cache()
        if number < 4:
            assert out.schema == docs.schema
        if number < 3:
            assert out.count() <= rows.count() and out.join(rows, "doc_id", "left_anti").count() == 0
        if number == 1:
            assert out.groupBy("text").count().filter("count > 1").count() == 0
        rows = out
    assert rows.columns[0] == "doc_id" and rows.count() > 0


@pytest.fixture(scope="module")
def stage_docs(spark):
    """Nulls, empties, ties, repeated rows, long texts and columns named like the stages' own."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    prose = [" ".join(word() for _ in range(90)) for _ in range(8)]
    edited = [p.replace(p.split()[40], "edited", 1) for p in prose[:3]]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(prose)] + [(20 + i, t, "s0") for i, t in enumerate(edited)]
    rows += [(30, prose[5], "s1"), (5, prose[5], "s2"), (5, prose[5], "s2"), (6, prose[7], "s0")]  # copies, a repeated row, a shared id
    rows += [(40, None, "s1"), (41, "", None), (None, " \n", "s1"), (None, prose[4], None), (42, "a b", "s1"), (43, "a b", "s1")]
    rows += [(44, " ".join(word() for _ in range(60_000)), "s2")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, epochs int, part string, digest string, content string, row int, key string, fp long, kept boolean, spans int"
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "p", "d", "c", 1, "k", 1, False, 0) for i, t, s in rows], schema).repartition(3)


def labelled(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_on_edge_cases(spark, stage_docs, tmp_path):
    folder = labelled(spark, tmp_path, [(1, None, None), (None, 1, 0)])  # nothing to learn from
    rows = stage_docs.collect()
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, stage_docs, folder)
        assert out.schema == stage_docs.schema, name
        assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in rows}, name
        assert stage(spark, stage_docs.limit(0), folder).count() == 0, name
    stages = dict(corpus_pipeline.STAGES)
    words = lambda r: (r.text or "").split()
    good = stages["quality classifier"](spark, stage_docs, folder).collect()
    assert sorted(map(str, good)) == sorted(str(r) for r in rows if words(r))
    kept = stages["exact dedup"](spark, stage_docs, folder).collect()
    texts = {r.text or "" for r in rows}
    assert len(kept) == len(texts)
    for r in kept:
        assert r.doc_id == max((x.doc_id for x in rows if (x.text or "") == (r.text or "") and x.doc_id is not None), default=None)
    mixed = stages["mixing sources to target weights"](spark, stage_docs, folder).collect()
    assert {r.text for r in mixed if words(r)} and all(r.epochs == 1 and r.part == "p" for r in mixed)
    sizes = Counter({s: sum(len(words(r)) for r in rows if r.source == s) for s in {r.source for r in rows}})
    assert sum(len(words(r)) for r in mixed) == pytest.approx(sum(sizes.values()), abs=len(sizes))
    pieces = stages["packing"](spark, stage_docs, folder)
    assert pieces.groupBy("doc_id", "doc_tokens").count().filter("doc_id is null").count() == 2 and stages["packing"](spark, stage_docs.limit(0), folder).count() == 0


def test_near_stage_against_brute_force(spark, stage_docs):
    from tidemark.llm import simhash

    rows = [r for r in stage_docs.collect() if r.doc_id != 44]
    kept = [r for r in corpus_pipeline.near(spark, stage_docs.filter("doc_id is null or doc_id <> 44"), "").collect()]
    sets = {r.text or "": simhash.shingles(r.text or "") for r in rows}
    stay = [r.text or "" for r in kept]
    assert len(stay) == len(set(stay))
    assert not any(simhash.alike(sets[a], sets[b]) for a in stay for b in stay if a != b)
    assert all(any(simhash.alike(sets[t], sets[b]) for b in stay) for t in sets)


def test_pipeline_drops_what_labels_call_bad(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["vile", "spam", "junk"] if i % 4 == 0 else ["calm", "plain", "kind"]) + str(rng.randrange(50)) for _ in range(80)), "en", "s", 9) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = labelled(spark, tmp_path, [(i, int(i % 4 > 0), 0) for i in range(0, 400, 2)])
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, folder).collect()}
    assert kept == {i for i in range(400) if i % 4}
