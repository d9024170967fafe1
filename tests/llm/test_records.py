"""URL rules, shards and chat: defined results for odd rows, and brute force."""

import random

from citeloom.llm import chat, shards, url_filter
from citeloom.llm.queries import EXTRA_TURNS, URL_RULES

URLS = [
    (1, "http://Www.EXAMPLE.org/en/15"), (2, "https://example.org/es/"), (3, "https://x.example.org"), (4, None), (5, "no scheme/de/"),
    (6, "a://b.com/de/x?y#z"), (7, "a://b.com/fr/#z"), (8, "a://com/de/"), (9, "a://notexample.org/es/1"), (10, ""),
    (11, "a://x.org:80/en/"), (12, "a://org?q=/es/"), (13, "a://net/" + "p/" * 3000), (2, "https://example.org/es/"),
]


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:end].lower(), rest[end:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "other") for i, u in URLS], "page_id long, url string, rule string")
    rules = url_filter.rule_table(spark, URL_RULES)
    expected = sorted((i, *brute_verdict(u, URL_RULES)) for i, u in URLS)
    key = lambda r: tuple(str(v) for v in r)
    for bound in (10_000, 0):
        found = [tuple(r) for r in url_filter.judge_urls(pages, rules, broadcast_bytes=bound).collect()]
        assert sorted(found, key=key) == sorted(expected, key=key)
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), rules).collect() == []


def test_shards(spark, tmp_path):
    rows = [(i, "x" * (i % 50) if i % 9 else None, "clash") for i in range(500)] + [(3, "xxx", "clash")] * 4 + [(None, None, None)]
    given = spark.createDataFrame(rows, "doc_id long, text string, slot string")
    placed = shards.place(given, 7, bucket_bytes=200)
    shards.write_shards(placed, str(tmp_path / "s"))
    read = shards.read_shards(spark, str(tmp_path / "s"), placed.schema).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in read) == sorted((str(r[0]), str(r[1])) for r in rows)
    by_shard = {}
    for r in read:
        by_shard.setdefault(r.shard, []).append(r)
    for number, own in by_shard.items():
        assert 0 <= number < 7 and sorted(r.slot for r in own) == list(range(len(own)))
    assert [r.doc_id for r in sorted(by_shard[0], key=lambda r: r.slot)] != sorted(r.doc_id for r in by_shard[0])
    again = {(r.doc_id, r.slot) for r in shards.place(given.repartition(5), 7, bucket_bytes=200).collect()}
    assert again == {(r.doc_id, r.slot) for r in read}
    moves = given.select(shards.shard_of("doc_id", 7).alias("a"), shards.shard_of("doc_id", 8).alias("b")).collect()
    assert all(r.a == r.b or r.b == 7 for r in moves) and any(r.b == 7 for r in moves)
    assert shards.place(given.limit(0), 7).collect() == []


def test_chat_round_trip(spark):
    texts = ["", "a\\|b", "<|im_end|>\n<|im_start|>user\nhi", "\\", "<", "|>", "<\\|x", "é😀" * 50]
    rows = [(7, t, r, x) for t, (r, x) in enumerate(zip(["system", "assistant", "us\ner", "<|nl|>", None, "assistant", "a", "b"], texts))]
    rows += [(8, 0, "user", None), (8, 0, "user", None), *EXTRA_TURNS]
    given = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, tree int")
    nodes = chat.linear_tree(given)
    out = {r.tree: r for r in chat.format_paths(nodes, chat.chosen_paths(nodes)).collect()}
    for conv in (7, 8, -1):
        turns = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        assert chat.parse(out[conv].formatted) == turns
        spans = [s.asDict() for s in out[conv].loss_spans]
        assert chat.masked_text(out[conv].formatted, spans) == "".join(t for r, t in turns if r == "assistant")
    nothing = chat.linear_tree(given.limit(0))
    assert chat.read_back(chat.format_paths(nothing, chat.chosen_paths(nothing))).collect() == []


def test_conversation_without_id(spark):
    rows = [(None, 0, "user", "hi"), (None, 1, "assistant", "hello"), (None, 2, "user", "bye"), (2**53 + 1, 0, "user", "x")]
    nodes = chat.linear_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    paths = chat.chosen_paths(nodes)
    assert {(r.tree, r.up) for r in paths.collect()} == {(None, 0), (None, 1), (None, 2), (2**53 + 1, 0)}
    formatted = chat.format_paths(nodes, paths)
    assert {r.tree: chat.parse(r.formatted) for r in formatted.collect()} == {
        None: [("user", "hi"), ("assistant", "hello"), ("user", "bye")], 2**53 + 1: [("user", "x")],
    }
    assert {(r.tree, r.n_turns, r.loss_chars) for r in chat.read_back(formatted).collect()} == {(None, 3, 5), (2**53 + 1, 1, 0)}


def test_reply_trees(spark):
    nodes = [(1, 1, None, 1.0), (1, 2, 1, 5.0), (1, 3, 1, 1.0), (1, 4, 3, 1.0), (1, 5, 3, 9.0), (2, 1, 99, 0.0), (2, 2, 3, 1.0), (2, 3, 2, 1.0)]
    nodes += [(3, i, i - 1 if i else None, 0.0) for i in range(300)]
    frame = spark.createDataFrame(nodes, "tree long, node long, parent long, score double")

    def paths(branches):
        found = {}
        for r in chat.chosen_paths(frame, branches).collect():
            found.setdefault((r.tree, r["rank"]), {})[r.up] = r.node
        return {k: [v[i] for i in sorted(v, reverse=True)] for k, v in found.items()}

    assert paths(1) == {(1, 1): [1, 3, 5], (2, 1): [1], (3, 1): list(range(300))}
    every = paths(None)
    assert every[1, 2] == [1, 2] and every[1, 3] == [1, 3, 4] and len(every) == 5


def test_random_trees(spark):
    draw = random.Random(5)
    nodes = [(t, i, draw.randrange(i) if i else None, float(draw.randrange(9))) for t in range(12) for i in range(draw.randint(1, 25))]
    parent = {(t, i): p for t, i, p, _ in nodes}
    inner = {(t, p) for t, _, p, _ in nodes}
    found = {}
    frame = spark.createDataFrame(nodes, "tree long, node long, parent long, score double")
    for r in chat.chosen_paths(frame, None).collect():
        found.setdefault((r.tree, r.leaf), {})[r.up] = r.node
    assert set(found) == {k for k in parent if k not in inner}
    for (tree, leaf), ups in found.items():
        at, up = leaf, 0
        while at is not None:
            assert ups.pop(up) == at
            at, up = parent[tree, at], up + 1
        assert not ups
