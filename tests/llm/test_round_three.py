"""Prefix tries, license scans, whitening, seeded shards and long quotations against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from citeloom.llm import html_text, licenses, prefix_trie, shards, toxicity, whitening

MASK = 2**64 - 1


def words_in(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(set)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    out = {}
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = ",".join(str(c) for c in sorted(c for c in convs if rebuilt[c] == node))
        out[min(convs), len(node), hashlib.sha256(ends.encode()).hexdigest()] = (
            min(members[node[:-1]]) if node else None, len(convs), len(children[node]), sum(not children[n] for n in below),
            sum((len(members[n]) - 1) * len(words_in(n[-1][1])) for n in below if n),
        )
    return out


def found_trie(df):
    return {
        (r.conv_id, r.depth, r.ends_sha256): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens)
        for r in df.collect()
    }


def conversations(draw, n):
    rows = []
    for c in [*range(n), -3, 10**12]:
        if c % 17 == 5:  # many copies
            rows += [(c, t, "user", f"copy {t}") for t in range(6)]
        else:
            rows += [(c, t, draw.choice(["user", "assistant", None]), draw.choice(["a b", "a", "", None, "c\td e"])) for t in range(draw.randint(1, 7))]
    rows += [(3, None, "user", "first"), (3, 2, "user", "tie"), (3, 2, "user", "tie"), (3, 2, "user", "tied"), (None, 0, "user", "nobody")]
    rows += [(40, t, "user", f"long {t}") for t in range(30)]
    draw.shuffle(rows)
    return rows


def test_conversation_trie(spark, monkeypatch):
    rows = conversations(random.Random(4), 90)
    schema = "conv_id long, turn long, role string, text string"
    frame = spark.createDataFrame([(*r, "clash") for r in rows], schema + ", depth string").repartition(7)
    expected = brute_trie(rows)
    assert found_trie(prefix_trie.conversation_trie(frame)) == expected
    # Segments of three turns, and tries that are emptied after every batch.
    monkeypatch.setattr(prefix_trie, "SEGMENT", 3)
    cut = prefix_trie.segments(frame, "conv_id", "turn", "role", "text")
    assert cut.count() > len({r[0] for r in rows})
    monkeypatch.setattr(prefix_trie.partial_nodes, "__defaults__", (5,))
    monkeypatch.setattr(prefix_trie.ending_digests, "__defaults__", (2,))
    assert found_trie(prefix_trie.conversation_trie(frame)) == expected
    assert prefix_trie.conversation_trie(frame.limit(0)).collect() == []
    alone = prefix_trie.conversation_trie(frame.where("conv_id is null")).collect()
    assert alone == []


def test_z_fast_trie_against_prefix_sets():
    draw = random.Random(9)
    assert [prefix_trie.two_fattest(a, b) for a, b in ((0, 1), (0, 7), (4, 7), (5, 7), (6, 7), (3, 8), (8, 15))] == [1, 4, 6, 6, 7, 8, 12]
    for _ in range(60):
        trie, strings = prefix_trie.ZFastTrie(0), []
        for _ in range(draw.randint(1, 4)):
            batch = []
            for _ in range(draw.randint(1, 12)):
                symbols = [draw.randint(1, 2) for _ in range(draw.randint(0, 20))]
                path = prefix_trie._paths(0, 0, symbols, symbols)
                batch.append((path, symbols, draw.randint(0, 99), draw.randint(1, 3)))
            strings += batch
            trie.insert_batch(batch)
        counted, least = defaultdict(int), {}
        for path, _, conv, n in strings:
            for depth, key in enumerate(path):
                counted[depth, key] += n
                least[depth, key] = min(least.get((depth, key), conv), conv)
        seen = {}
        for node in trie.nodes():
            for depth in range(max(0, node.low + 1), node.high + 1):
                seen[depth, node.path[depth]] = (node.passing, node.least)
        assert seen == {k: (counted[k], least[k]) for k in counted}


def brute_licenses(text, phrases):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places, labels = [], set()
    for label, phrase in phrases:
        wanted = phrase.split()
        at = [i for i in range(len(words) - len(wanted) + 1) if words[i : i + len(wanted)] == wanted]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_phrases(spark):
    draw = random.Random(2)
    pool = ["CC", "by", "cc", "MIT", "license", "GNU", "general", "public", "apache", "é", "ſ", "K", "x1", " ", "-", "İ"]
    texts = [" ".join(draw.choice(pool) for _ in range(draw.randint(0, 40))) for _ in range(120)]
    texts += [None, "", "...", "cc by " * 3000, "mit license", "MIT  LICENSE", "cc\nby", "gnu general public license " * 5]
    frame = spark.createDataFrame([(i if i % 9 else None, t, "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, labels string, row string")
    expected = sorted(((i if i % 9 else None), *brute_licenses(t, licenses.PHRASES)) for i, t in enumerate(texts) if i % 9)
    templates = licenses.template_table(spark)
    for bound in (1 << 24, 0):
        rows = licenses.scan(frame, templates, broadcast_bytes=bound).collect()
        found = [(r.doc_id, r.n_words, r.n_exact, r.first_word, r.last_word, r.exact_labels) for r in rows]
        assert len(found) == len(texts) and sorted(f for f in found if f[0] is not None) == expected
        assert all(set(r.exact_labels.split(",")) <= set(r.labels.split(",")) | {""} for r in rows)
        assert all(0 <= r.score <= 1 and (r.score == 1.0 or not r.n_exact) for r in rows)
    assert licenses.scan(frame.limit(0), templates).collect() == []
    assert {(r.labels, r.score) for r in licenses.scan(frame, templates.limit(0)).collect()} == {("", 0.0)}


def test_license_notices_with_changes(spark):
    notice = dict((label, text) for label, text in licenses.NOTICES)["mit-notice"]
    words = notice.split()
    cases = {
        1: notice, 2: " ".join(words[:12] + ["really", "quite"] + words[12:]), 3: " ".join(words[:10] + words[12:]),
        4: "before " * 300 + notice.upper() + " after" * 300, 5: " ".join(words[:6]), 6: " ".join(reversed(words)),
        7: " ".join(w + " x" * 40 for w in words),
    }
    frame = spark.createDataFrame(list(cases.items()), "doc_id long, text string")
    found = {r.doc_id: r for r in licenses.scan(frame, licenses.template_table(spark)).collect()}
    assert {i for i, r in found.items() if "mit-notice" in r.labels} == {1, 2, 3, 4}
    assert found[1].score == 1.0 and 0.6 <= found[2].score < 1 and 0 < found[5].score < 0.6 and found[6].score == 0
    (span,) = [s for s in found[4].spans if s.label == "mit-notice"]
    assert (span.first_word, span.last_word) == (300, 299 + len(re.findall(r"[a-z0-9]+", notice.lower())))


def test_components_against_numpy():
    draw = np.random.default_rng(3)
    for n, k in ((1, 1), (2, 2), (3, 2), (40, 32), (40, 40)):
        full = draw.standard_normal((n, n))
        q, _ = np.linalg.qr(full)
        for matrix in (full @ full.T, np.diag(draw.integers(1, 4, n).astype(float)), (q * np.where(np.arange(n) < n // 2, 2.0, 1.0)) @ q.T):
            matrix = (matrix + matrix.T) / 2
            values, vectors = whitening.leading_components(matrix, k)
            true = np.linalg.eigvalsh(matrix)[::-1][: len(values)]
            assert np.abs(values - true).max() < 1e-12 * true[0]
            assert np.abs(matrix @ vectors.T - vectors.T * values).max() < 1e-12 * true[0]
            assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-12
    assert len(whitening.leading_components(np.zeros((3, 3)), 2)[0]) == 0


def brute_whitening(vectors):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(int) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    y = x - s / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return n, deviation, y, values[::-1], vectors[:, ::-1].T


def test_whitening(spark):
    draw = np.random.default_rng(8)
    rows = (draw.standard_normal((300, 10)) * np.arange(1, 11) * 0.3).astype(np.float32).tolist()
    rows[5] = rows[6]
    odd = [None, [None] * 10, [float("nan")] * 10, [float("inf")] + [0.0] * 9, [float("-inf")] * 10]
    frame = spark.createDataFrame([(i, v, "x") for i, v in enumerate(rows)] + [(-1, v, "x") for v in odd], "vec_id long, embedding array<float>, whitened string")
    n, deviation, y, values, vectors = brute_whitening(rows)
    model = whitening.fit(frame.repartition(5), components=7)
    assert model.n == n and np.allclose(model.values, values[:7], rtol=1e-10) and np.isclose(model.trace, values.sum())
    found = whitening.whiten(frame, model).collect()
    assert sorted(r.vec_id for r in found) == list(range(300))
    signs = np.sign((model.vectors * vectors[:7]).sum(axis=1))
    for r in found:
        assert int(r.deviation) == deviation[r.vec_id]
        assert np.allclose(r.whitened, signs * (vectors[:7] @ y[r.vec_id]) / np.sqrt(values[:7]), atol=1e-8)
    assert whitening.identity_error(frame, model) < 1e-10


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    for rows, components in (([], 0), ([(1, None)], 0), ([(1, [1.0, 2.0])], 0), ([(1, [1.0, 2.0])] * 4, 0), ([(1, [1.0]), (2, [1.0, 5.0]), (3, [])], 2), ([(1, [])], 0)):
        frame = spark.createDataFrame(rows, schema)
        model = whitening.fit(frame)
        assert len(model.values) == components
        assert len(whitening.whiten(frame, model).collect()) == sum(r[1] is not None for r in rows)
        assert whitening.identity_error(frame, model) < 1e-10
    with pytest.raises(Exception, match="too large"):
        whitening.fit(spark.createDataFrame([(1, [3e30])], schema))
    big = whitening.Model(3 * 10**9, (10**6 * 3 * 10**9,) * 2, np.ones(1), np.eye(1, 2), 1.0)
    assert int(big.deviations(np.array([[5, -7]]))[0]) == (3 * 10**9) ** 2 * 74


def mixed(*values):
    """Spark's xxhash64 of integers, longs and texts; nulls leave it as it is."""
    state = 42
    for value in values:
        if value is not None:
            state = xxhash.xxh64_intdigest(value, state)
    return state - 2**64 if state >= 2**63 else state


def i4(x):
    return x.to_bytes(4, "little", signed=True)


def i8(x):
    return None if x is None else x.to_bytes(8, "little", signed=True)


def brute_shards(rows, n_shards, bucket_bytes, bucket_rows, seed=17):
    total = sum(len((t or "").encode()) + 16 for _, t in rows)
    buckets = max(1, -(-total // (n_shards * bucket_bytes)), -(-len(rows) // (n_shards * bucket_rows)))
    held = defaultdict(list)
    for key, text in rows:
        shard = max(j for j in range(n_shards) if mixed(i4(seed), i8(key), i4(j)) % (j + 1) == 0)
        data = None if text is None else text.encode()
        held[shard, mixed(i4(seed + 1), i8(key), data) % buckets].append((key is not None, key or 0, mixed(data), data is not None, data or b""))
    out, offset = [], defaultdict(int)
    for (shard, bucket), own in sorted(held.items()):
        order = list(range(len(own)))
        for i in range(len(own) - 1, 0, -1):
            j = mixed(i4(seed), i4(shard), i4(bucket), i8(i)) % (i + 1)
            order[i], order[j] = order[j], order[i]
        for rank, (has, key, _, has_text, data) in enumerate(sorted(own)):
            out.append((key if has else None, data.decode() if has_text else None, shard, offset[shard] + order[rank]))
        offset[shard] += len(own)
    return sorted(out, key=str)


def test_shards_follow_from_data_and_seed(spark):
    draw = random.Random(6)
    rows = [(i, "é" * draw.randrange(40) if i % 9 else None) for i in range(600)] + [(3, "xxx")] * 4 + [(None, None), (None, "n")] + [(7, f"hot {i}") for i in range(300)]
    expected = brute_shards(rows, 5, 2000, 100)
    given = spark.createDataFrame(rows, "doc_id long, text string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for partitions, adaptive in ((3, "true"), (7, "true"), (7, "false")):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            placed = shards.place(given.repartition(partitions), 5, bucket_bytes=2000, bucket_rows=100).collect()
            assert sorted(((r.doc_id, r.text, r.shard, r.slot) for r in placed), key=str) == expected
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert shards.place(given.limit(0), 5).collect() == []


def test_long_quotations_weigh_less():
    matcher = toxicity.Matcher([toxicity.Term("scum", False, 2.0)])
    plain = toxicity.text_features("scum " + "word " * 300, matcher)
    for size in (10, 300, 1000, 20_000):
        quoted = toxicity.text_features(f'he said "{"word " * size}scum" today', matcher)
        assert quoted[3] > 0 and quoted[0] < plain[0]
    assert toxicity.quotations('a "b" c “d „e” f” «g» ‹h "i') == [(2, 5), (8, 14), (18, 21)]
    assert toxicity.quotations('"' * 100_001)[:2] == [(0, 2), (2, 4)] and toxicity.quotations("„" * 100_000 + "”") == [(0, 100_001)]


def brute_score(text, terms):
    """Weights of exact words only, for terms that allow no edits."""
    text = text.lower()
    spans = toxicity.quotations(text)
    words = [(m.start(), m[0]) for m in re.finditer(r"[^\W_]+", text)]
    hits = [(k, at, terms[w]) for k, (at, w) in enumerate(words) if w in terms]
    total = quoted_weight = 0.0
    for k, at, weight in hits:
        near = sum(abs(k - other) <= toxicity.NEAR for other, _, _ in hits) - 1
        quoted = any(a <= at < b for a, b in spans)
        value = weight * (0.25 if quoted else 1.0) * (1 + 0.25 * min(near, 3))
        total, quoted_weight = total + value, quoted_weight + quoted * 1.0
    return total, quoted_weight, 100 * total / max(1, len(words))


def test_text_features_against_a_plain_scorer():
    terms = {"bad": 1.5, "vile": 2.0, "rot": 0.5}
    matcher = toxicity.Matcher([toxicity.Term(t, False, w) for t, w in terms.items()])
    draw = random.Random(1)
    for _ in range(200):
        text = " ".join(draw.choice(["bad", "vile", "rot", "fine", "word", '"', "«", "»", "x"]) for _ in range(draw.randrange(60)))
        total, quoted, share = brute_score(text, terms)
        features = toxicity.text_features(text, matcher)
        assert features[0] == pytest.approx(np.log1p(total)) and features[2] == pytest.approx(np.log1p(share))
        assert features[3] == pytest.approx(np.log1p(quoted)) and features[1] == 0


def test_page_text_keeps_whole_regions():
    text = lambda page: html_text.main_texts([page])[0][0]
    assert text('<div class="content has-sidebar"><p>main text here</p></div>') == "main text here"
    assert text('<article><div class="post no-comments">kept</div><section class="related-work">also</section></article>') == "kept\nalso"
    assert text("<main><h1>Title</h1><p>lead words</p><article>six words are here in it</article></main>") == "Title\nlead words\nsix words are here in it"
    assert text('<div class="comments">gone</div><div class="ad">gone</div><p>x') == "x"
    for page in ("<a " * 60_000, "<a '>" * 60_000, "<div>" * 60_000 + "x", "<b><div>" * 40_000, "<!-- " * 60_000, "<p>x<b>" * 40_000):
        html_text.blocks(page)  # in linear time


def test_repeats_beyond_the_broadcast_bound(spark):
    notice = " ".join(f"n{i}" for i in range(20))
    rows = [(k, "http://a.com/", f"<div>{' '.join(f'w{k}x{i}' for i in range(30))}</div><div>{notice} {k}</div>") for k in range(60)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    small = {r.page_id: (r.text, r.n_covered) for r in html_text.extract(frame).collect()}
    large = {r.page_id: (r.text, r.n_covered) for r in html_text.extract(frame, broadcast_rows=0).collect()}
    assert small == large and all(c == 20 for _, c in small.values())


def shuffled(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_anchors_of_pages_move_in_few_bytes(spark):
    draw = random.Random(5)
    rows = [(k, "http://a.com/", f"<div>{' '.join(f'w{draw.randrange(10**9)}' for _ in range(1000))}</div>") for k in range(400)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    before = shuffled(spark)
    assert all(r.n_tokens == 1000 and r.n_covered == 0 for r in html_text.extract(frame).collect())
    assert shuffled(spark) - before < 2.5 * 400 * 1000  # bytes a token; 6.5 with one row per anchor


def test_pages_of_one_short_checksum_differ(spark):
    notice = " ".join(f"n{i}" for i in range(20))
    own = " ".join(f"w{i}" for i in range(30))
    drawn = spark.range(300_000).select(F.format_string(f"<div>{own} %d</div><div>{notice}</div>", "id").alias("html"))
    one, two = drawn.groupBy(F.hash("html")).agg(F.sort_array(F.collect_list("html")).alias("all")).where("size(all) > 1").first()["all"][:2]
    frame = spark.createDataFrame([(0, "http://a.com/", one), (1, "http://a.com/", two)], "page_id long, url string, html string")
    assert [r.n_covered for r in html_text.extract(frame).collect()] == [50, 50]


def test_copies_of_pages_take_the_verdict_of_the_first(spark):
    notice = " ".join(f"n{i}" for i in range(20))
    page = lambda k: f"<div>{' '.join(f'w{k}x{i}' for i in range(30))}</div><div>{notice}</div>"
    rows = [(k, "http://a.com/", page(k % 3)) for k in range(60)] + [(k, f"http://b{k}.com/", page(0)) for k in (60, 61)]
    rows += [(k, "http://c.com/", page(9)) for k in (62, 63)] + [(64, "http://d.com/", None), (65, "http://d.com/", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    for bound in (1000, 0):
        found = {r.page_id: r for r in html_text.extract(frame, broadcast_rows=bound).collect()}
        assert len(found) == 66 and all(found[k].n_covered == 20 and notice not in found[k].text for k in range(60))
        assert all(found[k].n_covered == 0 and found[k].text.endswith(notice) for k in (60, 61, 62, 63))
        assert found[64].text == found[65].text == ""


def test_a_full_bitmap_and_small_packs_change_no_repeat(spark, monkeypatch):
    draw = random.Random(4)
    texts = [" ".join(draw.choice("abcdef") for _ in range(draw.randrange(90))) for _ in range(120)]
    frame = spark.createDataFrame([(k, "a.com", text) for k, text in enumerate(texts)], "row long, host string, texts string").repartition(3)
    expected = {k: flags for k, flags in enumerate(html_text.covered_tokens([t.split(" ") if t else [] for t in texts]))}
    for held, width in ((2_000_000, 30), (50, 15)):
        monkeypatch.setattr(html_text, "HELD_CODES", held)
        monkeypatch.setattr(html_text, "HELD_RUNS", held)
        found = {r.row: r.starts for r in html_text.covered_starts(frame, most_width=width).collect()}
        for k, flags in expected.items():
            covered = np.zeros(len(flags), bool)
            for start in found.get(k, []):
                covered[start : start + html_text.LONG] = True
            assert (covered == flags).all()
    many = np.random.default_rng(2).integers(0, 2**html_text.CODE_BITS, 30_000)
    anchors = spark.createDataFrame([(int(a),) for a in many[:20_000]], "anchor long")
    for width in (15, 18, 30):
        bitmap = html_text._bitmap(anchors, width)
        held = html_text._held(bitmap, many)
        assert held[:20_000].all() and (width < 30 or held[20_000:].mean() < 0.01)


def test_one_place_of_a_hot_run_per_batch_meets_the_others():
    runs = pd.DataFrame({"h": [5] * 1000 + [6, 6, 7], "g": [1] * 1003, "row": [*range(1000), 3, 3, 4], "at": [2] * 1000 + [0, 9, 1]})
    met = html_text._met([runs[:400], runs[400:]])
    assert sorted(zip(met["row"], met["at"], strict=True)) == sorted(zip(runs["row"], runs["at"], strict=True))
    assert met.groupby(["h", "g"]).size().max() == 2 and met["sure"].sum() == 1000  # a page's own repeat is not sure
    assert met[(met["h"] == 5) & (met["g"] == 1)]["sure"].all()
