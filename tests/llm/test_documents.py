"""Near duplicates, leaks, fingerprints and tokens against brute force."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from citeloom.llm import bpe, decontamination, fingerprints, near_duplicates

WORDS = [f"w{i}" for i in range(400)]


def shingles(text, width):
    words = (text or "").encode().lower().split()
    n = min(width, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, width))
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def corpus(seed):
    draw = random.Random(seed)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "a b c"), (6, "A  b\tc"), (7, "a b c d"), (8, "a\u00a0b c"), (8, "a\u00a0b c")]
    template = [draw.choice(WORDS) for _ in range(60)]
    for i in range(10, 60):  # share a passage, but not enough of it
        rows.append((i, " ".join(template + [draw.choice(WORDS) for _ in range(35)])))
    base = [draw.choice(WORDS) for _ in range(80)]
    for i in range(60, 130):  # a chain: each differs a little from the one before
        base = list(base)
        base[draw.randrange(80)] = draw.choice(WORDS)
        rows.append((i, " ".join(base)))
    same = " ".join(draw.choice(WORDS) for _ in range(50))
    rows += [(i, same if i % 2 else same.upper()) for i in range(130, 160)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"small_bucket": 1, "star_rounds": 1, "block": 7}])
def test_near_duplicates(spark, options):
    rows = corpus(11)
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, comp string, key int")
    expected = brute_components(rows, 4, 80)
    found = near_duplicates.near_duplicates(frame, width=4, percent=80, **options).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: r.component_id for r in found} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    sizes = {i: len(shingles(t, 4)) for i, t in rows}
    assert all(r.n_shingles == sizes[r.doc_id] for r in found)


def test_near_duplicates_of_little(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates.near_duplicates(empty).collect() == []
    odd = spark.createDataFrame([(None, "a b"), (2, "a b"), (2, "a b"), (3, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.kept) for r in near_duplicates.near_duplicates(odd).collect()) == [("2", True), ("2", True), ("3", True), ("None", True)]
    kept = near_duplicates.deduplicated(odd.selectExpr("doc_id", "text", "1 as kept"))
    assert kept.columns == ["doc_id", "text", "kept"] and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3", "None"]


def brute_leaks(documents, items, least=0.8):
    import regex

    words = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    sets = {}
    for i, t in documents:
        sets.setdefault(i, set()).update(grams(words(t)))
    return {(d, i) for i, t in items if (g := grams(words(t))) for d, s in sets.items() if len(g & s) >= least * len(g)}


def test_leaks(spark):
    draw = random.Random(2)
    items = [(k, " ".join(draw.choice(WORDS) for _ in range(n))) for k, n in enumerate([4, 5, 6, 9, 14, 20, 33, 60, 90])] + [(50, None)]
    items.append((51, items[6][1].upper() + "!"))
    documents = [(0, None), (1, ""), (2, "w1 w2")]
    for d in range(3, 60):
        text = [draw.choice(WORDS) for _ in range(draw.choice([3, 40, 700]))]
        for _ in range(d % 3):
            words = list(draw.choice(items[:9])[1].split())
            for _ in range(draw.choice([0, 0, 1, 4])):
                words[draw.randrange(len(words))] = "changed"
            at = draw.randrange(len(text))
            text[at:at] = words
        documents.append((d, ", ".join(text)))
    documents.append((3, documents[5][1]))
    docs = spark.createDataFrame([(*d, 9) for d in documents], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = brute_leaks(documents, items)
    assert len(expected) > 8
    for bound in (1000, 0):
        assert {(r.doc_id, r.item_id) for r in decontamination.contained_items(docs.drop("item_id"), bench, broadcast_rows=bound).collect()} == expected
    kept = decontamination.clean_documents(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in documents} - {d for d, _ in expected}
    assert decontamination.clean_documents(docs, bench.limit(0)).count() == len(documents)
    assert decontamination.contained_items(docs.limit(0), bench).collect() == []


def test_leaks_without_ids(spark):
    passages = [" ".join(f"{name}{i}" for i in range(30)) for name in ("one", "two", "six")]
    rest = " ".join(f"rest{i}" for i in range(50))
    bench = spark.createDataFrame([(None, passages[0]), (None, passages[1]), (7, passages[2])], "item_id long, text string")
    rows = [(1, f"{rest} {passages[0]}"), (2, f"{passages[1]} {rest}"), (3, rest), (None, f"x {rest} {passages[2]}"), (None, f"y {rest} {passages[0]}"), (None, f"z {rest}")]
    many = [(None, " ".join(f"n{k}x{i}" for i in range(60))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in decontamination.clean_documents(docs, bench).collect()} == {rows[2], rows[5]}
    # As in OP1_SQL: rows without an id are one document, and items without an id have no row.
    docs = docs.unionByName(spark.createDataFrame(many, docs.schema))
    assert [(r.doc_id, r.item_id, r.n_shared) for r in decontamination.contained_items(docs, bench).collect()] == [(None, 7, 26)]


def edited(texts):
    for at, text in enumerate(texts):
        cut = len(text) // 3
        yield text[: len(text) - cut] + texts[(at + 1) % len(texts)][:cut]


def test_fingerprints(spark):
    draw = random.Random(9)
    texts = {i: "".join(draw.choice("abcé😀 ") for _ in range(draw.choice([0, 1, 5, 30, 3000]))) for i in range(-20, 40)} | {99: "", 98: "same" * 40, 97: "same" * 40}
    given = [(i, t or None, "x") for i, t in texts.items()]
    draw.shuffle(given)
    order = sorted(texts, reverse=True)
    expected = dict(zip(order, edited([texts[i] for i in order]), strict=True))
    found = {r.doc_id: r for r in fingerprints.edited_fingerprints(spark.createDataFrame(given, "doc_id long, text string, part string")).collect()}
    assert set(found) == set(texts)
    for i, r in found.items():
        assert r.n_chars == len(texts[i]) and r.edited_sha256 == hashlib.sha256(expected[i].encode()).hexdigest()
        assert r.edited_fingerprint == fingerprints.Document(expected[i]).name
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prefix = next((k for k, (a, b) in enumerate(zip(texts[i], expected[i])) if a != b), min(len(texts[i]), len(expected[i])))
        assert r.kept_prefix == prefix
    assert found[98].fingerprint == found[97].fingerprint and found[98].near_next == 1.0
    one = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert fingerprints.edited_fingerprints(one).first().edited_sha256 == hashlib.sha256(b"aba").hexdigest()
    assert fingerprints.edited_fingerprints(one.limit(0)).collect() == []


def test_spans():
    a, b = fingerprints.Hashed("xxabcabcabcyy"), fingerprints.Hashed("abcabcz")
    assert a.span(2, 6) == b.span(0, 6) and a.span(2, 3) == a.span(5, 3) != a.span(3, 3)
    assert a.common_extension(b, 2, 0) == 6 and a.common_extension(b, 0, 0) == 0


@pytest.fixture(scope="module")
def vocabulary():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = bpe.parse_ranks(file.read())
    return path, ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(seed):
    draw = random.Random(seed)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "é", "ß", "漢字", "😀", "1", "23", "...", "##", "aaaa", "ción", "لا", "\u0301", "'s", "\u00a0", "<|endoftext|>"]
    return [None, "", " ", "\n\n", "x" * 5000, " " * 3000] + ["".join(draw.choice(parts) for _ in range(draw.randint(1, 60))) for _ in range(400)]


def test_tokens(spark, vocabulary):
    path, _, reference = vocabulary
    texts = odd_texts(1)
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    decoded = bpe.decode_ids(bpe.encode_texts(frame, path, public_tokenizers.PATTERN), path)
    both = bpe.encode_texts(frame, path, public_tokenizers.PATTERN, decoded="decoded")
    for r in [*decoded.collect(), *both.collect()]:
        assert list(r.ids) == reference.encode_ordinary(texts[r.doc_id] or "") and r.decoded == (texts[r.doc_id] or "")
    assert bpe.token_digests(frame.limit(0), path, public_tokenizers.PATTERN).collect() == []


def test_tables_may_be_full(vocabulary, monkeypatch):
    _, ranks, reference = vocabulary
    for name in ("STATES", "PIECES", "STEPS"):
        monkeypatch.setattr(bpe, name, 3)
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    decoder = bpe.Decoder(encoder.tokens)
    for text in odd_texts(2)[1:]:
        ids = encoder.encode(text).tolist()
        assert ids == reference.encode_ordinary(text) and decoder.decode(ids) == text


def test_ill_formed_bytes(vocabulary):
    _, ranks, _ = vocabulary
    decoder, draw = bpe.Decoder({rank: token for token, rank in ranks.items()}), random.Random(4)
    single = {token[0]: rank for token, rank in ranks.items() if len(token) == 1}
    for _ in range(2000):
        data = bytes(draw.choice([draw.randrange(256), draw.choice(b"\xe2\x82\xac\xf0\x9f\x98\x80\xed\xa0a")]) for _ in range(draw.randint(0, 9)))
        assert decoder.decode([single[b] for b in data]) == data.decode(errors="replace")
