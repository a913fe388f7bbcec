"""Vector codes, divergence and byte pairs, against brute force and the library."""

import base64
import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from vitrine.llm import bytepairs, divergence, queries, vectorcodes
from vitrine.session import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "b", "'", "s", "'ll", "'re", "'v", " ", "  ", "\n", "\n\n", "\t", "1", "23", "!", "é", "中文", "é", " ", " The", "ing", "<|endoftext|>", "ſ", "　", "🙂", "---", "İ", "ΑΣ", "K", "\x1c", "\x85", "x" * 40]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library(library):
    own = bytepairs.Encoder(RANKS)
    random.seed(5)
    rows = ["".join(random.choice(PARTS) for _ in range(random.randint(0, 30))) for _ in range(2000)]
    ids, first = own.encode(rows)
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [library.encode_ordinary(r) for r in rows]
    data, ends = own.decode(ids.astype(np.int64))
    assert data.tobytes().decode() == "".join(rows) and len(ends) == len(ids)


def test_trees_of_both_kinds_agree(library):
    file = bytepairs.RankFile(RANKS)
    random.seed(6)
    for n in (2, 3, 31, 32, 33, 127, 128):
        data = [bytes(random.choice(b"abcdeinglrstt") for _ in range(n)) for _ in range(20)] + [b"a" * n, bytes(random.randrange(256) for _ in range(n))]
        size = 1 << (n - 1).bit_length()
        short, long = bytepairs.merge_short(file, data, size), [bytepairs.merge_long(file, d) for d in data]
        assert short == long
    text = "".join(random.choice("abcdeinglrstt") for _ in range(20_000))
    assert bytepairs.merge_long(file, text.encode()) == library.encode_ordinary(text)
    assert bytepairs.merge_long(file, b"a" * 5000) == library.encode_ordinary("a" * 5000)


def test_windows(library, monkeypatch):
    text = "ab  c d\x1c e \n\n f'll g's 　h \x85 i" * 40
    own = bytepairs.Encoder(RANKS)
    for most in (1, 5, 7, 64):
        parts = list(bytepairs.windows(text, most))
        assert "".join(parts) == text and len(parts) > 3
        assert [i for p in parts for i in own.encode([p])[0].tolist()] == library.encode_ordinary(text)


def test_bytepairs_query(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    rows = queries.op13_bytepairs(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bytepairs_edges(spark, odd_docs, no_docs):
    rows = bytepairs.decoded(bytepairs.encoded(odd_docs, RANKS), RANKS)
    got = Counter((r.doc_id, bytes(r.decoded).decode()) for r in rows.collect())
    assert got == Counter((r.doc_id, r.text or "") for r in odd_docs.collect())
    assert all(len(r.ids) == 4 * r.n_tokens for r in rows.collect())
    assert bytepairs.decoded(bytepairs.encoded(no_docs, RANKS), RANKS).count() == 0
    assert [bytes(r.decoded) for r in bytepairs.decoded(spark.createDataFrame([(None,)], "ids binary"), RANKS).collect()] == [b""]
    with pytest.raises(ValueError):
        bytepairs.decoded(rows, RANKS)


def codes(rows, parts, entries, rounds):
    """The contract in plain Python; rows of one length."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda x, p: x[p * width : (p + 1) * width]
    books = [[cut(x, p) for _, x, _ in kept[:entries]] for p in range(parts)]
    near = lambda x, b: min((sum((a - c) ** 2 for a, c in zip(x, e)), k) for k, e in enumerate(b))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, x, _ in kept:
                own[near(cut(x, p), books[p])[1]].append(cut(x, p))
            for k, xs in own.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    found, total = [], Counter()
    for i, x, label in kept:
        best = [near(cut(x, p), books[p]) for p in range(parts)]
        found.append((i, bytes(k for _, k in best), sum(e for e, _ in best), label))
        total[label] += found[-1][2]
    return Counter((i, c, e, total[label]) for i, c, e, label in found), [[list(e) for e in b] for b in books]


def compare(frame, parts, entries, rounds):
    got, books = vectorcodes.compressed(frame, parts, entries, rounds)
    want, want_books = codes([(r.vec_id, r.embedding, r.label) for r in frame.collect()], parts, entries, rounds)
    assert Counter((r.vec_id, bytes(r.code), r.error, r.label_error) for r in got.collect()) == want
    assert [b.tolist() for b in books] == want_books


def test_codes_of_the_table(spark, sf):
    compare(table(spark, sf, "embeddings"), 16, 64, 2)


def test_codes_of_small_blocks_and_shared_parts(spark, monkeypatch):
    """Many vectors of one part, repeated rows and ids, null ids and labels, several blocks a task."""
    monkeypatch.setattr(vectorcodes, "BLOCK_VALUES", 40)
    random.seed(7)
    rows = [(random.choice([None, *range(60)]), [1.5, -0.25] + [random.choice([-1.0, 0.1, 2.0, -0.3]) for _ in range(2)], random.choice([None, 1, 2])) for _ in range(300)]
    rows += [(1, None, 1), (2, [1.0, None, 0.0, 0.0], 1), (3, [float("nan"), 0.0, 0.0, 0.0], 1), (4, [float("-inf"), 0.0, 0.0, 0.0], 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'c' AS code", "1 AS block", "2 AS error")
    compare(frame.repartition(3), 2, 7, 3)
    compare(frame, 4, 256, 1)


def test_codes_of_large_components(spark):
    """Squares beyond 2**53 are exact; what no long holds is the largest long."""
    rows = [(k, [float(2**k), -float(3**k % 100003), float(k % 5), 1e6 + k], k % 3) for k in range(22)]
    compare(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 2, 5, 2)
    huge = spark.createDataFrame([(0, [0.0, 0.0], 0), (1, [3e38, -3e38], 0)], "vec_id long, embedding array<float>, label int")
    found = {r.vec_id: (r.error, r.label_error) for r in vectorcodes.compressed(huge, 2, 1, 0)[0].collect()}
    assert found == {0: (0, 2**63 - 1), 1: (2**63 - 1, 2**63 - 1)}


def test_codes_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    none = spark.createDataFrame([], schema)
    got, books = vectorcodes.compressed(none)
    assert got.count() == 0 and books == []
    assert vectorcodes.compressed(spark.createDataFrame([(1, None, 1)], schema))[0].count() == 0
    odd = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1), (2, [1.0, 2.0], 1), (3, [1.0, 2.0, 4.0], 1), (4, [], 2)], schema)
    found = {r.vec_id: (r.code, r.error) for r in vectorcodes.compressed(odd, 2, 1, 0)[0].collect()}
    assert found == {1: (b"\0\0", 0), 3: (b"\0\0", 256**2), 2: (None, None), 4: (None, None)}
    empty = vectorcodes.compressed(spark.createDataFrame([(1, [], 1), (2, [], 1)], schema), 2)[0]
    assert [(bytes(r.code), r.error) for r in empty.collect()] == [(b"\0\0", 0)] * 2
    with pytest.raises(ValueError):
        vectorcodes.compressed(none, entries=257)


def audit(rows, min_docs, top):
    """The contract in plain Python."""
    import re

    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    found = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        share = lambda n, total: 1 + 10**9 * (n + 5) // (total + 5 * len(kept))  # noqa: B023, E731
        p = {s: [counts[lang, s][t] for t in kept] for s in sources}
        q = [sum(x) for x in zip(*p.values())]
        q = [share(n, sum(q)) for n in q]
        p = {s: [share(n, sum(x)) for n in x] for s, x in p.items()}
        for s in sources:
            pair = sorted(((-sum(abs(a - b) for a, b in zip(p[s], p[o])), o.encode()) for o in sources if o != s))
            found += [(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(pair)]
            term = sorted((b - a, t.encode()) for t, a, b in zip(kept, p[s], q) if counts[lang, s][t] and a > b)[:top]
            found += [(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(term)]
    return sorted(found)


def test_divergence_of_many_sources(spark, monkeypatch):
    """Heavy and light terms, several slabs and buckets, sources without terms, a hot one, non-ASCII terms."""
    for name, value in (("SLAB", 7), ("BUCKET", 60), ("PAIRS", 5)):
        monkeypatch.setattr(divergence, name, value)
    random.seed(8)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)] + ["Éa", "éa", "THE", "the", "中文"]
    rows = []
    for _ in range(700):
        s = min(random.randrange(33), 30)
        own = words[3 * s : 3 * s + 9] + ["The"] * 3 + words[-5:] + random.sample(words, 2)
        rows.append((" ".join(random.choice(own) for _ in range(random.randint(0, 12))), "en", f"s{s}"))
    rows += [(None, "en", "s0"), ("", "en", None), ("only here", "de", "s1"), (None, None, None), ("12 !?", "de", "ä"), ("x", "de", "z")]
    frame = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS term", "2 AS n", "3 AS place")
    assert sorted(map(tuple, divergence.audited(frame.repartition(3), 5, 4).collect())) == audit(rows, 5, 4)


def test_divergence_edges(odd_docs, no_docs):
    given = [(r.text, r.lang, r.source) for r in odd_docs.collect()]
    for least in (1, 2, 100):
        assert sorted(map(tuple, divergence.audited(odd_docs, least).collect())) == audit(given, least, 50)
    assert divergence.audited(no_docs).count() == 0
