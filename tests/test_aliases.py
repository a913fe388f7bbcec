"""Alias spans against plain searching, and the fuzzy join against the ratio of all pairs."""

import random
import re
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from vitrine.operators import fuzzy, spans
from vitrine.plans import QUERIES


def plain(text, alias):
    """Occurrences from the left that do not overlap; ASCII ones at word edges."""
    text, alias = (text or "").lower(), alias.strip().lower()
    found = [(m.start(), m.end()) for m in re.finditer(re.escape(alias), text)]
    edge = lambda i: not (0 <= i < len(text) and re.match("[a-z0-9]", text[i]))
    return [(a, b) for a, b in found if not alias.isascii() or (edge(a - 1) and edge(b))]


def brute(texts, table):
    rows = Counter()
    for key, text in texts:
        for target in {t for t, _, _ in table if t is not None}:
            own = {(a.strip().lower(), bool(x)) for t, a, x in table if t == target and a and a.strip()}
            covers = [s for a, x in own if x for s in plain(text, a)]
            for alias in {a for a, x in own if not x}:
                hits = plain(text, alias)
                if hits:
                    free = sum(not any(a < d and c < b for c, d in covers) for a, b in hits)
                    rows[key, target, alias, ",".join(f"{a}-{b}" for a, b in hits), len(hits), free] += 1
    return rows


def test_spans_equal_plain_searching(spark):
    random.seed(21)
    pieces = ["ring", "rin", "g", "spring", "old ring", " ", "  ", "环", "金环", "环环", "ab", "aba", "ba", "-", "RING", "9", "old"]
    texts = [(k, "".join(random.choices(pieces, k=random.randint(0, 12)))) for k in range(400)] + [(1, None), (1, ""), (None, "old ring"), (None, "old ring")]
    table = [("a", "ring", False), ("a", "old ring", True), ("a", "spring ", None), ("b", "aba", False), ("b", "ba", False), ("b", "ab", True), ("c", "环", False), ("c", "金环", True), ("c", "环环", False), ("d", "ring", False), ("d", "ring", False), ("d", "ring", True), ("e", " ", False), ("e", None, False), (None, "ring", False)]
    frame = spark.createDataFrame(texts, "key long, body string").selectExpr("key AS target", "body AS alias", "1 AS n")
    aliases = spark.createDataFrame(table, "target string, alias string, excludes boolean")
    want = brute(texts, table)
    for at_once in (spans.TABLE_BYTES, 150):
        assert Counter(map(tuple, spans.found(frame, "target", "alias", aliases, at_once).collect())) == want
    assert spans.found(frame.limit(0), "target", "alias", aliases).count() == 0
    assert spans.found(frame, "target", "alias", aliases.limit(0)).count() == 0


def test_many_aliases_are_one_pass(spark):
    texts = spark.range(50).select("id", F.concat(F.lit("name"), F.col("id") * 77, F.lit(" of goods")).alias("t"))
    few, many = (spark.range(n).select(F.col("id").cast("string").alias("target"), F.concat(F.lit("name"), "id").alias("alias")) for n in (100, 10_000))
    plans = [spans.found(texts, "id", "t", a)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") for a in (few, many)]
    assert plans[0] == plans[1] == 1
    assert spans.found(texts, "id", "t", many).count() == 50


@pytest.fixture(scope="module")
def names():
    random.seed(22)
    base = ["".join(random.choices("abcde", k=random.randint(1, 40))) for _ in range(120)] + ["Acme Tools", "acme-tools", "ACME", "环球", "a b"]
    changed = []
    for name in base * 4:
        x = list(name)
        for _ in range(random.randint(0, 3)):
            i = random.randrange(len(x) + 1)
            if random.random() < 0.5:
                x.insert(i, random.choice("abcde"))
            elif i < len(x):
                del x[i]
        changed.append("".join(x))
    return base, changed


@pytest.mark.parametrize("least", [0.92, 0.8])
def test_fuzzy_equals_all_pairs(spark, names, least):
    base, changed = names
    tight = lambda s: re.sub(r"[\s\-_.·]+", "", s.lower())
    table = {}
    for a in base:
        table[tight(a)] = min(a, table.get(tight(a), a))
    want = {}
    for v in set(changed):
        x, best = tight(v), None
        for a in sorted(table):
            ratio = 1.0 if x == a else SequenceMatcher(None, x, a).ratio() if min(len(x), len(a)) >= 4 and x.isascii() and a.isascii() else 0
            if x and ratio >= least and (best is None or ratio > best[0]):
                best = (ratio, a)
        if best:
            want[v] = (table[best[1]], best[1], round(best[0], 6))
    values = spark.createDataFrame([(v, 1) for v in changed] + [(None, 1), ("", 1)], "alias string, ratio int")
    aliases = spark.createDataFrame([(a, a) for a in base] + [(None, "x"), ("acme", None), ("", "e")], "alias string, target string")
    got = {r.value: (r.target, r.alias, r.ratio) for r in fuzzy.resolved(values, "alias", aliases, least).collect()}
    assert got == want
    assert fuzzy.resolved(values.limit(0), "alias", aliases, least).count() == 0


def test_fuzzy_query(spark, sf):
    import duckdb

    names = [r[0] for r in duckdb.sql(f"SELECT DISTINCT p_name FROM '{sf}/part.parquet'").fetchall()]
    tight = {re.sub(r"[\s\-_.·]+", "", n.lower()): n for n in sorted(names, reverse=True)}
    got = {r.value: r for r in QUERIES["fuzzy_names"](spark, sf).collect()}
    assert len(got) > 50
    values = {}
    for key, n in duckdb.sql(f"SELECT p_partkey, p_name FROM '{sf}/part.parquet'").fetchall():
        values[[n[:4] + n[5:], n[:3] + n[2:], n.upper(), n[::-1]][key % 4]] = 1
    for v in values:
        x = re.sub(r"[\s\-_.·]+", "", v.lower())
        ratio, alias = max(((1.0 if x == a else SequenceMatcher(None, x, a).ratio()), [-ord(c) for c in a], a) for a in tight)[::2]
        assert (v in got) == (ratio >= 0.92), v
        if v in got:
            assert got[v].ratio == round(ratio, 6)
