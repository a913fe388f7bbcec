"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns: defined results."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from vitrine.llm import chat, classifier, decontaminate, minhash, packing, rules, sharding, suffixes, tokens, warc

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def test_packing(odd_docs, no_docs):
    rows = packing.packed(odd_docs, WORD).collect()
    assert sum(r.doc_id is None for r in rows) >= 2
    whole = {}
    for r in rows:
        whole.setdefault((r.doc_id, r.doc_tokens), 0)
        whole[r.doc_id, r.doc_tokens] += r.length
        assert len(r.tokens) == 4 * r.length
    assert whole[3, 1] == 1 and whole[4, 1] == 1 and whole[5, 1] == 1
    assert whole[1, 11] == 22 and whole[None, 11] == 11
    by_sequence = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert by_sequence.setdefault(r.sequence_id, 0) == r.offset
        by_sequence[r.sequence_id] += r.length
    assert all(n == 4096 or n & (n - 1) == 0 for n in by_sequence.values())
    assert packing.packed(no_docs, WORD).count() == 0


def test_tokens(odd_docs, no_docs):
    rows = tokens.token_counts(odd_docs, BYTE, prefixes=True).collect()
    assert len(rows) == 12
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {0}
    assert all(r.over_limit == (r.doc_id in (6, 7)) for r in rows)
    assert tokens.token_counts(no_docs, BYTE).count() == 0


def test_rules(odd_docs, no_docs, odd_labels):
    model = rules.trained(odd_docs, odd_labels)
    rows = rules.judged(odd_docs, model).collect()
    assert len(rows) == 12
    for r in rows:
        if r.doc_id in (3, 4, 5):
            assert (r.n_words, r.word_chars, r.base_failed, r.kept) == (0, 0, True, False)
    assert not rules.trained(no_docs, odd_labels).roots
    assert rules.judged(no_docs, rules.Trees()).count() == 0
    assert {r.kept for r in rules.judged(odd_docs, rules.Trees()).where("doc_id = 6").collect()} == {True}


def test_classifier(odd_docs, no_docs, odd_labels):
    model = classifier.trained(odd_docs, odd_labels, eligible=None)
    rows = classifier.scored(odd_docs, model).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1
    nothing = classifier.trained(no_docs, odd_labels)
    assert classifier.scored(no_docs, nothing).count() == 0
    assert {r.predicted for r in classifier.scored(odd_docs, nothing).collect()} == {1}
    kept = classifier.filtered(odd_docs, nothing)
    assert kept.columns == odd_docs.columns and kept.count() == 12


def test_near_duplicates(odd_docs, no_docs):
    found = sorted((r.doc_id, r.class_id) for r in minhash.classes(odd_docs).collect() if r.doc_id is not None)
    assert found == [(1, 1), (1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 6), (8, 8), (9, 9)]
    assert [r.class_id for r in minhash.classes(odd_docs).collect() if r.doc_id is None] == [None, None]
    kept = minhash.first_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 4, 5, 6, 8, 9, None, None]
    assert minhash.classes(no_docs).count() == 0
    assert minhash.first_of_each(no_docs).count() == 0


def test_repeats(odd_docs, no_docs):
    rows = {r.doc_id: r for r in suffixes.repeats(odd_docs).collect()}
    assert set(rows) == {6, 7}
    assert rows[6].cut == [] and [tuple(s) for s in rows[7].cut] == [(0, 20000)]
    left = suffixes.without_repeats(odd_docs)
    assert left.columns == odd_docs.columns and left.count() == 12
    assert [(r.text, r.n_chars) for r in left.where("doc_id = 7").collect()] == [("tail", 4)]
    assert suffixes.repeats(no_docs).count() == 0 and suffixes.without_repeats(no_docs).count() == 0
    small = {r.doc_id for r in suffixes.repeats(odd_docs, min_words=8, core=4).collect()}
    assert small == {None, 1, 2, 6, 7}


def test_contaminated(spark, odd_docs, no_docs):
    items = spark.createDataFrame(
        [(1, "ONE two three four five six seven eight nine ten"), (1, "ONE two three four five six seven eight nine ten"), (2, None), (3, ""), (4, "hi"), (None, "six seven eight nine ten"), (5, "absent words")],
        "item_id long, text string",
    )
    found = sorted(((r.doc_id, r.item_id, r.start_word) for r in decontaminate.contaminated(odd_docs, items).collect()), key=str)
    assert found == sorted([(d, 1, 0) for d in (1, 1, 2, None)] + [(d, None, 5) for d in (1, 1, 2, None)] + [(8, 4, 0), (9, 4, 2)], key=str)
    kept = decontaminate.cleaned(odd_docs, items)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 4, 5, 6, 7, None]
    assert decontaminate.contaminated(no_docs, items).count() == 0
    assert decontaminate.contaminated(odd_docs, items.limit(0)).count() == 0
    assert decontaminate.cleaned(odd_docs, items.limit(0)).count() == 12


def test_shards(spark, odd_docs, no_docs):
    rows = sharding.read_shards(spark, sharding.write_shards(spark, odd_docs, shards=3, bucket_bytes=64)).collect()
    assert len(rows) == 12
    for s in range(3):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert sharding.read_shards(spark, sharding.write_shards(spark, no_docs)).count() == 0


def test_shards_of_equal_rows(spark, monkeypatch):
    """Rows of one id and text are dealt to many buckets by their number, and so in any order of the input."""
    monkeypatch.setattr(sharding, "EQUAL_ROWS", 20)
    rows = [(7, "again and again", "k")] * 300 + [(None, None, "k")] * 50 + [(d, f"text {d}", "k") for d in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    dealt = [
        sorted((r.shard, r.bucket, r.doc_id or -1, r.text or "", r.kind) for r in sharding.shuffled(f, shards=2, bucket_bytes=256, keep=("kind",)).collect())
        for f in (frame, frame.orderBy("doc_id").repartition(5))
    ]
    assert dealt[0] == dealt[1] and len(dealt[0]) == 450
    assert len({b for _, b, d, _, _ in dealt[0] if d == 7}) > 4
    found = sharding.read_shards(spark, sharding.write_shards(spark, frame, shards=2, bucket_bytes=256)).collect()
    for s in range(2):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))


def test_shards_are_dealt_alike_under_any_layout(spark):
    """Shard, bucket and place of every record hang on contents alone: not on the input's order, its partitions or the shuffle's."""
    rows = [(d % 400, "word " * (d % 37), f"k{d}") for d in range(1200)] + [(None, None, "n"), (None, "", "n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for parts, given in (("8", frame), ("5", frame), ("8", frame.repartition(7)), ("3", frame.orderBy(F.desc("kind")))):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            own = sharding.shuffled(given, shards=3, bucket_bytes=8192, keep=("kind",))
            found.append(sorted((r.shard, r.bucket, r.place, r.kind) for r in own.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found[0]) == 1202 and all(f == found[0] for f in found[1:])


def test_equal_long_records_are_numbered_by_their_bytes(spark):
    """Few equal records of many bytes do not meet in one bucket either."""
    frame = spark.createDataFrame([(1, "x" * 3000)] * 40 + [(d, "y") for d in range(50)], "doc_id long, text string")
    own = sharding.shuffled(frame, shards=2, bucket_bytes=8192).where("doc_id = 1 AND text <> 'y'").collect()
    assert len(own) == 40 and len({r.bucket for r in own}) > 4


def test_fisher_yates_is_uniform_and_whole(spark):
    """Every permutation of three is drawn about as often as another; of n all places come once."""
    own = spark.range(6000).select(sharding.fisher_yates(F.lit(3), 5, F.col("id")).alias("p"))
    counts = [r["count"] for r in own.groupBy("p").count().collect()]
    assert len(counts) == 6 and all(850 < c < 1150 for c in counts)
    sizes = spark.range(60).select("id", sharding.fisher_yates(F.col("id").cast("int"), 5, F.col("id")).alias("p")).collect()
    assert all(sorted(r.p) == list(range(r.id)) for r in sizes)


def test_chat(spark):
    rows = [(1, 0, "user", "[INST] a [/INST]</s>"), (1, 1, "assistant", None), (1, 1, None, "x<~/s>"), (2, None, "to[/ROLE]ol", "t"), (2, 0, "system", ""), (None, 0, "user", "q"), (3, 0, None, None), (3, 0, None, None)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'c' AS formatted", "1 AS turns")
    found = {r.conv_id: r for r in chat.format_conversations(given).collect()}
    assert [tuple(t) for t in found[1].turns] == [("user", "[INST] a [/INST]</s>"), ("", "x<~/s>"), ("assistant", "")]
    assert [tuple(t) for t in found[2].turns] == [("to[/ROLE]ol", "t"), ("system", "")]
    assert found[1].escaped and found[2].escaped and not found[None].escaped
    assert len(found[3].turns) == 2
    assert found[1].formatted == "[INST] [~INST] a [~/INST]<~/s> [/INST][ROLE][/ROLE][TEXT]x<~~/s>[/TEXT]<s></s>"
    nameless = spark.createDataFrame([(None, 0, "user", f"q{k % 3}") for k in range(30)], given.select("conv_id", "turn", "role", "text").schema)
    assert [len(r.turns) for r in chat.format_conversations(nameless).collect()] == [1] * 30
    long = spark.createDataFrame([(1, 0, "user", "x [INST] y " * 200_000), (1, 1, "assistant", "</s>" * 100_000)], nameless.schema)
    row = chat.format_conversations(long).first()
    assert [len(t.text) for t in row.turns] == [2_200_000, 400_000] and row.escaped
    assert chat.format_conversations(given.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    rows = [(1, "u", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (None, "u", "same"), (2, None, "same"), (5, "u\r\nWARC-Type: x", "é\r\n\r\nWARC/1.1 " * 9000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'d' AS digest", "7 AS response_id")
    folder = f"file://{tmp_path}/w"
    archives = warc.write_archives(pages, folder)
    found = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(spark, folder, archives).collect()), key=str)
    big = len(("é\r\n\r\nWARC/1.1 " * 9000).encode())
    assert found == sorted(
        [(1, "revisit", 2, 4), (2, "response", None, 4), (2, "response", None, 4), (3, "revisit", 4, 0), (4, "response", None, 0), (None, "revisit", 2, 4), (5, "response", None, big)], key=str
    )
    whole = {(r.page_id, r.member_start, r.file) for r in warc.read_archives(spark, folder, archives, split_bytes=1 << 30).collect()}
    for split in (7, 64, 1000):
        assert {(r.page_id, r.member_start, r.file) for r in warc.read_archives(spark, folder, archives, split_bytes=split).collect()} == whole
    empty = warc.write_archives(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.read_archives(spark, f"file://{tmp_path}/e", empty).count() == 0


@pytest.mark.parametrize("column", ["text", "doc_id"])
def test_columns_of_other_types(odd_docs, column):
    cast = odd_docs.withColumn(column, odd_docs[column].cast("string" if column == "doc_id" else "string"))
    assert tokens.token_counts(cast, BYTE).count() == 12
