"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its five-word shingles. A shingle weighs how often it occurs
times its inverse document frequency, which is the mean over its words of 1 + ln((N + 1) / (df + 1)),
df being the number of documents with the word (of words in one of 2**IDF_BITS hashed places).
Frequencies are taken from words since a shingle's own would let a large group of copies lower
the weight of all it shares, and would need a table larger than the corpus.

Sampling: each occurrence of a shingle is an element of the shingle's weight, so the elements two
documents share weigh the sum of their minima. An element has a Poisson process of its own, at a
rate of its weight times BANDS * ROWS, and each point falls into one of as many places by its hash. The
first point of a document in a place is one consistent weighted sample of all its elements, and
those of different places are independent; points beyond the time by which all places have one are
not made. ROWS samples are the key of a band. Two documents agree in a sample with a probability of
their weighted Jaccard similarity s, so in some band with 1 - (1 - s**ROWS)**BANDS: 0.99994 at 0.8, 0.02 at 0.3.

Classes: documents with the same words are one content (128-bit hash), a node, grouped with partial
sums. Nodes that share a key are a bucket. First each node is compared to one other, the most
popular in its buckets (whose buckets are largest in all), by exact weighted Jaccard similarity of
the whole texts; links become classes, and buckets of one class are done. Of the others, those with
PER_MEMBER pairs of different classes a member or fewer have these compared, such as a few texts that just
miss a large class. Another has its lightest node h as its hub, and all its members are compared to the hub only. For members x and y, let G be the
shingles that weigh more in both than in h. All others give no more to shared(x, y), the sum of
minima, than to shared(x, h), so shared(x, y) <= shared(x, h) + the weight that x has in G beyond h;
and y likewise. As similarity(x, y) >= s needs shared(x, y) >= s / (1 + s) * (W(x) + W(y)), x needs

    beyond(x, G) >= missing(x) = s / (1 + s) * (W(x) + max(W(h), s * W(x))) - shared(x, h),

and where that is nothing, x is linked to h, since no member is lighter than h. So members are dealt to
new buckets by hub and shingle beyond it. Shingles that only one class has there count for nothing;
of the others, rare ones come first, and as many of the last as weigh less than what is missing are
left out. The new buckets are treated alike. A hub is lighter than all in its new buckets (of
equals, of a smaller hash), so this ends, and no link between a pair that shares a key is lost. The pairs
compared in a bucket are at most PER_MEMBER times its members (PER_MEMBER_LATER for those that have been dealt
on), or one a member, however many members it has. Links become classes by spreading the least id, in joins.

Words are lower-case runs of a-z, 0-9 and characters beyond ASCII. Defined cases: a text of
fewer than five words, but one, is one shingle; null and wordless texts are in classes of their
own; a row without an id has no class and is compared with none; repeated rows are copies; rows
of one id with different texts are one document, and their classes one class; an empty table gives
no row; other columns are ignored, or carried by ``first_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, texts, written
from .textkit import LOWER_WORD, U, Chunk, chunks, mix, row_of, run_hashes, shingles

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 6
IDF_BITS = 18
#: Where there are no more pairs of different classes for each member of a bucket, at first and when it has been dealt on, all are compared.
PER_MEMBER, PER_MEMBER_LATER = 4, 16
#: A document's elements are followed up to a time at which one in e**SPARE has a place without a point; these are followed on.
SPARE = 3.0
#: Elements whose points are made at once, and how many points each.
ELEMENTS = 1 << 18
_STEPS = [1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64]
_SKETCH = "doc_id long, c1 long, c2 long, weight double, keys array<long>"


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """For each hashed place how many documents have its words, and how many documents there are.

    Each task sums into one array and the driver gathers 2**IDF_BITS sums, whatever the input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(1 << IDF_BITS, np.int64), 0
        for chunk in chunks(batches, lower=True):
            starts, ends, first = chunk.runs(LOWER_WORD)
            place = (run_hashes(chunk.data, starts, ends) >> U(64 - IDF_BITS)).astype(np.int64)
            pairs = np.unique((row_of(first) << IDF_BITS) | place)
            total += np.bincount(pairs & ((1 << IDF_BITS) - 1), minlength=1 << IDF_BITS)
            rows += chunk.rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], rows))], names=["place", "n"])

    sums = docs.mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    place, n = sums.column("place").to_numpy(), sums.column("n").to_numpy()
    found = np.zeros(1 << IDF_BITS, np.int64)
    found[place[place >= 0]] = n[place >= 0]
    return found, int(n[place < 0].sum())


def inverse_frequencies(frequencies: np.ndarray, documents: int) -> np.ndarray:
    return (1 + np.log((documents + 1) / (frequencies + 1))).astype(np.float32)


def counted(chunk: Chunk, idf: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct shingles of each row: row, hash, weight of one, count, in order of row; then all words' hashes and each row's first."""
    starts, ends, first = chunk.runs(LOWER_WORD)
    words = run_hashes(chunk.data, starts, ends)
    values, at, rows = shingles(words, first, WORDS)
    own = np.zeros(len(words) + 1)
    np.cumsum(idf[(words >> U(64 - IDF_BITS)).astype(np.int64)], out=own[1:])
    end = np.minimum(at + WORDS, first[rows + 1])
    # Rounded, so that a shingle weighs the same wherever its words stand in a chunk.
    mean = np.round((own[end] - own[at]) / np.maximum(end - at, 1), 4)
    order = np.lexsort((values, rows))
    v, r, w = values[order], rows[order], mean[order]
    new = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (r[1:] != r[:-1]))) if len(v) else np.zeros(0, np.int64)
    return r[new], v[new], w[new], np.diff(np.append(new, len(v))), words, first


def weighted(chunk: Chunk, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row: row, hash, weight, in order of row; then all words' hashes and each row's first."""
    rows, values, weights, counts, words, first = counted(chunk, idf)
    return rows, values, weights * counts, words, first


def _first_points(place: np.ndarray, elements: np.ndarray, weights: np.ndarray, until: np.ndarray, drawn: np.ndarray, times: np.ndarray) -> None:
    """Make the points of elements up to a time each, and keep the first of each of BANDS * ROWS places, from ``place`` on."""
    many = BANDS * ROWS
    time, made, step = np.zeros(len(elements)), 0, 0
    while len(elements):
        size = _STEPS[min(step, len(_STEPS) - 1)]
        for low in range(0, len(elements), max(1, ELEMENTS // size)):
            part = slice(low, low + max(1, ELEMENTS // size))
            points = mix(elements[part, None] + np.arange(made + 1, made + size + 1, dtype=U) * U(0x9E3779B97F4A7C15))
            gaps = -np.log(((points >> U(24)).astype(np.float64) + 0.5) * (1.0 / (1 << 40)))
            gaps[:, 0] += time[part]
            at = np.cumsum(gaps, axis=1)
            time[part] = at[:, -1]
            at /= weights[part, None]
            e, k = np.nonzero(at <= until[part, None])
            points, at = points[e, k], at[e, k]
            to = place[part][e] + ((points & U(0xFFFFFF)) % U(many)).astype(np.int64)
            sooner = np.flatnonzero(at < times[to])
            points, at, to = points[sooner], at[sooner], to[sooner]
            np.minimum.at(times, to, at)
            least = at == times[to]
            drawn[to[least]] = points[least]
        more = time <= until * weights
        place, elements, weights, until, time = place[more], elements[more], weights[more], until[more], time[more]
        made, step = made + size, step + 1


def samples(rows: np.ndarray, values: np.ndarray, weights: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The keys of all bands of n rows, in an array of n by BANDS. Rows without a shingle have no meaningful ones."""
    many = BANDS * ROWS
    copy = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    elements = mix(np.repeat(values, counts) ^ mix(copy.astype(U) + U(0x1000)))
    rows, weights = np.repeat(rows, counts), np.repeat(weights, counts)
    total = np.bincount(rows, weights, n)
    until = (np.log(many) + SPARE) / np.maximum(total, 1e-300)
    drawn, times = np.zeros(n * many, U), np.full(n * many, np.inf)
    while len(rows):
        _first_points(rows * many, elements, weights, until[rows], drawn, times)
        # A time that left a place empty is doubled. The points up to it are made again, and are the same.
        wanting = ~np.isfinite(times.reshape(n, many)).all(1)
        until[wanting] *= 2
        on = wanting[rows]
        rows, elements, weights = rows[on], elements[on], weights[on]
    drawn = drawn.reshape(n, BANDS, ROWS)
    keys = np.tile(mix(np.arange(1, BANDS + 1, dtype=U)), (n, 1))
    for k in range(ROWS):
        keys = mix(keys ^ drawn[:, :, k])
    return keys


def contents_of(chunk: Chunk, words: np.ndarray | None = None, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of all of each row's words, and whether it has none."""
    if words is None:
        starts, ends, first = chunk.runs(LOWER_WORD)
        words = run_hashes(chunk.data, starts, ends)
    c1 = run_hashes(words, first[:-1], first[1:]).view(np.int64)
    c2 = run_hashes(mix(words ^ U(0xC2)), first[:-1], first[1:]).view(np.int64)
    return c1, c2, np.diff(first) == 0


def sketches(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, content hash (null without words), total weight and band keys of each document that has an id."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, lower=True):
            n = chunk.rows
            rows, values, weights, counts, words, first = counted(chunk, idf)
            c1, c2, none = contents_of(chunk, words, first)
            keys = samples(rows, values, weights, counts, n)
            edges = np.arange(n + 1, dtype=np.int32) * BANDS
            yield pa.RecordBatch.from_arrays(
                [chunk.batch.column("doc_id"), pa.array(c1, mask=none), pa.array(c2, mask=none), pa.array(np.bincount(rows, weights * counts, n).astype(float)), pa.ListArray.from_arrays(pa.array(edges), pa.array(keys.ravel().view(np.int64)))],
                names=["doc_id", "c1", "c2", "weight", "keys"],
            )

    return docs.where("doc_id IS NOT NULL").mapInArrow(sketch, _SKETCH)


_COMPARED = "hub long, node long, wanted boolean, similarity double, shared double, weight double, hub_weight double, beyond array<long>, extra array<double>"


def compared(pairs: DataFrame, docs: DataFrame, idf: np.ndarray, least: float) -> DataFrame:
    """Of pairs (hub, node, wanted): similarity, sum of minima, weights, and if wanted the shingles that weigh more in the node than in the hub, and by how much."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text_a", lower=True):
            n, sides = chunk.rows, []
            for side in (chunk, Chunk(chunk.batch, "text_b", lower=True)):
                rows, values, weights, _, _ = weighted(side, idf)
                sides.append((mix(values ^ mix(rows.astype(U) + U(1))), rows, values, weights))
            (ka, ra, _, wa), (kb, rb, vb, wb) = sides
            order = np.argsort(ka)
            known = np.zeros(len(kb))
            if len(ka):
                place = np.minimum(np.searchsorted(ka[order], kb), len(ka) - 1)
                known = np.where(ka[order][place] == kb, wa[order][place], 0.0)
            both = np.bincount(rb, np.minimum(wb, known), n).astype(float)
            a, b = np.bincount(ra, wa, n).astype(float), np.bincount(rb, wb, n).astype(float)
            wanted = chunk.batch.column("wanted").to_numpy(zero_copy_only=False)
            more = np.flatnonzero((wb > known) & wanted[rb])
            edges = pa.array(np.searchsorted(rb[more], np.arange(n + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.batch.column("hub"),
                    chunk.batch.column("node"),
                    chunk.batch.column("wanted"),
                    *map(pa.array, (both / np.maximum(a + b - both, 1e-300), both, b, a)),
                    pa.ListArray.from_arrays(edges, pa.array(vb[more].view(np.int64))),
                    pa.ListArray.from_arrays(edges, pa.array((wb - known)[more])),
                ],
                names=[f.split()[0] for f in _COMPARED.split(", ")],
            )

    # Merged at any size, as a large corpus needs: with a side that is broadcast while it is small, small inputs would tell nothing of large ones.
    one = pairs.join(docs.select(F.col("node").alias("hub"), F.col("text").alias("text_a")).hint("merge"), "hub")
    two = pairs.select("hub", "node").join(docs.select("node", F.col("text").alias("text_b")).hint("merge"), "node")
    return one.join(two.hint("merge"), ["hub", "node"]).select("hub", "node", "wanted", "text_a", "text_b").mapInArrow(compare, _COMPARED)


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, component (the least node that links lead to) of the nodes of (a, b) links.

    Labels jump to their label's label in every round, so rounds are few, about the logarithm of the longest chain.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = written(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), f"{name}-links")
    labels = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), name)
    while True:
        # The least label of all neighbours, then the label that this label's node has itself.
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("before"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
        moved = written(step.join(jump, "component", "left").select("node", F.least("component", F.coalesce("beyond", "component")).alias("component"), "before"), name)
        dropped(labels)
        labels = moved.select("node", "component")
        if moved.where("component <> before").isEmpty():
            dropped(both)
            return labels


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """The components (node, component) of nodes known before and of those that new links (a, b) join."""
    ends = written(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    if ends.isEmpty():
        return labels
    known = ends.withColumn("component", F.col("node"))
    if labels is not None:
        known = labels.unionByName(known.join(labels, "node", "left_anti"))
    known = written(known, "known")
    of = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"{c}_own"))
    joins = links.join(of("a"), "a").join(of("b"), "b").where("a_own <> b_own").select(F.col("a_own").alias("a"), F.col("b_own").alias("b"))
    groups = components(joins.distinct())
    joined = groups.select(F.col("node").alias("component"), F.col("component").alias("joined"))
    result = written(known.join(joined, "component", "left").select("node", F.coalesce("joined", "component").alias("component")), "labels")
    dropped(ends, known, groups, labels)
    return result


def unseen(pairs: DataFrame, seen: list[DataFrame]) -> DataFrame:
    """The pairs (hub, node) that none of the earlier rounds' has. They pass one join, whatever the round."""
    return pairs.join(reduce(DataFrame.unionByName, seen), ["hub", "node"], "left_anti")


def linked(members: DataFrame, docs: DataFrame, idf: np.ndarray, least: float, labels: DataFrame | None = None, report: dict | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Links (a, b) that were found and the components they make, for members (key, node, weight, popular) of buckets.

    ``labels`` are components known before. ``report`` takes the pairs compared and the rounds.
    """
    share = least / (1 + least)
    links: list[DataFrame] = []
    seen: list[DataFrame] = []
    report = {} if report is None else report
    report |= {"rounds": 0}

    def with_class(rows: DataFrame) -> DataFrame:
        if labels is None:
            return rows.withColumn("own", F.col("node"))
        return rows.join(labels, "node", "left").withColumn("own", F.coalesce("component", "node")).drop("component")

    def link(found: DataFrame) -> None:
        nonlocal labels
        new = found.where(F.col("similarity") >= least).select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
        links.append(new)
        labels = merged(labels, new)

    # A lighter document of less than ``least`` of the other's weight cannot be similar.
    alike = lambda a, b: F.least(a, b) >= least * (1 - 1e-9) * F.greatest(a, b)
    best = members.groupBy("key").agg(F.max(F.struct("popular", "node", "weight")).alias("best"))
    first = members.join(best, "key").groupBy("node", "weight").agg(F.max("best").alias("best"))
    first = first.where((F.col("node") != F.col("best.node")) & alike(F.col("weight"), F.col("best.weight")))
    pairs = written(first.select(F.col("best.node").alias("hub"), "node", F.lit(False).alias("wanted")), "pairs")
    found = written(compared(pairs, docs, idf, least), "compared")
    link(found)
    seen.append(written(found.select(F.least("hub", "node").alias("hub"), F.greatest("hub", "node").alias("node")), "seen"))
    links[0] = written(links[0], "linked")
    dropped(pairs, found)
    members = members.select("key", "node", "weight")
    while True:
        report["rounds"] += 1
        own = with_class(members)
        each = own.groupBy("key", "own").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("weight", "node")).alias("hub"))
        buckets = each.groupBy("key").agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.min("hub").alias("hub"), F.max(F.struct("n", "own")).alias("major"), F.count(F.lit(1)).alias("classes")
        ).where("classes > 1")
        many = (F.col("n") * F.col("n") - F.col("squares")) / 2 > (PER_MEMBER if report["rounds"] == 1 else PER_MEMBER_LATER) * F.col("n")
        buckets = written(buckets.select("key", F.when(many, F.col("hub.node")).alias("hub"), F.col("major.own").alias("major")), "buckets")
        if buckets.isEmpty():
            break
        held = written(own.join(buckets, "key"), "held")
        around = held.where("hub IS NOT NULL AND node <> hub").select("hub", "node").distinct().withColumn("wanted", F.lit(True))
        # Those not of the largest class meet all: at most four times as many as the pairs of different classes.
        small = held.where("hub IS NULL").select("key", "node", "own", "weight", "major")
        others = small.where("own <> major").select("key", F.col("node").alias("hub"), F.col("own").alias("hub_own"), F.col("weight").alias("hub_weight"))
        met = small.join(others, "key").where("own <> hub_own").where(alike(F.col("weight"), F.col("hub_weight")))
        meet = met.select(F.least("hub", "node").alias("hub"), F.greatest("hub", "node").alias("node")).distinct()
        pairs = written(around.unionByName(unseen(meet, seen).withColumn("wanted", F.lit(False))), "pairs")
        found = written(compared(pairs, docs, idf, least), "compared")
        link(found)
        seen.append(written(found.where("NOT wanted").select("hub", "node"), "seen"))
        # Hubs whose members are of several classes still; the members are dealt on.
        around = with_class(found.where("wanted"))
        mixed = around.groupBy("hub").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high").select("hub")
        missing = share * (F.col("weight") + F.greatest(F.col("hub_weight"), least * F.col("weight"))) - F.col("shared")
        beyond = around.join(mixed, "hub").select("hub", "node", "own", "weight", missing.alias("missing"), F.explode(F.arrays_zip("beyond", "extra")).alias("one"))
        beyond = beyond.select(F.xxhash64("hub", "one.beyond").alias("key"), "hub", "node", "own", "weight", "missing", "one.extra")
        counts = beyond.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("own").alias("low"), F.max("own").alias("high"))
        shared = written(counts.where("low <> high").select("key", "n"), "shared")
        # Each shingle with those after it; a pair's first common shingle is before all its others.
        after = Window.partitionBy("hub", "node").orderBy(F.desc("n"), F.desc("key")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # Dealt by member as well, or all members of a hub would be in the task of the hub.
        dealt = beyond.join(shared, "key").repartition("hub", "node").withColumn("rest", F.sum("extra").over(after)).where("rest >= missing * (1 - 1e-9)")
        dealt = written(dealt.select("key", "node", "weight"), "members")
        links[-1] = written(links[-1], "linked")
        dropped(buckets, held, pairs, found, shared, *([members] if report["rounds"] > 1 else []))
        members = dealt
    return reduce(DataFrame.unionByName, links), labels


def classes(docs: DataFrame, least: float = SIMILARITY, report: dict | None = None) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), links (verified ones of its content to others)."""
    own = texts(docs)
    idf = inverse_frequencies(*document_frequencies(own))
    # Rows of one id need a text each: their contents are nodes by content, not by id.
    repeated = not own.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
    if repeated:
        own = written(own.distinct(), "distinct")
    sketch = written(sketches(own, idf), "sketches")
    contents = written(
        sketch.where("c1 IS NOT NULL")
        .groupBy("c1", "c2")
        .agg(F.min("doc_id").alias("first"), F.max("weight").alias("weight"), F.first("keys").alias("keys"))
        .withColumn("node", F.col("c1") if repeated else F.col("first")),
        "contents",
    )
    keyed = contents.select("node", "weight", F.explode("keys").alias("key"))
    shared = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    met = written(keyed.join(shared.hint("merge"), "key"), "met")
    members = written(met.join(met.groupBy("node").agg(F.sum("n").alias("popular")), "node").select("key", "node", "weight", "popular"), "members")
    # Only texts of contents that share a key are read again, one of each.
    nodes = written(members.select("node").distinct(), "nodes")
    wanted = written(contents.select("node", "first", "c1").join(nodes, "node"), "wanted")
    read = written(_texts_of(own, wanted, repeated), "texts")
    labels = merged(None, _same_id(sketch, contents)) if repeated else None
    links, labels = linked(members, read, idf, least, labels, report)
    found = contents.select("c1", "c2", "node", "first")
    if labels is None:
        found = found.select("c1", "c2", F.col("first").alias("class_id"), F.lit(0).cast("long").alias("links"))
    else:
        ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
        placed = written(found.join(labels, "node", "left").join(ends, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
        least_of = placed.groupBy("component").agg(F.min("first").alias("class_id"))
        found = placed.join(least_of, "component").select("c1", "c2", "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    found = written(found, "classes")
    dropped(contents, shared, met, members, nodes, wanted, read, labels)
    if repeated:
        sketch = sketches(texts(docs), idf)
    with_words = sketch.where("c1 IS NOT NULL").select("doc_id", "c1", "c2").join(found, ["c1", "c2"]).select("doc_id", "class_id", "links")
    alone = sketch.where("c1 IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    none = texts(docs).where("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("links"))
    return with_words.unionByName(alone).unionByName(none)


def _texts_of(own: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """node and text of each wanted content (node, first, c1)."""
    found = own.join(wanted.select(F.col("first").alias("doc_id"), "node", "c1").hint("merge"), "doc_id")
    if not repeated:
        return found.select("node", "text")

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, lower=True):
            c1, _, none = contents_of(chunk)
            keep = (c1 == chunk.batch.column("c1").to_numpy()) & ~none
            yield chunk.batch.select(["node", "text"]).filter(pa.array(keep))

    # Texts of the same words but other marks are one content: any of them will do.
    return found.select("node", "text", "c1").mapInArrow(same, "node long, text string").groupBy("node").agg(F.min("text").alias("text"))


def _same_id(sketch: DataFrame, contents: DataFrame) -> DataFrame:
    """Links between contents of one id: each to the least of its id."""
    of = sketch.where("c1 IS NOT NULL").select("doc_id", "c1", "c2").distinct().join(contents.select("c1", "c2", "node"), ["c1", "c2"]).select("doc_id", "node")
    first = of.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a <> last").select("doc_id", "a")
    return of.join(first, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()


def first_of_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all their columns, one of each class: its document of the least id.

    Rows without an id stay; of rows that repeat an id, one stays.
    """
    found = written(classes(docs, least).where("doc_id IS NOT NULL"), "assigned")
    gone = found.where("doc_id <> class_id").select(F.col("doc_id").alias("__gone")).distinct()
    kept = docs.join(gone.hint("merge"), docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
    if not found.groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.where("doc_id IS NULL").unionByName(kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    return kept
