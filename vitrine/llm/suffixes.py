"""Passages that repeat across documents, by a sparse suffix array.

Suffixes are kept at content-selected positions only: of each window of MIN_WORDS words, the
position whose next CORE words hash lowest (the leftmost of equals). Equal windows select the
same position, so a passage of MIN_WORDS words or more that two documents share has a kept suffix
in both, with the same first CORE words. A suffix is first dealt as four numbers; only those whose
first CORE words another document has too are read again, with the words before and after them
that windows which selected the position reach: MIN_WORDS - CORE before and MIN_WORDS behind at most.

These are dealt by the first CORE words and sorted by all that follow, which puts suffixes with the
same beginning next to each other. Neighbours are compared, byte by byte, for the number of words
that they have in common; so are they in the order of the reversed words before the position. A
match reaches d words to the left and MIN_WORDS - d to the right where no smaller number stands between two
suffixes in either order; every d is tried, and matches of different documents are repeats. Every window
belongs to one suffix, so the result is each word that lies in a window of MIN_WORDS words found
in another document, and no other: hashes choose and deal, words decide.

Texts that are equal as a whole take part once, by the smallest document; the others repeat it from
end to end. First CORE words of more than ``RUN_ROWS`` suffixes are not held in a task: windows around
them are grouped by Spark, by two 64-bit hashes of their words, with partial sums.

Of the documents that share a window, the one of the smallest id keeps it. ``repeats`` lists
spans as [start, end) in words (lower-case runs of a-z, 0-9 and characters beyond ASCII).

Limit: a passage that repeats inside one document only is not a repeat.

Defined cases: null text is empty; texts of fewer than MIN_WORDS words have no repeats; rows of
one id, and rows without an id, are one document each, within which nothing counts as repeated, but have spans by
their texts; an empty table gives no row; other columns are ignored, or carried by
``without_repeats``, which leaves rows without an id as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import spread
from .shared import dropped, texts, written
from .textkit import LOWER_WORD, U, Chunk, chunks, grams, mix, run_hashes

MIN_WORDS, CORE = 50, 20
RUN_ROWS = 100_000
#: Bytes of neighbours that are compared at once.
BLOCK = 4 << 20
NO_ID = np.iinfo(np.int64).min
_EITHER_CASE = LOWER_WORD.copy()
_EITHER_CASE[65:91] = True

KEPT = "key long, doc long, h long, at int, n_words int"
AROUND = "key long, doc long, h long, at int, n_left int, n_right int, left binary, right binary"
WINDOW = "w1 long, w2 long, doc long, h long, start int"
FOUND = "doc long, h long, start int, end int, cut_start int, cut_end int"
_SPANS = "array<struct<start:int,end:int>>"


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _lowest(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each full window of ``width`` hashes, where its lowest is; the leftmost of equals."""
    at, size = np.arange(len(hashes)), 1
    while size * 2 <= width:
        left, right = at[: len(at) - size], at[size:]
        at = np.where(hashes[left] <= hashes[right], left, right)
        size *= 2
    if size < width:
        left, right = at[: len(at) - (width - size)], at[width - size :]
        at = np.where(hashes[left] <= hashes[right], left, right)
    return at


class Suffixes:
    """The kept suffixes of a chunk: row, place of the word, windows that selected it, and their first one's start."""

    def __init__(self, chunk: Chunk, min_words: int, core: int):
        self.starts, self.ends, self.first = chunk.runs(LOWER_WORD)
        self.words = run_hashes(chunk.data, self.starts, self.ends)
        cores, core_at = grams(self.words, self.first, core)
        windows, window_at = grams(self.words, self.first, min_words)
        self.key = self.place = self.window = self.row = self.size = np.zeros(0, np.int64)
        if len(windows):
            whole = np.zeros(len(self.words), U)
            whole[core_at] = cores
            lowest = _lowest(whole, min_words - core + 1)[window_at]
            # Windows of one suffix are neighbours: windows that select a position are successive.
            begin = np.flatnonzero(np.append(True, (lowest[1:] != lowest[:-1]) | (np.diff(window_at) != 1)))
            self.size = np.diff(np.append(begin, len(lowest)))
            self.place, self.window = lowest[begin], window_at[begin]
            self.key = whole[self.place].view(np.int64)
            self.row = np.searchsorted(self.first, self.place, "right") - 1
        self.at = self.place - self.first[self.row]

    def pick(self, which: np.ndarray) -> None:
        for name in ("key", "place", "window", "row", "size", "at"):
            setattr(self, name, getattr(self, name)[which])


def kept(own: DataFrame, min_words: int, core: int) -> DataFrame:
    """Every kept suffix of (doc, h, text), as numbers only."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, lower=True):
            s = Suffixes(chunk, min_words, core)
            rows = pa.array(s.row)
            n_words = np.diff(s.first)[s.row].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(s.key), chunk.batch.column("doc").take(rows), chunk.batch.column("h").take(rows), pa.array(s.at.astype(np.int32)), pa.array(n_words)], names=_names(KEPT))

    return own.mapInArrow(keep, KEPT)


def _chosen(batches: Iterator[pa.RecordBatch], min_words: int, core: int) -> Iterator[tuple[Chunk, Suffixes]]:
    """The suffixes of (doc, h, text, live) whose places are in ``live``."""
    for chunk in chunks(batches, lower=True):
        s, live = Suffixes(chunk, min_words, core), chunk.batch.column("live")
        row = np.repeat(np.arange(chunk.rows), np.asarray(pc.list_value_length(live)))
        s.pick(np.isin((s.row << 32) | s.at, (row << 32) | np.asarray(live.flatten()).astype(np.int64)))
        if len(s.key):
            yield chunk, s


def around(read: DataFrame, min_words: int, core: int) -> DataFrame:
    """The chosen suffixes with the words before them, reversed, and those that follow."""

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, s in _chosen(batches, min_words, core):
            # The chunk's words with a blank before and behind each.
            length = s.ends - s.starts
            out = np.cumsum(length + 1) - length
            plain = np.full(int(length.sum() + len(length) + 1), 0x20, np.uint8)
            plain[spread(out, length)] = chunk.data[spread(s.starts, length)]
            out = np.append(out, len(plain))
            data, back = plain.tobytes(), plain[::-1].tobytes()
            low, mid, high = out[s.window].tolist(), out[s.place].tolist(), out[s.window + s.size - 1 + min_words].tolist()
            n = len(data)
            rows = pa.array(s.row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(s.key),
                    chunk.batch.column("doc").take(rows),
                    chunk.batch.column("h").take(rows),
                    *(pa.array(x.astype(np.int32)) for x in (s.at, s.place - s.window, s.window + s.size - 1 + min_words - s.place)),
                    pa.array([back[n - m + 1 : n - a + 1] for a, m in zip(low, mid, strict=True)], pa.binary()),
                    pa.array([data[m:z] for m, z in zip(mid, high, strict=True)], pa.binary()),
                ],
                names=_names(AROUND),
            )

    return read.mapInArrow(show, AROUND)


def windows_of(read: DataFrame, min_words: int, core: int) -> DataFrame:
    """The windows that selected the chosen suffixes."""

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, s in _chosen(batches, min_words, core):
            start = spread(s.window, s.size)
            row = np.repeat(s.row, s.size)
            w1, w2 = (run_hashes(w, start, start + min_words).view(np.int64) for w in (s.words, mix(s.words ^ U(0xC2))))
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(w1), pa.array(w2), chunk.batch.column("doc").take(rows), chunk.batch.column("h").take(rows), pa.array((start - s.first[row]).astype(np.int32))], names=_names(WINDOW)
            )

    return read.mapInArrow(show, WINDOW)


def common_words(strings: pa.BinaryArray, fresh: np.ndarray) -> np.ndarray:
    """For each string how many words it begins with like the one before it; a word ends with a blank. None where ``fresh``."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = np.frombuffer(strings.buffers()[2], np.uint8) if strings.buffers()[2] is not None else np.zeros(0, np.uint8)
    blanks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 0x20, out=blanks[1:])
    size = np.diff(offsets)
    least = np.zeros(len(size), np.int64)
    least[1:] = np.minimum(size[1:], size[:-1])
    least[fresh] = 0
    total, same, low = np.cumsum(least), np.zeros(len(size), np.int64), 0
    while low < len(size):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + BLOCK, "right")))
        n = least[low:high]
        begin = np.cumsum(n) - n
        differ = np.append(data[spread(offsets[low:high], n)] != data[spread(offsets[low:high] - np.append(size[low - 1] if low else 0, size[low : high - 1]), n)], True)
        at = np.flatnonzero(differ)
        same[low:high] = np.minimum(at[np.searchsorted(at, begin)] - begin, n)
        low = high
    return blanks[offsets[:-1] + same] - blanks[offsets[:-1]]


def compared(run: np.ndarray, doc: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, left: pa.BinaryArray, right: pa.BinaryArray, min_words: int) -> list[np.ndarray]:
    """Of suffixes in order of (run, right), how many words before the suffix the first and last repeated window start, then those to cut; -1: none."""
    n = len(run)
    fresh = np.append(True, run[1:] != run[:-1])
    follow = common_words(right, fresh)
    order = np.asarray(pc.sort_indices(pa.table({"run": run, "left": left}), [("run", "ascending"), ("left", "ascending")])).astype(np.int64)
    before = common_words(left.take(pa.array(order)), fresh)
    bounds = [np.full(n, -1) for _ in range(4)]
    by_left = np.zeros(n, np.int64)
    for d in range(int(n_left.max(initial=0)) + 1):
        valid = np.flatnonzero((d <= n_left) & (min_words - d <= n_right))
        if not len(valid):
            continue
        by_right = np.cumsum(fresh | (follow < min_words - d))
        by_left[order] = np.cumsum(fresh | (before < d))
        code = by_right[valid] * (n + 1) + by_left[valid]
        place = np.argsort(code, kind="stable")
        new = np.flatnonzero(np.append(True, code[place][1:] != code[place][:-1]))
        own = doc[valid][place]
        least, most, counts = np.minimum.reduceat(own, new), np.maximum.reduceat(own, new), np.diff(np.append(new, len(own)))
        for k, hit in ((0, np.repeat(least != most, counts)), (2, own > np.repeat(least, counts))):
            rows = valid[place[hit]]
            bounds[k][rows] = d
            bounds[k + 1][rows[bounds[k + 1][rows] < 0]] = d
    return bounds


def compare(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Spans of suffixes (AROUND) in order of (key, right), complete runs of equal keys at a time."""

    def results(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key, doc = (rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        run = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
        begin = np.flatnonzero(np.append(True, np.diff(run) > 0))
        live = (np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin))[run]
        if not live.any():
            return
        rows = rows.filter(pa.array(live))
        doc, at, n_left, n_right = (rows.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 3, 4, 5))
        high, low, cut_high, cut_low = compared(run[live], doc, n_left, n_right, rows.column(6), rows.column(7), min_words)
        hit = np.flatnonzero(high >= 0)
        cut = cut_high[hit] >= 0
        spans = (at[hit] - high[hit], at[hit] - low[hit] + min_words, np.where(cut, at[hit] - cut_high[hit], -1), np.where(cut, at[hit] - cut_low[hit] + min_words, -1))
        yield pa.RecordBatch.from_arrays([rows.column(1).take(pa.array(hit)), rows.column(2).take(pa.array(hit)), *(pa.array(x.astype(np.int32)) for x in spans)], names=_names(FOUND))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1], "left"))
        if cut or (held and held[-1].column(0)[-1].as_py() != key[-1]):
            if held or cut:
                yield from results([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from results(held)


def spans(docs: DataFrame, min_words: int = MIN_WORDS, core: int = CORE, run_rows: int = RUN_ROWS) -> DataFrame:
    """doc, h (the text's hash), [start, end) of words that repeat, [cut_start, cut_end) of those a smaller document has (-1: none)."""
    own = texts(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("h"), "text")
    numbers = written(kept(own, min_words, core), "suffixes")
    shared = numbers.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count(F.lit(1)).alias("n")).where("least <> most")
    shared = written(shared.select("key", (F.col("n") > run_rows).alias("hot")), "shared")
    # Equal texts of several documents: all but the smallest document's are whole repeats.
    hashes = own.where(F.octet_length("text") >= 2 * min_words - 1).select("doc", "h", F.xxhash64(F.lit(1), "text").alias("h2"))
    same = hashes.groupBy("h", "h2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least <> most")
    copies = hashes.distinct().join(same, ["h", "h2"]).select("doc", "h", (F.col("doc") == F.col("least")).alias("is_first"))
    places = F.sort_array(F.collect_set("at"))
    by_text = numbers.join(shared.hint("merge"), "key").groupBy("doc", "h").agg(
        places.alias("all"), F.sort_array(F.collect_set(F.when(F.col("hot"), F.col("at")))).alias("hot"), F.first("n_words").alias("n_words")
    )
    by_text = written(by_text.join(copies, ["doc", "h"], "left"), "places")
    first = F.col("is_first")
    whole = by_text.where("is_first IS NOT NULL").select(
        "doc", "h", F.lit(0).alias("start"), F.col("n_words").alias("end"), F.when(first, -1).otherwise(0).alias("cut_start"), F.when(first, -1).otherwise(F.col("n_words")).alias("cut_end")
    )
    taking_part = by_text.where("is_first IS NULL OR is_first")

    def read(which) -> DataFrame:
        live = taking_part.select("doc", "h", which.alias("live")).where("size(live) > 0")
        # Merged at any size: the texts of a large corpus are dealt by document, those without a live place as well.
        return own.join(live.hint("merge"), ["doc", "h"])

    cold = around(read(F.array_except("all", "hot")), min_words, core)
    found = written(cold.repartition("key").sortWithinPartitions("key", "right").mapInArrow(lambda batches: compare(batches, min_words), FOUND), "repeats")
    result = found.unionByName(whole)
    if not shared.where("hot").isEmpty():
        every = written(windows_of(read(F.col("hot")), min_words, core), "windows")
        groups = every.groupBy("w1", "w2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least <> most")
        later, end = F.col("doc") > F.col("least"), F.col("start") + min_words
        result = result.unionByName(every.join(groups, ["w1", "w2"]).select("doc", "h", "start", end.alias("end"), F.when(later, F.col("start")).otherwise(-1).alias("cut_start"), F.when(later, end).otherwise(-1).alias("cut_end")))
    dropped(numbers, shared)
    return result


def joined(lists: pa.ListArray) -> pa.ListArray:
    """In each list, overlapping or touching spans become one, in order."""
    n = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    flat = lists.flatten()
    row = np.repeat(np.arange(len(n)), n)
    start, end = (np.asarray(flat.field(k)).astype(np.int64) for k in (0, 1))
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    if not len(row):
        return lists
    # Rows are far apart on one line, so that the running end of one does not reach the next.
    far = int(end.max()) + 2
    line = np.maximum.accumulate(end + row * far)
    new = np.flatnonzero(np.append(True, start[1:] + row[1:] * far > line[:-1]))
    last = np.append(new[1:], len(row)) - 1
    offsets = np.searchsorted(row[new], np.arange(len(n) + 1)).astype(np.int32)
    spans_ = pa.StructArray.from_arrays([pa.array(start[new].astype(np.int32)), pa.array((line[last] - row[new] * far).astype(np.int32))], names=["start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets), spans_)


def _by_text(docs: DataFrame, min_words: int, core: int, run_rows: int) -> DataFrame:
    """doc, h, repeated and cut spans of each text that has any."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), joined(batch.column(2)), joined(batch.column(3))], names=["doc", "h", "repeated", "cut"])

    cut = F.when(F.col("cut_end") >= 0, F.struct(F.col("cut_start").alias("start"), F.col("cut_end").alias("end")))
    found = spans(docs, min_words, core, run_rows).groupBy("doc", "h").agg(F.collect_set(F.struct("start", "end")).alias("repeated"), F.collect_set(cut).alias("cut"))
    return found.mapInArrow(join, f"doc long, h long, repeated {_SPANS}, cut {_SPANS}")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, core: int = CORE, run_rows: int = RUN_ROWS) -> DataFrame:
    """doc_id, repeated and cut spans (arrays of [start, end) in words) of documents that have any.

    A document without cut spans is the first that has its passages. An id, or none, with several texts has a row for each.
    """
    return _by_text(docs, min_words, core, run_rows).select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "repeated", "cut")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, core: int = CORE, run_rows: int = RUN_ROWS, length: str = "n_chars") -> DataFrame:
    """``docs`` with each cut span taken out of its text, up to the next word; the column ``length`` follows.

    A text of which no word is left goes; texts without a cut span stay as they are.
    """
    cuts = _by_text(docs, min_words, core, run_rows).where((F.col("doc") != NO_ID) & (F.size("cut") > 0))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # All of a row in one column, so that no name of it can clash with what is joined.
    given = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"))
    both = given.join(cuts.select("doc", "h", "cut").hint("merge"), ["doc", "h"], "left").select("row", F.col("row.text").cast("string").alias("text"), "cut")
    schema = docs.schema

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            spans_of = chunk.batch.column("cut")
            given = dict(zip(schema.names, chunk.batch.column("row").flatten(), strict=True))
            if spans_of.null_count == chunk.rows:
                yield pa.RecordBatch.from_arrays(list(given.values()), names=schema.names)
                continue
            starts, _, first = chunk.runs(_EITHER_CASE)
            data, out, sizes, stay = chunk.data.tobytes(), chunk.batch.column("text").to_pylist(), np.full(chunk.rows, -1), np.ones(chunk.rows, bool)
            for i, own in enumerate(spans_of.to_pylist()):
                if own:
                    places = np.append(starts[first[i] : first[i + 1]], chunk.offsets[i + 1])
                    parts, at = [], int(chunk.offsets[i])
                    for s in own:
                        parts.append(data[at : places[s["start"]]])
                        at = int(places[s["end"]])
                    out[i] = b"".join([*parts, data[at : chunk.offsets[i + 1]]]).decode()
                    stay[i] = sum(s["end"] - s["start"] for s in own) < len(places) - 1
                    sizes[i] = len(out[i])
            given["text"] = pa.array(out, given["text"].type)
            if length in given:
                # A number or a string; of other types, the column stays as it is.
                kind = given[length].type
                if pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_string(kind):
                    given[length] = pc.if_else(pa.array(sizes >= 0), pc.cast(pa.array(sizes), kind), given[length])
            yield pa.RecordBatch.from_arrays(list(given.values()), names=schema.names).filter(pa.array(stay))

    return both.mapInArrow(edit, schema)
