"""How far the sources of a language differ in their words.

Every term that is in enough documents of a language has a smoothed share in each source of it
(p, an integer of a thousand millionth), seen there or not. Two sources differ by the sum of
|p - p'| over all terms. Most terms are in few sources, so sums are split by the term:

* a heavy term, in a quarter of the sources or more, is a line of a dense numpy tile, and whole
  columns of tiles are subtracted;
* a light term has postings only. Were no light term in either source, each would add the
  difference of the two shares of an unseen term. Postings of one source correct this, against all
  sources at once, by sorted shares and their running sums; pairs of postings of one term correct what
  both have. Only sources that share a term are paired.

Both sums are integers and are added as they are. Terms are dealt in buckets of about
``BUCKET`` postings, with slabs of ``SLAB`` sources for one side of the pairs, so a task holds a bucket
and sums for a slab. Words are counted where they are read before they meet, so a word that all documents have
is a row a task.

Defined cases: null text, language and source are empty strings; documents are counted by rows, so
repeated rows and null ids count; a language without kept terms gives each pair the value 0; ties
go by the item's UTF-8 bytes; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pieces import spread
from .shared import written
from .textkit import chunks, row_of

UNIT, PRIOR = 1_000_000_000, 5
BUCKET, SLAB, PAIRS = 200_000, 256, 1 << 21
#: Bytes whose words are counted together in a task.
COUNTED = 8 << 20
#: ASCII letters and every byte of characters beyond ASCII.
TERM = np.zeros(256, bool)
TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each stretch of rows: occurrences and documents of each term in each (lang, source)."""
    for chunk in chunks(batches, most=COUNTED):
        starts, ends, first = chunk.runs(TERM)
        if not len(starts):
            continue
        data = chunk.data + np.uint8(32) * ((chunk.data >= 0x41) & (chunk.data <= 0x5A))
        size = ends - starts
        offsets = np.append(0, np.cumsum(size))
        terms = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data[spread(starts, size)])).dictionary_encode()
        lang, source = (chunk.batch.column(c).dictionary_encode() for c in ("lang", "source"))
        group = np.asarray(lang.indices, np.int64) * len(source.dictionary) + np.asarray(source.indices)
        row = row_of(first)
        many = len(terms.dictionary)
        key = group[row] * many + np.asarray(terms.indices, np.int64)
        order = np.argsort(key, kind="stable")
        key, row = key[order], row[order]
        new = np.append(True, key[1:] != key[:-1])
        new_row = new | np.append(True, row[1:] != row[:-1])
        at = np.flatnonzero(new)
        group, term = np.divmod(key[at], many)
        group_lang, group_source = np.divmod(group, len(source.dictionary))
        columns = [lang.dictionary.take(pa.array(group_lang)), source.dictionary.take(pa.array(group_source)), terms.dictionary.take(pa.array(term)).cast(pa.string())]
        columns += [pa.array(np.diff(np.append(at, len(key)))), pa.array(np.add.reduceat(new_row.astype(np.int64), at))]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def _share(n: str, total: str, terms: str) -> F.Column:
    """1 + floor(UNIT (n + PRIOR) / (total + PRIOR terms)), exactly."""
    return F.expr(f"1 + ((cast({n} as decimal(19,0)) + {PRIOR}) * cast({UNIT} as decimal(10,0))) div cast({total} + {PRIOR} * {terms} as decimal(19,0))")


def _unseen(values: np.ndarray, base: int, other: np.ndarray) -> np.ndarray:
    """The sum over values of |v - x| - |base - x|, for each x of ``other``."""
    values = np.sort(values)
    running = np.append(0, np.cumsum(values))
    at = np.searchsorted(values, other)
    total = other * at - running[at] + (running[-1] - running[at]) - other * (len(values) - at)
    return total - len(values) * np.abs(base - other)


def _differences(slab_size: int, most: int, key: tuple, postings: pa.Table, sources: pa.Table) -> pa.Table:
    """For each source of a slab and each later one: the sum of differences over one bucket's terms."""
    lang, _, slab = (k.as_py() for k in key)
    place = np.asarray(sources.column("place"), np.int64)
    bases = np.zeros(len(place), np.int64)
    bases[place] = np.asarray(pc.fill_null(sources.column("unseen"), 0), np.int64)
    n, low = len(bases), slab * slab_size
    own = np.arange(low, min(n, low + slab_size))
    sums = np.zeros((len(own), n), np.int64)
    if postings.num_rows:
        term = np.asarray(postings.column("term").combine_chunks().dictionary_encode().indices, np.int64)
        order = np.lexsort((np.asarray(postings.column("at"), np.int64), term))
        term, at, p = term[order], np.asarray(postings.column("at"), np.int64)[order], np.asarray(postings.column("p"), np.int64)[order]
        size = np.bincount(term)
        heavy = 4 * size >= n
        _dense(sums, own, bases, heavy, term, at, p)
        light = ~heavy[term]
        _sparse(sums, own, bases, int((~heavy).sum()), size[~heavy], at[light], p[light], most)
    a, b = np.nonzero(np.arange(n)[None, :] > own[:, None])
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(own[a]), "b": pa.array(b), "value": pa.array(sums[a, b])})


def _dense(sums: np.ndarray, own: np.ndarray, bases: np.ndarray, heavy: np.ndarray, term: np.ndarray, at: np.ndarray, p: np.ndarray) -> None:
    n = len(bases)
    line = np.cumsum(heavy) - 1
    step = max(1, (1 << 20) // n)
    which = np.flatnonzero(heavy[term])
    lines = line[term[which]]
    for k in range(0, int(heavy.sum()), step):
        a, b = np.searchsorted(lines, [k, k + step])
        tile = np.repeat(bases[:, None], min(step, int(heavy.sum()) - k), 1)
        tile[at[which[a:b]], lines[a:b] - k] = p[which[a:b]]
        for i, g in enumerate(own):
            sums[i, g + 1 :] += np.abs(tile[g + 1 :] - tile[g]).sum(1)


def _sparse(sums: np.ndarray, own: np.ndarray, bases: np.ndarray, terms: int, size: np.ndarray, at: np.ndarray, p: np.ndarray, most: int) -> None:
    """``at`` and ``p``: the light terms' postings, ``size`` of each term, by term and source."""
    n = len(bases)
    sums += terms * np.abs(bases[own][:, None] - bases[None, :])
    order = np.argsort(at, kind="stable")
    edge = np.searchsorted(at[order], np.arange(n + 1))
    for g in range(n):
        values = p[order[edge[g] : edge[g + 1]]]
        if not len(values):
            continue
        sums[:, g] += _unseen(values, bases[g], bases[own])
        if own[0] <= g <= own[-1]:
            sums[g - own[0]] += _unseen(values, bases[g], bases)
    first = np.cumsum(size) - size
    for k in np.unique(size[size > 1]):
        i, j = np.triu_indices(k, 1)
        step = max(1, most // len(i))
        starts = first[size == k]
        for s in range(0, len(starts), step):
            x, y = starts[s : s + step, None] + i, starts[s : s + step, None] + j
            inside = (at[x] >= own[0]) & (at[x] <= own[-1])
            x, y = x[inside], y[inside]
            a, b = at[x], at[y]
            both = np.abs(p[x] - p[y]) - np.abs(p[x] - bases[b]) - np.abs(p[y] - bases[a]) + np.abs(bases[a] - bases[b])
            np.add.at(sums, (a - own[0], b), both)


def audited(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` rows for all other sources, ``term`` rows for the first ``top`` terms."""
    given = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = given.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    counted = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    totals = {"all_docs": F.sum("docs").over(term), "total": F.sum("n").over(term), "leads": F.min("source").over(term) == F.col("source")}
    kept = written(counted.withColumns(totals).where(F.col("all_docs") >= min_docs).select("lang", "term", "source", "n", "total", "leads"), "divergence-postings")

    langs = kept.groupBy(F.col("lang").alias("of_lang")).agg(F.sum("n").alias("lang_total"), F.count_if("leads").alias("terms"), F.count("*").alias("postings"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("source_total"))
    groups = given.select("lang", "source").distinct().join(own, ["lang", "source"], "left")
    groups = groups.join(langs, F.col("lang") == F.col("of_lang"), "left").drop("of_lang").fillna(0, ["source_total", "lang_total", "terms", "postings"])
    groups = groups.withColumns(
        {
            "place": F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1,
            "sources": F.count("*").over(Window.partitionBy("lang")),
            "unseen": F.when(F.col("terms") > 0, _share("0", "source_total", "terms")),
            "buckets": F.ceil((F.col("postings") + 1) / BUCKET).cast("int"),
        }
    ).withColumn("slabs", F.ceil(F.col("sources") / SLAB).cast("int"))
    groups = written(groups, "divergence-groups")

    here = groups.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "source_total", "lang_total", "terms", F.col("place").alias("at"), "buckets", "slabs")
    shares = kept.join(here, (F.col("lang") == F.col("g_lang")) & (F.col("source") == F.col("g_source")))
    shares = shares.withColumns({"p": _share("n", "source_total", "terms"), "q": _share("total", "lang_total", "terms")})
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)

    bucket = F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int")
    differences = functools.partial(_differences, SLAB, PAIRS)
    slabs = F.explode(F.sequence(F.lit(0), F.col("slabs") - 1))
    dealt = shares.select("lang", bucket.alias("bucket"), slabs.alias("slab"), "term", "at", "p")
    sides = groups.select(F.col("lang").alias("s_lang"), F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("s_bucket"), "slabs", "place", "unseen")
    sides = sides.select("s_lang", "s_bucket", slabs.alias("s_slab"), "place", "unseen")
    sums = dealt.groupBy("lang", "bucket", "slab").cogroup(sides.groupBy("s_lang", "s_bucket", "s_slab")).applyInArrow(lambda k, a, b: differences(k, a, b), "lang string, a long, b long, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.inline(F.array(F.struct(F.col("a").alias("of"), F.col("b").alias("to")), F.struct(F.col("b").alias("of"), F.col("a").alias("to")))), "value")
    name = lambda at, to: groups.select(F.col("lang"), F.col("place").cast("long").alias(at), F.col("source").alias(to))
    pairs = both.join(name("of", "source"), ["lang", "of"]).join(name("to", "item"), ["lang", "to"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return pairs.withColumn("rank", F.row_number().over(first)).unionByName(terms)
