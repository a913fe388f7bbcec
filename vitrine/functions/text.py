"""Text functions as Column expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case ASCII word tokens in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def mixed_tokens(text: Column) -> Column:
    """Distinct tokens of mixed CJK and Latin text: Latin words; CJK runs with their bigrams and trigrams."""
    lower = F.lower(text)
    latin = F.regexp_extract_all(lower, F.lit("[a-z0-9]+"), F.lit(0))
    runs = F.regexp_extract_all(lower, F.lit("[\\x{4e00}-\\x{9fff}]+"), F.lit(0))

    def grams(run: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(run) - (n - 1))
        return F.when(F.length(run) >= n, F.transform(starts, lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    own = F.transform(runs, lambda r: F.array_union(F.array(r), F.array_union(grams(r, 2), grams(r, 3))))
    return F.array_distinct(F.concat(latin, F.flatten(own)))


#: Words that an index leaves out.
STOPWORDS = (
    "的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 那 个 之 与 及 等 或 但 而 因为 "
    "所以 如果 虽然 但是 然而 因此 从而 而且 或者 还是 要么 假如 假设 即使 尽管 不管 无论 不论 不只 不仅 不但 不光 "
    "产品 商品 这款 这个 那个 什么 怎么 怎样 如何 为什么 多少 几 哪些 哪里 推荐 喜欢 想要 需要 适合 觉得 感觉 "
    "一下 一些 一点 比较 非常 特别 挺 蛮 还算 大概 大约 左右 差不多 请问 帮忙 帮我 给我 给我找 有没有"
).split()
_CJK = r"[\x{4e00}-\x{9fff}]"


def search_tokens(text: Column) -> Column:
    """Tokens of an index in order, with repeats: words of letters, digits and underscores in any
    script, in lower case; a CJK run gives the run, its bigrams and trigrams, each length once a place. Tokens of
    one character and stop words are left out.
    """
    apart = F.regexp_replace(F.lower(text), f"({_CJK}+)", " $1 ")
    runs = F.regexp_extract_all(apart, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    grams = lambda r, n: F.when(F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.length(r) - (n - 1)), lambda i: F.substring(r, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    own = lambda r: F.when(r.rlike(f"^{_CJK}"), F.concat(F.filter(F.array(r), lambda x: F.length(x) > 3), grams(r, 2), grams(r, 3))).otherwise(F.array(r))
    # Only texts with CJK characters pay for their grams.
    each = F.when(F.lower(text).rlike(_CJK), F.flatten(F.transform(runs, own))).otherwise(runs)
    kept = F.filter(each, lambda x: (F.length(x) > 1) & ~x.isin(STOPWORDS))
    return F.when(F.lower(text).rlike(_CJK), kept).otherwise(F.filter(runs, lambda x: F.length(x) > 1))


def search_tokens_sql(text: str) -> str:
    """The DuckDB expression of ``search_tokens``."""
    cjk, stop = _CJK, ", ".join(f"'{w}'" for w in STOPWORDS)
    return (
        f"list_filter(flatten(list_transform(regexp_extract_all(regexp_replace(lower({text}), '({cjk}+)', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}_]+'), "
        f"lambda r: CASE WHEN regexp_matches(r, '^{cjk}') THEN list_concat(CASE WHEN length(r) > 3 THEN [r] ELSE [] END, "
        "list_transform(range(1, length(r)), lambda i: substr(r, i, 2)), list_transform(range(1, greatest(length(r) - 1, 1)), lambda i: substr(r, i, 3))) ELSE [r] END)), "
        f"lambda t: length(t) > 1 AND t NOT IN ({stop}))"
    )


def haystack(*columns: Column) -> Column:
    """All fields as one lower-case text; arrays are joined by blanks."""
    return F.lower(F.concat_ws(" ", *columns))


def compact(text: Column) -> Column:
    """Lower case without blanks, hyphens, underscores and dots."""
    return F.regexp_replace(F.lower(text), r"[\s\-_.·]+", "")


def within_edits(a: Column, b: Column, most: int) -> Column:
    """Levenshtein distance; most + 1 where it is larger. (Spark gives -1 there.)"""
    found = F.levenshtein(a, b, most)
    return F.when(found < 0, F.lit(most + 1)).otherwise(found)


def fuzzy_contains(text: Column, needle: Column, edits: int = 1) -> Column:
    """Whether a window of the text, up to ``edits`` longer or shorter than the needle, is within that distance."""
    size = F.length(needle)

    def of_size(delta: int) -> Column:
        n = size + delta
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        return F.exists(starts, lambda i: within_edits(F.substring(text, i, n), needle, edits) <= edits)

    found = of_size(0)
    for delta in range(1, edits + 1):
        found = found | of_size(delta) | of_size(-delta)
    return F.contains(text, needle) | ((size >= 4) & found)


def alias_in(text: Column, alias: Column) -> Column:
    """ASCII aliases at word boundaries, others anywhere."""
    ascii_only = alias.rlike("^[ -~]+$")
    bounded = F.concat(F.lit("(?<![a-z0-9])"), F.regexp_replace(F.lower(alias), r"([^a-z0-9 ])", r"\\$1"), F.lit("(?![a-z0-9])"))
    return F.when(ascii_only, F.regexp_like(F.lower(text), bounded)).otherwise(F.contains(F.lower(text), F.lower(alias)))


def hash_number(text: Column, algorithm: str = "sha256", digits: int = 8) -> Column:
    """The first hexadecimal digits of a digest, as a number."""
    digest = F.md5(text) if algorithm == "md5" else F.sha2(text, 256)
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def stable_bucket(text: Column, buckets: int) -> Column:
    return hash_number(text) % F.lit(buckets)


def half_even(value: Column, digits: int = 2) -> Column:
    return F.bround(value, digits)
