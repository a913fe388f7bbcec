"""Grounding queries: an answer for each product, its two cards, and what the guards say of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.operators import grounding
from vitrine.operators import language as nlu

from .filters import PRODUCT_SQL, products
from .registry import query

#: Answers: {n} name, {b} brand, {p} price, {w} another price, {s} stock, {t} another stock, {i} another price in whole units.
ANSWERS = [
    "推荐【候选1】{n}，价格：{p}，库存 {s} 件", "{n}只要¥{w}，【候选1】", "{n}保证好用，【候选2】", "推荐【候选3】{b}的商品", "抱歉，没有找到合适的商品", "{n}有优惠券，售价：{p}，【候选1】", "这是一件很好的东西",
    "{n}不是{p}元吗，比另一款低 5 元，还有 {t} 件，【候选1】【候选2】【候选9】【候选1】", "{n}无法保证永久，{p}元",
    "{n}不能保证，保证好", "{n}只要¥{i}，编号 {i}.00", "{n}现在 {i}元, 编号 {i}，{p}元", "{n}已经售罄，【候选1】", "商品充足，第1款，剩余{t}件，还有 {t} 台",
]


def answers(spark, sf_dir):
    """product_id, answer, question and two cards (a, b): the product's own, and the next one's."""
    p = products(spark, sf_dir).select("product_id", F.struct("name", "brand", "price", "stock").alias("a"))
    both = p.join(p.select((F.col("product_id") - 1).alias("product_id"), F.col("a").alias("b")), "product_id")
    money = lambda x: F.format_string("%.2f", x)
    text = F.element_at(F.array(*map(F.lit, ANSWERS)), (F.col("product_id") % len(ANSWERS) + 1).cast("int"))
    for name, value in (("{n}", F.col("a.name")), ("{b}", F.col("b.brand")), ("{p}", money(F.col("a.price"))), ("{w}", money(F.col("a.price") + 7)), ("{i}", F.floor(F.col("a.price") + 7).cast("string")), ("{s}", F.col("a.stock").cast("string")), ("{t}", (F.col("a.stock") + 1).cast("string"))):
        text = F.replace(text, F.lit(name), value)
    question = F.when(F.col("product_id") % 4 == 0, F.concat(F.lit("预算 "), F.floor(F.col("a.price")).cast("string"), F.lit(" 元"))).otherwise("随便看看")
    return both.select("product_id", "a", "b", text.alias("answer"), question.alias("question"))


_LIST = "[" + ", ".join("'" + x + "'" for x in ANSWERS) + "]"
_ANSWERS_SQL = f"""{PRODUCT_SQL}, ans AS (SELECT a.product_id, a.name AS n1, a.brand AS b1, a.price AS p1, a.stock AS s1, b.name AS n2, b.brand AS b2, b.price AS p2, b.stock AS s2,
        replace(replace(replace(replace(replace(replace(replace({_LIST}[a.product_id % {len(ANSWERS)} + 1], '{{n}}', a.name), '{{b}}', b.brand), '{{p}}', printf('%.2f', a.price)), '{{w}}', printf('%.2f', a.price + 7)), '{{i}}', CAST(CAST(floor(a.price + 7) AS BIGINT) AS VARCHAR)), '{{s}}', CAST(a.stock AS VARCHAR)), '{{t}}', CAST(a.stock + 1 AS VARCHAR)) AS answer,
        CASE WHEN a.product_id % 4 = 0 THEN '预算 ' || CAST(CAST(floor(a.price) AS BIGINT) AS VARCHAR) || ' 元' ELSE '随便看看' END AS question
        FROM product a JOIN product b ON b.product_id = a.product_id + 1)"""


def _points(context: str, i: int) -> str:
    low = f"regexp_replace(lower({context}), '\\s+', '', 'g')"
    own = lambda x: f"regexp_replace(lower({x}), '\\s+', '', 'g')"
    return f"(CASE WHEN contains({low}, {own(f'substr(n{i}, 1, 15)')}) THEN 3 ELSE 0 END + CASE WHEN contains({low}, {own(f'b{i}')}) THEN 2 ELSE 0 END + CASE WHEN contains({context}, '候选{i}') OR contains({context}, '第{i}') THEN 5 ELSE 0 END)"


def _meant(context: str, what: str) -> str:
    one, two = _points(context, 1), _points(context, 2)
    return f"(CASE WHEN {one} > 0 AND {one} >= {two} THEN {what}1 WHEN {two} > 0 THEN {what}2 END)"


def _any(terms) -> str:
    return "(" + " OR ".join(f"contains(answer, '{x}')" for x in terms) + ")"


_MENTIONS = "(contains(lower(answer), lower(n1)) OR contains(lower(answer), lower(b1)) OR contains(lower(answer), lower(n2)) OR contains(lower(answer), lower(b2)))"
_CLAIMS_SQL = f"""{_ANSWERS_SQL},
    cut AS (SELECT *, regexp_extract_all(answer, '{nlu.PRICE}') AS found, string_split_regex(answer, '{nlu.PRICE}') AS parts FROM ans),
    numbered AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM cut),
    placed AS (SELECT *, length(array_to_string(list_slice(parts, 1, i), '')) + length(array_to_string(list_slice(found, 1, i - 1), '')) AS start, CAST(regexp_extract(found[i], '[0-9]+(?:[.][0-9]+)?') AS DOUBLE) AS claimed FROM numbered),
    claim AS (SELECT *, substr(answer, CAST(greatest(start - 15, 0) + 1 AS INT), CAST(start + length(found[i]) + 15 - greatest(start - 15, 0) AS INT)) AS context, substr(answer, CAST(greatest(start - 2, 0) + 1 AS INT), CAST(least(start, 2) AS INT)) AS before FROM placed),
    price AS (SELECT product_id, i, claimed, before, abs(claimed - {_meant('context', 'p')}) > 0.01 AS wrong, {_meant('context', 'p')} AS actual, round_even(claimed, 0) NOT IN (round_even(p1, 0), round_even(p2, 0)) AS strange FROM claim),
    prices AS (SELECT product_id, coalesce(bool_or(wrong), false) AS wrong, bool_or(strange) AS strange FROM price GROUP BY 1),
    stock AS (SELECT product_id, coalesce(bool_or(CAST(x AS INT) <> actual), false) AS wrong FROM (SELECT product_id, unnest(regexp_extract_all(answer, '{nlu.STOCK}', 1)) AS x, {_meant('answer', 's')} AS actual FROM ans) GROUP BY 1),
    broken AS (SELECT ans.*, list_filter([CASE WHEN NOT {_MENTIONS} AND NOT {_any(nlu.DECLINES)} THEN 'no_product' END, CASE WHEN {_any(nlu.ABSOLUTES)} THEN 'absolute' END, CASE WHEN {_any(nlu.PROMOTIONS)} THEN 'promotion' END, CASE WHEN {_any(nlu.BUSINESS)} THEN 'business' END,
            CASE WHEN prices.wrong THEN 'price' END, CASE WHEN stock.wrong THEN 'stock' END,
            CASE WHEN (regexp_matches(answer, '充足|很多') AND {_meant('answer', 's')} <= 5) OR (regexp_matches(answer, '售罄|断货|卖完') AND {_meant('answer', 's')} > 0) THEN 'status' END, CASE WHEN prices.strange THEN 'ungrounded' END], lambda x: x IS NOT NULL) AS v FROM ans LEFT JOIN prices USING (product_id) LEFT JOIN stock USING (product_id))"""


@query(f"""WITH {_CLAIMS_SQL}, shown AS (SELECT product_id, i, parts[i] AS part, CASE WHEN NOT wrong OR actual IS NULL THEN found[i]
            ELSE regexp_replace(found[i], '[0-9]+([.][0-9]+)?', CASE WHEN NOT contains(found[i], '.') AND floor(actual) = actual THEN CAST(CAST(actual AS BIGINT) AS VARCHAR) ELSE printf('%.2f', actual) END) END AS told
        FROM price JOIN cut USING (product_id)),
    fix AS (SELECT product_id, string_agg(part || told, '' ORDER BY i) || any_value(rest) AS text FROM shown JOIN (SELECT product_id, parts[-1] AS rest FROM cut) USING (product_id) GROUP BY 1),
    stocked AS (SELECT broken.*, coalesce(text, answer) AS priced, {_meant('answer', 's')} AS actual_stock FROM broken LEFT JOIN fix USING (product_id))
    SELECT product_id, array_to_string(v, ',') AS violations, CASE WHEN list_contains(v, 'no_product') THEN 'fallback' WHEN list_has_any(v, ['absolute', 'promotion', 'business']) THEN 'regenerate' WHEN list_has_any(v, ['price', 'stock', 'status', 'ungrounded']) THEN 'auto_correct' ELSE 'pass' END AS action,
        CASE WHEN actual_stock IS NULL THEN priced ELSE regexp_replace(priced, '((库存|现货|剩余|还有|仅剩)\\s*[：:]?\\s*)[0-9]+', '\\1' || actual_stock, 'g') END AS corrected FROM stocked""")
def price_grounding(spark, sf_dir):
    """Every rule that an answer breaks, what is done with it, and its text with wrong prices corrected."""
    a = answers(spark, sf_dir)
    cards = [F.col("a"), F.col("b")]
    v = grounding.violations(F.col("answer"), cards)
    return a.select("product_id", "answer", "a", "b", v.alias("v")).select("product_id", F.array_join("v", ",").alias("violations"), grounding.action(F.col("v")).alias("action"), grounding.corrected(F.col("answer"), cards).alias("corrected"))


@query(f"""WITH {_CLAIMS_SQL}, n AS (SELECT unnest(CASE WHEN len(v) = 0 THEN ['none'] ELSE v END) AS rule FROM broken) SELECT rule, count(*) AS answers FROM n GROUP BY 1""")
def violation_counts(spark, sf_dir):
    """How many answers break each rule."""
    v = grounding.violations(F.col("answer"), [F.col("a"), F.col("b")])
    return answers(spark, sf_dir).select(v.alias("v")).select(F.explode(F.when(F.size("v") == 0, F.array(F.lit("none"))).otherwise(F.col("v"))).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("answers"))


@query(f"""WITH {_ANSWERS_SQL}, c AS (SELECT product_id, answer, list_transform(regexp_extract_all(answer, '{nlu.CITATION}', 1), lambda x: CAST(x AS INT)) AS c FROM ans)
    SELECT product_id, array_to_string(list_filter(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN c[i] BETWEEN 1 AND 2 AND list_position(c, c[i]) = i THEN c[i] END), lambda x: x IS NOT NULL), ',') AS cited,
        CAST(len(list_filter(c, lambda x: x NOT BETWEEN 1 AND 2)) AS INT) AS invented, len(list_filter(c, lambda x: x BETWEEN 1 AND 2)) = 0 AND NOT {_any(nlu.DECLINES)} AS missing FROM c""")
def indexed_citations(spark, sf_dir):
    """The candidates that an answer cites by number, those that are not there, and whether citations are missing."""
    cited, invented = grounding.citations(F.col("answer"), 2)
    own = answers(spark, sf_dir).select("product_id", cited.alias("c"), invented.alias("invented"), grounding.declines(F.col("answer")).alias("declined"))
    return own.select("product_id", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("cited"), "invented", ((F.size("c") == 0) & ~F.col("declined")).alias("missing"))


@query(f"""WITH {_CLAIMS_SQL}, b AS (SELECT *, TRY_CAST(regexp_extract(question, '预算\\s*([0-9]{{3,6}})', 1) AS DOUBLE) AS budget FROM ans),
    s AS (SELECT product_id, bool_or(abs(claimed - p1) > 1 AND abs(claimed - p2) > 1 AND abs(claimed - coalesce(budget, p1)) > 1) AS strange FROM price JOIN b USING (product_id) WHERE NOT regexp_matches(before, '低|贵|便宜|差|省|降|剩') GROUP BY 1),
    w AS (SELECT product_id, word, string_split(answer, word) AS parts FROM ans, (SELECT unnest(['保证', '100%', '百分百', '根治', '治愈', '无副作用', '永久', '全网第一', '行业第一']) AS word) WHERE contains(answer, word)),
    o AS (SELECT product_id, substr(answer, CAST(greatest(at_char - 10, 0) + 1 AS INT), CAST(least(at_char, 10) AS INT)) AS ahead
        FROM (SELECT product_id, list_sum(list_transform(parts[:k], lambda p: length(p))) + (k - 1) * length(word) AS at_char FROM (SELECT *, unnest(range(1, len(parts))) AS k FROM w)) JOIN ans USING (product_id)),
    c AS (SELECT product_id, bool_or(NOT regexp_matches(ahead, '没有|无|无法|不能|不可|不得|未|别|暂不')) AS claims FROM o GROUP BY 1)
    SELECT product_id, coalesce(claims, false) OR coalesce(strange, false) OR NOT (contains(answer, b1) OR contains(answer, b2) OR contains(answer, substr(n1, 1, 6)) OR contains(answer, right(n1, 6)) OR contains(answer, substr(n2, 1, 6)) OR contains(answer, right(n2, 6))) AS bad
    FROM b LEFT JOIN s USING (product_id) LEFT JOIN c USING (product_id)""")
def judged_answers(spark, sf_dir):
    """A judge by rules over every answer: negated claims and the user's budget are exempt."""
    return answers(spark, sf_dir).select("product_id", grounding.judged_bad(F.col("answer"), F.col("question"), [F.col("a"), F.col("b")]).alias("bad"))
