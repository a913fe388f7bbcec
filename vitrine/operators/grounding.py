"""Whether an answer says what its cards say: prices, stock, citations, claims; all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import language as nlu


def plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"\s+", "")


def meant(context: Column, cards: list[Column]) -> Column:
    """Which card (from 1) a passage is about: 5 points for its number, 3 for its name, 2 for its brand; null if none has any."""

    def points(card: Column, i: int) -> Column:
        named = F.contains(plain(context), plain(F.substring(card["name"], 1, 15)))
        numbered = F.contains(context, F.lit(f"候选{i}")) | F.contains(context, F.lit(f"第{i}"))
        return named.cast("int") * 3 + F.contains(plain(context), plain(card["brand"])).cast("int") * 2 + numbered.cast("int") * 5

    best = F.array_max(F.array(*[F.struct(points(c, i).alias("n"), F.lit(-i).alias("minus")) for i, c in enumerate(cards, 1)]))
    return F.when(best["n"] > 0, -best["minus"])


def wrong_prices(answer: Column, cards: list[Column]) -> Column:
    """Prices that differ from the price of the card that they are about: array of (price, actual)."""
    rows = F.array(*cards)
    told = F.transform(nlu.price_contexts(answer), lambda p: F.struct(p["price"].alias("price"), F.try_element_at(rows, meant(p["context"], cards))["price"].alias("actual")))
    return F.filter(told, lambda p: F.abs(p["actual"] - p["price"]) > 0.01)


def wrong_stock(answer: Column, cards: list[Column]) -> Column:
    """Numbers in stock that differ from those of the card that the answer is about."""
    rows = F.array(*cards)
    told = F.transform(F.regexp_extract_all(answer, F.lit(nlu.STOCK), F.lit(1)), lambda x: x.try_cast("int"))
    actual = F.try_element_at(rows, meant(answer, cards))["stock"]
    return F.filter(told, lambda n: n.isNotNull() & (n != actual))


def wrong_status(answer: Column, cards: list[Column]) -> Column:
    """Whether an answer says that there is plenty where five or fewer are left, or nothing where something is."""
    actual = F.try_element_at(F.array(*cards), meant(answer, cards))["stock"]
    said = lambda words: F.size(nlu.matched_terms(answer, words)) > 0
    return F.coalesce((said(nlu.PLENTY) & (actual <= 5)) | (said(nlu.NOTHING_LEFT) & (actual > 0)), F.lit(False))


def ungrounded_prices(answer: Column, cards: list[Column]) -> Column:
    """Prices that, in whole units, no card has."""
    known = F.array(*[F.bround(c["price"], 0) for c in cards])
    return F.filter(F.transform(nlu.price_contexts(answer), lambda p: p["price"]), lambda p: ~F.array_contains(known, F.bround(p, 0)))


def declines(answer: Column) -> Column:
    return F.size(nlu.matched_terms(answer, nlu.DECLINES)) > 0


def mentions(answer: Column, cards: list[Column]) -> Column:
    """Whether a card's name or brand is in the answer."""
    found = F.lit(False)
    for c in cards:
        found = found | F.contains(F.lower(answer), F.lower(c["name"])) | F.contains(F.lower(answer), F.lower(c["brand"]))
    return found


def violations(answer: Column, cards: list[Column]) -> Column:
    """Names of the rules that an answer breaks, in a fixed order."""
    return F.array_compact(
        F.array(
            F.when(~mentions(answer, cards) & ~declines(answer), "no_product"),
            F.when(F.size(nlu.matched_terms(answer, nlu.ABSOLUTES)) > 0, "absolute"),
            F.when(F.size(nlu.matched_terms(answer, nlu.PROMOTIONS)) > 0, "promotion"),
            F.when(F.size(nlu.matched_terms(answer, nlu.BUSINESS)) > 0, "business"),
            F.when(F.size(wrong_prices(answer, cards)) > 0, "price"),
            F.when(F.size(wrong_stock(answer, cards)) > 0, "stock"),
            F.when(wrong_status(answer, cards), "status"),
            F.when(F.size(ungrounded_prices(answer, cards)) > 0, "ungrounded"),
        )
    )


def action(broken: Column) -> Column:
    """What to do with an answer: nothing fits, ask again, correct it, or let it pass."""
    has = lambda *names: F.arrays_overlap(broken, F.array(*map(F.lit, names)))
    return F.when(has("no_product"), "fallback").when(has("absolute", "promotion", "business"), "regenerate").when(has("price", "stock", "status", "ungrounded"), "auto_correct").otherwise("pass")


def corrected(answer: Column, cards: list[Column]) -> Column:
    """The answer with each wrong claim of a price or of stock set right where it stands, the last one first.

    Other numbers stay, though they look alike. A price is written as the answer writes it: without
    decimals where it had none and needs none, else with two.
    """
    rows = F.array(*cards)
    told = F.transform(nlu.price_contexts(answer), lambda p: F.struct(p["start"].alias("start"), p["found"].alias("found"), p["price"].alias("price"), F.try_element_at(rows, meant(p["context"], cards))["price"].alias("actual")))
    wrong = F.filter(told, lambda p: F.abs(p["actual"] - p["price"]) > 0.01)

    def put(text: Column, p: Column) -> Column:
        whole = ~F.contains(p["found"], F.lit(".")) & (F.bround(p["actual"], 0) == p["actual"])
        shown = F.when(whole, p["actual"].cast("long").cast("string")).otherwise(F.format_string("%.2f", p["actual"]))
        right = F.regexp_replace(p["found"], r"[0-9]+(?:[.][0-9]+)?", shown)
        return F.concat(F.substring(text, F.lit(1), p["start"]), right, F.substring(text, p["start"] + F.length(p["found"]) + 1, F.length(text)))

    priced = F.aggregate(F.reverse(wrong), answer, put)
    stock = F.try_element_at(rows, meant(answer, cards))["stock"]
    # All claims about stock are about the card that the answer is about.
    return F.when(stock.isNull(), priced).otherwise(F.regexp_replace(priced, F.lit(nlu.STOCK_NUMBER), F.concat(F.lit("$1"), stock.cast("string"))))


def citations(answer: Column, cards: int) -> tuple[Column, Column]:
    """Candidates that an answer cites, each once in order, and how many it cites that are not there."""
    cited = F.transform(F.regexp_extract_all(answer, F.lit(nlu.CITATION), F.lit(1)), lambda x: x.cast("int"))
    there = lambda n: (n >= 1) & (n <= cards)
    return F.array_distinct(F.filter(cited, there)), F.size(F.filter(cited, lambda n: ~there(n)))


def claims_too_much(answer: Column) -> Column:
    """Whether a word of an absolute claim stands without a negation in the ten characters before it."""
    far = lambda w: f"(?<!{w}.{{0,{10 - len(w)}}})"
    return answer.rlike("(?s)" + "".join(map(far, nlu.NEGATIONS)) + "(?:" + "|".join(nlu.ABSOLUTES) + ")")


def named(answer: Column, cards: list[Column]) -> Column:
    """Whether a card's brand, or the first or last six characters of its name, are in the answer."""
    found = F.lit(False)
    for c in cards:
        for part in (c["brand"], F.substring(c["name"], 1, 6), F.right(c["name"], F.lit(6))):
            found = found | F.coalesce((part != "") & F.contains(answer, part), F.lit(False))
    return found


def judged_bad(answer: Column, question: Column, cards: list[Column]) -> Column:
    """A judge by rules: a claim that is not negated, a price that neither a card nor the budget is near, or no card named."""
    budget = F.regexp_extract(question, r"预算\s*([0-9]{3,6})", 1).try_cast("double")
    known = F.array(*[c["price"] for c in cards], F.coalesce(budget, cards[0]["price"]))
    offers = F.filter(nlu.price_contexts(answer), lambda p: ~p["before"].rlike("|".join(nlu.DIFFERENCES)))
    strange = F.exists(offers, lambda p: ~F.exists(known, lambda k: F.abs(k - p["price"]) <= 1.0))
    return claims_too_much(answer) | strange | ~named(answer, cards)
