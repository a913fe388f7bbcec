"""Cases that were answered wrongly: claims set right where they stand, negations, bare ranges, nested JSON, refusals."""

import pytest
from pyspark.sql import functions as F

from vitrine.operators import catalogue, grounding, language


@pytest.fixture(scope="module")
def cards():
    card = lambda name, brand, price, stock: F.struct(F.lit(name).alias("name"), F.lit(brand).alias("brand"), F.lit(price).alias("price"), F.lit(stock).alias("stock"))
    return [card("soft coat", "Brand#1", 938.0, 3), card("warm hat", "Brand#2", 99.5, 40)]


def answers(spark, column, texts, name="t"):
    rows = {r.t: r.out for r in spark.createDataFrame([(t,) for t in texts], f"{name} string").select(name, column(F.col(name)).alias("out")).collect()}
    return [rows[t] for t in texts]


def test_claims_are_set_right_in_place(spark, cards):
    cases = {
        "soft coat 只要¥945": "soft coat 只要¥938",
        "soft coat 945元, 编号 945.00": "soft coat 938元, 编号 945.00",
        "编号 945.00 soft coat 价格：945.00": "编号 945.00 soft coat 价格：938.00",
        "warm hat 约：120元": "warm hat 约：99.50元",
        "soft coat ¥938，库存 12 件，还有9台": "soft coat ¥938，库存 3 件，还有3台",
        "【候选2】warm hat ¥1，¥2。": "【候选2】warm hat ¥99.50，¥99.50。",
        "无关 945元": "无关 945元",
        "": "",
    }
    got = answers(spark, lambda t: grounding.corrected(t, cards), list(cases))
    assert dict(zip(cases, got, strict=True)) == cases


def test_each_claim_has_its_own_negation(spark):
    cases = {"不能保证，保证好": False, "保证好": True, "不能保证": False, "未必可以说是保证": False, "没有人这样说过的一句话是永久": True, "别说永久，但是这一件的确是一件根治的": True, "好": False}
    assert dict(zip(cases, answers(spark, grounding.claims_too_much, list(cases)), strict=True)) == cases


def test_status_of_stock(spark, cards):
    cases = {"soft coat 货很多": True, "warm hat 货很多": False, "warm hat 售罄": True, "soft coat": False, "货很多": False}
    assert dict(zip(cases, answers(spark, lambda t: grounding.wrong_status(t, cards), list(cases)), strict=True)) == cases


def test_bare_ranges_are_no_prices(spark):
    bounds = lambda t: F.struct(*language.price_bounds(t))
    cases = {"3-5天到货": (None, None), "买10到20个": (None, None), "预算300": (None, 300.0), "100元以上200元以内": (100.0, 200.0), "3-5天到货，500元左右": (400.0, 600.0)}
    assert [tuple(x) for x in answers(spark, bounds, list(cases))] == list(cases.values())


def test_nested_json(spark):
    cases = {
        'x {"a": {"b": {}}} y': '{"a": {"b": {}}}',
        'x {not} {"a": "}{\\""} {"b": 1}': '{"a": "}{\\""}',
        '{"a": [1, {"b": 2}], ': '{"b": 2}',
        "{" * 200 + "}": "{}",
        "none": None,
        '{"a": 1': None,
        "": None,
        None: None,
    }
    assert answers(spark, catalogue.first_json, list(cases)) == list(cases.values())


def test_refusals(spark):
    cases = {"不要三星的": ["三星"], "那个蓝牙耳机先不要了": ["那个蓝牙耳机"], "苹果手机这款的不要，华为耳机算了": ["苹果手机", "华为耳机"], "我的旧手机不要了": [], "除了含酒精的吧，其他都行": ["酒精的"], "这是一个非常非常非常长的名字的商品不要": [], "好": []}
    assert dict(zip(cases, answers(spark, language.exclusions, list(cases)), strict=True)) == cases
    carts = {"加入购物车": "add", "看看购物车": "view", "全部删除": "clear", "删掉第二个": "remove", "好的": None, "去结算": "checkout", "数量改成3": "update_quantity"}
    assert dict(zip(carts, answers(spark, language.cart_action, list(carts)), strict=True)) == carts
