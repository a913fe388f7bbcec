"""Values that the operators are known to give."""

import json

from pyspark.sql import functions as F

from vitrine import sources
from vitrine.functions import text as t
from vitrine.operators import commerce, filters, language, state


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v"))).first()[0]


def test_bundle_keeps_the_budget(spark):
    rows = [("shoes", 1, 900.0, 50.0), ("shoes", 2, 399.0, 30.0), ("pants", 3, 299.0, 20.0)]
    cards = spark.createDataFrame(rows, "slot string, product_id long, price double, score double")
    best = commerce.bundles(cards, [commerce.Slot("shoes"), commerce.Slot("pants")], 700.0).first()
    assert (best.shoes_id, best.pants_id, best.total) == (2, 3, 698.0)


def test_bundle_leaves_an_optional_slot_empty(spark):
    rows = [("need", 1, 170.0, 10.0), ("extra", 2, 3999.0, 100.0)]
    cards = spark.createDataFrame(rows, "slot string, product_id long, price double, score double")
    best = commerce.bundles(cards, [commerce.Slot("need"), commerce.Slot("extra", optional=True)], 500.0).first()
    assert (best.need_id, best.extra_id, best.total) == (1, None, 170.0)


def test_numerals(spark):
    for text, value in (("两", 2), ("十一", 11), ("二十五", 25), ("一百零二", 102), ("１２", 12), ("x", None)):
        assert one(spark, text, language.number) == value


def test_messages(spark):
    assert one(spark, "来三瓶咖啡", language.quantity) == 3
    assert one(spark, "第10款", language.ordinal) == 9
    assert one(spark, "第10款", language.quantity) is None
    assert one(spark, "少两瓶", language.delta) == -2
    assert one(spark, "买500g咖啡豆", language.quantity) is None
    assert one(spark, "买500g咖啡豆", language.measure) == 500.0


def test_edits(spark):
    assert one(spark, "kitten", lambda c: t.within_edits(c, F.lit("sitting"), 2)) == 3
    assert one(spark, "kitten", lambda c: t.within_edits(c, F.lit("mitten"), 2)) == 1


def test_cause_of_nothing(spark):
    steps = spark.createDataFrame([("recall", 0, 8), ("RangeFilter", 1, 0), ("StockFilter", 2, 0)], "step string, position long, count long")
    assert [r.step for r in filters.zero_cause(steps).collect()] == ["RangeFilter"]


def test_facets(spark):
    rows = spark.createDataFrame([(1, 800.0, ["a"]), (2, 950.0, ["a"]), (3, 100.0, ["b"]), (4, 100.0, ["c"])], "id long, price double, tags array<string>")
    spec = filters.SearchSpec(max_price=900.0, types=("a", "b"))
    found = rows.where(filters.range_filter(spec) & filters.type_filter(spec)).collect()
    assert sorted(r.id for r in found) == [1, 3]


def test_clamped_level_equals_a_loop(spark):
    changes = [3, -5, 2, -1, -4, 7, -2, -2, -9, 1]
    rows = spark.createDataFrame(list(enumerate(changes)), "at long, change long").withColumn("key", F.lit(1))
    got = [r.level for r in state.clamped(rows, ["key"], [F.col("at")], "change").orderBy("at").collect()]
    level, want = 0, []
    for c in changes:
        level = max(0, level + c)
        want.append(level)
    assert got == want


def test_sources(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"id": "p1", "name": "Ring", "tags": ["a", "b"]}, {"id": "p2", "name": "Bolt", "price": 2.5}]))
    products = sources.read_catalog(spark, str(tmp_path / "c.json"))
    assert {r.id: (r.price, r.stock) for r in products.collect()} == {"p1": (0.0, 0), "p2": (2.5, 0)}
    assert {r.id: r.text for r in sources.documents_from_products(products).collect()}["p1"] == "ring a b"
    logs = spark.createDataFrame([(1, "x" * 30), (2, "y")], "at long, message string")
    sources.append_jsonl(logs, str(tmp_path / "log"), "message", most=5)
    (tmp_path / "log" / "bad.json").write_text("{not json\n")
    assert [tuple(r) for r in sources.read_jsonl_tail(spark, str(tmp_path / "log"), "at long, message string", "at", 1).collect()] == [(2, "y")]
    assert {r.message for r in sources.read_jsonl(spark, str(tmp_path / "log"), "at long, message string").collect()} == {"xxxxx", "y"}


def test_zipped_json(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("b.json", json.dumps([{"id": "2"}, {"id": "3"}]))
        z.writestr("a.json", json.dumps({"id": "1"}))
        z.writestr("c.txt", "not json")
    rows = sources.zipped_json(spark, str(tmp_path / "a.zip"), "id string").collect()
    assert [(r.member, r.id) for r in sorted(rows)] == [("a.json", "1"), ("b.json", "2"), ("b.json", "3")]


def test_products_of_a_locale(spark, tmp_path):
    rows = [("a", "us", 1), ("b", "us", 2), ("c", "de", 3)]
    spark.createDataFrame(rows, "product_id string, product_locale string, n int").write.parquet(str(tmp_path / "p"))
    assert {r.n for r in sources.read_products(spark, str(tmp_path / "p"), "us").collect()} == {1, 2}
    asked = sources.read_products(spark, str(tmp_path / "p"), "us", ["b", "c"])
    assert [r.n for r in asked.collect()] == [2]


def test_index_round_trip(spark, sf, tmp_path):
    """Written and read again, an index gives the same frequencies; a term's lookup is pushed to the files."""
    from vitrine.operators import ranking
    from vitrine.session import table

    index = ranking.postings(table(spark, sf, "documents"), "doc_id", "text")
    sources.write_index(index, str(tmp_path / "index"))
    again = sources.read_index(spark, str(tmp_path / "index"))
    assert again.exceptAll(index.select(*again.columns)).isEmpty() and again.count() == index.count()
    term = index.groupBy("term").count().orderBy(F.desc("count"), "term").first()
    assert again.where(F.col("term") == term.term).count() == term["count"]


def test_answers(spark):
    from vitrine.operators import grounding

    row = [("Lamp A", "Acme", 100.0, 3, "Lamp B", "Bolt", 50.0, 0)]
    cards = spark.createDataFrame(row, "n1 string, b1 string, p1 double, s1 int, n2 string, b2 string, p2 double, s2 int")
    own = [F.struct(F.col(f"n{i}").alias("name"), F.col(f"b{i}").alias("brand"), F.col(f"p{i}").alias("price"), F.col(f"s{i}").alias("stock")) for i in (1, 2)]
    tell = lambda text: cards.select(grounding.violations(F.lit(text), own)).first()[0]
    assert tell("推荐 Lamp A，价格：100，库存 3 件") == []
    assert tell("推荐 Lamp A，价格：90") == ["price", "ungrounded"]
    assert tell("Lamp B 还有 2 件") == ["stock"]
    assert tell("这是好东西") == ["no_product"] and tell("没有找到") == []
    assert tell("Lamp A 保证好，有优惠券，现货") == ["absolute", "promotion", "business"]
    cited, invented = grounding.citations(F.lit("【候选1】【候选2】【候选1】【候选7】"), 2)
    assert tuple(cards.select(cited, invented).first()) == ([1, 2], 1)


def test_more_messages(spark):
    assert one(spark, "改成3", language.quantity) == 3
    assert one(spark, "buy 4 bottles", language.quantity) == 4
    assert one(spark, "一百二", language.number) == 102 and one(spark, "百", language.number) == 100 and one(spark, "二三", language.number) is None
    assert one(spark, "第2款来3件", language.quantity) == 3
    assert one(spark, "加入购物车，加2个", language.delta) is None
    assert one(spark, "手机1000元左右", lambda c: F.array(*language.price_bounds(c))) == [800.0, 1200.0]
    assert one(spark, "不要含酒精的，三星不要了", language.exclusions) == ["酒精", "三星"]
