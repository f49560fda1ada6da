import pytest
from pyspark.sql import functions as F

from graphloom.functions import geo, text
from graphloom.functions.predicates import P

# Sentences and answers that text predicates are defined by.
FULL = "This world is full of 1funny surprises! A Full Yes"
CASES = [
    (text.text_contains("world"), FULL, True), (text.text_contains("WORLD full"), FULL, True), (text.text_contains("wor"), FULL, False), (text.text_contains("a"), FULL, False),
    (text.text_not_contains("nope"), FULL, True), (text.text_not_contains("world"), None, False), (text.text_contains_prefix("Wor"), FULL, True), (text.text_not_contains_prefix("zz"), FULL, True),
    (text.text_contains_regex("wo[a-z]*"), FULL, True), (text.text_contains_regex("wo"), FULL, False), (text.text_not_contains_regex("wo"), FULL, True),
    (text.text_contains_phrase("full of 1funny"), FULL, True), (text.text_contains_phrase("full 1funny"), FULL, False), (text.text_not_contains_phrase("x y"), FULL, True), (text.text_not_contains_phrase("xx yy"), FULL, True),
    (text.text_prefix("fully"), "fully funny", True), (text.text_prefix("Fully"), "fully funny", False), (text.text_not_prefix("ful"), None, False),
    (text.text_regex("(fu[ln]*y) (fu[ln]*y)"), "fully funny", True), (text.text_regex("(fu[l]*y) (fu[l]*y)"), "fully funny", False), (text.text_not_regex("f"), "fully", True),
    (text.text_fuzzy("fuly fuzy"), "fully funny", False), (text.text_fuzzy("ah"), "ah", True), (text.text_fuzzy("ai"), "ah", False), (text.text_fuzzy("hob"), "hop", True), (text.text_fuzzy("surprize"), "surprises", True),
    (text.text_not_fuzzy("surprize"), "surprises", False), (text.text_contains_fuzzy("surprize"), FULL, True), (text.text_not_contains_fuzzy("zzzz"), FULL, True),
    (P.starting_with("fu"), "fully", True), (P.ending_with("y").negate(), "fully", False), (P.containing("ll").negate(), None, False),
]


def answers(spark, cases, kind):
    d = spark.createDataFrame([(i, v) for i, (_, v, _) in enumerate(cases)], f"i int, v {kind}")
    out = F.lit(None).cast("boolean")
    for i, (p, _, _) in enumerate(cases):
        out = F.when(F.col("i") == i, p.column(F.col("v"), kind)).otherwise(out)
    return [r[0] for r in d.select(out.alias("x"), "i").orderBy("i").collect()]


def test_text(spark):
    assert answers(spark, CASES, "string") == [w for *_, w in CASES]
    with pytest.raises(ValueError):
        text.text_contains(" ").column(F.lit("x"))


def test_comparisons_and_absence(spark):
    nan = float("nan")
    cases = [
        (P.eq(1.0), 1.0, True), (P.neq(1.0), None, False), (P.neq(1.0).negate(), None, False), (~P.gt(1.0), None, False), (P.gt(1.0), nan, False), (P.lt(1.0), nan, False), (P.eq(nan), nan, True),
        (P.within([]), 1.0, False), (P.without([]), 1.0, True), (P.without([]), None, False), (P.inside(1, 2), 1.0, False), (P.between(1, 2), 1.0, True), (P.between(1, 2), 2.0, False), (P.outside(1, 2), 3.0, True),
        (~(P.lt(1) | P.gt(2)), 1.5, True), (~(P.lt(1) | P.gt(2)), None, False), (P.eq(None), None, True), (P.neq(None), None, False), (P.gt(1).and_(P.lt(3)).negate(), 5.0, True),
    ]
    assert answers(spark, cases, "double") == [w for *_, w in cases]


def test_shapes(spark):
    square = geo.polygon((0, 0), (0, 10), (10, 10), (10, 0))
    for s in (geo.point(1, 2), geo.circle(1, 2, 30), geo.box(0, 1, 2, 3), geo.line((0, 0), (1, 1)), square, geo.multi(geo.point(1, 2), square)):
        assert geo.geoshape(s.wkt()) == s
        if s.kind != "box":
            assert geo.geoshape(s.geojson()) == s
    assert geo.geoshape("1, 2") == geo.point(1, 2) and geo.geoshape([1, 2, 3]) == geo.circle(1, 2, 3)
    assert geo.within(geo.point(5, 5), square) and not geo.within(geo.point(11, 5), square)
    assert geo.intersects(geo.line((-5, 5), (15, 5)), square) and not geo.intersects(geo.circle(20, 20, 100), square)
    assert geo.within(geo.box(1, 1, 2, 2), square) and not geo.within(geo.box(1, 1, 12, 2), square)
    d = spark.createDataFrame([(geo.box(1, 1, 2, 2).wkt(),), (geo.point(50, 50).wkt(),), (None,)], "s string")
    got = [tuple(r) for r in d.select(geo.geo_within(square).column(F.col("s")), geo.geo_disjoint(square).column(F.col("s")), geo.geo_contains(geo.point(1.5, 1.5)).column(F.col("s"))).collect()]
    assert got == [(True, False, True), (False, True, False), (False, False, False)]
    with pytest.raises(ValueError):
        geo.point(100, 0)
