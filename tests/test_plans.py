"""Plans that should stay as they are: pushed filters, pruned columns, no needless shuffles or Python."""

from lexigraph import queries as core
from lexigraph.plans.inspect import summary

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return summary(core.queries()[name](spark, SF))


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(spark, "p04_equality_filter")
    assert "EqualTo(o_orderstatus,F)" in p["pushed"][0]
    assert p["read"] == ["o_orderkey:bigint,o_orderstatus:string,o_totalprice:double"]
    assert p["exchanges"] == 0


def test_group_count_shuffles_once(spark):
    p = plan(spark, "a01_group_count")
    assert p["exchanges"] == 1 and p["read"] == ["source:string"]


def test_dot_products_stay_in_the_jvm(spark):
    for name in ("a21_cohesion", "i24_silhouette", "w08_transitions", "f12_detect_language"):
        assert plan(spark, name)["python"] == 0


def test_cohesion_has_no_pairs(spark):
    p = plan(spark, "a21_cohesion")
    assert p["cartesian"] == 0 and p["exchanges"] <= 2
