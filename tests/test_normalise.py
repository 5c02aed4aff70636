"""House words: a company's own on top of those that all share."""

from concordat.functions import normalise


def words(spark, entries):
    house = normalise.house_words(spark.createDataFrame(entries, "company string, word string, meaning string, active boolean"))
    rows = spark.createDataFrame([(1, "east"), (2, "north"), (3, None)], "id int, company string").selectExpr("id", "company", "'zzq valve brg' as description", "cast(null as string) as uom")
    return {r["id"]: r["norm_text"] for r in normalise.normalise_rows(rows, house=house).collect()}


def test_shared_words_reach_everyone(spark):
    got = words(spark, [(None, "zzq", "FLANGED", True), ("east", "brg", "BIG RING", True)])
    assert got[1] == "FLANGED VALVE BIG RING"
    assert got[2] == got[3] and got[2].startswith("FLANGED VALVE") and "BIG RING" not in got[2]


def test_own_word_goes_first_and_inactive_ones_not_at_all(spark):
    got = words(spark, [(None, "ZZQ", "FLANGED", True), ("east", "zzq", "EASTERN", True), ("north", "zzq", "NORTHERN", False)])
    assert got[1].startswith("EASTERN") and got[2].startswith("FLANGED") and got[3].startswith("FLANGED")


def test_no_shared_words(spark):
    got = words(spark, [("east", "zzq", "EASTERN", True)])
    assert got[1].startswith("EASTERN") and got[2].startswith("ZZQ") and got[3].startswith("ZZQ")
