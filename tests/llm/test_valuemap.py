import pytest

from lanternway.llm import valuemap as V

REF = [
    ("highway", "motorway", ["expressway", "freeway"]), ("highway", "motorway_link", ["motorway ramp"]), ("highway", "primary", ["primary road"]), ("highway", "primary_link", ["primary ramp"]),
    ("highway", "residential", ["residential street"]), ("highway", "living_street", ["home zone"]), ("highway", "road", ["road of unknown class"]), ("highway", "steps", ["stairs", "staircase"]),
    ("highway", "path", None), ("highway", "service", ["service road", "driveway"]), ("highway", "footway", ["sidewalk", "footpath"]), ("highway", "track", ["farm track"]),
    ("oneway", "yes", ["true", "1"]), ("oneway", "no", ["false", "0", "both ways"]), ("oneway", "-1", ["reverse", "backward"]),
]
WANT = {
    ("highway", "MOTORWAY "): "motorway", ("highway", "Link (motorway)"): "motorway_link", ("highway", "prim. link"): "primary_link", ("highway", "primar yroad"): "primary", ("highway", "K: staircade"): "steps",
    ("highway", "livins  treet"): "living_street", ("highway", "living str."): "living_street", ("highway", "Resident."): "residential", ("highway", "stеps"): "steps", ("highway", "ｆｏｏｔｗａｙ"): "footway",
    ("highway", "road or path?"): "unmatched", ("highway", "residential/service ??"): "unmatched", ("highway", "steps, later footway"): "unmatched", ("highway", "not a way"): "unmatched", ("highway", "FIXME: check on foot"): "unmatched",
    ("highway", "steps, 3.5 m wide"): "steps", ("highway", "Road NE side"): "road", ("highway", "mostly track"): "track", ("highway", "service [checked]"): "service", ("highway", "road of unknown tclass"): "road", ("highway", "elevator"): "unmatched", ("highway", ""): "unmatched",
    ("oneway", "–1"): "-1", ("oneway", "- 1"): "-1", ("oneway", "1.0"): "yes", ("oneway", "no (sign gone)"): "no", ("oneway", "no idea"): "unmatched", ("oneway", "YES/NO"): "unmatched", ("oneway", "Yse"): "yes", ("oneway", "flase"): "no",
    ("oneway", "#N/A"): "unmatched", ("oneway", "backward only"): "-1", ("oneway", "boht ways"): "no", ("colour", "red"): "unmatched", ("highway", "word " * 3000): "unmatched", ("highway", "x" * 20000): "unmatched",
}


def test_values(spark):
    values = spark.createDataFrame([(k, v, "c") for k, v in WANT] * 2 + [("highway", None, "c"), (None, "road", "c")], "tag_key string, value string, canonical string")
    got = V.map_values(values, spark.createDataFrame(REF, "tag_key string, canonical string, aliases array<string>")).collect()
    assert len(got) == len(WANT)
    assert {(r.tag_key, r.value): r.canonical for r in got} == WANT


def test_empty(spark):
    none = spark.createDataFrame([], "tag_key string, canonical string, aliases array<string>")
    values = spark.createDataFrame([("highway", "road")], "tag_key string, value string")
    assert [r.canonical for r in V.map_values(values, none).collect()] == ["unmatched"]
    assert V.map_values(values.limit(0), spark.createDataFrame(REF, none.schema)).count() == 0


@pytest.mark.parametrize("threshold", [0.39, 0.6])
def test_join_equals_all_pairs(spark, threshold):
    words = ["road", "roda", "path", "payh", "steps", "step", "track", "trunk", "truck", "residential", "resodetial", "", "aaaa", "aa", "primaryroad", "primarroad"]
    forms = ["road", "path", "steps", "track", "trunk", "residential", "primaryroad", "aa"]
    left, right = spark.createDataFrame([("k", w) for w in words], "tag_key string, text string"), spark.createDataFrame([("k", f) for f in forms], "tag_key string, form string")
    sets = {w: set(V.token_set(w)) for w in words + forms}
    want = {(w, f) for w in words for f in forms if len(sets[w] & sets[f]) / len(sets[w] | sets[f]) >= threshold}
    assert {(r.text, r.form) for r in V.similar_pairs(left, right, threshold).collect()} == want


def test_distance():
    assert [V.distance(a, b) for a, b in (("road", "roda"), ("yes", "yse"), ("abc", "abc"), ("", "ab"), ("kitten", "sitting"), ("a" * 50, "b"))] == [1, 1, 0, 2, 3, 5]
