from lanternway.llm import valuemap as V

REF = [("highway", "steps", ["stairs"]), ("highway", "road", ["a road of which no one knows the class"])]
WANT = {"tsaisr": "steps", "stxixs": "steps", "a road of which no one knows the class": "road", "road of which no one knows the clas": "road", "elevator": "unmatched"}


def test_two_slips_in_six_letters_and_forms_of_many_words(spark):
    values = spark.createDataFrame([("highway", v) for v in WANT], "tag_key string, value string")
    got = V.map_values(values, spark.createDataFrame(REF, "tag_key string, canonical string, aliases array<string>")).collect()
    assert {r.value: r.canonical for r in got} == WANT
