from pyspark.sql import functions as F

from lanternway.llm import stuffing as S


def test_all_pages_are_learnt_from(spark):
    """A language of few pages among very many is learnt, and a word's lists count although they stand in other batches than its sentences."""
    many = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("page").alias("text"), F.lit("zz").alias("lang"))
    said = lambda word: F.concat_ws(" ", *[x for k in range(3) for x in (F.lit(word), F.concat(F.lit("n"), F.translate((F.col("id") * 3 + k).cast("string"), "0123456789", "abcdefghij")))]).alias("text")
    few = lambda start, lang, text: spark.range(start, start + 120, 1, 1).select(F.col("id").alias("doc_id"), text, F.lit(lang).alias("lang"))
    sentence = F.concat(said("qer"), F.lit(".")).alias("text")
    assert S.learn_clause_words(many.unionByName(few(100_000, "yy", sentence))) == {"qer"}
    assert S.learn_clause_words(few(100_000, "yy", sentence).unionByName(few(200_000, "yy", F.lit("qer").alias("text")))) == frozenset()
