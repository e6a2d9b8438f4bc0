"""Languages whose rows are mostly empty or very short are learned."""

from collections import Counter

from pyspark.sql import functions as F

from rowferry.llm import langid


def test_empty_and_short_texts_take_no_places(spark):
    ids = spark.range(3000).withColumnRenamed("id", "doc_id")
    long = F.concat(F.lit("row "), F.col("doc_id").cast("string"), F.lit(" of a language whose rows are mostly empty"))
    empty = F.when(F.col("doc_id") % 3 == 0, F.lit("")).when(F.col("doc_id") % 3 == 1, F.lit("12 34")).otherwise(F.lit("ab"))
    sparse = ids.select("doc_id", F.when(F.col("doc_id") % 50 == 0, long).otherwise(empty).alias("text"), F.lit("aa").alias("lang"))
    short = ids.select("doc_id", F.concat(F.lit("tiny "), F.col("doc_id").cast("string")).alias("text"), F.lit("bb").alias("lang"))
    docs = sparse.unionByName(short)
    data, targets, languages = langid.sample(docs, "doc_id", "text", "lang", 30)
    assert languages == ["aa", "bb"]
    learned = Counter(targets.tolist())
    assert learned[0] >= 30 and learned[1] == 30
    assert all(langid.LETTER[w].sum() >= langid.FULL for w in data[targets == 0])
