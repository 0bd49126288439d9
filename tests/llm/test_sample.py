from pyspark.sql import functions as F

from skein.llm.common import bounded_sample


def test_long_texts_do_not_end_a_sample(spark):
    docs = spark.range(200).select("id", F.lit("x" * 10).alias("text"))
    first = [r["id"] for r in docs.orderBy(F.xxhash64("id"), "id").limit(3).collect()]
    sizes = dict(zip(first, (5000, 1900, 600), strict=True))
    text = F.coalesce(*[F.when(F.col("id") == i, F.lit("x" * n)) for i, n in sizes.items()], F.col("text"))
    docs = docs.select(F.col("id").alias("doc_id"), text.alias("text"))
    got = bounded_sample(docs.select("doc_id"), docs, "doc_id", "text", 150, 2000)
    assert len(got) == 150
    # With places left, long texts are taken as far as they fit.
    got = {r[0] for r in bounded_sample(docs.select("doc_id"), docs, "doc_id", "text", 300, 4000)}
    assert len(got) == 198 and first[0] not in got and first[1] in got
    only = docs.where(F.col("doc_id") == first[0])
    assert len(bounded_sample(only.select("doc_id"), only, "doc_id", "text", 5, 2000)) == 1
