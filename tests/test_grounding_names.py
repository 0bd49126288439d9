from pyspark.sql import functions as F

from skein.operators.claims import grounding_failure


def test_names_beyond_the_fiftieth_are_checked(spark):
    names = " ".join(f"Name{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(50))
    df = spark.createDataFrame([(f"said {names} Absentee", f"said {names}")], "value string, source string")
    assert df.select(grounding_failure(F.col("value"), F.col("source"))).first()[0] == "name not in source"
