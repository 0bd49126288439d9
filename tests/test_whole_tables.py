from skein.plans import registry


def test_greedy_queries_take_whole_tables(spark, sf_dir):
    q = registry.queries()
    assert q["greedy_leader_cluster"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/part.parquet").count()
    assert q["greedy_claim_groups"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()


def test_entity_scanner_takes_all_languages(spark, sf_dir):
    found = registry.queries()["entity_scanner"](spark, sf_dir)
    langs = {r["lang"] for r in found.join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").select("lang").distinct().collect()}
    assert langs > {"en"}
