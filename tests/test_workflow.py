"""The chain from raw files to ranked opportunities, on the small test tables."""

from pyspark.sql import functions as F

from tradelattice.plans import workflow as W
from tradelattice.plans.cleaning_queries import payloads
from tradelattice.plans.views import Tables
from tradelattice.sources import slices


def test_chain(spark, data, tmp_path):
    t, raw, out = Tables(spark, data), str(tmp_path / "raw"), str(tmp_path / "out")
    t.raw_exports.write.option("header", True).csv(f"{raw}/exports")
    t.gravity.withColumn("col45", F.col("contig")).write.option("header", True).csv(f"{raw}/gravity")
    t.raw_reporters.write.parquet(f"{raw}/reporters")
    t.raw_partners.write.parquet(f"{raw}/partners")
    payloads(t).write.parquet(f"{raw}/payloads")
    slices.write_slices(t.raw_flows, f"{raw}/slices", "reporterCode", "flowCode", "period", 4, "all")
    settings = W.Settings(export_years=(1996, 2001), gravity_years=(1996, 2001), country="N03", train_end=1999, val_year=2000,
                          test_years=[2001], dim=8, sets={"eu_member": ["N02"]})
    inputs = W.Inputs(f"{raw}/exports", f"{raw}/reporters", f"{raw}/partners", f"{raw}/slices", f"{raw}/gravity", f"{raw}/payloads")
    assert set(W.clean(spark, inputs, out, settings)) == {"country_codes", "exports", "flows", "gravity", "indicators"}
    assert "proximity_matrix" in W.complexity(spark, out, settings=settings)
    W.graph(spark, out, t.products, t.sections, t.countries, 1999, settings)
    results = W.models(spark, out, ["sage", "fastrp"], ["dot_product", "distmult"], settings)
    assert {"density", "cn", "jaccard"} < {r.model for r in results.select("model").distinct().collect()}
    focus = spark.read.parquet(f"{out}/exports").groupBy("iso3").count().orderBy(F.desc("count")).first().iso3
    settings = W.Settings(**{**settings.__dict__, "country": focus})
    W.opportunities(spark, out, t.products, t.countries, 2000, settings)
    top = spark.read.parquet(f"{out}/product_opportunities")
    scored = spark.read.parquet(f"{out}/link_scores").where(f"src = 'country:{focus}' AND year = 2000")
    best = {r.dst.split(":")[1]: r.score for r in scored.collect()}
    assert all(r.score == best[r.hs4] for r in top.collect()) and len(best) >= top.count()
    assert 0 < top.count() <= 50 and top.columns == ["hs4", "product_name", "score", "rank", "density", "pci"]
    markets = spark.read.parquet(f"{out}/market_opportunities")
    assert markets.where("gravity_pred IS NOT NULL").count() > 0
