"""The factor pipeline from files to a report."""

from factorlake.plans import pipeline
from factorlake.sources import market


def test_factor_pipeline(spark, tmp_path):
    market.synthetic_panel(spark, 6, 80).write.parquet(f"{tmp_path}/bars")
    report = pipeline.run(spark, f"{tmp_path}/bars", None, f"{tmp_path}/out", horizon=5, top=10, least_ic=0.0, least_icir=0.0).collect()
    assert [r["rank"] for r in report] == list(range(1, 11))
    assert spark.read.parquet(f"{tmp_path}/out/validated").count() == 480
    assert spark.read.json(f"{tmp_path}/out/scores").count() == 175  # 59 + 41 + 34 + 42, one name twice
