from pyspark.sql import functions as F

from sessionflow.queries import cohort


def test_permutation_is_over_all_orders(spark, sf):
    """The observed difference is that of all orders; the p-value is a count of 1001."""
    got = cohort.permutation(spark, sf).first()
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").cast("double").alias("p"))
    cpi = cohort.news_rows(spark, sf).where("event_type = 'CPI'")
    on = {r[0] for r in cpi.select(F.to_date(cpi["dt_et"])).collect()} if "dt_et" in cpi.columns else None
    price = {r["date"]: r["p"] for r in orders.groupBy("date").agg(F.avg("p").alias("p")).collect()}
    if on is not None:
        links = cohort.calendar.event_links(orders.select("date").distinct(), cohort.news_rows(spark, sf)).where("event_type = 'CPI'")
        nxt = {r["date"] for r in links.collect()} - on
        a, b = [p for d, p in price.items() if d in on], [p for d, p in price.items() if d not in on | nxt]
        assert abs(got["difference"] - (sum(a) / len(a) - sum(b) / len(b))) < 1e-6 * abs(got["difference"]) + 1e-6
    hits = got["p_value"] * 1001
    assert abs(hits - round(hits)) < 1e-6
