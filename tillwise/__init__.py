"""Retail analytics on Spark: cleaning, KPI views, reports and churn, cluster and forecast jobs."""
