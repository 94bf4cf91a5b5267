"""Parts-catalogue analytics on Spark: DataFrame operators, query plans and streaming jobs."""
