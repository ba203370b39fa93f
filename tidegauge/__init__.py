"""tidegauge: market-stream analytics written as Spark DataFrame transformations."""
