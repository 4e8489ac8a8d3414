"""A Spark-native SQL gateway: catalog discovery, gated and paged reads, writes,
DDL and plan inspection over one SparkSession."""
