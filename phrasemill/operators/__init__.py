"""DataFrame to DataFrame operators and ``pyspark.ml`` stages."""
