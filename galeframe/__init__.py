"""galeframe: Spark-native preparation, screening and scoring of site-level time series."""
