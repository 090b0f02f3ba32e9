"""tidemark: log analytics and anomaly detection on Spark DataFrames."""

__version__ = "0.1.0"
