"""churnlens: customer-churn analytics as Spark DataFrame jobs.

Operators take and return DataFrames; fitted state (one-hot vocabulary,
high-value threshold, population scaler, explainer baselines) lives in small
driver-side model objects whose size is bounded by the feature count, never by
the row count.
"""

__version__ = "0.1.0"
