"""Credit-risk analytics on Spark: profiling, cleaning, features, models, metrics and scoring."""
