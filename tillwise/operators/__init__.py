"""DataFrame operators: profiling, cleaning, segmentation, recommendation, sentiment, roles."""
