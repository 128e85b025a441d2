"""Company-report analytics as Spark jobs: facts in, metrics, ratios and screens out."""
