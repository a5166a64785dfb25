"""respondex: finding, ranking and auditing features that respond to a treatment, on Spark."""
