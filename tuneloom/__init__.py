"""Model-selection and run analytics over Spark tables."""
