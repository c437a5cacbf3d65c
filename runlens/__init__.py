"""Model-run analytics on Spark: every operator takes and returns DataFrames or Columns."""
