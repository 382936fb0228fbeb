"""Follow-up analytics on Spark: search, linking, judging and reporting as DataFrame plans."""
