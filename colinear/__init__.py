"""Co-linear sequence analytics on Spark: everything is DataFrame in, DataFrame out."""
