"""Code-fact analytics on Spark: DataFrame-to-DataFrame operators over fact tables."""
