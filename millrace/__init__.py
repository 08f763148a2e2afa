"""millrace: dataflow jobs over Spark, and training-data operators in the optional subpackage llm."""
