"""skein: retrieval, recommendation and agent-memory analytics on PySpark DataFrames."""
