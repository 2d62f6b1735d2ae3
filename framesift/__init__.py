"""Detection post-processing, redaction and media catalog analytics on Spark."""
