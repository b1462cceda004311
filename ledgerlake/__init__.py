"""Evidence-and-rules audit engine built from Spark DataFrame stages."""
