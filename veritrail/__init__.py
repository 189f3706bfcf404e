"""Evidence and knowledge-graph analytics as declarative Spark plans."""
