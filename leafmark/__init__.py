"""leafmark: document-review analytics as Spark DataFrame operators."""
