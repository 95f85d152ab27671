"""lodestack: document and log analytics expressed as Spark plans."""
