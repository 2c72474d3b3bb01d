"""docmill: document retrieval and evidence analytics expressed as Spark plans."""
