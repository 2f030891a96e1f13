"""sparkquarry: repository and corpus analytics expressed as Spark plans."""
