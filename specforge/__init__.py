"""specforge: Spark table operators from documents to product specifications."""
