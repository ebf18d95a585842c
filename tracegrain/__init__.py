"""Code and document lineage analytics on Spark."""
