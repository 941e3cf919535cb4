"""silvercask: curation, de-identification and export of hierarchical records on Spark."""
