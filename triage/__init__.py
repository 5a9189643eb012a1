"""triage - failure analysis over source-code corpora as Spark tables."""
