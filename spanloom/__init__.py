"""spanloom: entity-linked text and co-occurrence graphs as Spark plans."""
