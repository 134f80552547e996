"""chronofold: analytics over append-only event logs, expressed as Spark plans."""
