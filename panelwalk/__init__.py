"""Walk-forward analytics over panels (entity by time) as Spark plans."""
