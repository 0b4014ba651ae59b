"""findrift: catalogue search and log tables as Spark batch and streaming jobs."""
