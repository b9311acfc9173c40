"""Event-stream and multichannel time-series analytics as Spark plans."""
