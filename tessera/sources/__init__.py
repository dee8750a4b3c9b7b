"""Where tables come from: attached Parquet and the engine's own snapshot store."""
