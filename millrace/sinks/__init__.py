"""Writers, for batches and for ``foreachBatch``."""
