"""Index builds and the execution of searches."""
