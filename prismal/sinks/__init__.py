"""Writers and renderings."""
