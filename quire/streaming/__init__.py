"""The import log as an append stream."""
