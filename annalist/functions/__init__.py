"""Pure column expressions: no Python runs on rows."""
