"""Column functions: statistics flavours and market time."""
