"""Studies: operators put together into the tables that users ask for."""
