"""gridlore: column intelligence over untidy tables, as Spark DataFrames."""
