"""cairn: versioned-metadata analytics and backup algebra on PySpark DataFrames."""
