"""Reading with explicit schemas, and writes that are verified before they replace anything."""
