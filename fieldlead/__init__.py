"""fieldlead: who leads a field, for how long, computed with the PySpark DataFrame API."""
