"""A versioned-table analytics engine on PySpark."""
