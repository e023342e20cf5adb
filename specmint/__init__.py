"""Entity resolution and material-master governance on PySpark."""
