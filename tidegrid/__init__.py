"""tidegrid: a Spark-first engine for live keyed tables, grid views and change streams."""
