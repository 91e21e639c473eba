"""heatgrid: urban-heat and planting analytics on long cell tables, as Spark DataFrame operators."""
