"""snapgrid: finding, explaining and treating incident hotspots with PySpark."""
