"""tesserae: Spark-native operators for raster grids, price sheets, session ledgers, rule-based text checks and corpus preparation."""
