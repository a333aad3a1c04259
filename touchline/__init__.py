"""touchline: league match analytics as PySpark DataFrame transformations."""
