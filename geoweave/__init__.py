"""geoweave: bulk address standardisation, geocoding and boundary analytics on Spark DataFrames."""
