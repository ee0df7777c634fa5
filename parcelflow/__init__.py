"""parcelflow: land-use, travel, speed, network and transit analytics on PySpark DataFrames."""
