"""landweave: parcel, ownership, permit and location analytics on Spark DataFrames."""
