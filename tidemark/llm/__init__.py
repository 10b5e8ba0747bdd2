"""Training-data operators: dedup, fingerprints, filtering, archives, mixing, sharding and packing.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and column names,
keeps its own intermediate data in the folder of ``spark.checkpoint.dir`` and never brings
rows to the driver except tables whose size a parameter bounds.
"""
