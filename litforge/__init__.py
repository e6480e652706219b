"""litforge: document, metadata and annotation processing on Spark DataFrames."""
