"""rasterloom: image-corpus analytics and palette quantization on Spark DataFrames."""
