"""Document-layout and OCR-corpus analytics on Spark DataFrames."""
