"""pagelens: full-text search over page-layout OCR documents, expressed as Spark DataFrames."""
