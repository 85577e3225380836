"""saleflow: PySpark jobs for court-ordered sale listings and for text corpora."""
