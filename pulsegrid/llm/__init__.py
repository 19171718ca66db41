"""Training-data operators: archives, text scans, deduplication, mixing and tokenisation."""
