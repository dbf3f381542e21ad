"""Training-data operators: ten large-corpus operators, usable one by one or as the corpus pipeline."""
