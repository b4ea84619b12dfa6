"""Training-data operators: quality, near duplicates, sharding, mixing, HTML, decontamination,
search, token output, toxicity and language. Nothing else in the library imports this subpackage."""
