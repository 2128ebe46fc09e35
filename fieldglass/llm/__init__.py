"""Training-data operators: deduplication, extraction, classification,
mixing, chat formatting and tokenisation.  Nothing else in the library
imports this subpackage."""
