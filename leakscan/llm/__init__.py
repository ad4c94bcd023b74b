"""Training-data operators: token files, URL filters, toxicity, near-duplicate
detection, byte-pair encoding, chat formatting, repeated passages, source
mixing and quality rules. Nothing else in the library imports this package."""
