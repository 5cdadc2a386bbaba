"""Operators for preparing training data: joins, packing, archives, fingerprints, filters, mixing, search, chat."""
