"""Training-data operators: joins, filters, classifiers, tokenisers and sharding over large text tables."""
