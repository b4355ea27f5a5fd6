"""Sources: parsing of physical lines, generators, write-ahead log."""
