"""Where vectors and indexes are kept."""
