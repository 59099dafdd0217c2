"""Column functions on vectors and their signatures."""
