"""Column functions over pixels, colours and plan values."""
