"""The stateless operators on unbounded input."""
