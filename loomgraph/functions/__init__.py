"""Column -> Column functions. Everything here stays inside Catalyst unless noted."""
