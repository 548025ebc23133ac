"""Part of wavecrate."""
