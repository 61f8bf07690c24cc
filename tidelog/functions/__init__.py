"""Part of tidelog."""
