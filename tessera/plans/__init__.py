"""Plans of whole conversions."""
