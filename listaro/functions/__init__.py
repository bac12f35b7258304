"""Part of the listaro listing-analytics engine."""
