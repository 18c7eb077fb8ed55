"""Part of netloom."""
