"""Part of loomline."""
