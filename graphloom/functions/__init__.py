"""Part of graphloom; see the README for the layout."""
