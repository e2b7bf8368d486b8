"""Part of quarryline; see the README for the operator map."""
