"""Part of papyra; see the README."""
