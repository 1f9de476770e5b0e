"""Lookup tables of the domain. The engine's expressions take all names, codes and limits from here."""
