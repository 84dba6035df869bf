from . import cell, elements, text, units

__all__ = ["cell", "elements", "text", "units"]
