"""Lookup tables of the domain."""

from __future__ import annotations

# Nearest-neighbour extinction coefficients of single-stranded DNA at 260 nm (two-letter steps, letters).
EXTINCTION_STEPS = {
    "AA": 27400, "AC": 21200, "AG": 25000, "AT": 22800, "CA": 21200, "CC": 14600, "CG": 18000, "CT": 15200,
    "GA": 25200, "GC": 17600, "GG": 21600, "GT": 20000, "TA": 23400, "TC": 16200, "TG": 19000, "TT": 16800,
}
EXTINCTION_BASES = {"A": 15400, "C": 7400, "G": 11500, "T": 8700}

# Stiffness of two-letter steps, and step coefficients of loop formation, heat shift and remodelling.
STIFFNESS = {
    "AA": 68, "AC": 44, "AG": 35, "AT": 48, "CA": 6, "CC": 34, "CG": 12, "CT": 35,
    "GA": 60, "GC": 58, "GG": 34, "GT": 44, "TA": 12, "TC": 60, "TG": 6, "TT": 68,
}
LOOPING = {
    "AA": -0.0007, "AC": 0.0112, "AG": -0.0197, "AT": 0.0043, "CA": 0.0144, "CC": -0.0188, "CG": 0.0432, "CT": -0.0242,
    "GA": 0.0347, "GC": -0.0061, "GG": -0.0172, "GT": 0.0099, "TA": -0.0505, "TC": 0.0276, "TG": 0.0169, "TT": 0.0028,
}
