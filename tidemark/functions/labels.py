"""Labels of result tables and starting values of fits."""

# Labels as published, in the order of their conditions.
INTEGRATION = ("I(0)", "I(1)", "ambiguous/near-I(1)", "ambiguous (neither rejects)")
DIRECTION = ("Sentiment LEADS", "Returns LEAD", "Bidirectional", "Neither (independent)")
DISPOSITION = ("RETAINED", "DROPPED_STAGE2", "DROPPED_STAGE34")

# The default start of a fit (omega by the sample variance) and the ranges of random starts.
DEFAULT_START = {"omega": 0.1, "alpha": 0.05, "gamma": 0.05, "beta": 0.85, "nu": 5.0}
START_RANGES = {"omega": (0.02, 0.30), "alpha": (0.01, 0.15), "gamma": (-0.10, 0.20), "beta": (0.70, 0.93), "nu": (3.0, 12.0)}
START_EXOG_SD = 0.5
START_REPAIR = 0.90
