"""Published results of the reference (its JSON artifacts), used as golden values.

Fixed values that must equal the reference's, in the artifacts' order.
"""

# Confusion matrices [[TN, FP], [FN, TP]] and the metrics computed from them.
CONFUSION = {
    "rf_val": ([[80056, 6846], [432, 667]], {"accuracy": 0.9173, "f1": 0.1549, "precision": 0.0888, "recall": 0.6069}),
    "rf_test": ([[80053, 6850], [455, 643]], {"accuracy": 0.917, "f1": 0.1497, "precision": 0.0858, "recall": 0.5856}),
    "xgb_val": ([[52507, 34395], [115, 984]], {"accuracy": 0.6078, "f1": 0.054, "precision": 0.0278, "recall": 0.8954}),
    "xgb_test": ([[52272, 34631], [121, 977]], {"accuracy": 0.6051, "f1": 0.0532, "precision": 0.0274, "recall": 0.8898}),
}

# Split sizes: 586,672 rows, 7,323 positives; train / val / test.
SPLIT_INPUT = {1: 7323, 0: 579349}
SPLIT_TOTALS = (410670, 88001, 88001)
SPLIT_POSITIVES = (5126, 1099, 1098)
CLASS_BALANCE = {"charted_pct": 1.25, "imbalance_ratio": 79.11}

# Follower buckets (half-decade log10 buckets with n >= 100): approx followers, n, chart rate.
FOLLOWER_BUCKETS = [(2, 1339, 0.0), (6, 2853, 0.0), (18, 5892, 0.0), (56, 8818, 0.0), (178, 12416, 0.0002),
                    (562, 19503, 0.0005), (1778, 31394, 0.0004), (5623, 46544, 0.0011), (17783, 73408, 0.0017),
                    (56234, 83747, 0.0035), (177828, 88068, 0.0064), (562341, 86936, 0.011),
                    (1778279, 67311, 0.0242), (5623413, 30199, 0.0617), (17782794, 9599, 0.1263),
                    (56234133, 2873, 0.2015)]
BREAKPOINT_FOLLOWERS = 56234133
BREAKPOINT_JUMP_FROM_ROUNDED = 0.0752

# Decade means 1920..2020 of four trend features and their published slope / p-value.
DECADES = [1920, 1930, 1940, 1950, 1960, 1970, 1980, 1990, 2000, 2010, 2020]
DECADE_MEANS = {
    "danceability": [0.6283, 0.5458, 0.5093, 0.5029, 0.5056, 0.5225, 0.5609, 0.5722, 0.5902, 0.6089, 0.6616],
    "energy": [0.2491, 0.2888, 0.2871, 0.3188, 0.4276, 0.5035, 0.5471, 0.5719, 0.6485, 0.6586, 0.6329],
    "acousticness": [0.9125, 0.871, 0.9194, 0.8398, 0.674, 0.5109, 0.4141, 0.3671, 0.3132, 0.2873, 0.2739],
    "duration_min": [2.8903, 3.3692, 3.4872, 3.4892, 3.426, 3.8741, 3.8443, 4.0412, 4.0219, 3.8807, 3.3667],
}
TRENDS = {"danceability": (0.000778, 0.132921), "energy": (0.004644, 1e-06), "acousticness": (-0.007774, 2e-06),
          "duration_min": (0.006868, 0.032591)}

# Hit-score tiers sum to all rows.
HIT_TIER_N = [151970, 148364, 121624, 138227, 26487]
TOTAL_ROWS = 586672

# One-hot column names after encoding (first level dropped; time signature 2 absent).
ONE_HOT_KEY = ["key_1", "key_2", "key_3", "key_4", "key_5", "key_6", "key_7", "key_8", "key_9", "key_10", "key_11"]
ONE_HOT_TS = ["ts_1", "ts_3", "ts_4", "ts_5"]
