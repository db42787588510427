"""Dimension tables of fixed size: blocs, shares, aliases, bins, election results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Blocs in their order, by stratum.
BLOCS = {
    "race": ["african_american", "latino", "asian", "white", "other_race"],
    "religion": ["evangelical", "catholic", "protestant", "secular", "jewish", "muslim", "other_rel"],
    "gender": ["women", "men", "other_gender"],
}

# Approximate share of the electorate, by bloc.
ELECTORATE_SHARE = {
    "african_american": 0.12, "latino": 0.11, "asian": 0.05, "white": 0.62, "other_race": 0.10,
    "evangelical": 0.24, "catholic": 0.21, "protestant": 0.13, "secular": 0.26, "jewish": 0.02, "muslim": 0.01, "other_rel": 0.13,
    "women": 0.52, "men": 0.47, "other_gender": 0.01,
}

# Shares of the electorate that samples of posts are drawn by.
SAMPLE_SHARE = {
    "evangelical": 0.26, "protestant": 0.17, "catholic": 0.21, "secular": 0.24, "jewish": 0.02, "muslim": 0.01, "other_rel": 0.09,
    "african_american": 0.11, "latino": 0.11, "asian": 0.03, "white": 0.71, "other_race": 0.04,
    "women": 0.53, "men": 0.47, "other_gender": 0.01,
}

# Third-party share of 1992 by bloc, and where nothing is known.
THIRD_PARTY_1992 = {
    "african_american": 0.07, "latino": 0.14, "asian": 0.15, "white": 0.21, "other_race": 0.189,
    "evangelical": 0.12, "catholic": 0.22, "protestant": 0.19, "secular": 0.22, "jewish": 0.10, "muslim": 0.15, "other_rel": 0.189,
    "women": 0.17, "men": 0.21, "other_gender": 0.189,
}
THIRD_PARTY_DEFAULT = 0.189

# Democratic two-party share and who won the electors, by cycle.
TWO_PARTY_SHARE = {
    1948: 0.524, 1952: 0.446, 1956: 0.422, 1960: 0.501, 1964: 0.613, 1968: 0.496, 1972: 0.382, 1976: 0.511, 1980: 0.447, 1984: 0.406,
    1988: 0.461, 1992: 0.535, 1996: 0.547, 2000: 0.503, 2004: 0.488, 2008: 0.537, 2012: 0.520, 2016: 0.511, 2020: 0.523, 2024: 0.492,
}
ELECTORS_WON = [1948, 1960, 1964, 1976, 1992, 1996, 2008, 2012, 2020]

# Labels of surveys for each bloc, after normalisation.
ALIASES = {
    "african_american": ["black", "black_african_american"],
    "latino": ["hispanic", "hispanic_latino", "latino_hispanic", "latina", "latinx", "chicano", "chicana"],
    "asian": ["asian_american"],
    "white": ["non_hispanic_white", "white_non_hispanic"],
    "other_race": ["other_races", "all_others", "multiracial", "two_or_more_races", "indigenous", "native_american"],
    "evangelical": [
        "white_evangelical", "born_again", "born_again_christian", "evangelical_born_again", "white_evangelical_born_again",
        "evangelical_christian", "white_evangelical_christian", "protestant_evangelical", "white_evangelical_born_again_christian",
        "white_evangelical_or_born_again_christian",
    ],
    "catholic": ["roman_catholic", "catholics"],
    "protestant": ["protestants", "mainline_protestant", "other_protestant", "non_evangelical_protestant", "protestants_non_evangelical"],
    "secular": ["none", "no_religion", "unaffiliated", "religiously_unaffiliated", "agnostic", "atheist", "no_religion_secular", "nones"],
    "jewish": ["jew", "judaism"],
    "muslim": ["islam", "islamic"],
    "other_rel": ["other_religion", "other_religions", "other_faith", "other_faiths", "other_dk", "something_else"],
    "women": ["woman", "female"],
    "men": ["man", "male"],
    "other_gender": ["non_binary", "nonbinary", "transgender"],
}

# Delta bins in order with their midpoints, and the cut points of sentiment scores.
BINS = ["strong_neg", "mod_neg", "mild_neg", "slight_neg", "neutral", "slight_pos", "mild_pos", "mod_pos", "strong_pos"]
MIDPOINTS = [-0.120, -0.070, -0.035, -0.012, 0.000, 0.012, 0.035, 0.070, 0.120]
SENTIMENT_CUTS = [-0.50, -0.30, -0.15, -0.05, 0.05, 0.15, 0.30, 0.50]

# Imputation rules (cycle, bloc, constant, donor cycle, source tag).
IMPUTATION = [
    *[(c, "other_gender", 0.76, None, "imputed_pew_lgbtq") for c in (2004, 2008, 2012, 2020, 2024)],
    (2004, "muslim", None, 2008, "imputed_carry_2008"),
    (1948, "other_race", None, 1952, "imputed_carry_1952"),
]


def blocs(spark: SparkSession) -> DataFrame:
    """``bloc, stratum, ord, share, third_party_1992``."""
    rows, at = [], 0
    for stratum, names in BLOCS.items():
        for b in names:
            rows.append((b, stratum, at, ELECTORATE_SHARE[b], THIRD_PARTY_1992[b]))
            at += 1
    return spark.createDataFrame(rows, "bloc string, stratum string, ord int, share double, third_party_1992 double")


def aliases(spark: SparkSession) -> DataFrame:
    """``label, bloc``: normalised labels, the blocs' own names among them."""
    rows = [(b, b) for b in ALIASES] + [(label, b) for b, labels in ALIASES.items() for label in labels]
    return spark.createDataFrame(rows, "label string, bloc string")


def cycles(spark: SparkSession) -> DataFrame:
    """``cycle, truth, electors``."""
    return spark.createDataFrame([(c, s, c in ELECTORS_WON) for c, s in TWO_PARTY_SHARE.items()], "cycle int, truth double, electors boolean")


def bins(spark: SparkSession) -> DataFrame:
    """``bin, ord, midpoint, lo, hi``: score intervals [lo, hi), open at both ends of the scale."""
    edges = [float("-inf"), *SENTIMENT_CUTS, float("inf")]
    rows = [(b, i, MIDPOINTS[i], edges[i], edges[i + 1]) for i, b in enumerate(BINS)]
    return spark.createDataFrame(rows, "bin string, ord int, midpoint double, lo double, hi double")


def imputation(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(IMPUTATION, "cycle int, bloc string, constant double, donor int, source string")


def small(df: DataFrame) -> DataFrame:
    """Marks a dimension table, whose size is fixed, for broadcast."""
    return F.broadcast(df)
