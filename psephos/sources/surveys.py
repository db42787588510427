"""Surveys of respondents: from files as they are published to cells of the panel."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.functions import scalars, text
from psephos.operators import aggregates
from psephos.sources import readers

STRATA = ["race", "religion", "gender"]

# Names that the published files give to the columns; of several that stand for one column none is renamed.
COLUMNS = {
    "ANES": {
        "VCF0004": "cycle", "VCF0105a": "bloc__race", "VCF0107": "bloc__race_hisp_flag", "VCF0128": "bloc__religion", "VCF0129": "bloc__religion_denomination",
        "VCF0130": "bloc__religion_attendance", "VCF0104": "bloc__gender", "VCF0704": "vote_indicator", "VCF0702": "turnout_indicator", "VCF0010x": "weight",
        "year": "cycle", "race_7cat": "bloc__race", "hispanic_origin": "bloc__race_hisp_flag", "religion": "bloc__religion", "religion_denomination": "bloc__religion_denomination",
        "church_attendance": "bloc__religion_attendance", "gender": "bloc__gender", "pres_vote_dem": "vote_indicator", "voted": "turnout_indicator",
    },
    "GSS": {
        "year": "cycle", "racecen1": "bloc__race", "hispanic": "bloc__race_hisp_flag", "relig": "bloc__religion", "fund": "bloc__religion_fund_level",
        "evangclx": "bloc__religion_evangelical_flag", "sex": "bloc__gender", "pres16": "vote_indicator", "pres20": "vote_indicator",
        "vote16": "turnout_indicator", "vote20": "turnout_indicator", "wtssnrps": "weight",
    },
    "CES": {
        "year": "cycle", "race_h": "bloc__race", "hispanic": "bloc__race_hisp_flag", "religion": "bloc__religion", "relig_bornagain": "bloc__religion_evangelical_flag",
        "relig_church": "bloc__religion_attendance", "gender": "bloc__gender", "gender4": "bloc__gender_4cat", "voted_pres_party": "vote_indicator",
        "vv_turnout_gvm": "turnout_indicator", "weight_cumulative": "weight",
    },
    "CES_2024": {
        "race": "bloc__race", "hispanic": "bloc__race_hisp_flag", "religpew": "bloc__religion", "pew_bornagain": "bloc__religion_evangelical_flag",
        "pew_churatd": "bloc__religion_attendance", "gender4": "bloc__gender", "CC24_410": "vote_indicator", "TS_g2024": "turnout_indicator", "commonweight": "weight",
        "religion": "bloc__religion", "born_again": "bloc__religion_evangelical_flag", "church_attend": "bloc__religion_attendance",
        "pres_vote_2024": "vote_indicator", "turnout_validated": "turnout_indicator",
    },
    "NPORS": {
        "RACETHN": "bloc__race", "HISP": "bloc__race_hisp_flag", "RELIG": "bloc__religion", "BORN": "bloc__religion_evangelical_flag", "RELIMP": "bloc__religion_importance",
        "PRAY": "bloc__religion_prayer", "GENDER": "bloc__gender", "PARTY": "vote_proxy", "PARTYLN": "vote_proxy_lean", "WEIGHT": "weight",
        "race_ethnicity": "bloc__race", "hispanic": "bloc__race_hisp_flag", "religion": "bloc__religion", "born_again": "bloc__religion_evangelical_flag",
        "religion_importance": "bloc__religion_importance", "prayer_freq": "bloc__religion_prayer", "gender": "bloc__gender", "party": "vote_proxy", "party_lean": "vote_proxy_lean",
    },
    "VOTER_PANEL": {},  # its columns carry the wave, so they stay
}

# Answers of the surveys by bloc.
ANSWERS = {
    "ANES": {
        "white": ["White non-Hispanic (1948-2012)"], "african_american": ["Black non-Hispanic (1948-2012)"], "latino": ["Hispanic (1966-2012)"],
        "asian": ["Asian or Pacific Islander, non-Hispanic (1966-2012)"],
        "other_race": ["Other or multiple races, non-Hispanic (1968-2012)", "American Indian or Alaska Native non-Hispanic (1966-2012)", "Non-white and non-black (1948-1964)"],
        "protestant": ["Protestant"], "catholic": ["Catholic [Roman Catholic]"], "jewish": ["Jewish"], "other_rel": ["Other and none (also includes DK preference)"],
        "women": ["Female"], "men": ["Male"], "other_gender": ["Other (2016)"],
    },
    "GSS": {
        "white": ["white"], "african_american": ["black or african american"], "latino": ["hispanic"], "other_race": ["american indian or alaska native", "some other race"],
        "asian": ["asian indian", "chinese", "filipino", "japanese", "korean", "vietnamese", "other asian"],
        "protestant": ["protestant", "christian", "inter-nondenominational"], "catholic": ["catholic"], "secular": ["none"], "jewish": ["jewish"], "muslim": ["muslim/islam"],
        "other_rel": ["other", "buddhism", "orthodox-christian", "hinduism", "other eastern"], "women": ["Female"], "men": ["Male"],
    },
    "CES": {
        "white": ["White"], "latino": ["Hispanic"], "african_american": ["Black"], "asian": ["Asian"],
        "other_race": ["Mixed", "Other", "Middle Eastern", "Native American", "Native Hawaiian / Pacific Islander"],
        "protestant": ["Protestant", "Mainline Protestant"], "evangelical": ["Evangelical Protestant", "Born Again"], "catholic": ["Roman Catholic"],
        "secular": ["Nothing in particular", "Agnostic", "Atheist"], "jewish": ["Jewish"], "muslim": ["Muslim"],
        "other_rel": ["Something else", "Mormon", "Buddhist", "Hindu", "Orthodox Christian"],
        "women": ["Female"], "men": ["Male"], "other_gender": ["Non-binary", "Other"],
    },
}

#: The strata that an answer may stand for; ``Other`` of a gender question is no race.
STRATUM_OF = {
    "race": ["white", "african_american", "latino", "asian", "other_race"],
    "religion": ["evangelical", "protestant", "catholic", "secular", "jewish", "muslim", "other_rel"],
    "gender": ["women", "men", "other_gender"],
}


@dataclass(frozen=True)
class Survey:
    """How a survey's votes are read: ``votes`` maps answers (numbers or lower-case words) to 1, 0 or nothing; ``elections`` has retrospective columns by cycle."""

    votes: Mapping[str, float] = field(default_factory=dict)
    elections: Mapping[int, tuple[str, Mapping[str, float]]] = field(default_factory=dict)
    other_is_no: bool = False  # any other answer counts as a vote for someone else
    every: int = 1  # cycles that count, by divisor
    weights: tuple[str, ...] = ("weight",)
    born_again: bool = False


# Vote answers that count, by survey.
SURVEYS = {
    "ANES": Survey(votes={"1": 1.0, "2": 0.0, "3": 0.0}),
    "GSS": Survey(elections={2016: ("pres16", {"clinton": 1.0, "trump": 0.0}), 2020: ("pres20", {"biden": 1.0, "trump": 0.0})}),
    "CES": Survey(votes={"democratic": 1.0}, other_is_no=True, every=4, weights=("weight_cumulative", "weight"), born_again=True),
}


def read(spark: SparkSession, path: str, source: str) -> DataFrame:
    """A survey file with canonical column names, its source, and the cycle of one-wave files; Windows text for the voter panel."""
    one_wave = {"NPORS": 2024, "CES_2024": 2024}
    return readers.survey(spark, path, COLUMNS[source], source, one_wave.get(source), "ISO-8859-1" if source == "VOTER_PANEL" else "UTF-8")


def vote(answer: Column, votes: Mapping[str, float], other_is_no: bool) -> Column:
    """1 for a Democratic vote, 0 for another that was reported, else null; answers are compared as whole numbers or in lower case."""
    n = answer.cast("string").try_cast("double")
    word = F.when(n.isNotNull() & (n == F.floor(n)), n.cast("long").cast("string")).otherwise(F.lower(text.strip(answer.cast("string"))))
    out = F.when(F.lit(False), F.lit(0.0))
    for said, value in votes.items():
        out = out.when(word == said, F.lit(value))
    return out.when(word.isNotNull() & (word != ""), F.lit(0.0)) if other_is_no else out


def split_born_again(rows: DataFrame) -> DataFrame:
    """Protestants who call themselves born again become evangelical ones; the rest stay."""
    flag = next((c for c in rows.columns if "evangelical_flag" in c or c == "relig_bornagain"), None)
    if flag is None or "bloc__religion" not in rows.columns:
        return rows
    yes = (text.strip(F.col("bloc__religion")) == "Protestant") & (F.lower(text.strip(F.col(flag).cast("string"))) == "yes")
    return rows.withColumn("bloc__religion", F.when(yes, "Evangelical Protestant").otherwise(F.col("bloc__religion")))


def bloc_of(answer: Column, source: str, stratum: str) -> Column:
    """The bloc of an answer in a stratum, or null."""
    pairs = [(said, bloc) for bloc, answers in ANSWERS[source].items() if bloc in STRATUM_OF[stratum] for said in answers]
    return F.element_at(F.create_map(*[F.lit(x) for p in pairs for x in p]), answer.cast("string"))


def cells(rows: DataFrame, source: str) -> DataFrame:
    """``cycle, bloc, vote_share, se, source`` of respondents: weighted shares with Kish's effective size, for each stratum whose column there is.

    Respondents without a vote or with an answer that stands for no bloc are
    left out of a stratum; a weight that is no number counts 1. Each respondent
    becomes one row for each stratum, and sums combine before the shuffle.
    """
    s = SURVEYS[source]
    if s.born_again:
        rows = split_born_again(rows)
    if s.every > 1:
        rows = rows.where(F.pmod(scalars.number(F.col("cycle").cast("string")), F.lit(float(s.every))) == 0)
    weight = next((scalars.number(F.col(c).cast("string")) for c in s.weights if c in rows.columns), F.lit(1.0))
    blocs = F.array(*[bloc_of(F.col(f"bloc__{x}"), source, x) for x in STRATA if f"bloc__{x}" in rows.columns])
    waves = [(F.lit(c), F.col(column), votes) for c, (column, votes) in s.elections.items() if column in rows.columns]
    if not s.elections:
        waves = [(scalars.number(F.col("cycle").cast("string")).cast("int"), F.col("vote_indicator"), s.votes)]
    said = [F.struct(cycle.cast("int").alias("cycle"), vote(column, votes, s.other_is_no).alias("dem")) for cycle, column, votes in waves]
    if not said:
        return rows.sparkSession.createDataFrame([], "cycle int, bloc string, vote_share double, se double, source string")
    each = rows.select(F.explode(F.array(*said)).alias("v"), blocs.alias("blocs"), weight.alias("w"))
    each = each.select("v.cycle", "v.dem", F.explode("blocs").alias("bloc"), "w").where("bloc IS NOT NULL")
    out = aggregates.kish_share(each, ["cycle", "bloc"], F.col("dem"), F.col("w"))
    return out.select("cycle", "bloc", "vote_share", "se", F.lit(source).alias("source"))


def all_cells(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The cells of several surveys, by source."""
    return reduce(lambda a, b: a.unionByName(b), [cells(df, source) for source, df in tables.items()])
