"""Text building and tokens as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 13 proximity flags in output order, each with the phrase that
# describes it in a query text.
FLAG_PHRASES = {
    "Has_Enhanced_Crossing": "Has enhanced crossing",
    "Has_Leading_Pedestrian_Signal": "Has leading pedestrian signal",
    "Has_Turn_Traffic_Calming": "Has turn traffic calming",
    "Has_SIP": "has street improvment project",
    "Has_Exclusive_Pedestrian_Signal": "has exclusive pedestrian signal",
    "Has_Accessible_Pedestrian_Signal": "has accessible pedestrian signal",
    "Is_Protected_Intersection": "is protected intersection",
    "Has_Pedestrian_Ramp": "Has pedestrian ramp",
    "Has_Bus_Lane": "has bus lane",
    "Has_Speed_Hump": "has speed hump",
    "Is_Speed_Reduced": "has speed reduction",
    "Is_Bike_Route": "is bike route",
    "Has_Bad_Pavement": "has bad pavement",
}
CAUSE_PHRASE = "Predicted cause is "
WORD_BREAK = r"[^\p{L}\p{N}]+"


def document_text(title: Column, keywords: Column) -> Column:
    """ "title: keywords"; null if either is missing."""
    return F.concat(title, F.lit(": "), keywords)


def flag_text(cause: Column | None = None, phrases: Mapping[str, str] = FLAG_PHRASES) -> Column:
    """Phrases of the flags that are set, then the cause if it is known."""
    parts = [F.when(F.col(flag) == 1, F.lit(phrase)) for flag, phrase in phrases.items()]
    if cause is not None:
        parts.append(F.concat(F.lit(CAUSE_PHRASE), cause))
    return F.concat_ws(", ", *parts)


def words(text: Column) -> Column:
    """Lower-case words of the whole text; blank entries stand where it starts or
    ends with something else."""
    return F.split(F.lower(text), WORD_BREAK)
